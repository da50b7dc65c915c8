"""Text that markup must not take out of an article."""

import time

import pytest

from quillspark.llm import htmltext as h

TREE = h.trained()
LEAD = "The river rose two metres in one night, and the town moved its market to the hill."


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', "class='overflow-hidden'", 'aria-hidden="false"', 'data-hidden="false"', 'title="a hidden place"', 'style="--display:none"', "data-a='x hidden y'"])
def test_shown(attrs):
    assert h.main_blocks(f"<article {attrs}><p>{LEAD}</p></article>", TREE) == [LEAD]


@pytest.mark.parametrize("attrs", ["hidden", 'class="a" hidden=""', "HIDDEN", "aria-hidden=true", "aria-hidden='TRUE'", 'style="color:red; display : none"', "style='visibility:hidden;'", "style=display:none", 'style="display:none !important"'])
def test_hidden(attrs):
    assert h.blocks(f"<div {attrs}><p>{LEAD}</p></div>") == []


@pytest.mark.parametrize("before", ["<svg class=icon/>", "<svg/><svg><text>drawn</text></svg>", "<svg width='1' />", "<math/>", "<svg>", "<math>", "<object>", "<template>", "<noscript>", "<iframe src=x>", "<title>"])
def test_rest_of_page_stays(before):
    page = f"<article>{before}<p>{LEAD}</p></article>"
    assert h.main_blocks(page, TREE) == [LEAD]


def test_math_object_and_select():
    page = f"<article><p>Let <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> be given, so that the sum of all the terms is known.</p><object data=f><p>{LEAD}</p></object><select><option>Choose a town</option></select></article>"
    assert h.main_blocks(page, TREE) == ["Let x = 2 be given, so that the sum of all the terms is known.", LEAD]


@pytest.mark.parametrize("code", ["<script>var t = 'some words of code that are not text';", "<style>p { color: red }"])
def test_code_cut_short_is_no_text(code):
    assert h.main_blocks(f"<article><p>{LEAD}</p>{code}", TREE) == [LEAD]


def test_many_unmatched_end_tags_take_linear_time():
    """180 KB of open elements and end tags without a start are read in well under a second each."""
    page = "<div>" * 20_000 + "some words" + "</section>" * 20_000 + "<p>more</p>" + "</div>" * 20_000
    began = time.process_time()
    assert [b.text for b in h.blocks(page)] == ["some words", "more"]
    assert time.process_time() - began < 5
