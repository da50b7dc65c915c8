"""The tree decides by words and neighbours; names on wrappers decide nothing."""

import pytest

from quillspark.llm import htmltext as h

TREE = h.trained()
LEAD = "The river rose two metres in one night, and the town moved its market to the hill."
MORE = "Nobody was hurt, but the bridge is closed until the water has gone down again by next week at least."
PLEA = "Get the best of our stories in your inbox every morning, and never miss what happens in your town."
NOTE = "I live by the river and can say that it was worse ten years ago, when nobody wrote about it."


def used(node):
    return set() if node.feature < 0 else {h.FEATURES[node.feature]} | used(node.below) | used(node.above)


def test_words_and_neighbours_decide():
    x, y = h.labelled_table()
    assert len(h._MARK.findall(h.LABELLED)) < 240 and used(TREE) >= {"words", "density", "article", "boiler"}
    assert used(TREE) & {"words_before", "words_after"} and used(TREE) & {"density_before", "density_after"}
    assert sum(h.decide(TREE, row) == bool(mark) for row, mark in zip(x, y)) >= 0.97 * len(y)


@pytest.mark.parametrize("wrap", ["<body class='has-sidebar'><article>%s</article></body>", "<article class='post tags-on'>%s</article>", "<div id=page-with-menu><main class='content no-ads'>%s</main></div>", "<body class='has-sidebar cookie-ok'>%s</body>", "<article><p><img alt=Bob's></p>%s</article>", "<article><p title=it's>%s</article>"])
def test_names_on_wrappers(wrap):
    got = h.main_blocks(wrap % f"<h1>High water</h1><p>{LEAD}</p><p>{MORE}</p>", TREE)
    assert got == ["High water", LEAD, MORE]


@pytest.mark.parametrize("after", [f"<section><h3>2 readers</h3><p>{NOTE}</p><p>{NOTE}</p></section>", f"<p>{PLEA}</p>", f"<div><p>{NOTE}</p></div>", f"<div class=comments><article><p>{NOTE}</p></article></div>"])
def test_what_follows_the_article(after):
    assert h.main_blocks(f"<main><article><h1>High water</h1><p>{LEAD}</p><p>{MORE}</p></article>{after}</main>", TREE) == ["High water", LEAD, MORE]


def test_the_same_block_by_its_neighbours():
    link = "<p><a href=x>See the map of the river</a></p>"
    inside = h.main_blocks(f"<article><p>{LEAD}</p>{link}<p>{MORE}</p></article>", TREE)
    among = h.main_blocks(f"<article><p>{LEAD}</p><p>{MORE}</p>{link}{link}{link}</article>", TREE)
    assert inside == [LEAD, "See the map of the river", MORE] and among == [LEAD, MORE]


def test_pages_without_any_hint():
    page = f"<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><h1>High water</h1><p>{LEAD}</p><p>{MORE}</p><ul><li><a href=3>Imprint</a></li><li><a href=4>Contact us</a></li></ul><p>Since 1990</p>"
    assert h.main_blocks(page, TREE) == ["High water", LEAD, MORE]
    assert h.main_blocks(f"<p>{LEAD}</p>", TREE) == [LEAD]


def test_deep_and_broken_markup():
    deep = "<div>" * 4000 + f"<p>{LEAD}</p><p>{MORE}" + "</div>" * 4000
    assert h.main_blocks(f"<article>{deep}", TREE) == [LEAD, MORE]
    assert h.main_blocks(f"<article><p>{LEAD}</p><p>{MORE}</p></article><p class=\"x", TREE) == [LEAD, MORE]


def test_text_of_an_article_stays_whatever_its_neighbours():
    """Blocks of an article that hold no link are content: short ones, first and last, before and after links."""
    tail = "<p><a href=1>Share this now</a></p>" * 3
    for short in ("Yes.", "It was late in the day when they came.", LEAD):
        for before in ("", f"<p>{LEAD} {MORE} {LEAD}</p>", f"<p>{LEAD} <a href=2>and more of it</a></p>", "<h2>Why</h2>"):
            for after in ("", tail, f"<p>{LEAD} {MORE} {LEAD}</p>", "<footer><p>Imprint</p></footer>"):
                assert short in h.main_blocks(f"<article>{before}<p>{short}</p>{after}</article><p>{NOTE}</p>", TREE), (short, before, after)
