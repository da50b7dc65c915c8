import re

from pyspark.sql import functions as F

from quillspark.llm import htmltext as h

TREE = h.trained()


def test_blocks():
    bs = h.blocks("<p>a &amp; b<br>c</p><script>var t='</p>';</script><!-- <p>x</p> --><div>d <a href='>'>e f</a></div><p>un<b>clos</b>ed <p>next")
    assert [(b.text, b.words, b.linked) for b in bs] == [("a & b c", 4, 0), ("d e f", 3, 2), ("unclosed", 1, 0), ("next", 1, 0)]


def test_corners(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "v", "<"), (4, "w", "plain & text " + "word " * 9000), (4, "w", "<article><p>" + "<b>" * 3000)], "page_id bigint, url string, html string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in h.extract(pages.withColumn("text", F.lit("x"))).collect() if r.n_chars != 0 or r.page_id != 4}
    assert got[1, "u"] == ("", 0) and got[2, None] == ("", 0)
    assert got[4, "w"][1] == len(got[4, "w"][0]) > 45_000
    assert h.extract(pages).count() == 5 and h.extract(pages.limit(0)).count() == 0


def test_unseen_layouts():
    page = "<header class='site-header'><p>My site</p></header><div role=navigation><a href=a>A</a></div><main><h1>Title</h1><p>Short.</p><p>A longer paragraph of the article with some words in it.</p><div class='comment-list'><p>I disagree with all of this, said a reader of the page.</p></div><form><p>Mail</p></form></main><div id=cookieNotice><p>We use cookies on this site for many good reasons.</p></div><aside><p>Other stories</p></aside>"
    assert h.main_blocks(page, TREE) == ["Title", "Short.", "A longer paragraph of the article with some words in it."]


def test_all_pages_against_their_articles(spark):
    """Brute force: in these pages the article element is the main text."""
    import html as std

    from .conftest import SF

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in h.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(std.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:h\d|p)\b[^>]*>", inner)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)
