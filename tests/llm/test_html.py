import html
import re

from pyspark.sql import functions as F

from corpuslens.llm import html_extract as x

PAGE = """<!DOCTYPE html><html lang=en><head><title>T&amp;t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a><li><a href="/b">More</a></ul></nav><div class="ad">Buy this thing now.</div>
<article><h1>Big   title</h1><p><b>Lead sentence here, it is long enough.<br><p>First &eacute;&#33; paragraph,
with a line break and an <a href=x>inline link</a>. It goes on for a while, and on.</p><p>Second paragraph of the text. It also says something.</p><div class="ad">Sponsored words.</div></article>
<div class="comments"><h3>Comments</h3><div class="comment"><b>Bob</b><p>I disagree with all of it.</p></div></div>
<footer>&copy; site &middot; contact</footer></body></html>"""


def test_parse_closes_what_html_leaves_open():
    page = x.parse("<ul><li>a<li>b</ul><p>c<p>d<div>e</p>f</div></nope>g")
    assert [(page.names[n], t) for n, _, t in page.texts] == [("li", "a"), ("li", "b"), ("p", "c"), ("p", "d"), ("div", "e"), ("div", "f"), ("#page", "g")]
    assert x.parse("").texts == [] and [t for *_, t in x.parse("a < b & <unfinished").texts] == ["a < b & <unfinished"]


def test_extracts_the_article():
    (text,) = x.extract([PAGE], x.trained())
    assert text == "Big title\n\nLead sentence here, it is long enough.\n\nFirst é! paragraph, with a line break and an inline link. It goes on for a while, and on.\n\nSecond paragraph of the text. It also says something."


def test_kept_elements_have_kept_parents():
    trees = x.trained()
    for seed in range(5000, 5020):
        page = x.parse(x._ROLE.sub("", x.synthetic_page(seed)))
        kept = x.keep(page, trees.odds(x.features([page])).tolist())
        assert all(kept[p] for i, p in enumerate(page.parent) if i and kept[i])


def test_held_out_pages():
    trees, right, total = x.trained(), 0, 0
    for seed in range(9000, 9060):
        source = x.synthetic_page(seed)
        roles = [1] + [(-1 if (m := x._ROLE.search(t[4])) is None else int(m[1] == "k")) for t in x._TOKEN.finditer(source) if t[3] and not t[2]]
        page = x.parse(x._ROLE.sub("", source))
        kept = x.keep(page, trees.odds(x.features([page])).tolist())
        right += sum(k == (r == 1) for k, r in zip(kept, roles) if r >= 0)
        total += sum(r >= 0 for r in roles)
    assert right / total > 0.98


def test_pages_of_the_tables(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in x.extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "plain text only"), (4, "u", PAGE), (4, "u", PAGE), (None, "u", "<p>" * 2000 + "deep")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = x.extract_pages(df)
    assert got.count() == 6 and {r.page_id: r.text for r in got.collect()}[1] == "" and x.extract_pages(df.limit(0)).count() == 0


def test_text_outside_all_elements_is_kept(spark):
    pages = {"plain text only": "plain text only", "a < b & <unfinished": "a < b & <unfinished", "Intro <b>x</b> rest of the article": "rest of the article", PAGE + " text after the end": "text after the end"}
    df = spark.createDataFrame([(i, "u", source) for i, source in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in x.extract_pages(df).collect()}
    assert got[0] == "plain text only" and got[1] == "a < b & <unfinished"
    assert got[2].startswith("Intro ") and got[2].endswith("rest of the article")
    assert got[3].endswith("text after the end") and "First" in got[3] and "Sponsored" not in got[3]
