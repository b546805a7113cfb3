import html
import re

from sluice.llm import htmltext
from sluice.llm.queries import op10_html


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string")
    return {x.page_id: (x.text, x.n_chars) for x in htmltext.extract(df).collect()}


def test_article_of_marked_pages(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></ul></nav>'
        '<div class="ad">buy</div><article><h1>Head {0}</h1><p><b>Body {0} &amp; more<br><p>second\n  <i>pa</i>ra<div class="cookie-notice">ok?</div><form>name<input></form></p>'
        '<script>var t="</p>";</script><aside>side</aside></article><section id="comments"><p>first!</p></section><footer>&copy; h</footer></body></html>'
    )
    got = run(spark, [("http://a.example.com/1", page.format(1)), ("http://a.example.com/2", page.format(2)), (None, page.format(3))])
    assert got == {k: (f"Head {k + 1} Body {k + 1} & more second para", 32) for k in range(3)}


def test_joined_templates_give_the_same_texts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    one = sorted(map(tuple, htmltext.extract(pages).collect()))
    assert sorted(map(tuple, htmltext.extract(pages, broadcast_bytes=0).collect())) == one


def test_article_without_marks_is_the_container_that_varies(spark):
    page = '<html><body><div class="w"><div class="m7">Home About <p>a long constant line of words that never changes here at all</p></div><div id="story"><div class="t">Title {0}</div><p>{1}</p></div><div class="comments">nice {0}</div></div></body></html>'
    rows = [(f"https://b.example.com/{i}?q", page.format(i, f"w{i} x y z " * (5 + i))) for i in range(6)]
    got = run(spark, rows)
    for i in range(6):
        assert got[i][0] == " ".join(f"Title {i} {f'w{i} x y z ' * (5 + i)}".split())


def test_odd_pages(spark):
    rows = [("u", None), (None, ""), ("http://[bad", "plain text"), ("http://c.d", "<p>a<p>b &am"), ("http://c.d", "<article>cut off <p>in the mid"), ("http://e.f", "<article><p>x</article></div></div> tail <"), ("http://e.f", "<div>" * 5000 + "deep"), ("http://g.h", '<article class="' + "a" * 10000), ("http://g.h", "<" * 20000)]
    got = run(spark, rows)
    assert [got[i][0] for i in range(6)] == ["", "", "plain text", "a b &am", "cut off in the mid", "x"]
    assert got[6][0] == "deep"
    assert all(n == len(t) for t, n in got.values())
    assert run(spark, [("u", None)][:0] or [("u", "")]) == {0: ("", 0)}


def test_classes_equal_occurrence_vectors(spark):
    pages = ["<body><div class=a><div class=b>x</div></div></body>", "<body><div class=a><div class=b>y</div><div class=c>z</div></div></body>", "<body><div class=a>q</div></body>"]
    df = spark.createDataFrame([(i, "http://h.i/", p) for i, p in enumerate(pages)], "key long, url string, html string")
    import json

    rows = json.loads(htmltext.templates(df, 0.3).first().template)
    by = {}
    for t in rows:
        by.setdefault(t["cls"], set()).add(t["token"])
    assert sorted(map(sorted, by.values())) == sorted([sorted(s + p for s in "+-" for p in ps) for ps in (["/body", "/body/div.a"], ["/body/div.a/div.b"], ["/body/div.a/div.c"])])


def test_query_on_the_small_table(spark):
    at = "/root/testdata/sf0.01"
    got = op10_html(spark, at)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    pages = {x.page_id: x.html for x in spark.read.parquet(f"{at}/pages.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(pages)
    for x in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[x.page_id], re.S).group(1)
        assert x.text == " ".join(html.unescape(re.sub(r"</?(b)>", "", re.sub(r"</?(p|br|h1)>", " ", inner))).split())


def test_text_after_deep_nests_stays():
    page = "<body><div id=page><article><p>one</p>" + "<div>" * 100 + "in" + '<div class="menu">no</div>' + "</div>" * 100 + "<p>two</p></article></div><div>foot</div></body>"
    assert htmltext.main_text(page, None) == "one in two"


def test_an_article_without_marks_is_found_at_any_depth(spark):
    page = "<body>" + "<div>" * 70 + '<div class="w"><div class="m"><div class="n">Home About, a long constant line of words that never changes here at all</div></div><div id="story"><p>{1}</p></div></div>' + "</div>" * 70 + "<div>end</div></body>"
    got = run(spark, [(f"https://b.example.com/{i}", page.format(i, f"w{i} x y z " * (5 + i))) for i in range(6)])
    for i in range(6):
        assert got[i][0] == " ".join((f"w{i} x y z " * (5 + i)).split())


def test_text_beside_odd_tags_stays(spark):
    inner = {
        "long": ('<div data-x="' + "a" * 5000 + '">in</div>', "in"),
        "less": ('<div title="a<b>c">in</div>', "in"),
        "json": ("<div data-x='{\"class\": \"<p class=ad>\"}'>in</div>", "in"),
        "cut": ("<div class=x <p>in</p></div>", "in"),
        "quote": ('<div title="a"b">in</div> <a href="x">out</a>', "in out"),
        "svg": ('<svg width="1"/>in', "in"),
        "button": ("<button>in", "in"),
        "canvas": ("<canvas>in<canvas>no</canvas>", "in"),
        "nested": ("<object>no<object>no</object>no</object>in", "in"),
        "title": ("<select>in<div><select><option>no</select></div>", "in"),
        "script": ("<script>if (a<b) '<div>'</script >in<style>x</style>", "in"),
    }
    rows = [(f"http://{i}.x/", f"<body><div id=page><article><p>one</p>{h}<p>two</p></article></div><div>foot</div></body>") for i, (h, _) in enumerate(inner.values())]
    got = run(spark, rows)
    for i, (k, (_, t)) in enumerate(inner.items()):
        assert got[i][0] == f"one {t} two", k


def test_deep_nests_take_linear_time():
    import time

    start = time.time()
    page = "<div>x" * 50_000 + "</td>" * 50_000 + "</div>" * 50_000 + "<button>" * 20_000 + "<title>" * 20_000 + '<p a="' * 20_000
    assert htmltext.main_text(page, None).startswith("x x")
    htmltext._profile(page)
    assert time.time() - start < 20


def neutral(page):
    """A page without the names that tell what its parts are: all containers are divs, nothing has a class or id."""
    return re.sub(r"<(/?)(?:nav|article|footer|aside|header|section|main)\b[^>]*>", r"<\1div>", re.sub(r"<div[^>]*>", "<div>", page))


def test_structure_alone_gives_the_text_of_marked_pages(spark):
    at = "/root/testdata/sf0.01/pages.parquet"
    pages = spark.read.parquet(at)
    want = {x.page_id: x.text for x in htmltext.extract(pages).collect()}
    rows = [(x.page_id, x.url, neutral(x.html)) for x in pages.collect()]
    bare = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in htmltext.extract(bare).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)
    alone = sum(htmltext.main_text(h, None) == want[k] for k, _, h in rows)
    assert alone < 0.1 * len(want)


def test_classes_decide_which_container_is_the_article(spark):
    """A container that only some pages have holds most of the text, but the most frequent class decides."""
    part = "<div id=extra><p>{1}</p></div>"
    page = "<body><div class=a>{0}</div><div class=w><p>start {0}</p>%s<p>end {0}</p></div></body>"
    rows = [(f"http://k.l/{i}", (page % (part if i % 4 else "")).format(i, f"w{i} x y z " * 30)) for i in range(12)]
    got = run(spark, rows)
    for i in range(12):
        assert got[i][0] == " ".join(f"start {i} {f'w{i} x y z ' * 30 if i % 4 else ''} end {i}".split())
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "key long, url string, html string")
    import json

    known = json.loads(htmltext.templates(df).first().template)
    right = htmltext.slots(json.dumps(known))
    assert right[0].endswith("div.w") and htmltext.slots(json.dumps([t | {"cls": "same"} for t in known]))[0] != right[0]


def test_constant_slots_are_template(spark):
    page = "<body><div class=x><div class=one>always the same words here</div><p>{0}</p><div class=two>{0} too</div></div></body>"
    rows = [(f"http://k.l/{i}", page.format(f"text {i} " * 9)) for i in range(4)]
    got = run(spark, rows)
    assert [got[i][0] for i in range(4)] == [" ".join(f"{f'text {i} ' * 9} {f'text {i} ' * 9} too".split()) for i in range(4)]
    # Copies of one page beside another do not make a slot constant.
    got = run(spark, [("http://m.n/1", page.format("same page"))] * 5 + [("http://m.n/2", page.format("other page"))])
    assert got[0][0] == "always the same words here same page same page too"
