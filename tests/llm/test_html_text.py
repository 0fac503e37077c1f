from ledgermesh.llm import html_text as h
from pyspark.sql import functions as F

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad <p> --><div class="ad">Buy</div><header>Site</header>
<article><h1>Head &amp; &copy; &amp</h1><p><b>One  two.<br><p>Three
 four &lt;p&gt; a<i>b</i>c</p><div class="reader-comments"><p>first!</p></div><ul><li>x<li>y</ul><form>q</form>
<table><tr><td>1<td>2<tr><td>3</table></article><footer>&copy; foot</footer></body></html>"""


def test_article_text():
    assert h.extract(PAGE) == "Head & © &\n\nOne two.\n\nThree four <p> abc\n\nx\n\ny\n\n1\n\n2\n\n3"


def test_odd_pages():
    assert h.extract("") == ""
    assert h.extract("just text &eacute;") == "just text é"
    assert h.extract("<p>a<b>c</p>d</b> <script>x") == "ac\n\nd"
    assert h.extract("<body><div>a</div><div>b") == "a\n\nb"
    assert h.extract("<article>" + "<div>" * 5000 + "deep") == "deep"
    assert h.extract("<main><p>m</p></main><article class='comment'>c</article>") == "m"
    assert h.extract("<body><header>site</header><div class='site-header'>top</div><p>t</p><article hidden>x</article></body>") == "t"
    assert h.extract("<article><header><h1>t</h1></header><p>u</p><aside>v</aside><section class='related-posts'>w</section></article>") == "t\n\nu"
    assert h.extract("a < b <p>1 &lt; 2") == "a < b\n\n1 < 2"


def test_template_of_a_host_goes(spark):
    page = lambda i, extra="": f"<body><div><p>Welcome to our site</p></div><div><p>Story {i} {extra}</p></div></body>"
    rows = [(i, f"https://a.example/x{i}", page(i)) for i in range(30)]
    rows += [(100 + i, "https://b.example/", page(7)) for i in range(40)]  # copies of one page are no template
    rows += [(200, None, None), (201, "nonsense", ""), (None, "https://a.example/y", page(99)), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(3)).withColumn("text", F.lit("t"))
    got = {}
    for r in h.main_texts(df).collect():
        got.setdefault(r.page_id, []).append((r.text, r.n_chars))
    assert got[3] == [("Story 3", 7)] and got[0] == [("Story 0", 7)] * 2 and got[None] == [("Story 99", 8)]
    assert got[110] == [("Welcome to our site\n\nStory 7", 28)]
    assert got[200] == got[201] == [("", 0)]
    assert h.main_texts(df.limit(0)).collect() == []


def test_quotes_that_open_nothing():
    assert h.extract("<p><a title=it's>Hello</a> world</p>") == "Hello world"
    assert h.extract("<p class=x' \"y>a</p><p title='>'>b</p>") == "a\n\nb"
    assert h.extract("<article><p style='overflow:hidden' data-hidden='1' title='class=ad'>kept</p></article>") == "kept"


def test_names_inside_an_article_count_as_a_whole():
    inner = "".join(f"<div class='{c}'>{c}</div>" for c in ("share-price", "search-results", "notice-period", "comments", "ad"))
    assert h.extract(f"<article>{inner}</article>") == "share-price\n\nsearch-results\n\nnotice-period"


def shop(i, words):
    """A page without telling names: two menus, an advert, a heading, the story, a repeated box, a footer."""
    r = words
    menu = "".join(f"<li><a>{next(r)}</a></li>" for _ in range(3 + i % 4))
    story = "".join(f"<p>{' '.join(next(r) for _ in range(30 + i % 7))}</p>" for _ in range(3 + i % 5))
    box = "<div><p>Follow our letters</p></div>"
    parts = [f"<div id='a'><ul>{menu}</ul></div>", f"<section><p>{next(r)} {next(r)}</p></section>", f"<h1>{next(r)} title {i}</h1>", f"<div id='z'>{story}{box if i % 3 else ''}<p>end {i}</p></div>", f"<div class='q'>{next(r)} (c)</div>"]
    return "<html><head><title>t</title></head><body>" + "".join(parts) + "</body></html>", story


def brute_templates(pages):
    """By the rule, from strings: (signatures with text) and (path and shape signatures) on half of the pages, ten at least."""
    import collections

    counts, own = collections.Counter(), []
    for page in pages:
        root = h.parse(page)
        size = lambda e: sum(len(" ".join(c.split())) if isinstance(c, str) else size(c) for c in e.children) if e.tag not in h._RAW else 0
        full = lambda e: (e.tag, tuple(" ".join(c.split()) if isinstance(c, str) else full(c) for c in e.children if not isinstance(c, str) or c.strip()))

        def plain(e):
            kinds = ["#" if isinstance(c, str) else plain(c) for c in e.children if (c.strip() if isinstance(c, str) else size(c))]
            return (e.tag, e.marks, tuple(k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k))

        total, core = size(root), root
        while True:
            heavy = [c for c in core.children if not isinstance(c, str) and 2 * size(c) > total and any(not isinstance(d, str) and d.tag in h._BLOCK for d in c.children)]
            if not heavy:
                break
            core = heavy[0]
        found, around = {}, set()

        def hold(e):
            return e is core or any([hold(c) for c in e.children if not isinstance(c, str)]) and not around.add(id(e))

        hold(root)

        def walk(e, path, inside):
            path = (*path, (e.tag, e.marks))
            inside = inside or e is core
            if size(e) and e.tag in h._BLOCK and e.tag not in ("html", "body", "head") and (inside or id(e) not in around):
                found[("text", full(e))] = e
                if not inside and e.tag not in h._HEADINGS:
                    found[("shape", path, plain(e))] = e
            for c in e.children:
                if not isinstance(c, str):
                    walk(c, path, inside)

        walk(root, (), False)
        own.append(found)
        counts.update(found.keys())
    often = {k for k, n in counts.items() if n >= max(h.MIN_PAGES, len(pages) * h.SHARE)}
    return [{id(e): e for k, e in found.items() if k in often} for found in own], [h.parse(p) for p in pages], own


def test_templates_equal_brute_force(spark):
    import itertools
    import random

    r = random.Random(2)
    words = ("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9))) for _ in itertools.count())
    pages = [shop(i, words)[0] for i in range(40)]
    deleted, _, own = brute_templates(pages)
    rows = [(i, f"https://s.example/{i}", p) for i, p in enumerate(pages)]
    got = {x.page_id: x.text for x in h.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"), roles=False).collect()}
    for i, page in enumerate(pages):
        gone = set(deleted[i])
        assert gone
        root = next(iter(own[i].values()), None)
        assert root is not None
        text = got[i]
        assert f"title {i}" in text and text.endswith(f"end {i}") and "Follow our letters" not in text and "(c)" not in text
        # what is left of the page is the heading and the paragraphs of the story, in order
        story = __import__("re").findall(r"<p>([^<]*)</p>", page.split("<div id='z'>")[1].split("<div class='q'>")[0])
        assert text.split("\n\n")[1:] == [x for x in story if x != "Follow our letters"]
        for e in deleted[i].values():
            for t in [c for c in e.children if isinstance(c, str)]:
                assert t.strip() not in text.split("\n\n")


def test_hosts_of_the_test_pages_have_templates(spark):
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("needs the test tables")
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    own = pages.withColumn("host", h.host_of(F.col("url")))
    large = own.groupBy("host").count().where("count >= 15").select("host")
    found = h.templates(own.select("host", "html"))
    assert large.join(found, "host", "left_anti").count() == 0
    both = h.main_texts(pages).select("page_id", "url", "text").join(h.main_texts(pages, roles=False).select("page_id", F.col("text").alias("plain")), "page_id").withColumn("host", h.host_of(F.col("url")))
    assert both.join(large, "host").where("text <> plain").count() == 0


def test_page_of_many_blocks(spark):
    page = "<article>" + "".join(f"<p>block {i}</p>" for i in range(60_000)) + "</article>"
    got = h.main_texts(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert got.text == "\n\n".join(f"block {i}" for i in range(60_000))
