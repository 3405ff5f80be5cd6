from urllib.parse import urljoin

from pyspark.sql import functions as F

from millrace.operators import images, parse
from millrace.sources import web

IMAGE = "struct<src:string,srcset:string,data_src:string,link:string,alt:string,title:string,caption:string,width:string,height:string,hints:string,decorative:boolean>"


def test_reasons(spark):
    cases = [
        ({"url": "a/logo.png"}, "looks like decoration (logo)"),
        ({"url": "a/logos.png", "alt": "the long story of it"}, ""),
        ({"url": "a/logo.png", "caption": "Our mark"}, ""),
        ({"url": "x.ico", "alt": "a"}, "icon file"),
        ({"url": "p.png", "alt": "", "width": 9}, "empty alt text"),
        ({"url": "p.png", "alt": "p", "width": 9}, "smaller than 32px"),
        ({"url": "https://img.shields.io/x", "alt": "b"}, "badge or tracker"),
        ({"url": "data:image/png;base64,AA", "alt": "b"}, "tiny inline image"),
        ({"url": "data:image/png;base64," + "A" * 2048, "alt": "b"}, ""),
        ({"url": "i.svg#menu", "alt": "b"}, "svg sprite"),
        ({"url": "p.png", "alt": "photo"}, ""),
        ({"url": "p", "decorative": True}, "marked decorative"),
        ({"url": None}, "no text"),
        ({"url": None, "title": "t"}, ""),
        ({"url": "p.png", "alt": "x", "hints": "hero promo"}, "skip pattern 'promo'"),
    ]
    rows = [(n, c.get("url"), ("", "", "", "", c.get("alt"), c.get("title", ""), c.get("caption"), str(c.get("width", "")), "", c.get("hints", ""), bool(c.get("decorative")))) for n, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"n int, url string, image {IMAGE}")
    got = {r.n: r.reason for r in df.select("n", images.image_reason(F.col("url"), F.col("image"), patterns=("promo",)).alias("reason")).collect()}
    assert got == {n: want or None for n, (_, want) in enumerate(cases)}


def test_largest_candidates(spark):
    sets = {"": None, "a.png": "a.png", "a 1x, b 2x, c 2x": "b", "a.png 100w,b.png 20w": "a.png", " , a zz, b": "a", "a 0.5x, b": "b", "a -3x": None}
    df = spark.createDataFrame([(k,) for k in sets], "s string")
    assert {r.s: r.u for r in df.select("s", images.largest_candidate(F.col("s")).alias("u")).collect()} == sets


def test_addresses(spark):
    bases = ["http://h.org/a/b/c?q=1#f", "https://h.org", "https://h.org:8080/x/"]
    refs = ["http://o/p.png", "//o/p.png", "/p.png?x#y", "p.png", "./p.png", "../p.png", "../../p/./q/../r.png", "?n=2", "#top", "data:image/png;base64,A", "mailto:x@y", "d/"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for row in df.select("b", "r", web.resolved_url(F.col("b"), F.col("r")).alias("u")).collect():
        if "/../" not in row.u:  # what has nothing to go up from stays
            assert row.u == urljoin(row.b, row.r), row
    odd = spark.createDataFrame([("", "a b.png"), (None, "x.png"), ("no address", "x.png"), ("http://h/", " a b.png ")], "b string, r string")
    assert [r.u for r in odd.select(web.resolved_url(F.col("b"), F.col("r")).alias("u")).collect()] == ["a%20b.png", "x.png", "x.png", "http://h/a%20b.png"]


def test_page_with_many_images(spark):
    many = "".join(f'<img src="i{k % 25}.png" alt="one picture number {k}">' for k in range(30))
    html = f"<body class='Big'><main id=m><p>text</p><figure class='hero promo'><a href='full.JPG?x'><img data-src='late.png' alt='shown as is here'></a><figcaption>Cap <b>tion</b></figcaption></figure>{many}<img><img alt=''></main></body>"
    pages = spark.createDataFrame([(1, "http://h/d/p", html), (2, None, "<p>none</p>"), (3, "", None)], "page int, url string, html string")
    parsed = parse.parse_pages(pages, "page", "html", "url").join(pages.select("page", "url"), "page")
    rows = images.page_blocks(parsed, "page", "url").where("page = 1").orderBy("pos").collect()
    first = next(r for r in rows if r.kind == "image")
    assert (first.url, first.text) == ("http://h/d/full.JPG?x", "[Image: shown as is here — Cap tion] (http://h/d/full.JPG?x)")
    reasons = [r.reason for r in rows if r.kind == "image"]
    assert reasons[:20] == [None] * 20 and reasons[20:26] == ["per-page limit"] * 6 and reasons[26:31] == ["duplicate on page"] * 5 and reasons[31:] == ["no text", "no text"]
    assert images.page_blocks(parsed, "page", "url", patterns=("promo",)).where("reason = \"skip pattern 'promo'\"").count() == 1
    assert [r.text for r in images.page_blocks(parsed, "page", "url").where("page = 2").collect()] == ["none"]
