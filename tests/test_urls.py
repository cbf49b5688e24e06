from urllib.parse import quote, urljoin, urlparse

from pyspark.sql import functions as F

from pagesift.functions import urls as U
from pagesift.operators import links as L

BASE = "https://www.a.example.com:8080/"
HREFS = [
    "foo.html", "/x/y", "?q=1", "#f", "//host/x", "", None, "a/../b", "../x", "./", "/a/./b/..", "mailto:x@y.de", "http://o.de/x?y#z",
    "HTTPS://B.de/..//x?", "x?", "x#", "foo;p", ";x", "a//b", "/a//b", " /lead", "tel:123", "https:rel", "javascript:void(0)",
    "../../a/./b/../c/.", "https://u@h.de:1/p", "..", "/..", "a/b/../..", "x y?z z", "/a'b", "/ä/ü?ß=%C3*~+",
]


def test_resolution_hosts_and_quoting_agree_with_the_standard_library(spark):
    df = spark.createDataFrame([(h,) for h in HREFS], "l string")
    rows = df.select("l", U.resolve(F.col("l"), F.lit(BASE)).alias("r"), U.host(F.col("l")).alias("h"), U.quote(F.col("l")).alias("q")).collect()
    for x in rows:
        assert x.r == urljoin(BASE, x.l), x.l
        if x.l is not None:
            assert x.h == urlparse(x.l.strip()).hostname, x.l
            assert x.q == quote(x.l, safe=":/?=#&"), x.l


def test_link_classes(spark):
    cases = [
        ("https://a.example.com/x", "internal"), ("http://www.a.example.com/", "internal"), ("https://b.example.com/", "subdomain"),
        ("https://a.x.example.com/", "internal"), ("https://a.other.com/", "external"), ("mailto:a@example.com", None),
        ("https://localhost/", "external"),
    ]
    df = spark.createDataFrame(cases, "l string, expected string")
    base = U.labels(U.host(F.lit("https://a.example.com/page")))
    for x in df.select("*", U.link_class(F.col("l"), base).alias("c")).collect():
        assert x.c == x.expected, x.l
    uk = U.labels(U.host(F.lit("https://shop.co.uk/")))
    got = spark.range(1).select(
        U.link_class(F.lit("https://other.co.uk/"), uk).alias("c"),
        U.link_class(F.lit("https://localhost/x"), U.labels(U.host(F.lit("http://localhost/")))).alias("one")).first()
    assert (got.c, got.one) == ("subdomain", "internal")  # the last two labels are the domain, also under co.uk


def test_page_links_are_distinct_and_keep_missing_href_as_root(spark):
    html = """<A HREF='x.html'>1</a><a class="c" href="x.html">2</a><a name=n>3</a><!-- <a href="/no">--><script>'<a href="/js">'</script>
    <a href=/plain>4</a><a href="mailto:a@b.c">5</a><a href="/q?a=1&amp;b=2">6</a><a
    href="https://www.example.com/w">7</a>"""
    df = spark.createDataFrame([("https://example.com/d/p", html)], "url string, html string")
    got = {(r.link, r.link_class) for r in L.page_links(df).collect()}
    root = "https://example.com/"
    assert got == {(root + p, "internal") for p in ("x.html", "", "plain", "q?a=1&b=2")} | {("https://www.example.com/w", "internal")}
    counts = L.link_class_counts(df).first()
    assert (counts.internal, counts.subdomain, counts.external) == (5, 0, 0)


def test_scope(spark):
    df = spark.createDataFrame([("internal",), ("external",), ("subdomain",)], "c string")
    def kept(single, subs):
        return {r.c for r in df.filter(L.in_scope(F.col("c"), single, subs)).collect()}
    assert kept(True, False) == {"internal"}
    assert kept(False, False) == {"internal", "external"}
    assert kept(True, True) == {"internal", "subdomain"}


def test_refresh_targets(spark):
    df = spark.createDataFrame([("0; url=/x",), ("5;https://o.de/",), ("3",), ("0; URL=/x",)], "c string")
    rows = df.select(
        U.refresh_target(F.col("c"), F.lit("https://b.de")).alias("glued"),
        U.refresh_target(F.col("c"), F.lit(""), F.lit("https://p.de/q/r")).alias("target")).collect()
    assert [r.glued for r in rows] == ["https://b.de/x", "https://b.dehttps://o.de/", None, "https://b.deURL=/x"]
    assert [r.target for r in rows][:3] == ["https://p.de/x", "https://o.de/", None]
