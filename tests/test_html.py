import random

import pytest
from pyspark.sql import functions as F

from pagesift.functions import html as H, urls as U
from pagesift.operators import content as C, directives as D


def content(spark, html, extractor):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    return C.with_content(df, extractor).first().content


LONG = " ".join(f"word{i}" for i in range(60))


def test_blocks_and_link_words(spark):
    html = ("<head><title>no</title></head><div>one &amp; two<br>three <b>four</b>&#228;&#xe4;&nbsp;x</div><!-- c --><script>var a='</p>';</script>"
            "<a href='/x'>in link<p>still link</p></a> after<style>p{}")
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [(r.text, r.words, r.link_words) for r in C.page_blocks(df).orderBy("block_no").collect()]
    assert got == [("one & two", 3, 0), ("three four ää x", 4, 0), ("in link", 2, 2), ("still link", 2, 2), ("after", 1, 0)]


def test_extractors(spark):
    nav = "<ul><li><a href='/a'>a</a></li><li><a href='/b'>b</a></li></ul>"
    assert content(spark, nav, "density") == ""
    assert content(spark, "", "density") == ""
    assert content(spark, f"<p>{LONG}</p>", "words") == LONG
    page = f"{nav}<p>{LONG}</p>{nav}{nav}<p>{LONG}</p><p>{LONG}</p>{nav}"
    assert content(spark, page, "words") == "\n".join([LONG] * 3)
    assert content(spark, page, "largest") == "\n".join([LONG] * 2)
    short = f"<p>{LONG}</p><p>short one here now</p><p>{LONG}</p>"
    assert content(spark, short, "words").count("\n") == 2


def test_robots_directive(spark):
    cases = {
        "<p>x</p>": 1,
        "<meta name='robots' content='noindex'>": -1,
        '<META NAME="robots" CONTENT="index, nofollow">': 0,
        "<meta name=robots content='noindex, nofollow'>": -1,
        "<meta name='robots' content='nofollow'><meta name='robots' content='noindex'>": 0,
        "<meta name='robots' content='NOINDEX'>": 1,
        "<meta name='robots' content='none'>": 1,
        "<meta name='other' content='noindex'>": 1,
        "<!-- <meta name='robots' content='noindex'> -->": 1,
    }
    df = spark.createDataFrame(list(cases.items()), "html string, expected int")
    for r in D.with_directive(df).collect():
        assert r.directive == r.expected, r.html
    assert {r.follow for r in D.indexable(D.with_directive(df)).filter("directive = 0").collect()} == {False}


def test_refresh_attribute_with_quotes(spark):
    html = """<meta content="0; url=/it's" http-equiv='refresh'>"""
    df = spark.createDataFrame([("https://a.de/x", html)], "url string, html string")
    r = D.with_refresh(df).first()
    assert (r.refresh, r.target) == ("0; url=/it's", "https://a.de/it's")


def test_redirect_chains(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("s", "s"), ("x", "y"), ("y", "x"), ("h1", "d"), ("h2", "d")]
    df = spark.createDataFrame(edges, "url string, target string")
    rows = D.follow_redirects(spark.createDataFrame([(u,) for u in "a s x h1 d".split()], "url string"), df).collect()
    chains = {}
    for r in sorted(rows, key=lambda r: (r.start, r.hop)):
        chains.setdefault(r.start, []).append((r.url, r.outcome))
    assert chains["a"] == [("a", None), ("b", None), ("c", None), ("d", "page")]
    assert chains["s"] == [("s", "loop")] and chains["x"] == [("x", None), ("y", "loop")]
    assert chains["d"] == [("d", "page")] and chains["h1"][-1] == ("d", "page")


def test_charsets(spark):
    rows = [("ascii", b"abc"), ("utf", "grün".encode()), ("utf", b"plain"), ("latin", "grün".encode("latin-1")), ("latin", b"x")]
    df = spark.createDataFrame(rows, "host string, raw binary")
    first = {r.host: r.charset for r in D.site_charset(df).collect()}
    last = {r.host: r.charset for r in D.site_charset(df, last_valid_wins=True).collect()}
    assert first == {"ascii": "UTF-8", "utf": "UTF-8", "latin": "ISO-8859-1"}
    assert last == {"ascii": "ASCII", "utf": "ISO-8859-1", "latin": "ISO-8859-1"}
    decoded = {r.html for r in D.decode_pages(df, D.site_charset(df)).collect()}
    assert decoded == {"abc", "grün", "plain", "x"}
    bad = df.withColumn("charset", F.lit("UTF-8"))
    assert bad.filter(H.decode_page(F.col("raw"), F.col("charset")).isNull()).count() == 1


def test_document_type(spark):
    df = spark.createDataFrame([("text/html; charset=x",), ("application/pdf",), ("image/png",)], "ct string")
    both = df.select(H.document_type(F.col("ct"), True).alias("a"), H.document_type(F.col("ct"), False).alias("b")).collect()
    assert [(r.a, r.b) for r in both] == [("html", "html"), ("pdf", None), (None, None)]


def test_robots_rules_agree_with_the_standard_library(spark):
    from urllib import robotparser

    file = [
        "Disallow: /ignored", "User-agent: Foo", "User-agent: mycrawler", "Allow: /a/b", "Disallow: /a # all of a", "Disallow: /q?x=1", "",
        "User-agent: *", "Disallow: /", "", "Disallow: /late",
    ]
    paths = ["/a/b/c", "/a/x", "/q?x=1&y", "/q?x=2", "/", "", "/late", "/ignored", "/%61/x"]
    lines = spark.createDataFrame([(i, line) for i, line in enumerate(file)], "line_no int, line string")
    urls = spark.createDataFrame([("https://h.de" + p,) for p in paths], "url string")
    for agent in ("MyCrawler/2 x", "Other/1"):
        parser = robotparser.RobotFileParser()
        parser.modified()
        parser.parse(file)
        got = {r.url: r.allowed for r in D.with_allowed(urls, D.robots_rules(lines, agent)).collect()}
        assert got == {u: parser.can_fetch(agent, u) for u in got}, agent
    assert U.quote is not None


def walked(start, target):
    """URLs of one chain in order, and how it ends."""
    seen = [start]
    while True:
        if seen[-1] not in target:
            return seen, "page"
        if target[seen[-1]] in seen:
            return seen, "loop"
        seen.append(target[seen[-1]])


@pytest.mark.parametrize("seed", range(4))
def test_redirects_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    n = 60
    target = {f"u{i}": f"u{rng.randrange(n)}" for i in range(n) if rng.random() < (0.6, 0.9, 1.0, 1.0)[seed]}
    if seed == 3:  # one cycle of all, and a way into it; ascending names never change the least one
        target = {f"u{i:03}": f"u{(i + 1) % 37:03}" for i in range(37)} | {f"v{i:03}": f"v{i + 1:03}" for i in range(20)} | {"v020": "u005"}
    starts = [*target, "elsewhere", None, "u1"]
    df = spark.createDataFrame([*target.items(), ("u0", None), (None, "u1")], "url string, target string")
    got = {(r.start, r.hop): (r.url, r.outcome) for r in D.follow_redirects(spark.createDataFrame([(s,) for s in starts], "url string"), df).collect()}
    want = {}
    for s in {s for s in starts if s}:
        urls, end = walked(s, target)
        want |= {(s, i): (u, end if i == len(urls) - 1 else None) for i, u in enumerate(urls)}
    assert got == want


def test_long_redirect_chain_takes_few_rounds(spark):
    n = 10_000
    df = spark.range(n).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("u"), (F.col("id") + 1).cast("string")).alias("target"))
    jumps, left = D._jumps(df.select("url", F.col("target").alias("to"), F.col("url").alias("low"), F.lit(0).alias("tail"), F.lit("").alias("outcome")))
    assert len(jumps) == 15 and left is None  # 2^14 hops, not 10,000
    rows = D.follow_redirects(spark.createDataFrame([("u0",)], "url string"), df)
    last = rows.orderBy(F.desc("hop")).first()
    assert rows.count() == n + 1 and (last.hop, last.url, last.outcome) == (n, f"u{n}", "page")
