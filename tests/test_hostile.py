"""Rows that must not stop or slow a job."""

import time

import pytest
from pyspark.sql import functions as F

from pagesift.functions import html as H, text as T
from pagesift.operators import frontier
from pagesift.plans import materialize as M
from pagesift.sources.state import CrawlStore


@pytest.mark.parametrize("run", ["\n", "\r\n", " ", "\t "])
def test_long_runs(spark, run):
    n = 1_000_000
    df = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(run), n), F.lit("b")).alias("text"))
    rules = T.usable_rules(spark, T.DEFAULT_RULES)
    start = time.perf_counter()
    got = df.select(T.apply_rules(F.col("text"), rules).alias("t")).first().t
    assert got == ("a b" if "\n" in run else f"a{run * n}b")
    assert time.perf_counter() - start < 5


def test_many_lines(spark):
    """Texts of many short lines: every step that a text goes through is linear in them."""
    rules = T.usable_rules(spark, T.DEFAULT_RULES)

    def seconds(lines: int, out) -> float:
        start = time.perf_counter()
        assert spark.range(1).select(out(F.repeat(F.lit("ein wort.\n"), lines))).first()[0] == lines
        return time.perf_counter() - start

    joined = lambda t: F.floor(F.length(T.apply_rules(t, rules)) / 10).cast("int")
    seconds(10, joined)
    assert seconds(1_000_000, joined) < 5
    assert seconds(100_000, lambda t: F.size(T.sentences(T.apply_rules(t, rules)))) < 10


def test_reference_table_is_cheap(spark):
    H.decode_entities(F.col("t"))
    start = time.perf_counter()
    for _ in range(10):
        H.decode_entities(F.col("t"))
    assert (time.perf_counter() - start) / 10 < 0.05


def test_line_rule_is_the_pattern(spark):
    rows = ["a \t\n\n b", "\n", "", "a\r\rb \r\n c  ", " \n \n ", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    pattern, put = T.DEFAULT_RULES[2]
    both = df.select(T.join_lines(F.col("t")).alias("x"), F.regexp_replace("t", pattern, put).alias("y")).collect()
    assert all(r.x == r.y for r in both)


@pytest.mark.parametrize("given, wanted", [
    ("&#55296;x", "�x"), ("&#0;", "�"), ("&#128512;&#x1F600;", "😀😀"), ("&rsquo;&bdquo;&euro;", "’„€"), ("&amp;lt; &nosuch; & &;", "&lt; &nosuch; & &;"),
    ("&#xe002;&#xE000;a", "a"), ("&#228;&#x00e4;&auml;", "äää"), ("&#99999999999;", "�"), ("a&b", "a&b"), ("&nbsp;", " "),
])
def test_references(spark, given, wanted):
    assert spark.createDataFrame([(given,)], "t string").select(H.decode_entities(F.col("t"))).first()[0] == wanted


def test_marks_in_pages(spark):
    df = spark.createDataFrame([("<p>one two three</p>",)], "html string")
    for step in H.marked_text(F.col("html")):
        df = df.select(step(F.col("html")).alias("html"))
    assert "one two three" in df.first().html


def test_load_then_save(spark):
    store = CrawlStore(spark, M.scratch_path(spark, "store"))
    settings = {"name": "n", "full_url": "https://a.org", "search_subdomains": True, "search_single_domain": False, "search_pdfs": False}
    crawl = store.new_crawl(settings)
    store.save_crawl(crawl, spark.createDataFrame([("a", 1.0)], "url string, last_fetched double"), spark.createDataFrame([("a", 1), ("b", 2)], "url string, priority int"))
    for _ in range(2):
        state = store.load_crawl(crawl)
        store.save_crawl(crawl, state.crawled, state.queue)
    state = store.load_crawl(crawl)
    assert [r.url for r in state.crawled.collect()] == ["a"] and [(r.url, r.priority) for r in state.queue.collect()] == [("b", 2)]
    docs = spark.createDataFrame([("u", 0.5, "html", "text")], "url string, relevance double, type string, content string")
    for _ in range(2):
        store.save_documents(docs, crawl)
    assert store.of_crawl("relevant_documents", crawl).count() == 1


def test_union_puts_without_order(spark):
    puts = spark.createDataFrame([("a", 3)], "url string, priority int")
    got = frontier.unique_frontier(frontier.union_puts(frontier.seeds(spark, ["a", "b"]), puts)).collect()
    assert {(r.url, r.priority) for r in got} == {("a", 1), ("b", 1)}
    assert frontier.unique_frontier(frontier.union_puts(puts)).first().priority == 3


def test_intermediate_tables(spark, monkeypatch):
    df = M.materialize(spark.range(5), "x")
    M.discard(df, None)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FAILED_READ"):
        df.collect()
    assert M.is_local("local[4]") and M.is_local("local") and not M.is_local("local-cluster[2,1,1024]") and not M.is_local("yarn")
    few = M.spread(spark.range(0, 10, 1, 1))
    assert few.rdd.getNumPartitions() > 1 and M.spread(spark.range(0, 10, 1, 1), enabled=False).rdd.getNumPartitions() == 1
