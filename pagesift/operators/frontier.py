"""The frontier of URLs: unique entries, pop order, anti joins, priorities, schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.ranking import global_rank
from ..plans.unnest import unnest
from .links import in_scope


def seeds(spark: SparkSession, urls: Sequence[str] | DataFrame) -> DataFrame:
    """Start URLs at priority 1, put in the given order; those of a table with the column ``url`` all at once."""
    if isinstance(urls, DataFrame):
        return urls.select("url", F.lit(1).alias("priority"), F.lit(0).cast("long").alias("put_seq")).filter("url IS NOT NULL").distinct()
    return spark.createDataFrame([(u, 1, i) for i, u in enumerate(urls)], "url string, priority int, put_seq long")


def union_puts(*puts: DataFrame) -> DataFrame:
    """Seeds, resumed queue and found links as one table of puts.

    A table without ``put_seq``, or a row where it is null, was put before all others.
    """
    out = None
    for p in puts:
        order = F.coalesce(F.col("put_seq").cast("long"), F.lit(-1)) if "put_seq" in p.columns else F.lit(-1)
        p = p.withColumn("put_seq", order.cast("long"))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def unique_frontier(puts: DataFrame, mode: str = "last") -> DataFrame:
    """One live entry per URL: the last put wins, even if worse (``mode='min'``: the best).

    ``put_seq`` tells the puts of one URL apart. An aggregation and not a window, so
    the many puts of a popular URL are combined before the shuffle; its buffers are
    plain numbers, so it hashes and does not sort.
    """
    if mode == "last":
        value = F.max_by("priority", "put_seq")
    elif mode == "min":
        value = F.min("priority")
    else:
        raise ValueError("mode must be 'last' or 'min'")
    return puts.groupBy("url").agg(value.alias("priority"))


def pop(frontier: DataFrame, k: int) -> DataFrame:
    """The next ``k`` URLs by priority, then by URL."""
    return frontier.orderBy("priority", "url").limit(k)


def frontier_size(frontier: DataFrame) -> DataFrame:
    return frontier.agg(F.count("*").alias("queued"))


def not_crawled(urls: DataFrame, crawled: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """URLs that are not in the crawled set. Call it on distinct URLs: a popular one is then one row.

    Catalyst moves an anti join below an aggregation on the same key, where all finds
    of a popular URL would meet again. An outer join with a test stays above it.
    """
    seen = crawled.select(*keys).withColumn("_seen", F.lit(True))
    return urls.join(seen, list(keys), "left").filter(F.col("_seen").isNull()).drop("_seen")


def with_pages(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """The frontier joined to the fetched pages; ``fetched`` is false for URLs still to fetch."""
    return frontier.join(pages.withColumn("fetched", F.lit(True)), "url", "left").withColumn(
        "fetched", F.coalesce("fetched", F.lit(False))
    )


def own_priority(relevance: Column, parent: Column, threshold: float) -> Column:
    """1 for a relevant page, else one more than the page it was found with."""
    return F.when(relevance > F.lit(threshold), 1).otherwise(parent + 1)


def expandable(own: Column, doc_type: Column, search_depth: int) -> Column:
    """Only HTML pages with a priority below the search depth pass on their links."""
    return (own < search_depth) & (doc_type == "html")


def expand(
    scored: DataFrame,
    crawled: DataFrame,
    threshold: float = -0.5,
    search_depth: int = 3,
    search_single_domain: bool = False,
    search_subdomains: bool = True,
    respect_nofollow: bool = False,
) -> DataFrame:
    """New puts ``(url, priority)`` from scored pages.

    ``scored`` holds ``url, type, relevance, priority, links`` (and ``follow``); the
    depth test comes before the links are exploded, and the puts are unique before
    they meet the crawled set.
    """
    own = own_priority(F.col("relevance"), F.col("priority"), threshold)
    parents = scored.withColumn("own", own).filter(expandable(F.col("own"), F.col("type"), search_depth))
    if respect_nofollow:
        parents = parents.filter(F.col("follow"))
    found = unnest(parents, ["own"], "links", "l").filter(
        in_scope(F.col("l.link_class"), search_single_domain, search_subdomains)
    )
    best = found.groupBy(F.col("l.link").alias("url")).agg(F.min("own").alias("priority"))
    return not_crawled(best, crawled)


def fetch_schedule(frontier: DataFrame, per_second: int) -> DataFrame:
    """Add ``slot``: at most ``per_second`` URLs per one-second slot, in pop order."""
    ranked = global_rank(frontier, [F.asc("priority"), F.asc("url")], "_rank", "schedule")
    return ranked.withColumn("slot", F.floor(F.col("_rank") / per_second).cast("long")).drop("_rank")


def finished(crawls: DataFrame, queued: DataFrame, crawled: DataFrame, to_parse: DataFrame) -> DataFrame:
    """Rows ``(crawl_id, finished)``: is nothing queued that was not crawled, and does nothing wait for its score?

    Each crawl with anything left becomes one row before it meets the crawls, so a crawl that holds most of the rows is one row.
    """
    keys = ("crawl_id", "url")
    left = not_crawled(queued.select(*keys).distinct(), crawled, keys).select("crawl_id").unionByName(to_parse.select("crawl_id")).distinct()
    open_ = left.withColumn("_open", F.lit(True))
    return crawls.select("crawl_id").join(open_, "crawl_id", "left").select("crawl_id", F.col("_open").isNull().alias("finished"))


def is_finished(frontier: DataFrame, crawled: DataFrame, to_parse: DataFrame) -> bool:
    """True if nothing is queued and nothing waits for its score."""
    return not_crawled(frontier, crawled).isEmpty() and to_parse.isEmpty()
