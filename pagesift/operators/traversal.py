"""Focused traversal of the page graph as waves of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.buckets import Levels, bucketed
from .frontier import expandable, own_priority


def wave(edges: DataFrame, new: DataFrame, known: Levels, threshold: float, search_depth: int) -> DataFrame:
    """The labels ``(url, label)`` that get better when the pages of ``new`` pass theirs on.

    ``edges(src, dst, type, relevance)`` and the known labels are bucketed: they are joined where they lie. What is
    shuffled are the new labels and, combined per URL before, their finds.
    """
    own = own_priority(F.col("relevance"), F.col("label"), threshold)
    found = edges.join(new.select(F.col("url").alias("src"), "label"), "src").withColumn("own", own)
    found = found.filter(expandable(F.col("own"), F.col("type"), search_depth))
    return known.better(found.select(F.col("dst").alias("url"), F.col("own").alias("label")))


def focused_traversal(
    seeds: DataFrame,
    edges: DataFrame,
    nodes: DataFrame,
    threshold: float = -0.5,
    search_depth: int = 3,
    crawled: DataFrame | None = None,
) -> DataFrame:
    """Every URL that enters the frontier, with its label.

    ``seeds(url, priority)``, ``edges(src, dst)`` in scope, ``nodes(url, type, relevance)``
    of the fetched and allowed pages. A label is the least own priority among the
    pages that lead to the URL; the labels are a fixpoint and do not depend on timing.
    ``crawled`` URLs are left out from the start. A page whose label falls
    is expanded again with the better label, and never scored again.

    Only URLs and small numbers move, and the evaluation is semi-naive: edges are written once, bucketed by source,
    labels bucketed by URL in tables that are merged as they grow, and a wave follows the labels that got better in the
    one before. The waves end because labels can only fall.
    """
    page = nodes.select("url", F.col("type"), F.col("relevance"))
    out = edges.select("src", "dst").filter(F.col("dst").isNotNull()).join(page.withColumnRenamed("url", "src"), "src")
    start = seeds.groupBy("url").agg(F.min("priority").alias("label"))
    if crawled is not None:
        start = start.join(crawled.select("url"), "url", "left_anti")
        out = out.join(crawled.select(F.col("url").alias("dst")), "dst", "left_anti")
    out = bucketed(out, "src", "edges")
    known = Levels("url", "label")
    new, count = known.add(start)
    while count:
        new, count = known.add(wave(out, new, known, threshold, search_depth))
    return known.all() if known.tables or known.kept else new


def crawl_outcome(labels: DataFrame, nodes: DataFrame, threshold: float = -0.5) -> DataFrame:
    """Traversal result per URL: fetched or still queued, and relevant or not."""
    seen = labels.join(nodes.select("url", "relevance"), "url", "left")
    return seen.select(
        "url", "label",
        F.col("relevance").isNotNull().alias("fetched"),
        F.coalesce(F.col("relevance") > threshold, F.lit(False)).alias("relevant"),
    )
