"""Main text of pages: blocks, block features, content rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import html as H
from ..plans.unnest import unnest

EXTRACTORS = {
    # name: (block rule, choice among the fused blocks)
    "density": ("density", H.all_content),
    "words": ("words", H.all_content),
    "largest": ("words", H.largest_content),
}


def with_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``blocks``, the array of text blocks with their features.

    Each rewrite is its own projection: a later one uses its input several times,
    and must not repeat the scan that made it.
    """
    out = pages.withColumn("_marked", F.col(html))
    for rewrite in H.marked_text(F.col("_marked")):
        out = out.withColumn("_marked", rewrite(F.col("_marked")))
    return out.withColumn("blocks", H.blocks(F.col("_marked"))).drop("_marked")


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows ``(key, block_no, text, words, link_words, link_density, text_density)``."""
    return unnest(with_blocks(pages.select(key, html), html), [key], "blocks", "b", "block_no").select(key, "block_no", "b.*")


def with_content(pages: DataFrame, extractor: str = "density", html: str = "html") -> DataFrame:
    """Add ``content``: the main text, '' if no block is kept or extraction fails.

    Neighbouring blocks are read from the same row's array, so pages become text in
    one map stage: no window, no shuffle, and the HTML never leaves its task.
    """
    if extractor not in EXTRACTORS:
        raise ValueError(f"extractor {extractor!r} unknown, choose from {sorted(EXTRACTORS)}")
    rule, choose = EXTRACTORS[extractor]
    return (
        with_blocks(pages, html)
        .withColumn("_fused", H.fused_content(F.col("blocks"), rule))
        .withColumn("content", F.coalesce(choose(F.col("_fused")), F.lit("")))
        .drop("blocks", "_fused")
    )
