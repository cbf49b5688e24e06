"""Crawl metrics as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def crawl_report(crawls: DataFrame, crawled: DataFrame, queued: DataFrame, to_parse: DataFrame, documents: DataFrame, threshold: float = -0.5) -> DataFrame:
    """Per crawl: crawled, queued, to-parse and relevant counts.

    Each table is counted per crawl before anything is joined, so a crawl that holds
    most of the rows is one small row here.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        n = F.count_if(F.col("relevance") > threshold) if name == "relevant" else F.count("*")
        return df.groupBy("crawl_id").agg(n.alias("n")).withColumn("what", F.lit(name))

    tables = {"crawled": crawled, "queued": queued, "parse_queued": to_parse, "relevant": documents}
    counts = reduce(DataFrame.unionByName, [counted(d, n) for n, d in tables.items()])
    wide = counts.groupBy("crawl_id").agg(*[F.sum(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in tables])
    return crawls.select("crawl_id", "name").join(wide, "crawl_id", "left").fillna(0, list(tables)).select("crawl_id", "name", *tables)


def found_counter(documents: DataFrame, threshold: float = -0.5) -> DataFrame:
    return documents.groupBy("crawl_id").agg(F.count_if(F.col("relevance") > threshold).alias("relevant"))


def download_rate(downloads: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: downloads in the latest second and mean downloads per elapsed second."""
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    per_second = downloads.groupBy(second.alias("second")).agg(F.count("*").alias("n"))
    elapsed = F.max("second") - F.min("second") + 1
    return per_second.agg(
        F.max_by("n", "second").alias("latest_per_s"),
        F.sum("n").alias("downloads"),
        elapsed.alias("elapsed_s"),
        (F.sum("n") / elapsed).alias("mean_per_s"),
    )
