"""Inputs: training texts, stopwords, fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import html as H


def training_texts(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV, the text in the third column; every row is a positive example."""
    return (
        spark.read.schema("c0 string, c1 string, text string")
        .csv(path, header=False, multiLine=True, escape='"')
        .filter(F.col("text").isNotNull())
        .select(F.monotonically_increasing_id().alias("doc_id"), "text")
    )


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    """One entry per line, lower-cased, only the line end stripped; distinct."""
    return spark.read.text(path).select(F.lower("value").alias("stopword")).distinct()


def stopword_tuple(table: DataFrame, limit: int = 50_000) -> tuple[str, ...]:
    """The stopwords as literals for the token filter. A table of any length may be given as ``TextSettings.stopwords`` instead."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} stopwords: give the table itself to TextSettings")
    return tuple(sorted(r["stopword"] for r in rows))


def fetched_pages(spark: SparkSession, path: str, fetch_pdfs: bool = True) -> DataFrame:
    """A Parquet table of fetched pages with its document ``type``.

    Expects ``url, content_type, html`` and optionally ``last_fetched``. Rows of other
    types keep a NULL type: they are no documents, but count as crawled.
    """
    return with_type(spark.read.parquet(path), F.col("content_type"), fetch_pdfs)


def with_type(pages: DataFrame, content_type: Column, fetch_pdfs: bool) -> DataFrame:
    return pages.withColumn("type", H.document_type(content_type, fetch_pdfs))


def documents_only(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("type").isNotNull())
