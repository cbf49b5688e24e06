"""Streaming jobs: continuous scoring, dedupe, counters, rates, sinks.

Each job takes a ``trigger``, as keyword arguments of ``DataStreamWriter.trigger``; without one it takes what
has arrived and stops. State that may outgrow an executor's heap needs the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import oneclass, sentences as S
from ..operators.content import with_content
from ..sources.state import CrawlStore
from .seen import SeenUrls


NOW = {"availableNow": True}


def page_stream(spark: SparkSession, path: str, schema, pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as a stream of pages (or any other table)."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def score_texts(texts: DataFrame, model: oneclass.OneClassModel, settings: S.TextSettings, key: str = "page_id") -> DataFrame:
    """Rows ``(key, relevance, n_sentences)`` of main texts: sentences, votes, mean vote."""
    terms = S.with_terms(S.to_sentences(texts, key, settings, keep_empty=True), settings, key)
    return oneclass.document_relevance(oneclass.sentence_votes(terms, model, key), key)


def score_pages(pages: DataFrame, model: oneclass.OneClassModel, settings: S.TextSettings, key: str = "page_id", extractor: str = "density") -> DataFrame:
    """Rows ``(key, relevance, n_sentences)``: main text, sentences, votes, mean vote."""
    return score_texts(with_content(pages.select(key, "html"), extractor).select(key, F.col("content").alias("text")), model, settings, key)


def start_scoring(
    pages: DataFrame, model, settings, out: str | Callable[[DataFrame, int], None], checkpoint: str, threshold: float = -0.5, key: str = "page_id",
    keep: tuple[str, ...] = (), trigger: dict | None = None,
) -> StreamingQuery:
    """Score arriving pages with a fixed model and keep the relevant ones.

    ``keep`` names further columns of the pages that go along, such as the URL; ``content`` stands for their main text, which
    is extracted once per page in any case. ``out`` is a folder or a writer ``(rows, batch_id)``, such as one that calls
    :meth:`CrawlStore.save_batch`.

    Each batch overwrites its own ``batch`` partition, so a batch that is run again
    after a failure leaves no duplicate.
    """
    settings = S.resolved(settings)

    def batch(df: DataFrame, batch_id: int) -> None:
        cores = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:  # a few files per trigger would leave cores idle
            df = df.repartition(cores)
        rest = [c for c in keep if c != "content"]
        texts = with_content(df).select(key, *rest, "content")
        if keep:
            texts = texts.persist(StorageLevel.DISK_ONLY)  # read twice; a lost executor's part is extracted anew
        scored = oneclass.relevant(score_texts(texts.select(key, F.col("content").alias("text")), model, settings, key), threshold)
        if keep:
            scored = scored.join(texts.select(key, *keep), key)
        if callable(out):
            out(scored, batch_id)
        else:
            scored.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        texts.unpersist()

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or NOW)).start()


def start_dedupe(
    urls: DataFrame, out: str, checkpoint: str, event_time: str | None = None, delay: str = "1 hour", trigger: dict | None = None,
    then: Callable[[DataFrame, int], None] | None = None, **seen: int,
) -> StreamingQuery:
    """First sight of each URL.

    What was seen lies in the folder ``out`` (:class:`SeenUrls`, which takes ``seen`` and gives the URLs back), not in operator state,
    so state does not grow with the web; ``then`` gets the new URLs of each batch. With an event time the operator keeps what the
    watermark allows, a URL may come again after that, and ``out`` is a plain table.
    """
    if event_time:
        once = urls.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url"])
        writer = once.writeStream.format("parquet").option("path", out).outputMode("append")
    else:
        def batch(df: DataFrame, batch_id: int) -> None:
            new = SeenUrls(df.sparkSession, out, **seen).add(df, batch_id)
            if then:
                then(new, batch_id)

        writer = urls.writeStream.foreachBatch(batch)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or NOW)).start()


def start_found_counter(documents: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Running number of relevant documents per crawl; each batch writes the counts it changed."""
    counts = documents.groupBy("crawl_id").agg(F.count("*").alias("relevant"))

    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or NOW)).start()
    )


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """Last known count per crawl from the written updates."""
    return spark.read.parquet(out).groupBy("crawl_id").agg(F.max_by("relevant", "batch").alias("relevant"))


def start_rate(
    downloads: DataFrame, out: str, checkpoint: str, ts: str = "ts", window: str = "1 second", delay: str = "10 seconds", trigger: dict | None = None
) -> StreamingQuery:
    """Downloads per window; a window is written once the watermark has passed it."""
    rates = (
        downloads.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"))
        .agg(F.count("*").alias("downloads")).select(F.col("w.start").alias("start"), "downloads")
    )
    return (
        rates.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or NOW)).start()
    )


# Kinds of state rows and the tables they go to, in the order of writing.
KINDS = {"document": "documents", "crawled": "crawled", "queued": "queued"}


def start_state_sinks(rows: DataFrame, store: CrawlStore, source: str, checkpoint: str, kind: str = "kind", trigger: dict | None = None) -> StreamingQuery:
    """One stream of mixed state rows into the three tables of a store, each row exactly once.

    ``rows`` has ``crawl_id``, ``url``, the columns of the three tables, and ``kind``: ``document``, ``crawled`` or ``queued``. A batch
    is written to all three tables before the store's manifest counts it, and one that is run again changes nothing. ``source``
    names the stream in the store; a new checkpoint needs a new name.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist(StorageLevel.DISK_ONLY)
        store.save_batch(source, batch_id, **{table: df.filter(F.col(kind) == name) for name, table in KINDS.items()})
        df.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or NOW)).start()
