"""A set of seen URLs on storage, for streams that must not keep the web in operator state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.bitmaps import bitmap_of, bitmap_row, bits_for, has_bit
from ..sources.state import Manifest

BUCKETS = 16
FILE_ROWS = 4_000_000
LEAST = 100_000  # new URLs before the set is first put in order
SMALL = 32 << 20  # bytes of bitmap that may be broadcast


class SeenUrls:
    """URLs by first sight, in a folder.

    ``base/generation=G`` holds all URLs up to some batch, in buckets by hash, and ``bitmap/generation=G`` a hashed bitmap of them, one row of
    4 KB per 2,048 URLs; later batches lie in ``recent/batch=N``. A batch first meets the bitmap. Only URLs whose bit is set meet the
    buckets they may be in, and all meet the recent batches. When those hold as many URLs as the base, a new generation is
    written, so a URL is rewritten a logarithmic number of times. ``manifest`` tells what holds; it is written last.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, least: int = LEAST):
        self.spark, self.path, self.buckets, self.least = spark, path.rstrip("/"), buckets, least
        self.manifest = Manifest(spark, f"{self.path}/manifest", {"generation": 0, "rows": 0, "bits": 0, "upto": -1, "last": -1, "recent": 0})

    def _bucket(self):
        return F.pmod(F.hash("url"), F.lit(self.buckets))

    def _base(self, state: dict) -> DataFrame:
        if not state["generation"]:
            return self.spark.createDataFrame([], "url string, bucket int")
        return self.spark.read.schema("url string, bucket int").parquet(f"{self.path}/base/generation={state['generation']}")

    def _recent(self, state: dict) -> DataFrame:
        if state["last"] == state["upto"]:
            return self.spark.createDataFrame([], "url string, batch long")
        rows = self.spark.read.schema("url string, batch long").parquet(f"{self.path}/recent")
        return rows.filter((F.col("batch") > state["upto"]) & (F.col("batch") <= state["last"]))

    def urls(self) -> DataFrame:
        """All URLs, each once."""
        _, state = self.manifest.read()
        return self._base(state).select("url").unionByName(self._recent(state).select("url"))

    def _unseen(self, urls: DataFrame, state: dict) -> DataFrame:
        found = urls.select("url").filter("url IS NOT NULL").distinct()
        found = found.join(self._recent(state).select("url"), "url", "left_anti")
        if not state["generation"]:
            return found
        bits = state["bits"]
        bitmap = self.spark.read.schema("bitmap_row long, bitmap binary").parquet(f"{self.path}/bitmap/generation={state['generation']}")
        bitmap = F.broadcast(bitmap) if bits // 8 <= SMALL else bitmap
        told = found.withColumn("bitmap_row", bitmap_row(F.col("url"), bits)).join(bitmap, "bitmap_row", "left")
        told = told.select("url", has_bit(F.col("bitmap"), F.col("url"), bits).alias("maybe"), self._bucket().alias("bucket"))
        # The base is pruned to the buckets of the doubtful URLs while it is scanned.
        sure = told.filter("maybe").join(self._base(state), ["bucket", "url"], "left_anti")
        return told.filter("NOT maybe").select("url").unionByName(sure.select("url"))

    def add(self, urls: DataFrame, batch: int) -> DataFrame:
        """Add the URLs of a batch and return those seen for the first time; a batch that comes again gives what it gave."""
        _, state = self.manifest.read()
        folder = f"{self.path}/recent/batch={batch}"
        fresh = self.spark.read.schema("url string")
        if batch <= state["last"]:
            return fresh.parquet(folder)
        self._unseen(urls, state).write.mode("overwrite").parquet(folder)
        new = fresh.parquet(folder)
        count = new.count()

        def edit(now: dict) -> None:
            now["last"], now["recent"] = batch, now["recent"] + count

        state = self.manifest.change(edit)
        if state["recent"] >= max(self.least, state["rows"]):
            self._settle(state)
        return new

    def _settle(self, state: dict) -> None:
        """Write base and bitmap anew, with all batches so far."""
        generation, rows = state["generation"] + 1, state["rows"] + state["recent"]
        bits = bits_for(rows, most=None)
        whole = self._base(state).select("url").unionByName(self._recent(state).select("url")).withColumn("bucket", self._bucket())
        base = f"{self.path}/base/generation={generation}"
        splits = -(-rows // (self.buckets * FILE_ROWS))  # files of a bucket
        whole = whole.repartition(self.buckets * splits, "bucket", F.pmod(F.xxhash64("url"), F.lit(splits)))
        whole.write.mode("overwrite").partitionBy("bucket").parquet(base)
        held = self.spark.read.schema("url string, bucket int").parquet(base)
        bitmap_of(held, "url", bits).write.mode("overwrite").parquet(f"{self.path}/bitmap/generation={generation}")
        upto = state["last"]

        def edit(now: dict) -> None:
            now.update(generation=generation, rows=rows, bits=bits, upto=upto, recent=now["recent"] - state["recent"])

        self.manifest.change(edit)
