"""Crawl state as tables: crawls, relevant documents, crawled and queued URLs.

A store is a folder. Rows lie in ``log/<table>/source=S/batch=N`` (what a crawl or a stream added in its batch N) and in
``snapshots/<version>/<table>`` (crawled sets and queues as they were saved, one row per URL). What counts is told by
the newest file of ``manifest``: the crawls, the snapshot that is valid for each, and the last
batch of each source. It is written last and under a new number, so readers see all tables of a save or none of it.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..operators.frontier import not_crawled

# The columns of the state tables.
SCHEMAS = {
    "crawls": (
        "crawl_id long, name string, base_url string, started double, last_change double, search_subdomains boolean, "
        "search_singledomain boolean, search_pdfs boolean, charset string"
    ),
    "relevant_documents": (
        "url string, last_fetched double, title string, type string, relevance double, content string, "
        "raw_content string, follow boolean, crawl_id long"
    ),
    "crawled_urls": "url string, last_fetched double, crawl_id long",
    "queued_urls": "url string, priority int, crawl_id long",
}
# One row per URL: which of several stays.
ONE_ROW = {"crawled_urls": ("last_fetched", F.max), "queued_urls": ("priority", F.min)}


def columns_of(table: str) -> list[str]:
    return [f.split()[0] for f in SCHEMAS[table].split(", ")]


@dataclass
class CrawlState:
    """A loaded crawl: its settings row, its crawled set and what is left to fetch."""

    settings: Row
    crawled: DataFrame
    queue: DataFrame


class Manifest:
    """Numbered files ``00000001.json``; the one with the highest number holds."""

    def __init__(self, spark: SparkSession, path: str, empty: dict):
        self.spark, self.path, self.empty = spark, path, empty
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.folder = self.jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.folder.getFileSystem(self.conf)

    def read(self) -> tuple[int, dict]:
        names = [s.getPath().getName() for s in self.files.listStatus(self.folder)] if self.files.exists(self.folder) else []
        last = max((n for n in names if re.fullmatch(r"[0-9]+\.json", n)), key=lambda n: int(n[:-5]), default=None)
        if last is None:
            return 0, json.loads(json.dumps(self.empty))
        file = self.files.open(self.jvm.org.apache.hadoop.fs.Path(self.folder, last))
        try:
            return int(last[:-5]), json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def change(self, edit: Callable[[dict], None]) -> dict:
        """Apply ``edit`` to the newest state and write the next file; again on what another writer wrote meanwhile."""
        while True:
            number, state = self.read()
            edit(state)
            if self._put(number + 1, json.dumps(state)):
                return state

    def _put(self, number: int, text: str) -> bool:
        """Write the file whole under its name; false if that name is taken."""
        fs = self.jvm.org.apache.hadoop.fs
        self.files.mkdirs(self.folder)
        draft, final = fs.Path(self.folder, f".{uuid.uuid4().hex}"), fs.Path(self.folder, f"{number:08}.json")
        out = self.files.create(draft, False)
        out.write(text.encode())
        out.close()
        context = fs.FileContext.getFileContext(self.folder.toUri(), self.conf)
        plain = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        plain[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), plain)
        except Py4JJavaError as e:
            self.files.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True


class CrawlStore:
    """The tables of all crawls in one folder.

    The crawled set and the queue are snapshots plus what was added since, with one row per URL however often a crawl is
    resumed. Every save is all or nothing, and a batch that is saved again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, f"{self.path}/manifest", {"crawls": {}, "snapshots": {}, "batches": {}})

    # --- reading --------------------------------------------------------------
    def _read(self, path: str, table: str, more: str = "") -> DataFrame | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.schema(SCHEMAS[table] + more).option("basePath", path).parquet(path)

    def table(self, name: str, crawl_ids: Sequence[int] | None = None) -> DataFrame:
        """A state table, of some crawls or of all; empty with its schema if nothing was saved yet."""
        _, state = self.manifest.read()
        if name == "crawls":
            rows = [tuple(c[k] for k in columns_of(name)) for c in state["crawls"].values()]
            table = self.spark.createDataFrame(rows, SCHEMAS[name])
            return table if crawl_ids is None else table.filter(F.col("crawl_id").isin(list(crawl_ids)))
        wanted = {int(c) for c in state["crawls"]} if crawl_ids is None else set(crawl_ids)
        parts = []
        log = self._read(f"{self.path}/log/{name}", name, ", source string, batch long")
        if log is not None:
            if crawl_ids is not None:
                log = log.filter(F.col("crawl_id").isin(sorted(wanted)))
            parts.append(self._counted(log, name, state).select(*columns_of(name)))
        if name in ONE_ROW:
            by_version: dict[str, list[int]] = {}
            for crawl, snapshot in state["snapshots"].items():
                if int(crawl) in wanted:
                    by_version.setdefault(snapshot["version"], []).append(int(crawl))
            for version, crawls in sorted(by_version.items()):
                rows = self._read(f"{self.path}/snapshots/{version}/{name}", name)
                if rows is not None:
                    parts.append(rows.filter(F.col("crawl_id").isin(crawls)))
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        if name in ONE_ROW and log is not None:
            column, choose = ONE_ROW[name]
            out = out.groupBy("crawl_id", "url").agg(choose(column).alias(column)).select(*columns_of(name))
        return out

    def _counted(self, log: DataFrame, name: str, state: dict) -> DataFrame:
        """Rows of finished batches that no snapshot of their crawl contains already."""
        # A row per source, and one per source and crawl saved since: not more than there are crawls and streams.
        done = self.spark.createDataFrame(sorted(state["batches"].items()), "source string, _last long")
        out = log.join(F.broadcast(done), "source").filter(F.col("batch") <= F.col("_last")).drop("_last")
        if name not in ONE_ROW:
            return out
        held = [(int(c), s, b) for c, snapshot in state["snapshots"].items() for s, b in snapshot["upto"].items()]
        held = F.broadcast(self.spark.createDataFrame(held, "crawl_id long, source string, _upto long"))
        return out.join(held, ["crawl_id", "source"], "left").filter(F.col("_upto").isNull() | (F.col("batch") > F.col("_upto"))).drop("_upto")

    def of_crawl(self, name: str, crawl_id: int) -> DataFrame:
        """Rows of one crawl; only its partitions are read."""
        return self.table(name, [crawl_id])

    def joined(self, name: str) -> DataFrame:
        """Crawls joined to one of their tables."""
        return self.table("crawls").join(self.table(name), "crawl_id")

    def crawls(self) -> DataFrame:
        """One row per crawl."""
        return self.table("crawls")

    def settings(self, crawl_id: int) -> Row:
        row = self.of_crawl("crawls", crawl_id).first()
        if row is None:
            raise KeyError(f"no crawl {crawl_id}")
        return row

    # --- writing --------------------------------------------------------------
    def new_crawl(self, settings: dict, charset: str | None = None) -> int:
        """Record a crawl and return its id, one more than the largest so far; two writers never get the same one."""
        return self.new_crawls([settings], charset)[0]

    def new_crawls(self, all_settings: Sequence[dict], charset: str | None = None) -> list[int]:
        ids: list[int] = []

        def edit(state: dict) -> None:
            ids.clear()
            for s in all_settings:
                now, crawl_id = time.time(), max(map(int, state["crawls"]), default=0) + 1
                row = (crawl_id, s["name"], s["full_url"], now, now, s["search_subdomains"], s["search_single_domain"], s["search_pdfs"], charset)
                state["crawls"][str(crawl_id)] = dict(zip(columns_of("crawls"), row))
                ids.append(crawl_id)

        self.manifest.change(edit)
        return ids

    def last_batch(self, source: str) -> int:
        """Number of the last batch of a source, -1 if there is none."""
        return self.manifest.read()[1]["batches"].get(source, -1)

    def save_batch(
        self, source: str, batch: int, documents: DataFrame | None = None, crawled: DataFrame | None = None, queued: DataFrame | None = None,
        before_commit: Callable[[], None] | None = None,
    ) -> bool:
        """Add the rows of one batch of a source to the three tables, all of them or none; ``crawl_id`` is a column.

        Batches of a source come in rising numbers. One that was saved already changes nothing (false), whatever it holds
        now. Documents get no title, and those whose URL their crawl has already are left out.
        """
        if not re.fullmatch(r"[\w.-]+", source):
            raise ValueError(f"source {source!r} is no plain name")
        if batch <= self.last_batch(source):
            return False
        if documents is not None:
            documents = self._new_documents(documents)
        for name, rows in (("relevant_documents", documents), ("crawled_urls", crawled), ("queued_urls", queued)):
            if rows is not None:
                folder = f"{self.path}/log/{name}/source={source}/batch={batch}"
                rows.select(*columns_of(name)).write.mode("overwrite").partitionBy("crawl_id").parquet(folder)
        if before_commit:
            before_commit()

        def edit(state: dict) -> None:
            state["batches"][source] = max(batch, state["batches"].get(source, -1))

        self.manifest.change(edit)
        return True

    def _new_documents(self, documents: DataFrame) -> DataFrame:
        for name, kind in (("title", "string"), ("raw_content", "string"), ("follow", "boolean"), ("last_fetched", "double")):
            if name not in documents.columns:
                documents = documents.withColumn(name, F.lit(None).cast(kind))
        documents = documents.withColumn("title", F.lit(None).cast("string"))
        return documents.join(self.table("relevant_documents").select("crawl_id", "url"), ["crawl_id", "url"], "left_anti")

    def save_documents(self, documents: DataFrame, crawl_id: int) -> None:
        """Append relevant documents of one crawl; those whose URL it has already are left out."""
        source = f"crawl-{crawl_id}"
        self.save_batch(source, self.last_batch(source) + 1, documents=documents.withColumn("crawl_id", F.lit(crawl_id).cast("long")))

    def save_crawls(self, crawl_ids: Sequence[int], crawled: DataFrame, queued: DataFrame, before_commit: Callable[[], None] | None = None) -> None:
        """Replace crawled sets and queues of some crawls (``crawl_id`` is a column), and note the time of the change.

        All crawls are written by one job per table into a new folder. Both tables may come from this store: nothing that is valid is touched, and
        until the manifest names the new folder the old state holds.
        """
        version, ids = uuid.uuid4().hex, sorted(set(crawl_ids))
        _, state = self.manifest.read()
        mine = F.col("crawl_id").isin(ids)
        folder = f"{self.path}/snapshots/{version}"
        once = crawled.filter(mine).groupBy("crawl_id", "url").agg(F.max("last_fetched").alias("last_fetched"))
        once.select(*columns_of("crawled_urls")).write.partitionBy("crawl_id").parquet(f"{folder}/crawled_urls")
        once = self._read(f"{folder}/crawled_urls", "crawled_urls")
        left = resume_queue(queued.filter(mine), once, ("crawl_id", "url"))
        left.select(*columns_of("queued_urls")).write.partitionBy("crawl_id").parquet(f"{folder}/queued_urls")
        if before_commit:
            before_commit()

        def edit(new: dict) -> None:
            for crawl in map(str, ids):
                new["snapshots"][crawl] = {"version": version, "upto": state["batches"]}
                new["crawls"][crawl]["last_change"] = time.time()

        self.manifest.change(edit)

    def save_crawl(self, crawl_id: int, crawled: DataFrame, queue: DataFrame, before_commit: Callable[[], None] | None = None) -> None:
        """Replace the crawled set and the queue of one crawl, both or neither."""
        own = F.lit(crawl_id).cast("long")
        self.save_crawls([crawl_id], crawled.withColumn("crawl_id", own), queue.withColumn("crawl_id", own), before_commit)

    def load_crawl(self, crawl_id: int) -> CrawlState:
        """Settings, crawled set and the queue without crawled URLs."""
        settings = self.settings(crawl_id)
        crawled = self.of_crawl("crawled_urls", crawl_id).select("url", "last_fetched")
        queue = self.of_crawl("queued_urls", crawl_id).select("url", "priority")
        return CrawlState(settings, crawled, resume_queue(queue, crawled))

    def vacuum(self) -> int:
        """Delete snapshots that no crawl needs any more; not while another writer saves. Their number."""
        _, state = self.manifest.read()
        valid = {s["version"] for s in state["snapshots"].values()}
        files, folder = self.manifest.files, self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots")
        if not files.exists(folder):
            return 0
        old = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName() not in valid]
        for path in old:
            files.delete(path, True)
        return len(old)


def resume_queue(queued: DataFrame, crawled: DataFrame, keys: tuple = ("url",)) -> DataFrame:
    """Queued minus crawled, one row per URL (with ``crawl_id`` in ``keys``, per crawl)."""
    once = queued.groupBy(*keys).agg(F.min("priority").alias("priority"))
    return not_crawled(once, crawled, keys)


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Append a state table to a relational database; its driver must be on the class path."""
    df.write.format("jdbc").mode("append").options(url=url, dbtable=table, **options).save()


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Read a state table from a relational database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
