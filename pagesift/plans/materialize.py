"""Cutting lineage through the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_own_folders: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables of this application.

    ``spark.checkpoint.dir`` of the session, else the folder given to
    ``sparkContext.setCheckpointDir``. Only a local master may go without either: then
    one temporary folder is made. On a cluster every node would have its own, so that
    is an error.
    """
    context = spark.sparkContext
    app = context.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        given = context._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if not folder:
        if not is_local(context.master):
            raise ValueError("no shared folder for intermediate tables: set spark.checkpoint.dir or call setCheckpointDir")
        folder = _own_folders.get(app) or tempfile.mkdtemp(prefix="pagesift-")
        _own_folders[app] = folder
    return f"{folder.rstrip('/')}/{app}"


def is_local(master: str) -> bool:
    """Do driver and executors share one machine and one process?"""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None, **metrics: Column):
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The written table survives lost executors, is column-pruned by its readers and
    gives Catalyst its true size, so joins are broadcast only where it is small.
    With ``metrics`` the aggregates are observed during the write and returned as
    a dict beside the table. ``path`` replaces a fresh path of the given name.
    """
    path = path or scratch_path(df.sparkSession, name)
    seen = None
    out = df
    if metrics:
        seen = Observation()
        out = df.observe(seen, *[c.alias(k) for k, c in metrics.items()])
    out.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return (table, seen.get) if metrics else table


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables that :func:`materialize` wrote and nothing reads any more.

    Only files below this application's scratch folder are touched.
    """
    for table in tables:
        if table is None:
            continue
        spark = table.sparkSession
        home = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark)).toUri().getPath()
        folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.toUri().getPath().startswith(home + "/"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scan_partitions(df: DataFrame) -> int:
    """Tasks that Spark plans for the largest scan below ``df``."""
    session = df.sparkSession._jsparkSession.sessionState()
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return max(session.executePlan(leaves.apply(i), mode).toRdd().getNumPartitions() for i in range(leaves.size()))


def spread(df: DataFrame, *keys: str, enabled: bool = True) -> DataFrame:
    """Give every core work where a scan has fewer tasks than there are cores.

    A file with one row group is one task however many cores there are. Any scan with
    enough tasks stays as it is, whatever its size; ``enabled=False`` never shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not enabled or scan_partitions(df) >= cores:
        return df
    return df.repartition(cores, *keys)


def portioned(df: DataFrame, weight: Column, most: int) -> DataFrame:
    """``df`` in tasks of about ``most`` by the sum of ``weight`` at most.

    For steps that keep what a task has read, as the combining side of a count does with every distinct key. How much a scan gives one task
    depends on files and row groups, so it is measured. Where no task holds more, the rows stay where they are.
    """
    held = df.select(F.spark_partition_id().alias("task"), weight.cast("long").alias("weight")).groupBy("task").agg(F.sum("weight").alias("weight"))
    largest, total = held.agg(F.max("weight"), F.sum("weight")).first()
    return df if (largest or 0) <= most else df.repartition(-(-2 * total // most))
