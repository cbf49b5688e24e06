"""Global ranks and order statistics without a one-partition window."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .materialize import materialize

_POSITION_BITS = 33  # monotonically_increasing_id: partition above, position below


def global_rank(df: DataFrame, order: list[Column], out: str, name: str = "rank") -> DataFrame:
    """Add the 0-based rank ``out`` of each row in the order of ``order`` (unique keys)."""
    return ranked(df, order, out, name)[0]


def ranked(df: DataFrame, order: list[Column], out: str, name: str = "rank") -> tuple[DataFrame, int]:
    """The table with its ranks, and its number of rows.

    One range shuffle and a local sort place the rows; the written row ids carry
    partition and position, and the offsets are one number per partition. No task
    ever holds more than its range.
    """
    spark = df.sparkSession
    # No fixed number: AQE merges neighbouring ranges of a small table, which keeps the order.
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", _POSITION_BITS)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, before = [], 0
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    table = F.broadcast(spark.createDataFrame(offsets, "_part long, _offset long"))  # one row per partition
    rows = (
        placed.withColumn("_part", part)
        .join(table, "_part")
        .withColumn(out, F.col("_offset") + F.col("_place").bitwiseAND((1 << _POSITION_BITS) - 1))
        .drop("_part", "_offset", "_place")
    )
    return rows, before


def with_neighbours(df: DataFrame, group: str, order: str, columns: dict[str, tuple[str, int]], name: str = "neighbours") -> DataFrame:
    """Add columns ``{new: (column, offset)}`` of the row ``offset`` places on in its group, in the order of ``order`` (unique keys).

    A window would bring a whole group to one task. Here rows are ranked over all groups, and a neighbour is a join on the rank.
    """
    rows = materialize(global_rank(df, [F.asc(group), F.asc(order)], "_rank", name), name)
    out = rows
    for new, (column, offset) in columns.items():
        other = rows.select((F.col("_rank") - offset).alias("_rank"), F.col(group).alias("_group"), F.col(column).alias("_value"))
        out = out.join(other, "_rank", "left").withColumn(new, F.when(F.col(group).eqNullSafe(F.col("_group")), F.col("_value"))).drop("_group", "_value")
    return out.drop("_rank")


class Threshold(NamedTuple):
    value: int
    below: int  # rows with a smaller value
    equal: int  # rows with this value


def kth_smallest(df: DataFrame, column: str, k: int, low: int, high: int, bins: int = 65_536) -> Threshold:
    """Exact k-th smallest (1-based) of an integer column with values in low..high.

    Narrows a histogram until one value is left: each pass is a map-side combined
    count of at most ``bins`` groups, so neither the rows nor any hot value ever
    meet in one task, and only ``bins`` counts reach the driver.
    """
    below = 0
    while True:
        width = -(-(high - low + 1) // bins)
        rows = (
            df.filter(F.col(column).between(low, high))
            .groupBy(F.expr(f"(`{column}` - ({low})) div {width}").alias("bin"))
            .agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
            .collect()
        )
        for r in sorted(rows, key=lambda r: r["bin"]):
            if below + r["n"] >= k:
                if r["lo"] == r["hi"]:
                    return Threshold(r["lo"], below, r["n"])
                low, high = r["lo"], r["hi"]
                break
            below += r["n"]
        else:
            raise ValueError(f"only {below} rows, asked for number {k}")
