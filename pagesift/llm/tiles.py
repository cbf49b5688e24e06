"""All pairs of a group, in tiles of bounded size, without ever making the pairs rows.

Groups of candidates come from buckets or components. One of up to ``chunk`` members is one tile. A
larger one is cut into chunks by a hash of the member, and every two chunks are a tile, so
no task holds more than two chunks and none of the group's pairs is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .rows import look_up


def group_sizes(members: DataFrame, group: str) -> DataFrame:
    return members.groupBy(group).agg(F.count("*").alias("size")).filter("size > 1")


def tiled(members: DataFrame, group: str, node: str, chunk: int, sizes: DataFrame | None = None) -> DataFrame:
    """``group, low, high, part`` and the columns of ``members``, for groups of two and more.

    Where groups are few, ``sizes`` may be a written table of :func:`group_sizes`: the members then do not move for their size.

    A tile (low, high) holds the members of two chunks, or of one if they are equal; ``part`` is
    the member's own chunk.
    """
    rows = members.join(group_sizes(members, group), group) if sizes is None else look_up(members, sizes, group)
    rows = rows.withColumn("chunks", F.ceil(F.col("size") / chunk).cast("long"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(node), "chunks")).drop("size")
    rows = rows.withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return rows.withColumn("low", F.least("part", "mate")).withColumn("high", F.greatest("part", "mate")).drop("chunks", "mate")


def gathered(tiles: DataFrame, group: str, sort_by: str) -> DataFrame:
    """The rows of each tile one after the other in one partition."""
    return tiles.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high", sort_by)


def runs(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole tiles, and the edges between their tiles."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        keys = np.stack([table.column(c).to_numpy() for c in (group, "low", "high")])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if len(edges):
            yield table.slice(0, edges[-1]), np.concatenate([[0], edges])
            rest = table.slice(edges[-1])
        else:
            rest = table
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that span the components of the link relation on 0..n-1.

    ``linked(u, others)`` tells which of the others are linked to u. Members that are
    already reached are not compared with each other, which changes no component.
    """
    edges, left = [], np.arange(n)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            hit = linked(u, left)
            for v in left[hit]:
                edges.append((u, int(v)))
                queue.append(int(v))
            left = left[~hit]
    return edges
