"""Hard negatives of anchor vectors by a secondary-sort shuffle.

Scores are integer inner products. Every anchor meets every vector in tiles: a block of anchors of bounded size and a
part of the vectors, read in pieces. From a tile come only scores that may matter, for each anchor the best of its
own label, then, when its positives are known, the best of other labels within each positive's window. Packed into keys (anchor,
descending score, id) they are dealt by anchor and sorted in the shuffle, and an iterator reads
each anchor once: a positive opens its window, a negative goes to the windows it lies in.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.materialize import materialize
from .rows import ROW, with_rows

ANCHORS = 2_048  # of a block
SOME_ANCHORS = 256  # scored at once
PIECE = 8_192  # vectors scored at once
PART = 1 << 18  # vectors of a tile
KEYS = 1 << 17  # keys of a task that sorts them
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
SCORED = "anchor long, anchor_id long, score long, vec_id long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of ``a`` with all of ``b``; those beyond a long are cut to its ends."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return a.astype(float) @ b.astype(float).T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LOWEST, HIGHEST).astype(np.int64)


class Best:
    """The best ``k`` (score, id) within [low, high] of what is offered: higher scores first, ties by smaller id."""

    __slots__ = ("k", "low", "high", "scores", "ids")

    def __init__(self, k: int, low: int = LOWEST, high: int = HIGHEST):
        self.k, self.low, self.high = k, low, high
        self.scores = self.ids = np.empty(0, dtype=np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        floor = self.low if len(self.scores) < self.k else max(self.low, int(self.scores[-1]))
        hit = np.flatnonzero(allowed & (scores >= floor) & (scores <= self.high))
        if not len(hit):
            return
        found = scores[hit]
        if len(hit) > self.k:
            hit = hit[found >= np.partition(found, len(found) - self.k)[len(found) - self.k]]
        all_scores = np.concatenate([self.scores, scores[hit].astype(np.int64)])
        all_ids = np.concatenate([self.ids, ids[hit]])
        order = np.lexsort((all_ids, ~all_scores))[: self.k]  # ~ turns the order about and cannot overflow
        self.scores, self.ids = all_scores[order], all_ids[order]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Runs of rows of one tile and kind."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("size", "block", "part", "kind")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for at, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            if end > at:
                yield tuple(keys[:3, at].tolist()), keys[3, at] == 0, batch.slice(at, end - at)


def _vectors(rows: pa.RecordBatch, size: int) -> np.ndarray:
    return rows.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, size)


def _score(positives: int, negatives: int, low: int, high: int, base: int, mining: bool):
    """What may matter of each tile: the best of the anchor's label or, when mining, of other labels in each window."""

    def wants(scores: list[int]) -> list[Best]:
        if not mining:
            return [Best(positives)]
        return [Best(negatives, -(-low * p // base), high * p // base) for p in scores if p >= 0]  # the window of a negative score is empty

    def run(batches):
        tile, anchors, vectors = None, [], []

        def results():
            rows = []
            for row, vec_id, _, best in anchors:
                some = {(s, i) for b in best for s, i in zip(b.scores.tolist(), b.ids.tolist())}
                rows += [(row, vec_id, s, i) for s, i in some]
            for at in range(0, len(rows), 65_536):
                columns = [pa.array(c, pa.int64()) for c in zip(*rows[at : at + 65_536])]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "anchor_id", "score", "vec_id"])

        for key, is_anchor, rows in _tiles(batches):
            if key != tile:
                yield from results()
                tile, anchors, vectors = key, [], []
            size = key[0]
            if is_anchor:
                facts = [rows.column(c).to_pylist() for c in (ROW, "vec_id", "label", "scores")]
                anchors += [(r, v, label, wants(s or [])) for r, v, label, s in zip(*facts)]
                vectors.append(_vectors(rows, size))
                continue
            if not anchors:
                continue
            if len(vectors) != 1:
                vectors = [np.concatenate(vectors)]
            for at in range(0, rows.num_rows, PIECE):
                part = rows.slice(at, PIECE)
                other, ids, labels = _vectors(part, size), part.column("vec_id").to_numpy(), part.column("label").to_numpy()
                same = {label: labels == label for label in {a[2] for a in anchors}}
                for first in range(0, len(anchors), SOME_ANCHORS):
                    scores = products(vectors[0][first : first + SOME_ANCHORS], other)
                    for line, (_, own, label, best) in zip(scores, anchors[first : first + SOME_ANCHORS]):
                        allowed = ~same[label] if mining else same[label] & (ids != own)
                        if mining:
                            allowed &= ids != own
                        for b in best:
                            b.offer(line, ids, allowed)
        yield from results()

    return run


def _tiled(anchors: DataFrame, vectors: DataFrame, blocks: int, parts: int, run) -> DataFrame:
    """``run`` over the tiles: each block of anchors meets each part of the vectors."""
    own = F.xxhash64(ROW)
    columns = ["size", ROW, "vec_id", "label", "vector"]

    def upto(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = anchors.select(*columns, "scores", F.lit(0).alias("kind"), F.pmod(own, F.lit(blocks)).alias("block"), upto(parts).alias("part"))
    none = F.lit(None).cast("array<long>").alias("scores")
    right = vectors.select(*columns, none, F.lit(1).alias("kind"), upto(blocks).alias("block"), F.pmod(own, F.lit(parts)).alias("part"))
    tiles = left.unionByName(right).repartition(blocks * parts, "size", "block", "part").sortWithinPartitions("size", "block", "part", "kind")
    return tiles.mapInArrow(run, SCORED)


def pack(anchor_id: int, anchor: int, score: int, negative: bool, vec_id: int) -> bytes:
    """A key whose bytes sort by anchor, descending score, positives before negatives, and id."""
    shift = 1 << 63
    return struct.pack(">QQQ?Q", anchor_id + shift, anchor, HIGHEST - score, negative, vec_id + shift)


def unpack(key: bytes) -> tuple[tuple[int, int], int, bool, int]:
    shift = 1 << 63
    anchor_id, anchor, score, negative, vec_id = struct.unpack(">QQQ?Q", key)
    return (anchor_id - shift, anchor), HIGHEST - score, negative, vec_id - shift


def windows(keys: Iterator[bytes], negatives: int, low: int, high: int, base: int) -> Iterator[tuple]:
    """The negatives of each positive, from sorted keys. Only the windows of one anchor are held."""
    anchor, opened = None, []
    for own, score, negative, vec_id in map(unpack, keys):
        if own != anchor:
            anchor, opened = own, []
        if not negative:
            opened.append([vec_id, score, 0])
            continue
        for window in opened:
            positive_id, positive, found = window
            if found < negatives and low * positive <= base * score <= high * positive:
                window[2] += 1
                yield own[0], positive_id, found + 1, vec_id, positive, score


def mine_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, base: int = 100, scale: int = 256,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``is_anchor`` tells.

    A component x counts as floor(scale * x), a score is the integer inner product with the anchor. An
    anchor's positives are its best ``positives`` rows of the same label, its negatives for one of them the best
    ``negatives`` rows of other labels with low * positive <= base * negative <= high * positive (0 < low <= high <= base).
    Ties go to the smaller id.

    - Rows with a null id, label or vector, or a component that is null or not finite, take no part. Vectors of different length
      are not compared. An anchor without positives, or a positive without negatives, gives no rows.
    - Rows that are equal in id, label and vector count once. Other rows that share an id are rows of
      their own, but an anchor never meets its own id.
    - Components and scores beyond a long are cut to its ends. Other columns are not looked at. No rows give no rows.

    Anchors times vectors are scored, which is the task; shuffled are the vectors, once for each block of ANCHORS anchors, and a
    bounded number of keys per anchor and tile. All anchors have about as many keys.
    """
    if not 0 < low <= high <= base:
        raise ValueError("0 < low <= high <= base is needed")
    spark = rows.sparkSession
    real = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    inner = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    inner = inner.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(real).distinct()
    inner = inner.withColumn("vector", F.transform("v", lambda x: F.floor(x * scale).cast("long"))).withColumn("size", F.size("v").cast("long")).drop("v")
    held = with_rows(inner, "vectors")
    count, n_anchors = held.agg(F.count("*"), F.count_if("is_anchor")).first()
    if not n_anchors:
        return spark.createDataFrame([], MINED)
    blocks = -(-n_anchors // ANCHORS)
    parts = max(-(-count // PART), -(-spark.sparkContext.defaultParallelism // blocks))
    vectors, anchors = held.drop("is_anchor"), held.filter("is_anchor").drop("is_anchor")

    some = (positives, negatives, low, high, base)
    found = _tiled(anchors.withColumn("scores", F.lit(None).cast("array<long>")), vectors, blocks, parts, _score(*some, mining=False))
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    best = materialize(found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives).drop("n"), "positives")
    scores = best.groupBy(F.col("anchor").alias(ROW)).agg(F.collect_list("score").alias("scores"))  # at most ``positives``
    far = _tiled(anchors.join(scores, ROW), vectors, blocks, parts, _score(*some, mining=True))
    keys, seen = materialize(best.withColumn("negative", F.lit(False)).unionByName(far.withColumn("negative", F.lit(True))), "scored", n=F.count("*"))

    tasks = -(-(seen["n"] or 0) // KEYS) or 1
    packed = keys.select("anchor_id", "anchor", "score", "negative", "vec_id").rdd.map(lambda r: (pack(*r), None))
    dealt = packed.repartitionAndSortWithinPartitions(tasks, lambda key: zlib.crc32(key[:16]))
    mined = dealt.mapPartitions(lambda pairs: windows((key for key, _ in pairs), negatives, low, high, base))
    return spark.createDataFrame(mined, MINED)
