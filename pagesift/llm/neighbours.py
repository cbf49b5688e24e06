"""Nearest neighbours by low-dimensional stable projections and kd-trees.

A projection on M Gaussian directions keeps distances in this sense: the squared projected distance over the squared
true one follows a chi-square law with M degrees of freedom. So with d the distance of the k-th
neighbour found, a point that is nearer than d lies beyond a projected distance of d * sqrt(q) only with
probability 1 - p, where q is the p-quantile. Projected neighbours are
verified in order of their distance until the next one lies beyond that.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.materialize import materialize

PROJECTED = 8
CONFIDENCE = 0.98
LEAF_ROWS = 50_000
NODE_ROWS = 64
SAMPLE_ROWS = 20_000
QUERY_ROWS = 20_000


def chi_square_quantile(p: float, freedom: int) -> float:
    """Quantile of the chi-square law with an even number of degrees of freedom (closed form, bisected)."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for j in range(1, freedom // 2):
            term *= x / 2 / j
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def kd_leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Index sets of a kd-tree's leaves: medians along the widest side until at most ``most`` points are left."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        some = todo.pop()
        if len(some) <= most:
            out.append(some)
            continue
        side = int(np.ptp(points[some], axis=0).argmax())
        order = some[np.argpartition(points[some, side], len(some) // 2)]
        todo += [order[: len(some) // 2], order[len(some) // 2 :]]
    return out


class Regions:
    """The upper kd-tree: splits that send a projected point to one of some regions."""

    def __init__(self, sample: np.ndarray, count: int):
        self.side, self.value, self.children, self.count = [], [], [], 0
        self._grow(sample, count)

    def _grow(self, sample: np.ndarray, count: int) -> int:
        me = len(self.side)
        side = int(np.ptp(sample, axis=0).argmax()) if len(sample) else 0
        value = float(np.median(sample[:, side])) if len(sample) else 0.0
        left = sample[:, side] <= value
        self.side.append(side), self.value.append(value), self.children.append(None)
        if count <= 1 or len(sample) < 4 or left.all():
            self.children[me] = self.count
            self.count += 1
        else:
            self.children[me] = (self._grow(sample[left], count // 2), self._grow(sample[~left], count - count // 2))
        return me

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, some = todo.pop()
            child = self.children[node]
            if isinstance(child, int):
                out[some] = child
                continue
            left = points[some, self.side[node]] <= self.value[node]
            todo += [(child[0], some[left]), (child[1], some[~left])]
        return out


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from each point to each box."""
    gap = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0)
    return (gap * gap).sum(axis=2)


class Index:
    """A kd-tree over projected points, with the original vectors and the ids that have each."""

    def __init__(self, vectors: np.ndarray, projected: np.ndarray, ids: list[np.ndarray]):
        self.leaves = kd_leaves(projected, NODE_ROWS)
        self.vectors, self.ids = vectors, ids
        self.low = np.array([projected[leaf].min(axis=0) for leaf in self.leaves])
        self.high = np.array([projected[leaf].max(axis=0) for leaf in self.leaves])

    def search(self, query: np.ndarray, projected: np.ndarray, k: int, quantile: float, bound: float) -> tuple[list[float], list[int]]:
        """Distances and ids of the k nearest, the smaller id first among equals; ``bound`` is a known k-th distance."""
        near = box_distances(projected[None], self.low, self.high)[0]
        found: list[tuple[float, int]] = []
        limit = bound
        for leaf in np.argsort(near, kind="stable"):
            if near[leaf] > quantile * limit * limit:
                break
            rows = self.leaves[leaf]
            gap = self.vectors[rows] - query
            distance = np.sqrt((gap * gap).sum(axis=1))
            new = [(d, int(i)) for r, d in zip(rows, distance.tolist()) if d <= limit for i in self.ids[r]]
            if new:
                found = sorted(found + new)[:k]
                limit = min(limit, found[-1][0]) if len(found) == k else limit
        return [d for d, _ in found], [i for _, i in found]


def _project(directions: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
                made = (flat @ directions).reshape(-1)
                edges = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * directions.shape[1])
                yield batch.append_column("projected", pa.ListArray.from_arrays(edges, pa.array(made)))

    return run


def _assign(regions: Regions):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                points = batch.column("projected").flatten().to_numpy().reshape(batch.num_rows, -1)
                yield batch.append_column("region", pa.array(regions.of(points)))

    return run


def _search(k: int, quantile: float):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(candidates) and len(queries):
            index = Index(np.stack(candidates["vector"]), np.stack(candidates["projected"]), list(candidates["ids"]))
            for uid, vector, projected, bound in zip(queries["uid"], queries["vector"], queries["projected"], queries["bound"]):
                distances, ids = index.search(np.asarray(vector), np.asarray(projected), k, quantile, bound)
                rows += [(uid, d, i) for d, i in zip(distances, ids)]
        return pd.DataFrame(rows, columns=["uid", "score", "vec_id"]).astype({"uid": "int64", "score": "float64", "vec_id": "int64"})

    return run


def _visits(low: np.ndarray, high: np.ndarray, quantile: float):
    """Regions that the stopping test does not rule out, the query's own aside."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                points = batch.column("projected").flatten().to_numpy().reshape(batch.num_rows, -1)
                bound, own, out = batch.column("bound").to_numpy(), batch.column("region").to_numpy(), []
                for at in range(0, len(points), 64):
                    near = box_distances(points[at : at + 64], low, high)
                    for i, reach in enumerate(near <= quantile * bound[at : at + 64, None] ** 2, at):
                        reach[own[i]] = False
                        out.append(np.flatnonzero(reach).tolist())
                yield batch.append_column("visits", pa.array(out, pa.list_(pa.int64())))

    return run


def nearest(
    vectors: DataFrame, is_query, k: int = 10, projected: int = PROJECTED, confidence: float = CONFIDENCE, leaf_rows: int = LEAF_ROWS,
    query_rows: int = QUERY_ROWS, seed: int = 7, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each query, by Euclidean distance.

    ``is_query`` is a condition on the column ``vec_id``. Equal vectors are indexed once with their k + 1
    smallest ids (the window's group limit keeps no more of a hot vector per task). All distinct vectors are
    projected and dealt to the regions of an upper kd-tree, whose splits come from a bounded sample (SAMPLE_ROWS);
    a region has about ``leaf_rows`` vectors and a kd-tree of its own. Each query searches its
    own region first, then those that its k-th distance does not rule out by the chi-square test. Queries of a region are
    searched in parts of about ``query_rows``.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids, nor
    vectors whose size is not the most frequent one. Rows that repeat both id and vector count once; a query's
    own id is never its neighbour. Ties go to the smaller id; with fewer than k candidates all are returned. Other columns
    are not looked at. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    usable = F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & usable)
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    rows = rows.filter(F.size("vector") == sizes["size"])
    order = W.partitionBy("vector").orderBy("vec_id")
    first = rows.withColumn("n", F.dense_rank().over(order)).filter(F.col("n") <= k + 1)
    distinct = first.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    distinct = distinct.withColumn("uid", F.monotonically_increasing_id())
    directions = np.random.default_rng(seed).standard_normal((sizes["size"], projected))
    with_points = distinct.mapInArrow(_project(directions), "vector array<double>, ids array<long>, uid long, projected array<double>")
    table, seen = materialize(with_points, "projected", n=F.count("*"))

    count = -(-seen["n"] // leaf_rows)
    share = F.lit(min(1 << 30, (SAMPLE_ROWS << 30) // seen["n"]))
    sample = table.filter(F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) <= share).select("projected").collect()
    regions = Regions(np.array([r["projected"] for r in sample]).reshape(-1, projected), count)
    schema = "vector array<double>, ids array<long>, uid long, projected array<double>, region long"
    placed = materialize(table.mapInArrow(_assign(regions), schema), "regions")
    sides = [f(F.get("projected", F.lit(i))).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(projected)]
    boxes = {r["region"]: r for r in placed.groupBy("region").agg(*sides).collect()}
    low, high = np.full((regions.count, projected), np.inf), np.full((regions.count, projected), np.inf)
    for n, r in boxes.items():
        low[n], high[n] = [r[f"low{i}"] for i in range(projected)], [r[f"high{i}"] for i in range(projected)]

    asked = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    asked = materialize(asked.join(placed.select("vector", "uid"), "vector").select("query_id", "uid"), "queries")
    queries = placed.select("uid", "vector", "projected", "region").join(asked.select("uid").distinct(), "uid")
    queries = materialize(queries.withColumn("bound", F.lit(float("inf"))), "query-vectors")
    quantile = chi_square_quantile(confidence, projected)

    def searched(q: DataFrame) -> DataFrame:
        """Each query in its region: ``uid, score, vec_id``."""
        parts = -(-q.count() // max(1, regions.count) // query_rows) or 1
        q = q.withColumn("part", F.pmod(F.xxhash64("uid", "region"), F.lit(parts)))
        c = placed.select("region", "vector", "projected", "ids").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        both = c.groupBy("region", "part").cogroup(q.groupBy("region", "part"))
        return both.applyInPandas(_search(k + 1, quantile), "uid long, score double, vec_id long")

    home = materialize(searched(queries), "home")
    best = home.groupBy("uid").agg(F.count("*").alias("n"), F.max("score").alias("far"))
    known = queries.drop("bound").join(best, "uid").withColumn("bound", F.when(F.col("n") > k, F.col("far")).otherwise(float("inf"))).drop("n", "far")
    visits = known.select("uid", "vector", "projected", "region", "bound").mapInArrow(
        _visits(low, high, quantile), "uid long, vector array<double>, projected array<double>, region long, bound double, visits array<long>"
    )
    away = materialize(visits.withColumn("region", F.explode("visits")).drop("visits"), "visits")
    found = home if away.isEmpty() else home.unionByName(materialize(searched(away), "away"))

    pair = F.array_sort(F.collect_set(F.struct("score", "vec_id")))  # k + 1 per visited region
    top = found.groupBy("uid").agg(pair.alias("near"))
    rows = asked.join(top, "uid").withColumn("near", F.filter("near", lambda x: x["vec_id"] != F.col("query_id")))
    rows = rows.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("place", "hit"))
    return rows.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
