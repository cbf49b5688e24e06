"""Jaccard join of documents on word shingles, with Bayesian pruning of candidates."""

from __future__ import annotations

import hashlib
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.materialize import materialize
from .graph import components
from .hashing import MinHasher, WordHasher, mix
from .rows import ROW, keep_keys, slices, vacate, with_rows
from .tiles import forest, gathered, runs, tiled

HASHES, BAND_ROWS = 128, 5
STEPS = (16, 32, 64, 96, 128)
TOLERANCE = 1e-4
SIGNED = f"{ROW} long, doc_id long, shingles long, set_id binary, bands array<long>, signature binary"


def _sign(words: int, hashes: int, band_rows: int):
    """Shingle count, identity of the shingle set, band keys and one byte per MinHash value."""

    def run(batches):
        vacate()
        hasher, minhash = WordHasher(), MinHasher(hashes)
        for part, texts in slices(batches, "text"):
            counts, ids, bands, signatures = [], [], [], []
            for text in texts:
                shingles = hasher.shingles(text, words)
                counts.append(len(shingles))
                if not len(shingles):
                    ids.append(None), bands.append([]), signatures.append(None)
                    continue
                ids.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                values = minhash.signature(shingles).astype(np.uint64)
                rows = values[: hashes // band_rows * band_rows].reshape(-1, band_rows)
                key = np.arange(1, len(rows) + 1, dtype=np.uint64)
                for k in range(band_rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
                bands.append(key.view(np.int64).tolist())
                signatures.append((values & np.uint64(255)).astype(np.uint8).tobytes())
            new = [pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
            kept = [part.column(c) for c in (ROW, "doc_id")]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[ROW, "doc_id", "shingles", "set_id", "bands", "signature"])

    return run


@cache
def least_matches(threshold: float, tolerance: float, steps: tuple[int, ...] = STEPS) -> tuple[int, ...]:
    """Matches needed after each number of compared values to stay a candidate.

    With a uniform prior on the similarity s, a byte of a MinHash value matches with
    probability p = s + (1 - s) / 256, so after m matches of n the posterior density is proportional to
    p^m (1 - p)^(n - m). A pair is dropped when the mass at s >= threshold is below the tolerance.
    """
    s = (np.arange(4_000) + 0.5) / 4_000
    p = s + (1 - s) / 256
    out = []
    for n in steps:
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            mass = np.exp(log - log.max())
            if mass[s >= threshold].sum() >= tolerance * mass.sum():
                out.append(m)
                break
    return tuple(out)


def survivors(one: np.ndarray, others: np.ndarray, need: tuple[int, ...], steps: tuple[int, ...] = STEPS) -> np.ndarray:
    """Which signatures (rows of ``others``) remain candidates beside ``one`` (one row, or a row each)."""
    alive, matches, before = np.arange(len(others)), np.zeros(len(others), dtype=np.int64), 0
    for n, m in zip(steps, need):
        left = one[before:n] if one.ndim == 1 else one[alive, before:n]
        matches[alive] += (others[alive, before:n] == left).sum(axis=1)
        alive = alive[matches[alive] >= m]
        before = n
    keep = np.zeros(len(others), dtype=bool)
    keep[alive] = True
    return keep


def _candidates(need: tuple[int, ...]):
    """Spanning edges of the pairs of each bucket that pruning leaves."""

    def run(batches):
        vacate()
        for table, edges in runs(batches, "bucket"):
            nodes = table.column("node").to_numpy()
            flat = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(nodes), -1)
            sizes, found = np.diff(edges), []
            twos = edges[:-1][sizes == 2]
            keep = survivors(flat[twos], flat[twos + 1], need)
            found += [np.stack([nodes[twos[keep]], nodes[twos[keep] + 1]], axis=1)]
            for at, size in zip(edges[:-1][sizes > 2], sizes[sizes > 2]):
                some, sig = nodes[at : at + size], flat[at : at + size]
                pairs = forest(size, lambda u, others: survivors(sig[u], sig[others], need))  # noqa: B023
                found.append(some[np.array(pairs, dtype=np.int64).reshape(-1, 2)])
            a, b = np.concatenate(found).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets, by products of 0/1 matrices over shared elements."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    here = shared[place]
    owner, column, total = owner[here], column[place[here]], int(shared.sum())
    out = np.zeros((n, n), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, total, 4_096):
        low, high = np.searchsorted(column, [at, at + 4_096])
        flags = np.zeros((n, min(4_096, total - at)), dtype=np.float32)
        flags[owner[low:high], column[low:high] - at] = 1
        out += flags @ flags.T
    return np.rint(out).astype(np.int64)


def _verify(words: int, numerator: int, denominator: int):
    """Exact links within each tile: ``a, b`` spanning edges, ``a, null, links`` counts."""

    def run(batches):
        vacate()
        hasher = WordHasher()
        for table, edges in runs(batches, "component"):
            nodes, parts = table.column("node").to_numpy(), table.column("part").to_numpy()
            copies = table.column("copies").to_numpy()
            left, right, links = [], [], []
            for at, end in zip(edges[:-1], edges[1:]):
                sets = [hasher.shingles(t, words) for t in table.column("text").slice(at, end - at).to_pylist()]
                sizes = np.array([len(s) for s in sets])
                both = overlaps(sets)
                linked = both * denominator >= (sizes[:, None] + sizes[None, :] - both) * numerator
                np.fill_diagonal(linked, False)
                part = parts[at:end]
                if part.min() != part.max():  # pairs within one chunk belong to that chunk's own tile
                    linked &= part[:, None] != part[None, :]
                elif table.column("low")[at].as_py() != table.column("high")[at].as_py():
                    linked[:] = False
                some = nodes[at:end]
                for i, j in forest(len(some), lambda u, others: linked[u, others]):  # noqa: B023
                    left.append(some[i]), right.append(some[j]), links.append(0)
                counts = linked.astype(np.int64) @ copies[at:end]
                for i in np.flatnonzero(counts):
                    left.append(some[i]), right.append(None), links.append(counts[i])
            cols = [pa.array(c, pa.int64()) for c in (left, right, links)]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "links"])

    return run


def jaccard_classes(
    docs: DataFrame, threshold: float = 0.8, words: int = 5, hashes: int = HASHES, band_rows: int = BAND_ROWS, tolerance: float = TOLERANCE,
    chunk: int = 2_048, verify_chunk: int = 256, doc_id: str = "doc_id", text: str = "text", row: str | None = None,
) -> DataFrame:
    """One row per document: ``__row, doc_id, class_id, links, keep``.

    Two documents are linked if the Jaccard similarity of their sets of ``words``-word
    shingles is at least ``threshold``. ``links`` counts the documents a document is linked to, copies included. A
    class is a connected group of linked documents; ``class_id`` is its least doc_id (a negative
    number if it has none) and ``keep`` marks the one document of it with the least (doc_id, row). ``row`` names a
    column of unique numbers of a written table; without it the documents are written with such numbers first.

    - Documents with equal sets are one node from the start; their number is carried along.
    - Bands of MinHash values make candidate buckets. Within a bucket pairs are compared value by value, and
      dropped as soon as the posterior probability of reaching the threshold is below ``tolerance``.
      What remains is kept as spanning edges, never as pairs.
    - The components of these edges are verified exactly, tile by tile. Only their texts are read again.

    A null or empty text, or one without words, has no shingle and is linked to none. A text of fewer
    words than a shingle is one shingle. Repeated rows and rows that share an id are documents of
    their own; null ids sort last. Other columns are not looked at. No rows give no rows.
    """
    share = Fraction(str(threshold))
    own = [F.col(row).alias(ROW)] if row else []
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *own)
    rows = rows if row else with_rows(rows, "documents")
    signed = materialize(rows.select(ROW, "doc_id", "text").mapInArrow(_sign(words, hashes, band_rows), SIGNED), "signed")

    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first")
    nodes = signed.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min(ROW).alias("node"), F.count("*").alias("copies"), first)
    nodes = materialize(nodes, "nodes")
    chosen = signed.select(F.col(ROW).alias("node"), "bands", "signature").join(nodes.select("node"), "node", "left_semi")
    chosen = materialize(chosen, "chosen")
    buckets = chosen.select("node", F.explode("bands").alias("bucket"))
    tiles = tiled(buckets, "bucket", "node", chunk).join(chosen.select("node", "signature"), "node")
    edges = gathered(tiles, "bucket", "node").mapInArrow(_candidates(least_matches(threshold, tolerance)), "a long, b long")
    groups = materialize(components(edges), "candidates")

    members = groups.select("node", "component").join(nodes.select("node", "copies"), "node")
    texts = keep_keys(rows.select(F.col(ROW).alias("node"), "text"), groups, "node")
    tiles = tiled(members, "component", "node", verify_chunk).join(texts, "node")
    verified = gathered(tiles, "component", "node").select("component", "low", "high", "part", "node", "copies", "text")
    verified = materialize(verified.mapInArrow(_verify(words, share.numerator, share.denominator), "a long, b long, links long"), "verified")
    links = verified.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    classes = components(verified.filter("b IS NOT NULL"))

    per_node = nodes.join(classes, "node", "left").join(links, "node", "left").select(
        "set_id", "first", F.coalesce("component", "node").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    per_node = materialize(per_node, "classes")
    heads = per_node.groupBy("component").agg(F.min("first").alias("head"))
    per_node = per_node.join(heads, "component").select("set_id", "links", F.col("head.doc_id").alias("head_id"), F.col(f"head.{ROW}").alias("head_row"))
    out = signed.select(ROW, "doc_id", "set_id").join(per_node, "set_id", "left")
    own = F.coalesce("head_row", ROW)
    return out.select(
        ROW, "doc_id", F.coalesce("head_id", F.when(F.col("set_id").isNull(), F.col("doc_id")), -1 - own).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"), (own == F.col(ROW)).alias("keep"),
    )
