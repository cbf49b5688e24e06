"""The prefix trie of conversations, from padded matrices of turn numbers.

A conversation is a sequence of turns, a node of the trie a sequence that some conversation begins with. Conversations are
cut into segments of WIDTH turns, so a row is bounded however long one is; a segment carries the
hash of all turns before it. Segments are dealt to shards by ranges of (depth, that hash, turns). In a
shard they are a matrix with one column per depth: sorted by numpy's lexsort, the OR-accumulated changes from row to
row mark where the nodes of each column start, and reduceat adds up each column. Nodes that go
on over the border of two shards come out in parts, which are put together by their hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..plans.joins import lookup
from ..plans.materialize import materialize
from .rows import look_up

WIDTH = 32
SHARD = 16_384  # segments
NOBODY = (1 << 63) - 1
SPACES = r"[^\x20\x09-\x0D]+"
NODE = (
    "depth long, a long, b long, parent_a long, parent_b long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, ends string, part boolean, shard int"
)
MERGED = NODE.replace(", ends string, part boolean, shard int", "")
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_ids(rows: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` with ``turn_id``, 128 bits of the SHA-256 of role and text, and ``words`` in place of the two; nulls are empty."""
    said, words = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = F.concat(F.length(said).cast("string"), F.lit(":"), said, words)
    kept = [c for c in rows.columns if c not in (role, text)]
    return rows.select(
        *[F.col(f"`{c}`") for c in kept], F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("turn_id"),
        F.regexp_count(words, F.lit(SPACES)).cast("long").alias("words"),
    )


def running(df: DataFrame, group: str, order: Sequence[Column], sums: dict[str, Column], xors: dict[str, Column]) -> DataFrame:
    """``df`` with the sums and xors of the rows before each in its group, in order; a group may be of any size.

    Rows are placed by ranges of (group, order). Each place adds up its own rows; a group that goes on over
    several places gets what stood in those before, one number per place.
    """
    start, last = Window.unboundedPreceding, -1
    placed = materialize(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "placed")
    here = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(start, last)
    aggregates = {n: F.sum(c) for n, c in sums.items()} | {n: F.bit_xor(c) for n, c in xors.items()}
    out = placed.select("*", *[F.coalesce(a.over(here), F.lit(0)).alias(n) for n, a in aggregates.items()])
    totals = placed.groupBy("_part", group).agg(*[a.alias(f"_before_{n}") for n, a in aggregates.items()])
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(start, last)
    carried = [F.sum(f"_before_{n}").over(before).alias(f"_before_{n}") for n in sums] + [F.bit_xor(f"_before_{n}").over(before).alias(f"_before_{n}") for n in xors]
    first = F.row_number().over(Window.partitionBy(group).orderBy("_part")) > 1
    carried = totals.select("_part", F.col(group).alias("_group"), first.alias("_later"), *carried).filter("_later").drop("_later")
    carried = F.broadcast(carried)  # a row for each border of two places at most
    out = out.join(carried, (out["_part"] == carried["_part"]) & (out[group] == carried["_group"]), "left").drop("_part", "_group")
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.coalesce(f"_before_{n}", F.lit(0)))
    for n in xors:
        out = out.withColumn(n, F.col(n).bitwiseXOR(F.coalesce(f"_before_{n}", F.lit(0).cast("long"))))
    return out.drop(*[f"_before_{n}" for n in aggregates])


def _segments(turns: DataFrame, order: Sequence[str], width: int) -> DataFrame:
    """``conv, layer, a, b, more, turns``: up to ``width`` turns, the hash of those before, and whether more follow.

    A turn's two numbers are hashes of the turn and its place, the hash of a sequence is their xor.
    """
    places = [F.col(f"`{c}`").asc_nulls_first() for c in order] + [F.col("turn_id")]
    numbered = running(turns, "conv", places, {"pos": F.lit(1).cast("long")}, {})
    numbered = numbered.withColumn("x", F.xxhash64("turn_id", "pos")).withColumn("y", F.xxhash64(F.lit(7), "turn_id", "pos"))
    numbered = numbered.withColumn("layer", F.expr(f"pos div {width}"))
    # A turn that begins a later segment tells the one before that more follow.
    told = numbered.withColumn("layer", F.explode(F.when((F.col("pos") > 0) & (F.col("pos") % width == 0), F.array(F.col("layer") - 1, F.col("layer"))).otherwise(F.array("layer"))))
    own = F.col("layer") == F.expr(f"pos div {width}")
    cut = told.groupBy("conv", "layer").agg(
        F.bool_or(~own).alias("more"), F.sort_array(F.collect_list(F.when(own, F.struct("pos", "x", "y", "words")))).alias("turns"),
        F.bit_xor(F.when(own, F.col("x"))).alias("x"), F.bit_xor(F.when(own, F.col("y"))).alias("y"),
    )
    cut = materialize(cut.withColumn("turns", F.transform("turns", lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), t["words"].alias("words")))), "segments")
    zero = F.lit(0).cast("long")
    short = cut.filter("layer = 0").drop("x", "y").withColumn("a", zero).withColumn("b", zero)
    if cut.filter("layer > 0").isEmpty():
        return short
    later = cut.filter("more OR layer > 0").withColumnRenamed("x", "_x").withColumnRenamed("y", "_y")
    later = running(later, "conv", [F.col("layer")], {}, {"a": F.col("_x"), "b": F.col("_y")}).filter("layer > 0").drop("_x", "_y")
    return short.unionByName(later)


class Matrix:
    """The segments of one shard, sorted, as padded matrices; columns are counted from 1, column 0 is what stands before the segment."""

    def __init__(self, rows: pa.Table, sort: bool):
        rows = rows.combine_chunks()
        turns = rows.column("turns").combine_chunks()
        sizes = turns.value_lengths().to_numpy()
        flat = turns.flatten()
        width = int(sizes.max(initial=0))
        inside = np.arange(width) < sizes[:, None]
        self.x, self.y, self.words = (np.zeros((len(sizes), width), dtype=np.int64) for _ in range(3))
        for matrix, name in ((self.x, "x"), (self.y, "y"), (self.words, "words")):
            matrix[inside] = flat.field(name).to_numpy()
        self.rows, self.n = rows, sizes.astype(np.int64)
        for name in ("layer", "a", "b", "conv"):
            setattr(self, name, rows.column(name).to_numpy())
        self.more = rows.column("more").to_numpy(zero_copy_only=False)
        if sort:
            # Longer sequences come before those that they begin with, so a node's first row tells whether it has children.
            down = [np.where(inside, ~m, NOBODY) for m in (self.x, self.y)]
            columns = [d[:, k] for k in reversed(range(width)) for d in reversed(down)]
            self.order = np.lexsort([self.conv, ~self.more, *columns, self.b, self.a, self.layer])

    def common(self, first: int) -> np.ndarray:
        """Columns that each row shares with the row before it, -1 if they are of different origin; ``first`` for the first row."""
        out = np.full(len(self.n), first, dtype=np.int64)
        if len(out) > 1:
            inside = np.arange(self.x.shape[1]) < np.minimum(self.n[1:], self.n[:-1])[:, None]
            change = (self.x[1:] != self.x[:-1]) | (self.y[1:] != self.y[:-1]) | ~inside
            started = np.logical_or.accumulate(change, axis=1)
            apart = (self.layer[1:] != self.layer[:-1]) | (self.a[1:] != self.a[:-1]) | (self.b[1:] != self.b[:-1])
            out[1:] = np.where(apart, -1, (~started).sum(axis=1))
        return out


def _arrange(batches):
    """The rows of a shard in order; the first and the last are marked."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    order = Matrix(rows, sort=True).order
    rows = rows.take(pa.array(order)).combine_chunks()
    edge = np.zeros(len(order), dtype=bool)
    edge[[0, -1]] = True
    rows = rows.append_column("place", pa.array(np.arange(len(order)))).append_column("edge", pa.array(edge))
    rows = rows.append_column("shard", pa.array(np.full(len(order), TaskContext.get().partitionId(), dtype=np.int32)))
    yield from rows.to_batches(max_chunksize=4_096)


def _borders(shards: DataFrame) -> dict[int, tuple[int, int]]:
    """For each shard the columns that its first row shares with the row before, and those that the row behind shares with its last.

    Two rows of each shard come to the driver, and two numbers go back.
    """
    found = shards.filter("edge").select("shard", "place", "layer", "a", "b", "turns").collect()
    rows = sorted(found, key=lambda r: (r["shard"], r["place"]))
    shared, before = {}, None
    for row in rows:
        if row["place"] == 0:
            both = -1
            if before is not None and (before["layer"], before["a"], before["b"]) == (row["layer"], row["a"], row["b"]):
                pairs = zip(before["turns"], row["turns"])
                both = next((k for k, (t, u) in enumerate(pairs) if (t["x"], t["y"]) != (u["x"], u["y"])), min(len(before["turns"]), len(row["turns"])))
            shared[row["shard"]] = both
        before = row
    names = sorted(shared)
    return {s: (shared[s], shared[nxt] if nxt is not None else -1) for s, nxt in zip(names, [*names[1:], None])}


def _in_order(rows: pa.Table) -> Matrix:
    return Matrix(rows.sort_by("place"), sort=False)


def _own(borders: dict[int, tuple[int, int]]):
    """What each segment of a later layer adds to the nodes above it: words that it shares with the row before, and its leaf."""

    def run(rows: pa.Table) -> pa.Table:
        m = _in_order(rows)
        common = m.common(borders[rows.column("shard")[0].as_py()][0])
        sums = np.concatenate([np.zeros((len(m.n), 1), dtype=np.int64), np.cumsum(m.words, axis=1)], axis=1)
        saved = sums[np.arange(len(m.n)), np.maximum(common, 0)]
        leaf = ((common < m.n) & ~m.more).astype(np.int64)
        table = pa.table({"conv": m.conv, "layer": m.layer, "saved": saved, "leaves": leaf})
        return table.filter(pa.array(m.layer > 0))

    return run


def _nodes(borders: dict[int, tuple[int, int]], full: int):
    """The nodes of a shard; those that other shards or layers add to are parts."""

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        first, behind = borders[shard]
        m = _in_order(rows)
        width, count = m.x.shape[1], len(m.n)
        every = np.arange(count)
        common = m.common(first)
        sums = np.concatenate([np.zeros((count, 1), dtype=np.int64), np.cumsum(m.words, axis=1)], axis=1)
        below, leaves_below = m.rows.column("saved").to_numpy(), m.rows.column("leaves").to_numpy()
        shared = sums[every, np.maximum(common, 0)]
        leaf = ((common < m.n) & ~m.more) + leaves_below
        x = np.bitwise_xor.accumulate(np.concatenate([m.a[:, None], m.x], axis=1), axis=1)
        y = np.bitwise_xor.accumulate(np.concatenate([m.b[:, None], m.y], axis=1), axis=1)
        out: list[dict] = []
        above = None
        for k in range(width + 1):
            lead = np.flatnonzero((common < k) | (every == 0))
            has = m.n[lead] >= k
            end = np.append(lead[1:], count)
            add = lambda v: np.add.reduceat(v, lead)[has]  # noqa: E731, B023
            children = add(((common < k + 1) & (m.n >= k + 1)).astype(np.int64))
            low = np.minimum.reduceat(m.conv, lead)[has]
            ending = (m.n == k) & ~m.more
            n_ends = add(ending.astype(np.int64))
            lead, end = lead[has], end[has]
            top = m.layer[lead] == 0 if k == 0 else np.ones(len(lead), dtype=bool)  # of later layers only the children are new in column 0
            cuts = sums[every, max(k, 1) - 1]
            saved = np.where(common >= k, shared - cuts, 0) if k else shared
            part = ((lead == 0) & (first >= k)) | ((end == count) & (behind >= k)) | ~top
            if k == full:
                part |= np.logical_or.reduceat(m.more & (m.n >= k), np.flatnonzero((common < k) | (every == 0)))[has]
            if k:
                at = np.searchsorted(above["lead"], lead, side="right") - 1
                parent = np.where(above["part"][at], NOBODY, above["low"][at])
            else:
                parent = np.full(len(lead), NOBODY)
            ends, hashes = [None] * len(lead), [EMPTY] * len(lead)
            for i in np.flatnonzero((n_ends > 0) & top):
                text = ",".join(map(str, m.conv[end[i] - n_ends[i] : end[i]].tolist()))
                if part[i]:
                    ends[i] = text
                else:
                    hashes[i] = hashlib.sha256(text.encode()).hexdigest()
            zero = lambda v: np.where(top, v, 0)  # noqa: E731, B023
            out.append({
                "depth": m.layer[lead] * full + k, "a": x[lead, k], "b": y[lead, k], "parent_a": x[lead, max(k - 1, 0)], "parent_b": y[lead, max(k - 1, 0)],
                "conv_id": np.where(top, low, NOBODY), "parent_conv_id": parent, "n_convs": zero(end - lead), "n_children": children,
                "n_leaves": zero(np.add.reduceat(leaf, np.flatnonzero((common < k) | (every == 0)))[has]),
                "saved_tokens": zero(np.add.reduceat(saved + below, np.flatnonzero((common < k) | (every == 0)))[has]),
                "ends_sha256": hashes, "ends": ends, "part": part,
            })
            above = {"lead": lead, "low": low, "part": part}
        columns = {n: np.concatenate([o[n] for o in out]) for n in out[0] if n not in ("ends", "ends_sha256")}
        names = [f.split(" ")[0] for f in NODE.split(", ")]
        columns |= {n: pa.array([v for o in out for v in o[n]], pa.string()) for n in ("ends", "ends_sha256")}
        columns["shard"] = np.full(len(columns["depth"]), shard, dtype=np.int32)
        return pa.table({n: columns[n] for n in names})

    return run


def _merge(batches):
    """One node from its parts, which follow each other in the order of their shards; members' ids are hashed as they come."""
    names = [f.split(" ")[0] for f in MERGED.split(", ")]
    held, digest, ready = None, None, []

    def done():
        return (*held[:10], held[10], digest.hexdigest())

    for batch in batches:
        for r in batch.to_pylist():
            key = (r["depth"], r["a"], r["b"])
            if held is None or key != tuple(held[:3]):
                if held is not None:
                    ready.append(done())
                held, digest, any_end = [*key, r["parent_a"], r["parent_b"], NOBODY, NOBODY, 0, 0, 0, 0], hashlib.sha256(), False
            if r["n_convs"]:  # a part of the node itself, not only its children in the next layer
                held[3], held[4] = r["parent_a"], r["parent_b"]
            held[5], held[6] = min(held[5], r["conv_id"]), min(held[6], r["parent_conv_id"])
            for place, name in enumerate(("n_convs", "n_children", "n_leaves", "saved_tokens"), 7):
                held[place] += r[name]
            if r["ends"]:
                digest.update((("," if any_end else "") + r["ends"]).encode())
                any_end = True
        if len(ready) >= 4_096:
            yield _batch(ready, names)
            ready = []
    if held is not None:
        ready.append(done())
    if ready:
        yield _batch(ready, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if n == "ends_sha256" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def turn_trie(turns: DataFrame, order: Sequence[str] = ("turn",), conv_id: str = "conv_id", turnless: DataFrame | None = None, width: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """One row per node of the prefix trie of all conversations, from the table of :func:`turn_ids`.

    The turns of a conversation are ordered by the columns ``order`` (null first), ties by ``turn_id``. ``turnless``
    holds the ``conv_id`` of conversations without a turn, which are members of the root alone. ``width`` and ``shard`` bound the turns of
    a segment and the segments of a matrix; they change no result.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves``
    (childless nodes of the subtree), ``saved_tokens`` (over the subtree: words of a node's last turn times its members but one)
    and ``ends_sha256`` (of the members that end there: decimal ids in order, joined by commas). A node is told by ``conv_id`` and ``depth``.

    Rows without a ``conv_id`` take no part, repeated rows are turns of their own. Empty roles, empty texts and texts of any length are
    turns like others, of which only hash and number of words move. Other columns are not looked at. No conversations give no nodes.

    A hot conversation is many segments, a hot turn or a conversation that repeats very often is cut by ranges that end in conv_id.
    """
    spark = turns.sparkSession
    kept = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)]
    rows = turns.select(F.col(conv_id).cast("long").alias("conv"), *kept, "turn_id", "words").filter("conv IS NOT NULL")
    segments = _segments(rows, [f"o{i}" for i in range(len(order))], width)
    if turnless is not None:
        nothing = turnless.select(F.col(conv_id).cast("long").alias("conv")).filter("conv IS NOT NULL").distinct()
        fill = {"layer": "0L", "more": "false", "a": "0L", "b": "0L"}
        nothing = nothing.select("conv", *[F.expr(v).alias(n) for n, v in fill.items()], F.array().cast(segments.schema["turns"].dataType).alias("turns"))
        segments = segments.unionByName(nothing)
    segments, seen = materialize(segments, "trie-segments", n=F.count("*"), layers=F.max("layer"))
    if not seen["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    turns_of = F.transform("turns", lambda t: F.struct(t["x"], t["y"]))
    dealt = segments.repartitionByRange(-(-seen["n"] // shard), "layer", "a", "b", turns_of.desc(), F.desc("more"), "conv")
    schema = StructType([*dealt.schema.fields, *StructType.fromDDL("place long, edge boolean, shard int").fields])
    shards = materialize(dealt.mapInArrow(_arrange, schema), "shards")
    borders = _borders(shards)

    zero = F.lit(0).cast("long")
    if seen["layers"]:
        late = shards.filter("layer > 0").select("shard").distinct()  # a shard number each
        own = look_up(shards, materialize(late, "late"), "shard").groupBy("shard").applyInArrow(_own(borders), "conv long, layer long, saved long, leaves long")
        own = own.withColumnRenamed("saved", "_saved").withColumnRenamed("leaves", "_leaves")
        # Down the conversation from its end: what its later layers add, for each layer that has later ones.
        starts = segments.filter("more AND layer = 0").select("conv", "layer", zero.alias("_saved"), zero.alias("_leaves"))
        sums = running(own.unionByName(starts), "conv", [F.desc("layer")], {"saved": F.col("_saved"), "leaves": F.col("_leaves")}, {})
        below = materialize(sums.select("conv", "layer", "saved", "leaves"), "below")
        shards = shards.join(below, ["conv", "layer"], "left").fillna(0, ["saved", "leaves"])
    else:
        shards = shards.withColumn("saved", zero).withColumn("leaves", zero)

    nodes = materialize(shards.groupBy("shard").applyInArrow(_nodes(borders, width), NODE), "nodes")
    parts = nodes.filter("part").repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "shard")
    merged = materialize(parts.mapInArrow(_merge, MERGED), "merged-nodes")
    whole = nodes.filter("NOT part").drop("ends", "part", "shard").unionByName(merged)
    key = F.struct(F.col("depth").alias("depth"), F.col("a").alias("a"), F.col("b").alias("b")).alias("above")
    parents = merged.select(key, F.col("conv_id").alias("above_conv"), F.col("n_children").alias("heat"))
    lost = whole.filter((F.col("parent_conv_id") == NOBODY) & (F.col("depth") > 0))
    lost = lost.withColumn("above", F.struct((F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b")))
    found = lookup(lost, parents, "above", "left", heat="heat").withColumn("parent_conv_id", F.col("above_conv")).drop("above", "above_conv")
    known = whole.filter((F.col("parent_conv_id") != NOBODY) | (F.col("depth") == 0))
    known = known.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    return known.unionByName(found).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
