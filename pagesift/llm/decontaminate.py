"""Benchmark decontamination: rare n-gram seeds join documents to items, Smith-Waterman alignment of words judges the pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.bitmaps import ROW_BITS, bits_for, may_be_in
from ..plans.joins import lookup
from ..plans.materialize import materialize
from .hashing import WordHasher
from .rows import ROW, look_up, slices, vacate, with_rows, worker_store

SEED_WORDS = 3
RARE = 16  # items that hold a rare seed, at most
TOGETHER = 512  # items that a row of candidates holds
KEPT_ITEMS = 20_000  # of a worker
BROADCAST_BYTES = 4 << 20  # of candidates in memory
LEAST_BITS = 1 << 24  # 2 MB: a small benchmark's bitmap is nearly empty, so hardly any gram passes by chance
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
LEAK = "item_id long, score double, first_word long, end_word long"


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of two word sequences, and the end of the passage's aligned part."""
    steps = GAP * np.arange(len(passage))
    row = np.zeros(len(passage) + 1)
    best, end = 0.0, 0
    for word in item:
        fresh = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        fresh = np.maximum(np.maximum(fresh, row[1:] + GAP), 0)
        # Gaps in the item: each place may come from any earlier one of the row, at a cost per step.
        row[1:] = np.maximum(np.maximum.accumulate(fresh - steps) + steps, 0)
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
    return best, end


def most(fits: np.ndarray) -> float:
    """The largest sum over a run of places, each of which counts as a match or as a mismatch."""
    sums = np.concatenate([[0.0], np.cumsum(np.where(fits, MATCH, MISMATCH))])
    return float((sums - np.minimum.accumulate(sums)).max())


class Item:
    """Words of an item as numbers, its distinct words, and its seeds in order with their places."""

    def __init__(self, words: np.ndarray, size: int, hasher: WordHasher):
        self.words = words
        self.known, self.at = np.unique(words, return_inverse=True)
        grams = hasher.grams(words, seed_size(len(words), size))
        self.places = np.argsort(grams, kind="stable")
        self.grams = grams[self.places]


def seed_size(words: int, size: int) -> int:
    """Words of an item's seeds: an item of fewer words is one seed."""
    return max(1, min(words, size))


def seeds_of(grams: np.ndarray, size: int) -> np.ndarray:
    """Grams of one size made different from those of another."""
    return (grams << np.uint64(2)) | np.uint64(size & 3)


class Seeds:
    """Some items and all their seeds, sorted, as pointers into them."""

    def __init__(self, items: list[tuple[int, Item]], words: int = SEED_WORDS):
        self.ids, self.items, self.words = [i for i, _ in items], [item for _, item in items], words
        grams = [seeds_of(item.grams, seed_size(len(item.words), words)) for item in self.items]
        owners = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        places = np.concatenate([np.empty(0, dtype=np.int64), *(item.places for item in self.items)])
        grams = np.concatenate([np.empty(0, dtype=np.uint64), *grams])
        order = np.argsort(grams, kind="stable")
        self.grams, self.owners, self.places = grams[order], owners[order], places[order]
        self.sizes = sorted({seed_size(len(item.words), words) for item in self.items})

    def bound(self, n: int, passage: np.ndarray) -> float:
        """No alignment of item ``n`` with the passage scores more.

        A place whose word the other side lacks costs at least a mismatch or a gap (which cost the same) on either side.
        """
        known, at = self.items[n].known, self.items[n].at
        place = np.minimum(np.searchsorted(known, passage), len(known) - 1)
        fits = known[place] == passage
        there = np.zeros(len(known), dtype=bool)
        there[place[fits]] = True
        return min(most(there[at]), most(fits))

    def leaks(self, words: np.ndarray, hasher: WordHasher, threshold: float) -> list[tuple]:
        """``(id, score, first_word, end_word)`` of the items that a document holds."""
        owners, starts = [], []
        for size in self.sizes:
            grams = seeds_of(hasher.grams(words, size), size)
            low = np.searchsorted(self.grams, grams, "left")
            hit = np.flatnonzero((low < len(self.grams)) & (self.grams[np.minimum(low, len(self.grams) - 1)] == grams))
            low = low[hit]
            times = np.searchsorted(self.grams, grams[hit], "right") - low
            seed = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
            owners.append(self.owners[seed])
            starts.append(np.repeat(hit, times) - self.places[seed])
        owner, start = np.concatenate(owners), np.concatenate(starts)
        if not len(owner):
            return []
        order = np.lexsort((start, owner))
        owner, start = owner[order], start[order]
        out = []
        for at, end in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]))):
            item = self.items[owner[at]].words
            slack = len(item) // 2 + 4
            lows, highs = np.maximum(start[at:end] - slack, 0), np.minimum(start[at:end] + len(item) + slack, len(words))
            breaks = np.flatnonzero(lows[1:] > np.maximum.accumulate(highs)[:-1]) + 1
            best = (0.0, 0, 0)
            for a, b in zip(np.concatenate([[0], breaks]), np.concatenate([breaks, [len(lows)]])):
                first, last = int(lows[a]), int(highs[a:b].max())
                if self.bound(owner[at], words[first:last]) < threshold * len(item):
                    continue
                score, stop = align(item, words[first:last])
                if score > best[0]:
                    best = (score, first, first + stop)
            score, first, stop = best
            if score >= threshold * len(item):
                _, back = align(item[::-1], words[first:stop][::-1])
                out.append((self.ids[owner[at]], score / len(item), stop - back, stop))
        return out


def _item_words(batches):
    """Words of each distinct item text, as little-endian 64-bit numbers; texts without a word are left out."""
    vacate()
    hasher = WordHasher()
    for part, texts in slices(batches, "text"):
        words = [hasher.words(t)[0] for t in texts]
        keep = [i for i, w in enumerate(words) if len(w)]
        columns = [part.column(ROW).take(pa.array(keep, pa.int64())), pa.array([words[i].astype("<u8").tobytes() for i in keep], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "words"])


def _item_seeds(size: int):
    def run(batches):
        vacate()
        hasher = WordHasher()
        for batch in batches:
            for at in range(batch.num_rows):
                words = np.frombuffer(batch.column("words")[at].as_py(), "<u8")
                n = seed_size(len(words), size)
                grams = np.unique(seeds_of(hasher.grams(words, n), n)).view(np.int64)
                item = np.full(len(grams), batch.column("item")[at].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(grams), pa.array(np.full(len(grams), n, dtype=np.int32))], names=["item", "gram", "words"])

    return run


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """A hashed bitmap of all seeds, of a size that is bounded whatever the benchmark's (32 MB): what the driver gets of it."""
    place = F.col("gram").bitwiseAND(bits - 1)
    rows = seeds.select(F.shiftright(place, 15).alias("row"), (place % ROW_BITS).alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows.collect():
        out[r["row"] * ROW_BITS // 8 : (r["row"] + 1) * ROW_BITS // 8] = np.frombuffer(r["bitmap"], np.uint8)
    return out


def _hits(bitmap, bits: int, sizes: list[int]):
    """Distinct grams of each document that may be seeds."""
    def run(batches):
        vacate()
        hasher, table = WordHasher(), bitmap.value
        for part, texts in slices(batches, "text"):
            ids = part.column(ROW).to_numpy()
            rows, grams = [], []
            for i, t in zip(ids, texts):
                words = hasher.words(t)[0]
                for n in sizes:
                    some = seeds_of(hasher.grams(words, n), n)
                    place = some & np.uint64(bits - 1)
                    some = np.unique(some[table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1])
                    rows.append(np.full(len(some), i, dtype=np.int64))
                    grams.append(some.view(np.int64))
            none = [np.empty(0, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows or none)), pa.array(np.concatenate(grams or none))], names=[ROW, "gram"])

    return run


def _judge(size: int, threshold: float):
    """Leaks of the documents' candidates."""
    def run(batches):
        vacate("items")
        hasher, kept = WordHasher(), worker_store("items").setdefault(size, {})
        for part, texts in slices(batches, "text"):
            out = []
            for row, text, items in zip(part.column(ROW).to_pylist(), texts, part.column("items").to_pylist()):
                known = []
                for item in items:
                    if item["words"] not in kept:
                        if len(kept) >= KEPT_ITEMS:
                            kept.clear()
                        kept[item["words"]] = Item(np.frombuffer(item["words"], "<u8"), size, hasher)
                    known.append((item["item"], kept[item["words"]]))
                out += [(row, *leak) for leak in Seeds(known, size).leaks(hasher.words(text)[0], hasher, threshold)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[ROW, "item", "score", "first_word", "end_word"])

    return run


def _beside(docs: DataFrame, wanted: DataFrame, n: int, size: int) -> DataFrame:
    """Documents joined with their ``n`` rows of candidates, which hold ``size`` bytes.

    An item's words repeat in them, so their files are some hundred times smaller than the rows are in memory: the files' size must not
    decide on a broadcast, neither here nor in Spark's planner. Too large for one, they meet those documents alone that a bitmap leaves.
    """
    if size <= BROADCAST_BYTES:
        return docs.join(F.broadcast(wanted), ROW)
    return may_be_in(docs, ROW, wanted, n).join(wanted.hint("merge"), ROW)


def find_leaks(
    rows: DataFrame, benchmark: DataFrame, threshold: float = 0.5, words: int = SEED_WORDS, rare: int = RARE,
    text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``__row, item_id, score, first_word, end_word`` of the test items that texts hold; ``rows`` is a written table with ``__row``.

    Seeds are the ``words``-word grams of an item (an item of fewer words is one seed). A leak is a text that holds a seed of an item
    and scores at least ``threshold`` times the item's words in a Smith-Waterman alignment with it over words, near its seeds: +1 for
    a match, -0.5 for a mismatch or a gap. The score is given as that share, with the place of the first aligned
    word and the end. Of several places with the same score the first counts. What is found in a text depends on that text and the items alone.

    - Documents keep grams that are in a hashed bitmap of all seeds, and these join the seeds. How rare a seed is, is told by how many items
      hold it, not by how often it leaked: seeds of at most ``rare`` items come first, then those of more items give the
      pairs that share no rare one. No pair is left out.
    - A pair is then judged by all seeds it shares, whichever found it, where an upper bound of the score allows.
    - Hot items and hot documents: items that repeat are judged once, a document's candidates go in rows of some hundred, and an
      item's words are looked up through a salted join. Candidates are broadcast only where their rows are small in memory.

    A null or empty text has no leaks, an item without a word is never found, items that repeat are found each, null ids are ids. Other
    columns are not looked at. No rows give no rows.
    """
    spark = rows.sparkSession
    docs = rows.select(ROW, F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text IS NOT NULL")
    distinct = with_rows(items.select("text").distinct(), "items")
    texts = materialize(distinct.mapInArrow(_item_words, "item long, words binary"), "item-words")
    seeds, seen = materialize(texts.mapInArrow(_item_seeds(words), "item long, gram long, words int"), "seeds", n=F.count("*"), sizes=F.collect_set("words"))
    if not seen["n"]:
        return spark.createDataFrame([], f"{ROW} long, {LEAK}")
    bits = max(bits_for(seen["n"]), LEAST_BITS)
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds, bits))
    hits = materialize(docs.mapInArrow(_hits(bitmap, bits, sorted(seen["sizes"])), f"{ROW} long, gram long"), "seed-hits")

    holders = seeds.groupBy("gram").agg(F.count("*").alias("holders")).filter(F.col("holders") > rare).select("gram")
    common = materialize(holders, "common-seeds")
    first = materialize(seeds.join(common, "gram", "left_anti").select("gram", "item"), "rare-seeds")
    second = materialize(seeds.join(common, "gram", "left_semi").select("gram", "item"), "common-seeds")
    pairs = materialize(look_up(hits, first, "gram").select(ROW, "item").distinct(), "pairs")
    others = look_up(hits, second, "gram").select(ROW, "item").distinct().join(pairs, [ROW, "item"], "left_anti")
    pairs = pairs.unionByName(others)

    sizes = pairs.groupBy(ROW).agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    held = lookup(pairs.join(sizes, ROW), texts, "item").withColumn("part", F.pmod(F.xxhash64("item"), "parts"))
    wanted = held.groupBy(ROW, "part").agg(F.collect_list(F.struct("item", "words")).alias("items"))
    bytes_ = F.aggregate("items", F.lit(0).cast("long"), lambda total, x: total + F.octet_length(x["words"]) + 48)
    wanted, seen = materialize(wanted.drop("part"), "candidates", n=F.count("*"), size=F.sum(bytes_))
    found = _beside(docs, wanted, seen["n"] or 0, seen["size"] or 0).select(ROW, "text", "items").mapInArrow(_judge(words, threshold), f"{ROW} long, item long, score double, first_word long, end_word long")
    ids = items.join(distinct, "text").select("item_id", F.col(ROW).alias("item"))
    return materialize(found, "leaks").join(ids, "item").select(ROW, "item_id", "score", "first_word", "end_word")


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, words: int = SEED_WORDS, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    out: str = "__leaks",
) -> DataFrame:
    """The columns of ``docs`` and ``out``, an array of the leaks of each row in the order of item id and place; see :func:`find_leaks`.

    Other columns pass through, whatever their names; one that is named ``out`` stays beside the new one.
    """
    names = docs.columns
    rows = with_rows(docs.toDF(*[f"c{i}" for i in range(len(names))]), "leak-docs")
    found = find_leaks(rows, benchmark, threshold, words, RARE, f"c{names.index(text)}", item_id, item_text)
    leaks = found.groupBy(ROW).agg(F.sort_array(F.collect_list(F.struct("item_id", "first_word", "end_word", "score"))).alias("leaks"))
    leaks = materialize(leaks.withColumn("leaks", F.transform("leaks", lambda x: F.struct(x["item_id"].alias("item_id"), x["score"].alias("score"), x["first_word"].alias("first_word"), x["end_word"].alias("end_word")))), "leaks")
    marked = lookup(rows, leaks, ROW).withColumn("leaks", F.coalesce("leaks", F.array().cast(leaks.schema["leaks"].dataType)))
    return marked.drop(ROW).toDF(*names, out)
