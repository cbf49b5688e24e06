"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks that go to different tasks. Two
neighbours share the window around their border. A place of the window is a proven border if

- it is a single blank between two characters that are not blanks: pre-tokenizers always
  cut there, whatever comes before or after, so the tokens on either side do not depend on
  the other side's text, and
- both encodings have a token that starts there, and the same tokens from there to the next such place.

With the first place that both share, the left chunk counts its tokens before it and the right
one those from it on. Where neighbours share none, that document is taken again with wider
overlaps and chunks, in the end whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.materialize import materialize
from .rows import ROW, slices, with_rows
from .tokens import encoder

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")
SEGMENTS = f"{ROW} long, number long, origin long, left_end long, right_end long, last boolean, part string"
MARKS = f"{ROW} long, border long, is_left boolean, places array<struct<place:long,print:long,before:long>>, total long"


def _whole(path: str):
    def run(batches):
        for part, texts in slices(batches, "text"):
            counts = [len(ids) // 4 for ids in encoder(path).encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def _segments(chunk: int, overlap: int):
    """Overlapping parts; ``left_end`` and ``right_end`` bound the windows shared with the neighbours."""

    def run(batches):
        for part, texts in slices(batches, "text", rows=16):
            for row, text in zip(part.column(ROW).to_pylist(), texts):
                count = max(1, -(-len(text) // chunk))
                for k in range(count):
                    a, b = max(0, k * chunk - overlap), min(len(text), (k + 1) * chunk + overlap)
                    left, right = min(len(text), k * chunk + overlap), (k + 1) * chunk - overlap
                    cols = [[row], [k], [a], [left], [right], [k == count - 1], [text[a:b]]]
                    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string()]
                    names = [ROW, "number", "origin", "left_end", "right_end", "last", "part"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return run


def proven(text: str, origin: int, low: int, high: int, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Borders of one encoding within ``low <= place < high``, each with a print of the tokens up to the next."""
    found = []
    for m in LONE_BLANK.finditer(text, max(0, low - origin - 1), high - origin):
        q = m.start()
        t = int(np.searchsorted(starts, q))
        # Offsets may leave out the blank; then the next token starts behind it.
        if q + origin >= low and t < len(starts) and starts[t] <= q + 1 and (t == 0 or ends[t - 1] <= q):
            found.append((q + origin, t))
    return [
        {"place": q, "print": zlib.crc32(np.ascontiguousarray(ids[t:after]).tobytes()), "before": t}
        for (q, t), (_, after) in zip(found, found[1:])
    ]


def _marks(path: str):
    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids, starts, ends = encoder(path).with_offsets(r["part"])
                where = lambda low, high: proven(r["part"], r["origin"], low, high, ids, starts, ends)  # noqa: B023, E731
                if r["number"]:
                    rows.append((r[ROW], r["number"], False, where(r["origin"], r["left_end"]), 0))
                if r["last"]:
                    rows.append((r[ROW], -1, True, [], len(ids)))
                else:
                    rows.append((r[ROW], r["number"] + 1, True, where(r["right_end"], r["origin"] + len(r["part"])), 0))
            place = pa.struct([("place", pa.int64()), ("print", pa.int64()), ("before", pa.int64())])
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(place), pa.int64()]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[ROW, "border", "is_left", "places", "total"])

    return run


def _spliced(marks: DataFrame) -> DataFrame:
    """``__row, n_tokens`` of each document; null where some neighbours share no proven border."""
    sides = marks.groupBy(ROW, "border").agg(
        F.max(F.when(F.col("is_left"), F.col("places"))).alias("l"), F.max(F.when(~F.col("is_left"), F.col("places"))).alias("r"),
        F.sum("total").alias("total"),
    )
    plain = lambda side: F.transform(side, lambda p: F.struct(p["place"].alias("place"), p["print"].alias("print")))
    common = F.array_min(F.array_intersect(plain("l"), plain("r")))
    before = lambda side: F.get(F.filter(side, lambda p: p["place"] == F.col("at.place")), F.lit(0))["before"]
    sides = sides.withColumn("at", common)
    share = F.when(F.col("border") == -1, F.col("total")).otherwise(before("l") - before("r"))
    return sides.withColumn("share", share).groupBy(ROW).agg(
        F.when(F.count("*") == F.count("share"), F.sum("share")).alias("n_tokens")
    )


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 1024, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    ``tokenizer`` is a ``.json`` file of tokenizers or a ``.model`` file of
    sentencepiece; special strings in texts are handled as the library does by default,
    none are added. Texts of up to ``chunk`` characters are counted where they are
    scanned, longer ones in chunks. An added token that holds a blank rules the chunks out, so then all texts are
    counted whole.

    A null text counts as empty. Repeated rows and null ids give a row each. Other
    columns are not looked at. No rows give no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    counts = "doc_id long, n_bytes long, n_tokens long"
    over = lambda df: df.withColumn("over_limit", F.col("n_tokens") > limit)
    if encoder(tokenizer).blank_in_added:
        return over(rows.mapInArrow(_whole(tokenizer), counts))
    huge = F.length("text") > chunk
    out = rows.filter(~huge).mapInArrow(_whole(tokenizer), counts)
    long = with_rows(rows.filter(huge), "long-texts")
    todo = long
    while True:
        parts = todo.select(ROW, "text").mapInArrow(_segments(chunk, overlap), SEGMENTS)
        parts = parts.repartition(ROW, "number")  # the chunks of one document go to many tasks
        marks = parts.mapInArrow(_marks(tokenizer), MARKS)
        done = materialize(_spliced(marks), "spliced")
        out = out.unionByName(long.drop("text").join(done.filter("n_tokens IS NOT NULL"), ROW).select("doc_id", "n_bytes", "n_tokens"))
        failed = done.filter("n_tokens IS NULL").select(ROW)
        if failed.isEmpty():
            return over(out)
        todo = long.join(failed, ROW, "left_semi")
        overlap *= 4
        chunk = max(4 * chunk, 4 * overlap)

