"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .rows import slices
from .tokens import encoder

BLOCK_DOCS = 4_096
BLOCK_IDS = 8 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def balance(lengths: np.ndarray, size: int, linear: float = 1.0, quadratic: float = 1.0) -> list[list[tuple[int, int, int]]]:
    """Sequences ``[(item, start, length), ...]`` of at most ``size`` tokens from items shorter than that.

    A piece of n tokens costs ``linear * n + quadratic * n * n / size``: the attention of a
    piece looks at itself only. Items go, the dearest first, to the cheapest sequence that
    still has room. There are just as many sequences as the tokens need; what fits nowhere
    whole at the end is cut along the free room, and the sequence with least tokens then fills
    the gaps of the others, so that one sequence at most is not full. That one is cut at powers of
    two, which need no padding.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    count = -(-int(lengths.sum()) // size)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    if not count:
        return bins
    free, cost, rest = np.full(count, size, dtype=np.int64), np.zeros(count), []
    for item in np.argsort(-lengths, kind="stable"):
        n = int(lengths[item])
        if n == 0:
            continue
        best = int(np.argmin(np.where(free >= n, cost, np.inf)))
        if free[best] < n:
            rest.append(int(item))
            continue
        bins[best].append((int(item), 0, n))
        free[best] -= n
        cost[best] += linear * n + quadratic * n * n / size

    roomy = [int(b) for b in np.argsort(-free, kind="stable")]

    def pour(item: int, start: int, n: int) -> None:
        """Cut a piece along the free room, the roomiest sequence first."""
        while n:
            while not free[roomy[0]]:
                roomy.pop(0)
            b = roomy[0]
            part = min(n, int(free[b]))
            bins[b].append((item, start, part))
            free[b] -= part
            start, n = start + part, n - part

    for item in rest:
        pour(item, 0, int(lengths[item]))
    last = int(np.argmax(free))  # the emptiest gives its pieces to the gaps of the others
    roomy = [b for b in roomy if b != last]
    gaps = int(free.sum() - free[last])
    while gaps:
        item, start, n = bins[last].pop()
        moved = min(n, gaps)
        if moved < n:
            bins[last].append((item, start, n - moved))
        pour(item, start + n - moved, moved)
        gaps -= moved
    tail, bins[last] = bins[last], []
    return [b for b in bins if b] + powers_of_two(tail, size)


def powers_of_two(pieces: list[tuple[int, int, int]], size: int) -> list[list[tuple[int, int, int]]]:
    """Cut the pieces of one sequence into sequences whose lengths are the binary digits of its length."""
    total = sum(n for _, _, n in pieces)
    if total == size:
        return [pieces]
    out, queue = [], pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        room = total & (1 << bit)
        if not room:
            continue
        seq = []
        while room:
            item, start, n = queue.pop()
            part = min(n, room)
            seq.append((item, start, part))
            if part < n:
                queue.append((item, start + part, n - part))
            room -= part
        out.append(seq)
    return out


def _pack(path: str, size: int, end_id: int, linear: float, quadratic: float):
    def run(batches):
        first = TaskContext.get().partitionId() << 32
        made, docs, held = 0, [], 0
        end = np.array([end_id], dtype="<u4").tobytes()

        def flush():
            nonlocal made
            remains = [len(ids) // 4 % size for _, ids in docs]
            groups = [[(i, k * size, size)] for i, (_, ids) in enumerate(docs) for k in range(len(ids) // 4 // size)]
            heads = [len(ids) // 4 // size * size for _, ids in docs]
            groups += [[(i, heads[i] + s, n) for i, s, n in seq] for seq in balance(np.array(remains), size, linear, quadratic)]
            rows = []
            for seq in groups:
                offset = 0
                for i, start, n in seq:
                    doc, ids = docs[i]
                    rows.append((doc, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, first + made, offset))
                    offset += n
                made += 1
            for at in range(0, len(rows), 2048):
                cols = list(zip(*rows[at : at + 2048]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for part, texts in slices(batches, "text"):
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoder(path).encode(texts)):
                docs.append((doc, ids + end))
                held += len(ids) // 4 + 1
                if len(docs) >= BLOCK_DOCS or held >= BLOCK_IDS:
                    yield from flush()
                    docs, held = [], 0
        yield from flush()

    return run


def pack(
    docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1.0,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` of all documents.

    ``ids`` holds the piece as little-endian unsigned 32-bit numbers. Every document ends with
    ``end_id``. Full sequences are cut from long documents, and the remainders of a block of
    documents (up to BLOCK_DOCS documents or BLOCK_IDS ids of one scan task) are balanced among the block's
    sequences. All is done where a document is scanned: nothing is shuffled and a task holds one block.

    A null or empty text is a document of the end id alone. Repeated rows and null ids
    are documents of their own. Other columns are not looked at. No rows give no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_pack(tokenizer, size, end_id, linear, quadratic), SCHEMA)
