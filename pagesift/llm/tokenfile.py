"""Token ids in files of compressed bit or byte planes.

A file set is a folder with two tables. ``chunks`` holds one row per chunk: the payload, whole
documents in ascending order, and their lengths. ``index`` holds the same rows without
payload, to find a document's chunk. Spark's own writer carries the payloads, so that they are committed
whole on any store that executors can reach.

A payload is, in little-endian order: ``PLNS``, one byte version 1, one byte bits per plane (1 or
8), unsigned 32-bit ids per block, unsigned 64-bit number of ids; then the plane index, one
unsigned 32-bit compressed size per block and plane; then the planes, each compressed by zstandard alone.
Plane p of a block holds bits (or byte) p of each of its ids, least significant first.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .rows import slices
from .tokens import encoder

MAGIC, HEAD = b"PLNS", "<4sBBIQ"
BLOCK_IDS = 65_536
CHUNK_IDS = 4 * BLOCK_IDS
CHUNKS = "shard int, chunk int, ids_before long, n_ids long, doc_ids array<long>, doc_lengths array<long>, payload binary"


def _planes(ids: np.ndarray, bits: int) -> list[bytes]:
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [octets[:, p].tobytes() for p in range(4)]
    flags = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(flags[:, p], bitorder="little").tobytes() for p in range(32)]


def encode_chunk(ids: np.ndarray, bits: int = 8, block: int = BLOCK_IDS, level: int = 3) -> bytes:
    """The payload of some ids."""
    press = zstandard.ZstdCompressor(level=level)
    planes = [press.compress(p) for at in range(0, len(ids), block) for p in _planes(ids[at : at + block], bits)]
    sizes = np.array([len(p) for p in planes], dtype="<u4").tobytes()
    return struct.pack(HEAD, MAGIC, 1, bits, block, len(ids)) + sizes + b"".join(planes)


def decode_chunk(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a payload; only the blocks that hold them are decompressed."""
    magic, version, bits, block, total = struct.unpack_from(HEAD, payload)
    if magic != MAGIC or version != 1:
        raise ValueError("not a chunk of token planes")
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return np.empty(0, dtype="<u4")
    per_block, blocks = 32 // bits, -(-total // block)
    sizes = np.frombuffer(payload, "<u4", blocks * per_block, struct.calcsize(HEAD)).astype(np.int64)
    places = struct.calcsize(HEAD) + sizes.nbytes // 2 + np.concatenate([[0], np.cumsum(sizes)])
    open_, out = zstandard.ZstdDecompressor(), []
    for b in range(start // block, -(-stop // block)):
        n = min(block, total - b * block)
        planes = [
            np.frombuffer(open_.decompress(payload[places[p] : places[p + 1]]), np.uint8) for p in range(b * per_block, (b + 1) * per_block)
        ]
        if bits == 1:
            flags = np.stack([np.unpackbits(p, count=n, bitorder="little") for p in planes], axis=1)
            octets = np.packbits(flags, axis=1, bitorder="little")
        else:
            octets = np.stack(planes, axis=1)
        out.append(np.ascontiguousarray(octets).view("<u4").reshape(-1))
    first = start // block * block
    return np.concatenate(out)[start - first : stop - first]


def _write(path: str, end_id: int, bits: int, chunk_ids: int):
    def run(batches):
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        chunk = before = held = 0
        docs, lengths, parts = [], [], []

        def flush():
            nonlocal chunk, before, held, docs, lengths, parts
            payload = encode_chunk(np.frombuffer(b"".join(parts), "<u4"), bits)
            row = [[shard], [chunk], [before], [held], [docs], [lengths], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "chunk", "ids_before", "n_ids", "doc_ids", "doc_lengths", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names=names)
            chunk, before, held = chunk + 1, before + held, 0
            docs, lengths, parts = [], [], []

        for part, texts in slices(batches, "text"):
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoder(path).encode(texts)):
                docs.append(doc)
                lengths.append(len(ids) // 4 + 1)
                parts += [ids, end]
                held += lengths[-1]
                if held >= chunk_ids:
                    yield from flush()
        if docs:
            yield from flush()

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, bits: int = 8, chunk_ids: int = CHUNK_IDS,
    doc_id: str = "doc_id", text: str = "text",
) -> None:
    """Write the ids of all documents, in ascending ``doc_id`` order, each followed by ``end_id``.

    The texts are shuffled once, by ranges of (doc_id, hash of the text), and encoded behind the shuffle, where the
    order is known; a shard is one range. Rows that share an id are ordered by that hash, so one
    id on very many rows does not fill one shard. A null id comes first, a null text is empty, repeated rows stay. An empty table gives an
    empty file set.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    placed = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    made = placed.mapInArrow(_write(tokenizer, end_id, bits, chunk_ids), CHUNKS)
    made.write.option("compression", "none").parquet(f"{path}/chunks")
    index = docs.sparkSession.read.schema(CHUNKS).parquet(f"{path}/chunks").drop("payload")
    index.write.parquet(f"{path}/index")


def _bases(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each shard: one number per shard."""
    index = spark.read.parquet(f"{path}/index")
    rows, before = [], 0
    for r in sorted(index.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()):
        rows.append((r["shard"], before))
        before += r["n"]
    return spark.createDataFrame(rows, "shard int, base long")


def _read(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            lengths = row["doc_lengths"]
            at, block = 0, 0
            while at < len(lengths):  # some documents at a time
                end, size = at, 0
                while end < len(lengths) and (end == at or size + lengths[end] <= 1 << 20):
                    size += lengths[end]
                    end += 1
                data = decode_chunk(row["payload"], block, block + size).tobytes()
                edges = np.concatenate([[0], np.cumsum(lengths[at:end])]).astype(np.int64)
                ids = [data[4 * a : 4 * b] for a, b in zip(edges, edges[1:])]
                columns = [
                    pa.array([row["shard"]] * (end - at), pa.int32()), pa.array(row["doc_ids"][at:end], pa.int64()),
                    pa.array(row["ids_before"] + block + edges[:-1], pa.int64()), pa.array(lengths[at:end], pa.int64()), pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "in_shard", "n_tokens", "ids"])
                at, block = end, block + size


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents ``doc_id, start, n_tokens, ids`` of a file set; ``start`` counts the ids of all documents before.

    Null ids, repeated rows and empty texts (the end id alone) come back as they were written; an empty file set gives no rows.
    """
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    docs = chunks.mapInArrow(_read, "shard int, doc_id long, in_shard long, n_tokens long, ids binary")
    bases = F.broadcast(_bases(spark, path))  # one row per shard
    return docs.join(bases, "shard").select("doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "ids")


def read_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The rows of one document, by way of the index: only the chunks that hold it are decoded. All rows that share the id; none if there is none."""
    holds = F.array_contains("doc_ids", F.lit(doc_id).cast("long"))
    found = spark.read.parquet(f"{path}/index").filter(holds).select("shard", "chunk")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").filter(holds).join(found, ["shard", "chunk"], "left_semi")
    docs = chunks.mapInArrow(_read, "shard int, doc_id long, in_shard long, n_tokens long, ids binary").filter(F.col("doc_id") == doc_id)
    return docs.join(F.broadcast(_bases(spark, path)), "shard").select("doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "ids")
