"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. The vectors of three letters in a row, moved by
two, one and no places, are multiplied: the vector of that trigram. A document is the sum
of its trigram vectors, a language the sum of the unit vectors of its training documents, and a
document has the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .hashing import mix
from .rows import slices, vacate

DIMENSIONS = 1_024
TRAIN_ROWS = 20_000
UNKNOWN = "und"
CHANCE = 1e-6  # that a text unrelated to all languages reaches the noise level
COMMON_SHARE = 1e-3  # of a language's training documents that hold a trigram for it to be ordinary there
_PLACES = 1 << 22
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_WINDOW = 1 << 18


def _letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """+1/-1 vectors of code points, by a hash of (code point, dimension)."""
    x = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(dimensions, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(63)).astype(np.int8) * 2 - 1).astype(np.int8)


def bundles(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the trigram vectors of each text, and which texts have a letter.

    Counts times trigram vectors, for some thousand distinct trigrams of the batch at a time.
    """
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    points, owners, known = [], [], np.zeros(len(texts), dtype=bool)
    for i, text in enumerate(texts):
        plain = _NOT_LETTERS.sub(" ", text.lower()).strip()
        if plain:
            known[i] = True
            run = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            points.append(run)
            owners.append(np.full(len(run), i, dtype=np.int32))
    if not points:
        return out, known
    run, owner = np.concatenate(points), np.concatenate(owners)
    letters = np.unique(run)
    vectors = _letter_vectors(letters, dimensions)
    first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    code = np.searchsorted(letters, run).astype(np.int64)
    base = len(letters)
    inside = (owner[2:] == owner[:-2])
    grams = (code[:-2] * base + code[1:-1]) * base + code[2:]
    grams, of = grams[inside], owner[:-2][inside]
    distinct, place = np.unique(grams, return_inverse=True)
    for at in range(0, len(distinct), 4_096):
        some = distinct[at : at + 4_096]
        bound = (first[some // base // base] * second[some // base % base] * vectors[some % base]).astype(np.float32)
        here = (place >= at) & (place < at + len(some)) if len(distinct) > 4_096 else slice(None)
        counts = np.bincount(of[here].astype(np.int64) * len(some) + (place[here] - at), minlength=len(texts) * len(some))
        out += counts.reshape(len(texts), len(some)).astype(np.float32) @ bound
    return out, known


def _vectors(part, texts: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`bundles`; a very long text is summed over windows that share two characters."""
    pieces, owner = [], []
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - 2), _WINDOW):
            pieces.append(text[at : at + _WINDOW + 2])
            owner.append(i)
    if len(pieces) == len(texts):
        return bundles(texts, dimensions)
    out, known = np.zeros((len(texts), dimensions), dtype=np.float32), np.zeros(len(texts), dtype=bool)
    for i, piece in zip(owner, pieces):
        sums, some = bundles([piece], dimensions)
        out[i] += sums[0]
        known[i] |= some[0]
    return out, known


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _train(dimensions: int):
    def run(batches):
        vacate()
        sums: dict[str, np.ndarray] = {}
        for part, texts in slices(batches, "text", rows=128):
            found, known = _vectors(part, texts, dimensions)
            found = _unit(found)
            for i, lang in enumerate(part.column("lang").to_pylist()):
                if known[i]:
                    sums[lang] = sums.get(lang, 0) + found[i].astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([np.round(v * 1e6).astype(np.int64).tolist() for v in sums.values()], pa.list_(pa.int64()))],
                names=["lang", "sums"],
            )

    return run


@dataclass(frozen=True)
class LanguageModel:
    """Language names and their unit prototype vectors."""

    languages: tuple[str, ...]
    prototypes: np.ndarray

    def predict(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The columns of ``docs`` but those named here, and ``lang_pred``, ``score``.

        ``und`` and 0 for a text that is null or has no letter, and without any learned language.
        """
        kept = docs.drop("lang_pred", "score")
        plain = [f"c{i}" for i in range(len(kept.columns))]  # any column names pass through Arrow this way
        inner = kept.toDF(*plain)
        schema = StructType([*inner.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
        made = inner.mapInArrow(_predict(self.languages, self.prototypes, plain[kept.columns.index(text)]), schema)
        return made.toDF(*kept.columns, "lang_pred", "score")


def _predict(languages: tuple[str, ...], prototypes: np.ndarray, text: str):
    def run(batches):
        vacate()
        for part, texts in slices(batches, text, rows=128):
            found, known = _vectors(part, texts, prototypes.shape[1])
            if languages:
                cosines = _unit(found).astype(np.float64) @ prototypes.T
                best = cosines.argmax(axis=1)
                names = [languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                scores = np.where(known, np.clip(cosines.max(axis=1), 0, 1), 0.0)
            else:
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            part = part.append_column("lang_pred", pa.array(names, pa.string()))
            yield part.append_column("score", pa.array(scores, pa.float64()))

    return run


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text leaves no remainder; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def training_rows(docs: DataFrame, train_rows: int, text: str, lang: str) -> tuple[DataFrame, dict[str, float]]:
    """``lang, text`` of the rows that are learned from, and about how many there are of each language."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    shares = {k: min(1.0, train_rows / n) for k, n in sizes.items()}
    if any(s < 1 for s in shares.values()):
        limits = docs.sparkSession.createDataFrame([(k, int(s * (1 << 40))) for k, s in shares.items()], "lang string, below long")
        draw = F.shiftrightunsigned(F.xxhash64("text"), 24)
        rows = rows.join(F.broadcast(limits), "lang").filter(draw <= F.col("below")).select("lang", "text")  # one row per language
    return rows, {k: n * shares[k] for k, n in sizes.items()}


def train_language(
    docs: DataFrame, train_rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS, text: str = "text", lang: str = "lang"
) -> LanguageModel:
    """Prototypes from the rows whose ``lang`` and text are not null.

    At most about ``train_rows`` rows of each language are used, chosen by a hash of the
    text; a language with fewer is used whole. Only counts and prototypes, one row per language, reach
    the driver. Sums are rounded to integers, so their order does not matter. Empty texts and texts without a letter teach nothing, repeated
    rows teach each, columns of other names are not looked at, and without a labelled row the model knows no language.
    """
    rows, _ = training_rows(docs, train_rows, text, lang)
    partial = rows.mapInArrow(_train(dimensions), "lang string, sums array<long>")
    totals = partial.select("lang", F.posexplode("sums").alias("place", "v")).groupBy("lang", "place").agg(F.sum("v").alias("v")).collect()
    names = tuple(sorted({r["lang"] for r in totals}))
    table = np.zeros((len(names), dimensions))
    for r in totals:
        table[names.index(r["lang"]), r["place"]] = r["v"]
    return LanguageModel(names, _unit(table))


def noise_level(model: LanguageModel) -> float:
    """The score that a text unrelated to all of the model's languages reaches with probability CHANCE at most.

    Its cosine with a prototype is about normal, of variance 1 / dimensions, and the best of all languages is taken.
    """
    return float(np.sqrt(2 * np.log(max(len(model.languages), 1) / CHANCE) / model.prototypes.shape[1]))


def _places(text: str) -> np.ndarray:
    """The hashed places of the trigrams of a text, in order."""
    plain = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not plain:
        return np.empty(0, dtype=np.int64)
    run = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    code = (run[:-2] << np.uint64(42)) | (run[1:-1] << np.uint64(21)) | run[2:]
    return (mix(code) % np.uint64(_PLACES)).astype(np.int64)


def _holding(batches):
    """In how many documents of a language each place occurs, by slice."""
    vacate()
    for part, texts in slices(batches, "text"):
        found: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(part.column("lang").to_pylist(), texts):
            found.setdefault(lang, []).append(np.unique(_places(text)))
        for lang, places in found.items():
            place, n = np.unique(np.concatenate(places), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(place), pa.string()), pa.array(place), pa.array(n)], names=["lang", "place", "n"])


def ordinary_trigrams(docs: DataFrame, train_rows: int = TRAIN_ROWS, text: str = "text", lang: str = "lang") -> np.ndarray:
    """Sorted hashed places of the trigrams that are ordinary in some language.

    Those are held by at least two of its training documents and at least COMMON_SHARE of them. There are at most a few
    million places, whatever the input.
    """
    rows, sizes = training_rows(docs, train_rows, text, lang)
    if not sizes:
        return np.empty(0, dtype=np.int64)
    least = docs.sparkSession.createDataFrame([(k, max(2.0, n * COMMON_SHARE)) for k, n in sizes.items()], "lang string, least double")
    held = rows.mapInArrow(_holding, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    some = held.join(F.broadcast(least), "lang").filter("n >= least").select("place").distinct()  # one row per language
    return np.array(sorted(r["place"] for r in some.collect()), dtype=np.int64)


def _ordinary(known: np.ndarray, text: str, score: str, level: float):
    def run(batches):
        vacate()
        for part, texts in slices(batches, text):
            shares = []
            for value, t in zip(part.column(score).to_pylist(), texts):
                places = _places(t) if value < level else ()
                shares.append(float(np.isin(places, known).mean()) if len(places) else 0.0)
            yield part.append_column("ordinary", pa.array(shares, pa.float64()))

    return run


def with_ordinary(docs: DataFrame, known: np.ndarray, text: str, score: str, level: float) -> DataFrame:
    """The columns of ``docs`` and ``ordinary``: the share of ordinary trigrams in the text, 0 where the score is at least ``level``."""
    schema = StructType([*docs.schema.fields, StructField("ordinary", DoubleType())])
    return docs.mapInArrow(_ordinary(known, text, score, level), schema)
