"""Vocabulary and sparse sentence vectors as long tables.

A vector is rows ``(key, sent_no, term, weight)``. Every sentence has one more row with a
NULL term and weight 0, so one without a known term still votes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, Window as W

from ..plans.joins import PLACE, lookup
from ..plans.materialize import materialize
from ..plans.ranking import global_rank, ranked

VECTORIZERS = ("count", "tfidf")


def term_statistics(sentence_terms: DataFrame) -> DataFrame:
    """Rows ``(term, n_total, n_sentences)``.

    Occurrences and first occurrences per sentence are exploded together, so both
    counts come from one shuffle with map-side combine and no distinct count.
    """
    def occurrence(total: int, first: int):
        return lambda t: F.struct(t.alias("term"), F.lit(total).alias("c"), F.lit(first).alias("s"))

    both = F.concat(
        F.transform("terms", occurrence(1, 0)),
        F.transform(F.array_distinct("terms"), occurrence(0, 1)),
    )
    return (
        sentence_terms.select(F.explode(both).alias("o"))
        .groupBy(F.col("o.term").alias("term"))
        .agg(F.sum("o.c").cast("long").alias("n_total"), F.sum("o.s").cast("long").alias("n_sentences"))
    )


def vocabulary(sentence_terms: DataFrame, feature_percentage: float = 1.0) -> DataFrame:
    """Rows ``(term, n_total, n_sentences, term_id)``, ids in term order.

    Below 1, ``feature_percentage`` keeps the first floor(n * share) terms by count,
    then by term, and ids are given anew.
    """
    stats = term_statistics(sentence_terms)
    if feature_percentage < 1:
        stats, n_terms = ranked(stats, [F.desc("n_total"), F.asc("term")], "_rank", "terms")
        stats = stats.filter(F.col("_rank") < math.floor(n_terms * feature_percentage)).drop("_rank")
    return materialize(global_rank(stats, [F.asc("term")], "term_id", "vocabulary"), "vocabulary")


def training_summary(sentences: DataFrame, full: DataFrame, reduced: DataFrame) -> DataFrame:
    """One row ``(sentences, features, reduced_features)``."""
    parts = [
        d.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        for name, d in (("sentences", sentences), ("features", full), ("reduced_features", reduced))
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.agg(*[F.max(F.when(F.col("what") == c, F.col("n"))).alias(c) for c in ("sentences", "features", "reduced_features")])


def known_terms(
    sentence_terms: DataFrame, vocab: DataFrame, key: str, columns: list[str], vocab_rows: int | None = None, keep_place: bool = False,
) -> DataFrame:
    """Exploded known terms with the given vocabulary columns, and one row of NULLs per sentence; unknown terms are left out before they move."""
    return lookup(with_marks(sentence_terms, key), vocab.select("term", "n_total", *columns), "term", "left", vocab_rows, "n_total", misses=False, keep_place=keep_place)


def with_marks(sentence_terms: DataFrame, key: str) -> DataFrame:
    """Rows ``(key, sent_no, term)``, one per term and one of a NULL term per sentence."""
    marked = F.concat(F.coalesce("terms", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    return sentence_terms.select(key, "sent_no", F.explode(marked).alias("term"))


def count_vectors(sentence_terms: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """Rows ``(key, sent_no, term_id, term, weight)`` with the number of occurrences. Where the terms were moved to a large vocabulary they are counted there."""
    rows = known_terms(sentence_terms, vocab, key, ["term_id"], keep_place=True)
    place = [PLACE] if PLACE in rows.columns else []
    counts = rows.groupBy(key, "sent_no", "term_id", "term", *place).agg(F.count("term_id").cast("double").alias("weight"))
    return counts.drop(*place)


def only_known(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("term_id").isNotNull())


def tfidf_vectors(sentence_terms: DataFrame, vocab: DataFrame, key: str, n_sentences: int) -> DataFrame:
    """Count times smoothed idf, scaled to length 1 per sentence.

    The counts are shuffled by sentence, which serves both the count and the norm.
    ``n_sentences`` is the size of the training set, zero vectors included.
    """
    idf = F.log((1.0 + n_sentences) / (1.0 + F.col("n_sentences"))) + 1.0
    rows = known_terms(sentence_terms, vocab.withColumn("idf", idf), key, ["term_id", "idf"])
    known = F.when(F.col("term_id").isNotNull(), F.col("term"))
    weights = (
        rows.repartition(key, "sent_no")
        .groupBy(key, "sent_no", "term_id", known.alias("term"))
        .agg((F.count("term_id") * F.coalesce(F.max("idf"), F.lit(0.0))).alias("raw"))
    )
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key, "sent_no")))
    return weights.withColumn("_norm", norm).select(
        key, "sent_no", "term_id", "term", F.when(F.col("_norm") > 0, F.col("raw") / F.col("_norm")).otherwise(0.0).alias("weight")
    )


def vectors(sentence_terms: DataFrame, vocab: DataFrame, key: str, vectorizer: str = "count", n_sentences: int | None = None) -> DataFrame:
    """Vectors of the chosen kind; any other name is an error."""
    if vectorizer not in VECTORIZERS:
        raise ValueError(f"vectorizer {vectorizer!r} unknown, choose between 'count' and 'tfidf'")
    if vectorizer == "count":
        return count_vectors(sentence_terms, vocab, key)
    if n_sentences is None:
        raise ValueError("tfidf needs n_sentences, the number of training sentences")
    return tfidf_vectors(sentence_terms, vocab, key, n_sentences)
