"""Documents to sentences and terms, and the corpus job for abbreviations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..plans import joins
from ..plans.materialize import materialize
from ..plans.unnest import unnest


LITERAL_STOPWORDS = 20_000
TASK_TEXT, TASK_TERMS = 16 << 20, 4_000_000  # bytes of text, or terms, that one task may count


@dataclass(frozen=True)
class TextSettings:
    """Text processing parameters of a crawl."""

    rules: tuple = T.DEFAULT_RULES
    abbreviations: tuple = T.DEFAULT_ABBREVIATIONS
    starters: tuple = ()  # words that mostly begin a sentence
    pairs: tuple = ()  # (word, word) with a period between that ends none
    stopwords: tuple | DataFrame = T.DEFAULT_STOPWORDS  # words, or a table with the column ``stopword``
    language: str = "german"
    ngram_range: tuple = (1, 2)
    vectorizer: str = "count"
    tokenizer: object = field(default=None)  # Column -> Column, replaces tokens and stems


def with_rules(docs: DataFrame, settings: TextSettings = TextSettings(), text: str = "text") -> DataFrame:
    """Rewrite ``text`` by the ordered rules; rules that do not compile are skipped."""
    rules = T.usable_rules(docs.sparkSession, settings.rules)
    return docs.withColumn(text, T.apply_rules(F.col(text), rules))


def to_sentences(docs: DataFrame, key: str, settings: TextSettings = TextSettings(), text: str = "text", keep_empty: bool = False) -> DataFrame:
    """Rows ``(key, sent_no, sentence)``. ``keep_empty`` keeps a document without sentences as one NULL row."""
    ruled = with_rules(docs.select(key, text), settings, text)
    split = ruled.withColumn("_s", T.sentences(F.col(text), settings.abbreviations, settings.starters, settings.pairs))
    return unnest(split, [key], "_s", "sentence", "sent_no", keep_empty)


def resolved(settings: TextSettings, limit: int = LITERAL_STOPWORDS) -> TextSettings:
    """Settings whose stopword table, if it has at most ``limit`` words, is read once and goes into plans as a list.

    A longer table stays a table; :func:`with_tokens` then joins it. The tokens are the same.
    """
    table = settings.stopwords
    if not isinstance(table, DataFrame):
        return settings
    rows = table.select("stopword").distinct().limit(limit + 1).collect()
    return settings if len(rows) > limit else replace(settings, stopwords=tuple(sorted(r["stopword"] for r in rows if r["stopword"])))


def with_tokens(sentences: DataFrame, settings: TextSettings = TextSettings(), key: str = "doc_id") -> DataFrame:
    """Add ``tokens``: cleaned words without stopwords, in order. ``key`` and ``sent_no`` name a sentence."""
    settings = resolved(settings)
    if isinstance(settings.stopwords, DataFrame):
        return remove_stopwords(sentences.withColumn("tokens", T.tokens(F.col("sentence"))), settings.stopwords, key)
    return sentences.withColumn("tokens", T.tokens(F.col("sentence"), settings.stopwords))


def with_terms(sentences: DataFrame, settings: TextSettings = TextSettings(), key: str = "doc_id") -> DataFrame:
    """Add ``terms``: the n-grams of the stemmed tokens of each sentence."""
    if settings.tokenizer is not None:
        stemmed = sentences.withColumn("_stems", settings.tokenizer(F.col("sentence")))
    else:
        stemmed = with_tokens(sentences, settings, key).withColumn("_stems", T.stems(F.col("tokens"), settings.language)).drop("tokens")
    low, high = settings.ngram_range
    return stemmed.withColumn("terms", T.ngrams(F.col("_stems"), low, high)).drop("_stems")


def remove_stopwords(sentences: DataFrame, stopwords: DataFrame, key: str) -> DataFrame:
    """``tokens`` without the words of a stopword *table*, for lists too long for a literal. Order and repeats are kept.

    Up to BROADCAST_ROWS words and BROADCAST_BYTES, which are measured, the list goes to the tasks as an Arrow array and no sentence
    moves. Beyond that each distinct word of a sentence is looked up by a join, and the words to drop are gathered per
    sentence; sentences without such a word do not meet another row. The tokens are the same.
    """
    listed = stopwords.select("stopword").filter("stopword IS NOT NULL").distinct()
    rows, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("stopword").cast("long")), F.lit(0))).first()
    if rows <= joins.BROADCAST_ROWS and size <= joins.BROADCAST_BYTES:
        words = pa.array([r["stopword"] for r in listed.toLocalIterator()], pa.string())
        return sentences.mapInArrow(_without(sentences.sparkSession.sparkContext.broadcast(words)), sentences.schema)
    words = unnest(sentences.select(key, "sent_no", F.array_distinct("tokens").alias("_words")), [key, "sent_no"], "_words", "stopword")
    gone = words.join(listed, "stopword", "left_semi").groupBy(key, "sent_no").agg(F.collect_set("stopword").alias("_gone"))
    kept = F.filter("tokens", lambda w: ~F.array_contains(F.col("_gone"), w))
    out = sentences.join(gone, [key, "sent_no"], "left")
    return out.withColumn("tokens", F.when(F.col("_gone").isNull(), F.col("tokens")).otherwise(kept)).drop("_gone")


def _without(words):
    """Batches whose ``tokens`` lack the words of a broadcast array."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("tokens")
            tokens = batch.column(at)
            edges = tokens.offsets.to_numpy()
            flat = tokens.values.slice(edges[0], edges[-1] - edges[0])
            keep = ~pc.is_in(flat, value_set=words.value).to_numpy(zero_copy_only=False)
            places = np.concatenate([[0], np.cumsum(keep)])[edges - edges[0]].astype(np.int32)
            left = pa.ListArray.from_arrays(pa.array(places), flat.filter(pa.array(keep)), mask=tokens.is_null())
            yield batch.set_column(at, "tokens", left)

    return run


def stem_dictionary(sentences: DataFrame, settings: TextSettings = TextSettings(), key: str = "doc_id") -> DataFrame:
    """Rows ``(token, stem)``: every distinct token is stemmed once."""
    words = unnest(with_tokens(sentences, settings, key), [], "tokens", "token").distinct()
    stem = T.stem_word(F.col("token")) if settings.language == "german" else F.col("token")
    return words.withColumn("stem", stem)


def abbreviation_scores(docs: DataFrame, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Word types that are mostly written with a period (Kiss and Strunk 2006).

    Rows ``(type, with_period, without_period, score, is_abbreviation)`` for every
    type seen with a final period. The score is the log likelihood ratio of the
    pair (type, period) times factors for length, inner periods and uses without
    period. Texts are read once: the counts are written, and the two totals, which are all that
    reaches the driver, are observed on the way.
    """
    words = docs.select(F.explode(F.split(F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")), " ")).alias("word"))
    # a period counts at the end of a word, before closing signs
    bare = words.select(F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "").alias("w")).filter(F.col("w").rlike(r"\p{L}"))
    ends = F.col("w").endswith(".")
    types = bare.groupBy(F.lower(F.regexp_replace("w", r"\.+$", "")).alias("type")).agg(
        F.count_if(ends).alias("with_period"), F.count_if(~ends).alias("without_period")
    )
    types, totals = materialize(types, "types", n=F.sum(F.col("with_period") + F.col("without_period")), periods=F.sum("with_period"))
    n, periods = totals["n"], totals["periods"]
    if not n or not periods:
        return types.limit(0).select("type", "with_period", "without_period", F.lit(0.0).alias("score"), F.lit(False).alias("is_abbreviation"))
    p = periods / (n + periods)  # share of periods among all tokens, each period a token
    q = 0.99
    a, ab = F.col("with_period") + F.col("without_period"), F.col("with_period")
    null_model = ab * F.log(F.lit(p)) + (a - ab) * F.log(F.lit(1 - p))
    period_model = ab * F.log(F.lit(q)) + (a - ab) * F.log(F.lit(1 - q))
    inner = F.length("type") - F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    letters = (F.length("type") - inner).cast("double")
    score = -2 * (null_model - period_model) * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("without_period").cast("double"))
    return (
        types.filter(ab > 0)
        .withColumn("score", F.round(score, 9))
        .withColumn("is_abbreviation", F.col("score") >= threshold)
    )


# --- the second stage: words around a period --------------------------------------------------
STARTER_SCORE, PAIR_SCORE = 30.0, 7.88  # of Kiss and Strunk 2006
MOST_LEARNED = 2_000  # words or pairs of one list that go into a plan


def _bits(k: Column, n: Column, p: Column) -> Column:
    """Log likelihood of k hits in n trials; none and all cost nothing where p says so."""
    hit = F.when(k > 0, k * F.log(p)).otherwise(0.0)
    return hit + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)


def association(first: Column, second: Column, both: Column, total: Column) -> Column:
    """Dunning's log likelihood ratio of ``second`` after ``first``, from counts as doubles; 0 where they repel each other."""
    p, p1, p2 = second / total, both / first, (second - both) / (total - first)
    score = -2 * (_bits(both, first, p) + _bits(second - both, total - first, p) - _bits(both, first, p1) - _bits(second - both, total - first, p2))
    return F.when((total > first) & (p1 > p), score).otherwise(0.0)


def period_words(docs: DataFrame, abbreviations: Sequence[str] = T.DEFAULT_ABBREVIATIONS, text: str = "text") -> DataFrame:
    """Words and word pairs around periods, as ``kind, first, second, n, score, learned``.

    ``starter``: a word (``second``) that follows sentence ends more often than chance, that is periods behind a word which is no listed
    abbreviation, no single letter and no number. ``pair``: two words that meet across the period of such a one, and do so
    more often than chance. Words are compared in lower case. Every count is over the whole corpus, combined before it is shuffled.
    """
    blank = F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")
    bare = lambda c: F.lower(F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    # A word is cleaned once, not as the first and as the second of a pair.
    word = lambda w: F.struct(bare(w).alias("w"), w.rlike(r"[\p{L}\p{N}]\.$").alias("period"))
    tokens = docs.select(F.transform(F.split(F.trim(blank), " "), word).alias("t"))
    follow = F.zip_with("t", F.slice("t", F.lit(2), F.size("t")), lambda a, b: F.struct(a["w"].alias("first"), a["period"].alias("period"), b["w"].alias("second")))
    pairs = unnest(tokens.select(follow.alias("p")), [], "p", "p").select("p.first", "p.period", "p.second")
    short = F.col("first").isin([a.lower() for a in abbreviations]) | (F.length("first") == 1) | ~F.col("first").rlike(r"\p{L}")
    counted = pairs.filter("first <> ''").withColumn("short", F.col("period") & short)
    counted = counted.groupBy("first", "second", "period", "short").agg(F.count("*").alias("n"))
    counted, totals = materialize(counted, "period-words", total=F.sum("n"), ends=F.sum(F.when(F.col("period") & ~F.col("short"), F.col("n"))))
    total, ends = float(totals["total"] or 0), float(totals["ends"] or 0)
    words = counted.groupBy(F.col("first").alias("second")).agg(F.sum("n").cast("double").alias("n2"))
    after = counted.filter("period AND second <> ''")
    starters = after.filter("NOT short").groupBy("second").agg(F.sum("n").cast("double").alias("n"))
    starters = starters.select(F.lit("starter").alias("kind"), F.lit("").alias("first"), "second", "n", F.lit(ends).alias("n1"))
    firsts = counted.filter("short").groupBy("first").agg(F.sum("n").cast("double").alias("n1"))
    both = after.filter("short").groupBy("first", "second").agg(F.sum("n").cast("double").alias("n"))
    both = both.join(firsts, "first").select(F.lit("pair").alias("kind"), "first", "second", "n", "n1")
    found = starters.unionByName(both).join(words, "second")
    score = F.round(association(F.col("n1"), F.col("n2"), F.col("n"), F.lit(total)), 6)
    limit = F.when(F.col("kind") == "starter", STARTER_SCORE).otherwise(PAIR_SCORE)
    return found.select("kind", "first", "second", F.col("n").cast("long").alias("n"), score.alias("score"), (score >= limit).alias("learned"))


def learn_sentences(docs: DataFrame, settings: TextSettings = TextSettings(), text: str = "text") -> TextSettings:
    """Settings with the abbreviations, starters and pairs of a corpus besides those they have.

    Of each list the MOST_LEARNED of highest score are taken (and both ways of writing, as a sentence may begin with them).
    """
    def top(rows: DataFrame, *columns: str) -> list:
        return rows.orderBy(F.desc("score"), *columns).limit(MOST_LEARNED).select(*columns).collect()

    types = abbreviation_scores(docs.select(text), text).filter("is_abbreviation")
    names = [w for r in top(types, "type") for w in (r["type"], r["type"].capitalize())]
    names = tuple(dict.fromkeys((*settings.abbreviations, *names)))
    around = period_words(docs, names, text).filter("learned")
    starters = tuple(r["second"].capitalize() for r in top(around.filter("kind = 'starter'"), "second"))
    pairs = top(around.filter("kind = 'pair'"), "first", "second")
    written = lambda w: dict.fromkeys((w, w.capitalize()))
    pairs = tuple((a, b) for r in pairs for a in written(r["first"]) for b in written(r["second"]))
    return replace(settings, abbreviations=names, starters=tuple(dict.fromkeys((*settings.starters, *starters))), pairs=tuple(dict.fromkeys((*settings.pairs, *pairs))))
