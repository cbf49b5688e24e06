import random

import pytest
from pyspark.sql import functions as F

from pagesift.functions import text as T
from pagesift.operators import sentences as S

VOWELS = "aeiouyäöü"


def stem_by_position(w):
    """The published rules on positions, the model for the line rewrites."""
    letters = list(w.replace("ß", "ss"))
    for i in range(1, len(letters) - 1):
        if letters[i] in "uy" and letters[i - 1] in VOWELS and letters[i + 1] in VOWELS:
            letters[i] = letters[i].upper()
    w = "".join(letters)

    def region(at):
        return next((i + 1 for i in range(at + 1, len(w)) if w[i] not in VOWELS and w[i - 1] in VOWELS), len(w))

    r1 = region(0)
    r1, r2 = max(r1, 3), region(r1)

    def has(ending, at):
        return w.endswith(ending) and len(w) - len(ending) >= at

    found = next((e for e in ("ern", "em", "er", "en", "es", "e", "s") if has(e, r1)), None)
    if found == "s":
        w = w[:-1] if w[-2] in "bdfghklmnrt" else w
    elif found:
        w = w[: -len(found)]
        w = w[:-1] if found in ("en", "es", "e") and w.endswith("niss") else w
    found = next((e for e in ("est", "en", "er", "st") if has(e, r1)), None)
    if found == "st":
        w = w[:-2] if len(w) >= 6 and w[-3] in "bdfghklmnt" else w
    elif found:
        w = w[: -len(found)]
    found = next((e for e in ("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik") if has(e, r2)), None)
    if found in ("isch", "ig", "ik"):
        w = w if w[: -len(found)].endswith("e") else w[: -len(found)]
    elif found:
        w = w[: -len(found)]
        if found in ("end", "ung"):
            w = w[:-2] if has("ig", r2) and not w.endswith("eig") else w
        elif found == "keit":
            w = w[:-4] if has("lich", r2) else w[:-2] if has("ig", r2) else w
        else:
            w = w[:-2] if has("er", r1) or has("en", r1) else w
    return w.translate(str.maketrans("UYäöü", "uyaou"))


def test_known_stems(spark):
    known = {
        "aufeinander": "aufeinand", "häuser": "haus", "bewegungen": "beweg", "ergebnissen": "ergebnis", "kategorien": "kategori",
        "beteiligung": "beteil", "freundlichkeit": "freundlich", "heiß": "heiss", "kindern": "kind",
    }
    df = spark.createDataFrame(list(known.items()), "w string, s string")
    assert df.filter(T.stem_word(F.col("w")) != F.col("s")).count() == 0


def test_stems_agree_with_positions(spark):
    rng = random.Random(7)
    parts = "er en ern em es e s st est niss nisse nis ung end ig eig ik isch lich heit keit a o u ü ei au y b d k l m n r t sch ß x".split()
    made = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(30000)})
    made = [w for w in made if len(w) > 1]
    lines = [made[i : i + 20] for i in range(0, len(made), 20)]
    df = spark.createDataFrame([(ws,) for ws in lines], "w array<string>").select("w", T.stems(F.col("w")).alias("s"))
    wrong = [(a, b, stem_by_position(a)) for r in df.collect() for a, b in zip(r.w, r.s, strict=True) if b != stem_by_position(a)]
    assert not wrong, wrong[:10]


def test_empty_and_foreign_stems(spark):
    df = spark.createDataFrame([([],), (["häuser"],)], "w array<string>")
    assert [r.s for r in df.select(T.stems(F.col("w")).alias("s")).collect()] == [[], ["haus"]]
    assert df.select(T.stems(F.col("w"), "english").alias("s")).collect()[1].s == ["häuser"]


def test_rules(spark):
    rules = [(r"(\w+)@(?P<d>\w+)", r"\g<d> at \1 $5"), ("[", "x"), *T.DEFAULT_RULES]
    good = T.usable_rules(spark, rules)
    assert len(good) == 4
    df = spark.createDataFrame([("me@home Bürger*innen Wort-\nteil\n\n neu",)], "t string")
    assert df.select(T.apply_rules(F.col("t"), good).alias("t")).first().t == "home at me $5 Bürgerinnen Wortteil  neu"


def test_sentences(spark):
    cases = {
        "Dr. Mayer kommt. Er geht!  Wann?! Ende": ["Dr. Mayer kommt.", "Er geht!", "Wann?!", "Ende"],
        "Prof. Dr. X sagt 3.5 m. Gut.": ["Prof. Dr. X sagt 3.5 m.", "Gut."],
        "": [], "   ": [],
    }
    df = spark.createDataFrame(list(cases.items()), "t string, e array<string>")
    for r in df.select("t", "e", T.sentences(F.col("t")).alias("s")).collect():
        assert r.s == r.e


def test_tokens_and_bigrams_bridge_stopwords(spark):
    df = spark.createDataFrame([("Die 2 Café-Häuser und der A Über Bürger",)], "s string")
    tok = df.select(T.tokens(F.col("s"), ("und", "die", "der")).alias("t"))
    assert tok.first().t == ["caf", "häuser", "über", "bürger"]
    grams = tok.select(T.ngrams(F.col("t"), 1, 3).alias("g")).first().g
    assert grams[:4] == ["caf", "häuser", "über", "bürger"]
    assert grams[4:] == ["caf häuser", "häuser über", "über bürger", "caf häuser über", "häuser über bürger"]
    assert spark.range(1).select(T.ngrams(F.array(F.lit("a")), 2, 3).alias("g")).first().g == []


def test_stopword_table_equals_literals(spark):
    docs = spark.createDataFrame([(1, "der Hund und der Hund. und der."), (2, "")], "doc_id long, text string")
    plain = S.TextSettings(stopwords=())
    sents = S.with_tokens(S.to_sentences(docs, "doc_id", plain), plain)
    table = spark.createDataFrame([("der",), ("und",)], "stopword string")
    joined = {(r.doc_id, r.sent_no): r.tokens for r in S.remove_stopwords(sents, table, "doc_id").collect()}
    literal = S.TextSettings(stopwords=("der", "und"))
    direct = {(r.doc_id, r.sent_no): r.tokens for r in S.with_tokens(S.to_sentences(docs, "doc_id", literal), literal).collect()}
    assert joined == direct == {(1, 0): ["hund", "hund"], (1, 1): []}


def test_custom_tokenizer(spark):
    settings = S.TextSettings(tokenizer=lambda c: F.split(F.lower(c), " "), ngram_range=(1, 1))
    df = spark.createDataFrame([(1, 0, "A bc")], "doc_id long, sent_no int, sentence string")
    assert S.with_terms(df, settings).first().terms == ["a", "bc"]


def test_abbreviations_are_found(spark):
    text = " ".join(["Herr Dr. Mayer und Dr. Huber gehen heim."] * 40 + ["Das Heim ist weit heim"] * 40)
    rows = {r.type: r for r in S.abbreviation_scores(spark.createDataFrame([(text,)], "text string")).collect()}
    assert rows["dr"].is_abbreviation and not rows["heim"].is_abbreviation


@pytest.mark.parametrize("name", ["bad"])
def test_unknown_vectorizer(spark, name):
    from pagesift.operators import features

    with pytest.raises(ValueError):
        features.vectors(None, None, "doc_id", name)


def test_stopwords_from_a_table_of_any_length(spark):
    docs = spark.createDataFrame([(1, "Der Hund und der Hund. Und der."), (2, ""), (3, "Und Ende.")], "doc_id long, text string")
    table = spark.createDataFrame([("der",), ("und",), ("und",), ("zwei worte",), (None,)], "stopword string")
    settings = S.TextSettings(stopwords=table)
    sents = S.to_sentences(docs, "doc_id", settings, keep_empty=True)
    short = S.resolved(settings)
    assert set(short.stopwords) == {"der", "und", "zwei worte"} and S.resolved(settings, 1) is settings
    words = lambda df: sorted((r.doc_id, r.sent_no, r.tokens) for r in df.filter("sent_no IS NOT NULL").collect())
    joined = S.remove_stopwords(sents.withColumn("tokens", T.tokens(F.col("sentence"))), table, "doc_id")
    assert words(joined) == words(S.with_tokens(sents, settings)) == [(1, 0, ["hund", "hund"]), (1, 1, []), (3, 0, ["ende"])]
    assert joined.count() == sents.count()


def test_learned_sentences(spark):
    """A word that is mostly written with a period is learned and ends no sentence, unless a word follows that mostly begins one."""
    texts = ["Er kam Mo. abends. Danach schlief er lang. Danach aß er viel. Sie kam Mo. mittags."] * 40 + ["Alle gehen weg. Danach kommen viele. Danach ist Ruhe hier."] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    probe = spark.createDataFrame([(1, "Wir kommen Mo. mittags. Es war Mo. Danach nicht.")], "doc_id long, text string")
    cut = lambda settings: [r.sentence for r in S.to_sentences(probe, "doc_id", settings).orderBy("sent_no").collect()]
    plain = S.TextSettings()
    assert cut(plain) == ["Wir kommen Mo.", "mittags.", "Es war Mo.", "Danach nicht."]
    learned = S.learn_sentences(docs, plain)
    assert "Mo" in learned.abbreviations and "Danach" in learned.starters
    assert cut(learned) == ["Wir kommen Mo. mittags.", "Es war Mo.", "Danach nicht."]
    pair = S.TextSettings(abbreviations=(), pairs=(("5", "Mai"), ("z.b", "so")))
    found = spark.createDataFrame([(1, "Am 5. Mai war es. Am 15. Mai auch. Oder 5. Juni. Also z.b. so.")], "doc_id long, text string")
    assert [r.sentence for r in S.to_sentences(found, "doc_id", pair).orderBy("sent_no").collect()] == [
        "Am 5. Mai war es.", "Am 15.", "Mai auch.", "Oder 5.", "Juni.", "Also z.b. so."]


def test_long_stopword_tables_move_no_sentence(spark, monkeypatch):
    from pagesift.plans import joins

    rows = [(1, 0, ["a", "b", "a", "c"], "x"), (1, 1, [], "y"), (None, 2, ["b", "d"], "z"), (3, None, None, None)]
    sents = spark.createDataFrame(rows, "doc_id long, sent_no int, tokens array<string>, more string").coalesce(1)
    table = spark.createDataFrame([("a",), ("d",), (None,), ("a",)], "stopword string")
    out = S.remove_stopwords(sents, table, "doc_id")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.more: r.tokens for r in out.collect()}
    assert got == {"x": ["b", "c"], "y": [], "z": ["b"], None: None}
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    assert {r.more: r.tokens for r in S.remove_stopwords(sents.filter("doc_id = 1"), table, "doc_id").collect()} == {"x": ["b", "c"], "y": []}
