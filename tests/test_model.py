import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.operators import features, kernels, oneclass, sentences as S
from pagesift.plans import joins, ranking
from pagesift.plans.materialize import scratch_path

TEXTS = [
    (1, "Bürger beteiligen sich gern. Die Stadt plant Bürgerbeteiligung. Bürger planen mit."),
    (2, "Der Rat plant eine Straße. Bürger fragen den Rat. 123 456."),
    (3, "Die Straße ist lang. Die Stadt ist alt. Rat und Stadt planen."),
]


@pytest.fixture(scope="module")
def terms(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return S.with_terms(S.to_sentences(docs, "doc_id")).persist()


def matrix(terms, vocab):
    """Dense model of the sparse vectors: rows by (doc, sentence), columns by term id."""
    ids = {r.term: r.term_id for r in vocab.collect()}
    rows = sorted(terms.collect(), key=lambda r: (r.doc_id, r.sent_no))
    x = np.zeros((len(rows), len(ids)))
    for i, r in enumerate(rows):
        for t in r.terms:
            if t in ids:
                x[i, ids[t]] += 1
    return [(r.doc_id, r.sent_no) for r in rows], x


def frank_wolfe(gram, nu, steps):
    """Brute-force model of the solver on a dense kernel matrix."""
    n = len(gram)
    a, mass = np.full(n, 1 / n), nu * n
    k = max(1, math.ceil(mass - 1e-9))
    for t in range(steps):
        g = np.round(gram @ a, 9)
        lim = np.sort(g)[k - 1]
        below, same = (g < lim).sum(), (g == lim).sum()
        v = np.where(g < lim, 1 / mass, np.where(g == lim, (1 - below / mass) / same, 0))
        eta = 2 / (t + 3)
        a = (1 - eta) * a + eta * v
    g = np.round(gram @ a, 9)
    return a, g, np.sort(g)[k - 1]


def test_vocabulary_counts_ids_and_truncation(terms):
    full = features.vocabulary(terms)
    rows = {r.term: r for r in full.collect()}
    assert [r.term for r in sorted(rows.values(), key=lambda r: r.term_id)] == sorted(rows)
    assert rows["burg"].n_total == 3 and rows["burg"].n_sentences == 3
    top = features.vocabulary(terms, 0.5).collect()
    assert len(top) == math.floor(len(rows) * 0.5)
    best = sorted(rows.values(), key=lambda r: (-r.n_total, r.term))[: len(top)]
    assert {r.term for r in top} == {r.term for r in best}


def test_zero_vectors_are_kept(terms):
    vocab = features.vocabulary(terms)
    vecs = features.count_vectors(terms, vocab, "doc_id").collect()
    assert [(r.term, r.weight) for r in vecs if (r.doc_id, r.sent_no) == (2, 2)] == [(None, 0.0)]


def test_tfidf(terms):
    vocab = features.vocabulary(terms)
    keys, x = matrix(terms, vocab)
    df = (x > 0).sum(0)
    w = x * (np.log((1 + len(x)) / (1 + df)) + 1)
    norm = np.linalg.norm(w, axis=1, keepdims=True)
    w = np.divide(w, norm, out=np.zeros_like(w), where=norm > 0)
    got = np.zeros_like(w)
    for r in features.only_known(features.tfidf_vectors(terms, vocab, "doc_id", len(x))).collect():
        got[keys.index((r.doc_id, r.sent_no)), r.term_id] = r.weight
    assert np.allclose(got, w)


@pytest.mark.parametrize("steps", [0, 4])
def test_linear_fit_equals_brute_force(terms, steps):
    vocab = features.vocabulary(terms)
    keys, x = matrix(terms, vocab)
    a, g, rho = frank_wolfe(x @ x.T, 0.3, steps)
    model = oneclass.fit_linear(terms, vocab, "doc_id", 0.3, steps)
    w = {r.term_id: r.w for r in model.weights.collect()}
    assert np.allclose([w[i] for i in range(len(w))], x.T @ a)
    assert abs(model.rho - rho) < 1e-8
    votes = {(r.doc_id, r.sent_no): r.vote for r in oneclass.sentence_votes(terms, model, "doc_id").collect()}
    assert [votes[k] for k in keys] == [1 if s > rho else -1 for s in g]


def gram_of(kernel, x):
    dot, sq = x @ x.T, (x * x).sum(1)
    return {
        "linear": dot, "poly": (kernel.gamma * dot + kernel.coef0) ** kernel.degree, "sigmoid": np.tanh(kernel.gamma * dot + kernel.coef0),
        "rbf": np.exp(-kernel.gamma * (sq[:, None] + sq[None, :] - 2 * dot)),
    }[kernel.name]


def sparse_frank_wolfe(gram, nu, steps):
    """Brute-force model of the kernel solver: from the vertex of the first rows."""
    n = len(gram)
    mass, k = nu * n, max(1, int(np.ceil(nu * n - 1e-9)))
    a = np.where(np.arange(n) < k - 1, 1 / mass, 0.0)
    a[k - 1] = 1 - (k - 1) / mass
    for t in range(steps):
        order = np.argsort(np.round(gram @ a, 9), kind="stable")
        v = np.zeros(n)
        v[order[: k - 1]], v[order[k - 1]] = 1 / mass, 1 - (k - 1) / mass
        a = (1 - 2 / (t + 2)) * a + 2 / (t + 2) * v
    g = np.round(gram @ a, 9)
    return a, g, np.sort(g)[k - 1]


@pytest.mark.parametrize("name, steps", [("linear", 0), ("linear", 3), ("poly", 2), ("rbf", 3), ("sigmoid", 2)])
def test_kernel_fit_and_scoring_equal_brute_force(terms, name, steps):
    vocab = features.vocabulary(terms)
    keys, x = matrix(terms, vocab)
    kernel = kernels.Kernel(name, gamma=0.2, coef0=-0.5, degree=2)
    gram = gram_of(kernel, x)
    a, g, rho = sparse_frank_wolfe(gram, 0.3, steps)
    model = kernels.fit_kernel(terms, vocab, "doc_id", kernel, 0.3, steps)
    got = {(r.doc_id, r.sent_no): r.units / oneclass.UNIT for r in model.training.collect()}
    assert np.allclose([got[k] for k in keys], g, atol=2e-9) and abs(model.rho - rho) < 2e-9
    assert model.n_support == (a > 0).sum() and model.n_support <= max(steps, 1) * int(np.ceil(0.3 * len(x)))
    path = scratch_path(terms.sparkSession, "kernel")
    kernels.save_kernel_model(model, path)
    again = kernels.load_kernel_model(terms.sparkSession, path)
    votes = kernels.kernel_votes(features.count_vectors(terms, vocab, "doc_id"), again, "doc_id").collect()
    assert np.allclose([r.score for r in sorted(votes, key=lambda r: (r.doc_id, r.sent_no))], gram @ a, atol=1e-8)


def test_kernel_pairs_grow_with_matches(spark):
    """Sentences without a common term are no rows: blocks of one term each meet only themselves."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(0).alias("sent_no"), F.array(F.concat(F.lit("t"), (F.col("id") % 100).cast("string"))).alias("terms"))
    vocab = features.vocabulary(docs)
    points, heads = kernels._points(features.count_vectors(docs, vocab, "doc_id"), "doc_id")
    support = kernels._support(points.join(heads, ["cell", "doc_id", "sent_no"]).withColumn("alpha", F.lit(1 / 300)), "doc_id")
    met = features.only_known(points).drop("cell").join(support, "term_id")
    assert met.count() == 900
    sums = kernels.kernel_sums(points, heads, support, kernels.Kernel("sigmoid"), "doc_id").collect()
    want = (3 * np.tanh(0.1 - 1.0) + 297 * np.tanh(-1.0)) / 300
    assert len(sums) == 300 and all(abs(r.total - want) < 1e-12 for r in sums)


def test_relevance_of_empty_and_unknown_documents(spark, terms):
    vocab = features.vocabulary(terms)
    for kind in ("count", "tfidf"):
        model = oneclass.fit_centroid(terms, vocab, "doc_id", 0.3, kind)
        path = scratch_path(spark, "model")
        oneclass.save_model(model, path)
        model = oneclass.load_model(spark, path)
        docs = spark.createDataFrame([(7, ""), (8, "Xyzzy quux."), (9, TEXTS[0][1])], "doc_id long, text string")
        t = S.with_terms(S.to_sentences(docs, "doc_id", keep_empty=True))
        rel = {r.doc_id: r for r in oneclass.document_relevance(oneclass.sentence_votes(t, model, "doc_id"), "doc_id").collect()}
        assert (rel[7].relevance, rel[7].n_sentences) == (0.0, 0)
        assert rel[8].relevance == -1.0
        assert -1 <= rel[9].relevance <= 1
        kept = oneclass.relevant(spark.createDataFrame(list(rel.values())), -0.5)
        assert {r.doc_id for r in kept.collect()} >= {7}
        assert oneclass.relevant(spark.createDataFrame(list(rel.values())), -0.5, 1).filter("doc_id = 7").count() == 0


def test_share_of_outliers_is_about_nu(terms):
    model = oneclass.fit_linear(terms, features.vocabulary(terms), "doc_id", 0.3, 20)
    votes = oneclass.sentence_votes(terms, model, "doc_id")
    below = oneclass.sentence_scores(terms, model, "doc_id").filter(F.col("units") < model.rho_units).count()
    assert below <= 0.3 * votes.count()


def test_bad_parameters(terms):
    with pytest.raises(ValueError):
        features.vectors(terms, terms, "doc_id", "hash")
    with pytest.raises(ValueError):
        kernels.Kernel("cosine")


def test_global_rank(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 7)
    ranked = ranking.global_rank(df, [F.desc("g"), F.asc("id")], "r").collect()
    assert [r.r for r in sorted(ranked, key=lambda r: (-r.g, r.id))] == list(range(1000))


def test_kth_smallest_with_a_hot_value(spark):
    values = [5] * 500 + list(range(-300, 300)) + [10**12, -(10**12)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values)
    for k in (1, 2, 300, 301, 306, 700, 806, len(values)):
        t = ranking.kth_smallest(df, "v", k, min(values), max(values), bins=16)
        v = ordered[k - 1]
        assert t == (v, sum(x < v for x in values), values.count(v))


def test_lookup_ways_agree(spark, monkeypatch):
    many = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(300)] + [(999, None)], "id long, k string")
    one = spark.createDataFrame([("hot", 1, 9)] + [(f"k{i}", i, 1) for i in range(40)], "k string, v int, heat int")
    small = {tuple(r) for r in joins.lookup(many, one.drop("heat"), "k").select("id", "k", "v").collect()}
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(joins, "HOT_KEYS", 3)
    counted = joins.lookup(many, one.drop("heat"), "k").select("id", "k", "v")
    known = joins.lookup(many, one, "k", heat="heat").select("id", "k", "v")
    assert {tuple(r) for r in counted.collect()} == small == {tuple(r) for r in known.collect()}
    assert counted.count() == known.count() == 301
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1_000)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 100)
    assert {tuple(r) for r in joins.lookup(many, one.drop("heat"), "k").select("id", "k", "v").collect()} == small


def test_lookup_reads_many_once(spark, monkeypatch, tmp_path):
    spark.range(300).selectExpr("id", "concat('k', id % 7) AS k").write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    one = spark.createDataFrame([(f"k{i}", i, 1) for i in range(9)], "k string, v int, heat int")
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    for out in (joins.lookup(many, one, "k", heat="heat"), joins.lookup(many, one.drop("heat"), "k")):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
        assert out.count() == 300


@pytest.mark.parametrize("kind", ["count", "tfidf"])
def test_fit_with_a_vocabulary_beyond_broadcast(terms, monkeypatch, kind):
    """The same weights, and a step that moves neither vectors nor weights but one number per sentence and block."""
    vocab = features.vocabulary(terms)
    plain = oneclass.fit_linear(terms, vocab, "doc_id", 0.3, 3, kind)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(joins, "HOT_KEYS", 2)
    large = oneclass.fit_linear(terms, vocab, "doc_id", 0.3, 3, kind)
    assert abs(plain.rho_units - large.rho_units) <= 1
    one, other = ({r.term: r.w for r in m.weights.collect()} for m in (plain, large))
    assert one.keys() == other.keys() and all(abs(one[t] - other[t]) < 1e-9 for t in one)
    vecs = features.vectors(terms, vocab, "doc_id", kind, terms.count())
    spark = terms.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = oneclass.TermBlocks(vecs, vocab, "doc_id").weighted(plain.weights)
        plan = rows.groupBy("doc_id", "sent_no").agg(F.sum("weight"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "partial_sum" in plan and plan.count("Bucketed: true") == 2, plan


@pytest.mark.parametrize("least", [3, 1_000_000])
def test_a_step_scores_by_its_vertex_alone(spark, monkeypatch, least):
    """Only the first scores meet all weights; the terms of a vertex, which is a small part of the rows, serve the steps."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", least)
    met, first = [], oneclass._linear_scores
    monkeypatch.setattr(oneclass, "_linear_scores", lambda *a: met.append(a) or first(*a))
    rng = np.random.default_rng(5)
    rows = [(i, 0, [f"t{n}" for n in rng.integers(0, 30, rng.integers(0, 9))]) for i in range(60)]
    rows += [(i, 1, rows[i][2]) for i in range(20)]  # rows that tie
    table = spark.createDataFrame(rows, "doc_id long, sent_no int, terms array<string>")
    vocab = features.vocabulary(table)
    keys, x = matrix(table, vocab)
    a, g, rho = frank_wolfe(x @ x.T, 0.1, 6)
    model = oneclass.fit_linear(table, vocab, "doc_id", 0.1, 6)
    assert len(met) == 1
    w = {r.term_id: r.w for r in model.weights.collect()}
    assert np.allclose([w[i] for i in range(len(w))], x.T @ a) and abs(model.rho - rho) < 1e-8


@pytest.mark.parametrize("name, steps", [("sigmoid", 2), ("rbf", 1)])
def test_kernel_fit_from_the_mean_equals_brute_force(terms, name, steps, monkeypatch):
    for what, size in (("BLOCK_ROWS", 4), ("PART_ROWS", 2), ("MATCHES", 5)):  # several tiles, parts and pieces
        monkeypatch.setattr(kernels, what, size)
    vocab = features.vocabulary(terms)
    keys, x = matrix(terms, vocab)
    kernel = kernels.Kernel(name, gamma=0.2, coef0=-0.5)
    gram = gram_of(kernel, x)
    a, g, rho = frank_wolfe(gram, 0.3, steps)
    model = kernels.fit_kernel(terms, vocab, "doc_id", kernel, 0.3, steps, start="mean")
    got = {(r.doc_id, r.sent_no): r.units / oneclass.UNIT for r in model.training.collect()}
    assert np.allclose([got[k] for k in keys], g, atol=2e-9) and abs(model.rho - rho) < 2e-9 and model.n_support == len(x)


@pytest.mark.parametrize("name", ["sigmoid", "rbf"])
def test_kernel_sums_by_parts_of_the_support(spark, name, monkeypatch):
    """However many parts the support is cut into: the sums are those of all pairs, no row is copied for the parts, and long sentences do not overflow."""
    for what, size in (("SUPPORT_ROWS", 7), ("SUPPORT_TERMS", 40), ("FOLD", 3), ("DENSE", 20)):
        monkeypatch.setattr(kernels, what, size)
    rng, made, one = np.random.default_rng(3), [], kernels.materialize
    monkeypatch.setattr(kernels, "materialize", lambda df, name, **m: made.append(name) or one(df, name, **m))
    rows = [(int(i // 2), int(i % 2), [f"t{n}" for n in rng.integers(0, 12, rng.integers(0, 7))]) for i in range(50)] + [(90, 0, ["t1"] * 4_000 + ["t2"])]
    table = spark.createDataFrame(rows, "doc_id long, sent_no int, terms array<string>")
    vocab = features.vocabulary(table)
    keys, x = matrix(table, vocab)
    kernel = kernels.Kernel(name, gamma=0.2, coef0=-0.5)
    points, heads = kernels._points(features.count_vectors(table, vocab, "doc_id"), "doc_id")
    alpha = F.when(F.col("doc_id") == 90, 0.5).otherwise(0.5 / 50)
    support = kernels._support(points.join(heads, ["cell", "doc_id", "sent_no"]).withColumn("alpha", alpha), "doc_id")
    got = {(r.doc_id, r.sent_no): r.total for r in kernels.kernel_sums(points, heads, support, kernel, "doc_id").collect()}
    square = (x * x).sum(axis=1)
    gram = np.exp(-0.2 * (square[:, None] + square - 2 * x @ x.T)) if name == "rbf" else np.tanh(0.2 * x @ x.T - 0.5)
    assert np.allclose([got[k] for k in keys], gram @ [0.5 if k[0] == 90 else 0.01 for k in keys], atol=1e-9)
    assert made.count("tile-left") == 1 and made.count("tile-sums") > 8  # a job for each part


def test_unknown_terms_do_not_move(spark, monkeypatch):
    """Terms that a large vocabulary lacks are left out before the join; every sentence keeps its row without a term."""
    from pagesift.plans import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    vocab = spark.createDataFrame([("a", 5, 0), ("b", 3, 1), ("c", 1, 2)], "term string, n_total long, term_id long")
    docs = spark.createDataFrame([(1, 0, ["a", "x", "a"]), (1, 0, ["a"]), (2, 0, ["y", "z"]), (None, None, None)], "doc_id long, sent_no int, terms array<string>")
    moved = joins.lookup(features.with_marks(docs, "doc_id"), vocab, "term", heat="n_total", misses=False)
    assert sorted((r.doc_id or 0, r.term or "") for r in moved.collect()) == [(0, ""), (1, ""), (1, ""), (1, "a"), (1, "a"), (1, "a"), (2, "")]
    rows = features.count_vectors(docs, vocab, "doc_id").collect()
    assert sorted((r.doc_id or 0, r.term or "", r.weight) for r in rows) == [(0, "", 0.0), (1, "", 0.0), (1, "a", 3.0), (2, "", 0.0)]
    assert joins.mark_possible(spark.createDataFrame([("x",), ("a",), (None,)], "term string"), "term", vocab, 3).filter("_possible").count() == 1


def test_terms_are_counted_where_they_were_joined(spark, monkeypatch):
    """With a vocabulary too large to broadcast the counts need no shuffle of their own, hot terms and repeated or null sentences included."""
    rows = [(None if i % 11 == 0 else i % 40, i % 3 if i % 7 else None, ["a"] * (i % 4) + [f"t{i % 13}", "never"] if i % 5 else []) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, sent_no int, terms array<string>")
    vocab = spark.createDataFrame([("a", 900, 0), *((f"t{n}", 20, n + 1) for n in range(13))], "term string, n_total long, term_id long")
    small = features.count_vectors(docs, vocab, "doc_id")
    want = sorted(map(str, small.collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = features.count_vectors(docs, vocab, "doc_id")
        assert large.columns == small.columns and sorted(map(str, large.collect())) == want
        plan = large._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning(term") == 2 and "hashpartitioning(doc_id" not in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
