"""SentencePiece codec, conversation trie and hard negatives against the library or brute force, and on awkward rows."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pagesift.llm import negatives, pieces, queries, turntrie

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
CLASHES = ("pos", "x", "turn_id_", "scores", "a.b", "block", "decoded_", "size", "layer", "n_tokens")


def clashing(df):
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df


# --- op11 ---


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def replayed(scores, text):
    """Merges one by one: the best score, the leftmost of equal ones."""
    symbols = list(text)
    while True:
        pairs = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores]
        if not pairs:
            return symbols
        at = min(pairs)[1]
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


def test_prefix_table_equals_merges_on_any_vocabulary():
    rng = random.Random(5)
    for _ in range(150):
        letters = "abc"[: rng.randint(1, 3)]
        words = {"".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 14))}
        scores = {w: float(rng.randint(0, 6)) for w in words}  # ties, parts that come after their whole, pieces that no merge reaches
        table = pieces.MergeTable(scores)
        for _ in range(40):
            text = "".join(rng.choices(letters + "d", k=rng.randint(0, 14)))
            assert table.tokens(text) == replayed(scores, text), (scores, text)


def test_codec_equals_library(library):
    rng = random.Random(1)
    signs = [*"abcdeth inor  \n\t▁\r\x00", "  ", "   " * 9, "日", "本", "𠮷", "é", "ﬁ", "the", "ing", "23", "<s>", "́", "aaaa", "——", "x" * 40]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(6_000)] + ["", " "]
    codec = pieces.PieceCodec(MODEL)
    codec.units = pieces.WordTable(codec._units, slots=1 << 12)  # filled and cleared many times
    got = codec.encode(texts)
    want = library.encode(texts, add_bos=True, add_eos=True)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert codec.decode(got) == [library.decode(w) for w in want]
    assert codec.encode(["", "a"], begin=False, end=False) == [np.array(library.encode(t), "<u4").tobytes() for t in ("", "a")]
    whole = ["a" * 50_000 + " é\n" * 10, "日本" * 9_000]  # units as long as the text
    assert [np.frombuffer(g, "<u4").tolist() for g in codec.encode(whole)] == library.encode(whole, add_bos=True, add_eos=True)


def test_op11_equals_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op11_pieces(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_awkward(spark, library):
    long = "lorem ipsum  dolor\n" * 20_000
    rows = [(1, None), (1, ""), (2, "twice"), (2, "twice"), (None, "no id"), (3, long), (4, "\x00 日 <s>")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = pieces.decode_pieces(pieces.encode_pieces(docs, MODEL), MODEL)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    got = sorted(((r.doc_id, r.n_tokens, r.decoded) for r in out.collect()), key=str)
    ids = [library.encode(t or "", add_bos=True, add_eos=True) for _, t in rows]
    assert got == sorted(((d, len(i), library.decode(i)) for (d, _), i in zip(rows, ids)), key=str)
    assert pieces.encode_pieces(docs.limit(0), MODEL).collect() == []
    clash = spark.createDataFrame([(None, "x"), (bytearray(np.array([1, 2], "<u4").tobytes()), "y")], "ids binary, decoded string")
    assert sorted(map(str, (tuple(r) for r in pieces.decode_pieces(clash, MODEL, out="text").collect()))) == sorted(map(str, [(None, "x", None), (bytes(b"\1\0\0\0\2\0\0\0"), "y", "")]))


# --- op12 ---


def brute_trie(convs):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for s in members:
        if s:
            kids[s[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for s, who in members.items():
        words = len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", s[-1][1])]) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in kids
            saved[s[:d]] += (len(who) - 1) * words
    out = set()
    for s, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(convs[c]) == len(s)))
        out.add((min(who), len(s), min(members[s[:-1]]) if s else None, len(who), kids[s], leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(spark, convs, **kw):
    rows = [(c, n, *turn) for c, turns in convs.items() for n, turn in enumerate(turns)]
    random.Random(1).shuffle(rows)
    turns = turntrie.turn_ids(clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    none = spark.createDataFrame([(c,) for c, turns in convs.items() if not turns], "conv_id long")
    found = turntrie.turn_trie(turns, turnless=none, **kw).collect()
    assert len(found) == len({tuple(r) for r in found})
    return {tuple(r) for r in found}


@pytest.mark.parametrize("width, shard", [(1, 3), (2, 5), (3, 1), (32, 16_384)])
def test_trie_equals_brute_force(spark, width, shard):
    rng = random.Random(width)
    convs = {}
    for c in range(-3, 60):
        turns = [(rng.choice("ua"), rng.choice(["a", "b c", "a\x0bb c  d", ""])) for _ in range(rng.randint(0, 7))]
        convs[c] = list(convs[rng.choice(list(convs))][: rng.randint(0, 9)]) + turns[: rng.randint(0, 3)] if convs and rng.random() < 0.7 else turns
    assert trie(spark, convs, width=width, shard=shard) == brute_trie(convs)


def test_trie_hot(spark):
    """One conversation with most of the turns, one that repeats very often, one first turn of nearly all."""
    hot = [("u", "hello there")]
    convs = {0: hot + [("a", f"turn {n % 5}") for n in range(400)], 1: hot + [("a", f"turn {n % 5}") for n in range(380)] + [("u", "end")]}
    convs |= {c: hot + [("a", "copy of it")] for c in range(10, 400)} | {c: hot + [("a", f"own {c}")] for c in range(400, 500)} | {7: [], 8: []}
    assert trie(spark, convs, width=8, shard=64) == brute_trie(convs)


def test_trie_awkward(spark):
    rows = [(1, None, None, None), (1, None, "", ""), (1, 2, "u", "x y"), (None, 1, "u", "lost"), (2, 5, "", None), (2, 5, None, ""), (3, 1, "u", "w " * 100_000)]
    turns = turntrie.turn_ids(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = brute_trie({1: [("", ""), ("", ""), ("u", "x y")], 2: [("", ""), ("", "")], 3: [("u", "w " * 100_000)]})
    assert {tuple(r) for r in turntrie.turn_trie(turns).collect()} == want
    assert turntrie.turn_trie(turns.limit(0)).collect() == []
    none = spark.createDataFrame([(5,), (4,), (5,), (None,)], "conv_id long")
    assert {tuple(r) for r in turntrie.turn_trie(turns.limit(0), turnless=none).collect()} == brute_trie({4: [], 5: []})
    # A tie of different turns goes by the hash of the turn, wherever the rows stand.
    tie = [(1, 1, "u", "b"), (1, 1, "u", "a"), (2, 1, "u", "a"), (2, 1, "u", "b")]
    nodes = turntrie.turn_trie(turntrie.turn_ids(spark.createDataFrame(tie, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted((r.depth, r.n_convs) for r in nodes) == [(0, 2), (1, 2), (2, 2)]


def test_op12_rebuilds(spark, tmp_path):
    """Null and repeated turn numbers, absent and short first conversations, conversations that lose all turns."""
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 24), *range(40, 47), *range(63, 80), 101, 102, 103, 104]:
        rows += [(c, None if n == 0 and c % 3 == 0 else n, rng.choice(["u", None]), rng.choice(["a", "b b", None, f"own {c}"])) for n in range(rng.randint(1, 5))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    mine = queries.op12_turntrie(spark, str(tmp_path))
    theirs = con.execute(f"select {', '.join(mine.columns)} from ({queries.ORACLES['op12_turntrie']})").fetchall()
    assert sorted(map(str, theirs)) == sorted(str(tuple(r)) for r in mine.collect())
    import zlib

    original = defaultdict(list)
    for c, n, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        original[c].append((role or "", text or ""))
    convs = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = original.get(c - c % 20, [])[:h] + turns[h:]
    assert any(not t for t in convs.values())
    assert {tuple(r) for r in mine.collect()} == brute_trie(convs)


# --- op13 ---


def brute_negatives(rows, anchors, positives=5, negatives=10):
    def score(a, b):
        return sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b))

    rows = list({(i, label, tuple(v)): None for i, v, label in rows if None not in (i, v, label) and all(x is not None and np.isfinite(x) for x in v)})
    out = set()
    for i, label, v in rows:
        if not anchors(i):
            continue
        met = sorted((-score(v, w), j, other == label) for j, other, w in rows if j != i and len(w) == len(v))
        for p, pos, _ in [m for m in met if m[2]][:positives]:
            inside = [(n, j) for n, j, same in met if not same and 30 * -p <= 100 * -n <= 90 * -p][:negatives]
            out |= {(i, pos, k, j, -p, -n) for k, (n, j) in enumerate(inside, 1)}
    return out


SCHEMA = "vec_id long, embedding array<float>, label int"


def mined(spark, rows, every=5, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("score", "vector", "size", "a.b", "block", "__row"):
        df = df.withColumn(name, F.lit("clash"))
    found = negatives.mine_negatives(df, F.col("vec_id") % every == 0, **kw).collect()
    assert len(found) == len({tuple(r) for r in found})
    return {tuple(r) for r in found}


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, 0.01]) for _ in range(3)], rng.randint(0, 2)) for i in range(-40, 160)]  # many ties
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 5 == 0)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "PART", 30)
    monkeypatch.setattr(negatives, "KEYS", 40)
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 5 == 0)
    assert mined(spark, rows, positives=2, negatives=3) == brute_negatives(rows, lambda i: i % 5 == 0, 2, 3)


def test_negatives_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2), (3, [0.0, 0.0], 1), (4, [0.0, 0.0], 2), (5, None, 1),
            (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (10, [0.6], 1), (15, [0.5], 2), (20, [], 1), (25, [], 2),
            (30, [], 1), (35, [0.0, 0.0], 1), (2, [0.25, 0.5], 2), (40, [1.0, 0.0], 7)]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 5 == 0)
    assert mined(spark, []) == set()
    with pytest.raises(ValueError):
        negatives.mine_negatives(spark.createDataFrame(rows, SCHEMA), F.lit(True), low=90, high=30)


def test_negatives_large_components(spark):
    """Products beyond exact doubles; scores beyond a long are cut to its ends."""
    rows = [(0, [1e6, 1.0], 1), (1, [1e6, 1.0], 1), (2, [5e5, 3.0], 2), (3, [5e5, 2.0], 2)]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 5 == 0)
    a = np.array([[(1 << 62), 5]], dtype=np.int64)
    assert negatives.products(a, np.array([[(1 << 62), 0], [1, 1], [-(1 << 62), 0]], dtype=np.int64)).tolist() == [[negatives.HIGHEST, (1 << 62) + 5, negatives.LOWEST]]
    assert {r[0] for r in mined(spark, [(0, [1e38, 0.0], 1), (1, [1e38, 0.0], 1), (2, [0.25, 0.0], 2)])} == set()


def test_negative_keys_sort_and_return():
    rng = random.Random(2)
    keys = [(rng.randint(-3, 3), rng.randint(0, 2), rng.choice([negatives.LOWEST, -5, 0, 7, negatives.HIGHEST]), rng.random() < 0.5, rng.randint(-9, 9)) for _ in range(500)]
    for k in keys:
        (anchor_id, anchor), score, negative, vec_id = negatives.unpack(negatives.pack(*k))
        assert (anchor_id, anchor, score, negative, vec_id) == k
    assert sorted(keys, key=lambda k: negatives.pack(*k)) == sorted(keys, key=lambda k: (k[0], k[1], -k[2], k[3], k[4]))
