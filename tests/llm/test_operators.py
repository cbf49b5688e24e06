"""Each operator against brute force, the library itself or an exact round trip, and on awkward rows."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from pagesift.llm import chat, decontaminate, graph, hashing, jaccard, language, lines, neighbours, packing, rows, tokencount, tokenfile, tokens, urls, wordtable
from pagesift.plans.materialize import scratch_path

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "lorem ipsum dolor sit amet " * 4_000
AWKWARD = [(1, None), (1, ""), (2, "same text of a few more words"), (2, "same text of a few more words"), (None, "no id but words"), (3, "***\n\n\t"),
           (4, LONG), (5, "x<|endoftext|>y  we'll \x0b 日本 ½"), (6, "same text of a few more words")]


def table(spark, rows=AWKWARD):
    """Rows with further columns whose names clash with those of the operators."""
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    for name in ("n_tokens", "start", "score", "node", "size", "__gone_not", "a.b", "component", "lang_pred", "__leaks_", "items", "gram"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def test_encoder_equals_library(library):
    random.seed(3)
    alphabet = "ab  \n\t'stdmrevlSTé ß1²½.,!?-<|endoftext|>Ā\r\x0b  日ªº×"
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(5_000)] + ["a<|endoftext|>b", ""]
    want = [ids_of(library, t).tobytes() for t in texts]
    small = tokens.JsonEncoder(PATH)
    small.words = wordtable.WordTable(small._words, slots=256)  # filled and cleared many times
    assert small.encode(texts) == want
    assert tokens.JsonEncoder(PATH).encode(texts) == want
    long = "x" * 5_000 + " " + "é" * 40 + "\n" * 3_000 + "it's " * 4
    assert tokens.JsonEncoder(PATH).encode([long, "", long]) == [ids_of(library, t).tobytes() for t in (long, "", long)]


def test_language_held_out_accuracy(spark, docs):
    model = language.train_language(docs.filter(~language.is_held_out(F.col("doc_id"))))
    rows = model.predict(docs).filter(language.is_held_out(F.col("doc_id"))).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_bundle_is_the_sum_of_bound_letters():
    text, size = "abcab", 64
    points = np.frombuffer(f" {text} ".encode("utf-32-le"), dtype=np.uint32)
    v = language._letter_vectors(points, size).astype(int)
    want = sum(np.roll(v[i], 2) * np.roll(v[i + 1], 1) * v[i + 2] for i in range(len(points) - 2))
    got, known = language.bundles([text, "12 .", "ABCAB"], size)
    assert (got[0] == want).all() and (got[2] == want).all() and known.tolist() == [True, False, True]


def test_language_awkward(spark):
    df = table(spark).withColumn("lang", F.when(F.col("doc_id") == 2, "en"))
    model = language.train_language(df)
    rows = model.predict(df).select("text", "lang_pred", "score").collect()
    assert len(rows) == len(AWKWARD)
    assert {r.lang_pred for r in rows if not r.text or not any(c.isalpha() for c in r.text)} == {language.UNKNOWN}
    assert language.train_language(df.limit(0)).predict(df).select("lang_pred").distinct().collect() == [("und",)]
    assert model.predict(df.limit(0)).count() == 0


@pytest.mark.parametrize("leaf", [50_000, 40])
def test_neighbours_equal_brute_force(spark, leaf):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 12)), 3)
    x[300:] = x[7]  # a hot vector
    rows = [(i, [float(v) for v in row], i) for i, row in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 12, 0), (1002, [float("nan")] * 12, 0), (1003, [None] * 12, 0), (None, [1.0] * 12, 0), (1004, [1.0], 0), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0, leaf_rows=leaf).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 400, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [int(j) for j in np.lexsort((np.arange(400), d)) if j != q][:10]
        have = [got[q][k][0] for k in range(1, 11)]
        hits += len(set(want) & set(have))
        if q >= 300:
            assert have == want
    assert set(got) == set(range(0, 400, 10)) and hits >= 0.9 * 400
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_chi_square_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


def check_pieces(rows, texts, library, size=1024):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or at & (at - 1) == 0
    total = sum(len(ids_of(library, t)) + 1 for t in texts)
    assert sum(r.length for r in rows) == total


def test_packing(spark, docs, library):
    rows = packing.pack(docs, PATH).collect()
    check_pieces(rows, [r.text for r in docs.collect()], library)
    text = {r.doc_id: r.text for r in docs.collect()}
    for doc in sorted(text)[:40]:
        pieces = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces])[:-1])
        assert b"".join(r.ids for r in pieces) == ids_of(library, text[doc]).tobytes() + bytes(4)
    check_pieces(packing.pack(table(spark), PATH).collect(), [t for _, t in AWKWARD], library)
    assert packing.pack(table(spark).limit(0), PATH).count() == 0


def test_balance_assigns_whole_items_and_levels_cost():
    rng = random.Random(2)
    lengths = np.array([rng.randint(0, 1023) for _ in range(700)])
    bins = packing.balance(lengths, 1024)
    assert sorted((i, s + k) for b in bins for i, s, n in b for k in range(n)) == [(i, k) for i, n in enumerate(lengths) for k in range(n)]
    assert sum(len(b) for b in bins) < 1.6 * len(lengths) and sum(n for b in bins[:-11] for _, _, n in b) == 1024 * len(bins[:-11])
    assert packing.balance(np.array([], dtype=int), 1024) == []
    assert sorted(sum(n for _, _, n in b) for b in packing.balance(np.array([700]), 1024)) == [4, 8, 16, 32, 128, 512]


@pytest.mark.parametrize("bits", [1, 8])
def test_planes_round_trip(bits):
    ids = np.random.default_rng(1).integers(0, 1 << 32, 10_001, dtype=np.uint64).astype("<u4")
    payload = tokenfile.encode_chunk(ids, bits, block=1_000)
    assert (tokenfile.decode_chunk(payload) == ids).all()
    assert (tokenfile.decode_chunk(payload, 1_999, 5_003) == ids[1_999:5_003]).all()
    assert len(tokenfile.decode_chunk(tokenfile.encode_chunk(ids[:0], bits))) == 0


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
def test_token_files(spark, docs, library, which):
    df = {"docs": docs, "awkward": table(spark), "empty": table(spark).limit(0)}[which]
    path = scratch_path(spark, "files")
    tokenfile.write_tokens(df, path, PATH, chunk_ids=3_000)
    got = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: r.start)
    key = lambda i: (i is not None, i or 0)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in df.collect()), key=key)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])][: len(got)]
    want = sorted((key(r.doc_id), ids_of(library, r.text).tobytes() + bytes(4)) for r in df.collect())
    assert sorted((key(r.doc_id), bytes(r.ids)) for r in got) == want
    if which == "docs":
        one = got[17]
        assert [bytes(r.ids) for r in tokenfile.read_document(spark, path, one.doc_id).collect()] == [bytes(one.ids)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, docs, name):
    path = public_tokenizers.path(name)
    whole = tokens.encoder(path)
    texts = ["", "x" * 3_000, "ab " * 900 + "é" * 700 + " <|endoftext|> z", "a  b\n" * 400, LONG[:5_000]]
    rows = [(r.doc_id, r.text) for r in docs.limit(40).collect()] + [(10_000 + i, t) for i, t in enumerate(texts)] + AWKWARD[:6]
    got = tokencount.count_tokens(table(spark, rows), path, chunk=500, overlap=40).collect()
    want = sorted((i or -1, len((t or "").encode()), len(whole.encode([t or ""])[0]) // 4) for i, t in rows)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert tokencount.count_tokens(table(spark).limit(0), path).count() == 0


def brute_jaccard(rows, words=5):
    sets = []
    for _, text in rows:
        w = lines._WORDS.findall((text or "").lower())
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdef", k=4))
    rows = list(AWKWARD[:6])
    base = [word() for _ in range(200)]
    for i in range(60):  # a large group of near copies, more than one tile, and some unlike texts
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(200)] = word()
        rows += [(100 + i, " ".join(copy)), (1_000 + i, " ".join(word() for _ in range(30)))]
    linked = brute_jaccard(rows)
    got = jaccard.jaccard_classes(table(spark, rows), chunk=16, verify_chunk=8).collect()
    count = {}
    for i, _ in linked:
        count[i] = count.get(i, 0) + 1
    assert sorted((r.doc_id or -1, r.links) for r in got) == sorted((d or -1, count.get(i, 0)) for i, (d, _) in enumerate(rows))
    near = {r.class_id for r in got if r.doc_id and 100 <= r.doc_id < 160}
    assert near == {100} and sum(r.keep for r in got if r.class_id == 100) == 1
    assert len({r.class_id for r in got if r.doc_id and r.doc_id >= 1_000}) == 60
    assert jaccard.jaccard_classes(table(spark).limit(0)).count() == 0


def test_pruning_keeps_what_reaches_the_threshold():
    need = jaccard.least_matches(0.8, 1e-4)
    rng = np.random.default_rng(1)
    one = rng.integers(0, 256, 128).astype(np.uint8)
    same = rng.random((2_000, 128)) < 0.8
    others = np.where(same, one, rng.integers(0, 256, (2_000, 128))).astype(np.uint8)
    assert jaccard.survivors(one, others, need).mean() > 0.995
    assert jaccard.survivors(one, rng.integers(0, 256, (2_000, 128)).astype(np.uint8), need).mean() == 0


def brute_lines(rows):
    """Texts rid of repeated lines by edit similarity alone, and the places of the lines that go, of those that stay and of mere copies."""
    occ = {}
    for at, (doc, text) in enumerate(rows):
        for n, line in enumerate((text or "").split("\n")):
            if key := lines.normalised(line):
                occ.setdefault(key, []).append((doc is None, doc or 0, at, n))
    keys = sorted(occ, key=len)
    letters = np.array([[k.count(c) for c in "abcdefghijklmnopqrstuvwxyz "] for k in keys])
    sizes = np.array([len(k) for k in keys])
    group = list(range(len(keys)))
    for i in range(len(keys)):
        some = np.arange(i + 1, np.searchsorted(sizes, sizes[i] / 0.8 + 1, side="right"))
        some = some[np.abs(letters[some] - letters[i]).sum(axis=1) <= 2 * 0.2 * sizes[some] + 2]
        for j in some:
            if group[i] != group[j] and lines.similar(keys[i], keys[j], 0.8):
                group = [group[j] if g == group[i] else g for g in group]
    gone, copies = set(), set()
    for k in keys:
        copies |= {o[2:] for o in sorted(occ[k])[1:]}
    for g in set(group):
        found = sorted(o for k, h in zip(keys, group) if h == g for o in occ[k])
        gone |= {o[2:] for o in found[1:]}
    return gone, copies


def without(rows, gone):
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (at, n) not in gone) for at, (_, t) in enumerate(rows)]


def test_lines_equal_brute_force(spark):
    """Equal lines, lines that differ in a word and lines that differ a little: all that plain edit similarity finds."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    texts = []
    for n in [4, 5, 6, 8, 11, 20, 40, 90] * 3:
        own = [word() for _ in range(n)]
        near = list(own)
        near[rng.randrange(n)] = word()[:4]
        typo = " ".join(own)
        at = rng.choice([i for i, c in enumerate(typo) if c != " "])
        texts += ["\n".join([" ".join(own), " ".join(word() for _ in range(n))]), " ".join(near).upper() + "\n***", typo[:at] + "x" + typo[at + 1 :]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i and i + 1_000, t) for i, t in AWKWARD]
    long = " ".join(f"word{i}" for i in range(300))
    rows += [(5_000 + i, f"{long} {'x' * i}\nown line {i} of it\n") for i in range(6)]
    got = lines.dedup_lines(table(spark, rows).coalesce(1)).select("doc_id", "text").collect()
    gone, _ = brute_lines(rows)
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(d), str(t)) for (d, _), t in zip(rows, without(rows, gone)))
    assert lines.dedup_lines(table(spark).limit(0)).count() == 0


def test_near_lines_recall(spark, docs):
    """Against plain edit similarity over all lines: 0.9 of the near lines go at least, and no line that has none like it."""
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    gone, copies = brute_lines(rows)
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    found = set()
    for at, (doc, text) in enumerate(rows):
        left = (got[doc].text or "").split("\n") if got[doc].text is not None else []
        for n, line in enumerate((text or "").split("\n")):  # what stays keeps its order
            if left and left[0] == line:
                left = left[1:]
            else:
                found.add((at, n))
    near = gone - copies
    assert found <= gone and copies <= found and len(near) > 30
    assert len(found & near) >= 0.9 * len(near), (len(found & near), len(near))


@pytest.mark.parametrize("lines_in_all", [0, 1 << 21, 1 << 30])
def test_hashes_with_fewer_differences_than_blocks_share_one(spark, lines_in_all):
    rng = random.Random(lines_in_all)
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    rows = []
    keys = lambda c: lines.block_keys([F.get(F.col(c), F.lit(0)), F.get(F.col(c), F.lit(1))], lines_in_all)
    blocks = len(keys("a"))
    for i in range(200):
        code = other = rng.getrandbits(128)
        for bit in rng.sample(range(128), blocks - 1):
            other ^= 1 << bit
        rows.append((i, *[[signed(c >> 64 & (1 << 64) - 1), signed(c & (1 << 64) - 1)] for c in (code, other)]))
    df = spark.createDataFrame(rows, "i long, a array<long>, b array<long>")
    assert blocks == 8 and df.filter(F.arrays_overlap(F.array(*keys("a")), F.array(*keys("b")))).count() == 200


def test_lines_meet_whatever_the_number_of_lines(spark):
    """The keys of two lines are theirs alone: the same for few and for very many lines."""
    df = spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % (1 << 63), i * 0xD6E8FEB86659FD93 % (1 << 63)) for i in range(200)], "a long, b long")
    few, many = ([tuple(r) for r in df.select(*lines.block_keys([F.col("a"), F.col("b")], n)).collect()] for n in (100, 1 << 30))
    assert few == many


def test_lines_with_word_runs_meet_by_their_blocks_too(spark):
    """Lines whose hashes are near meet by a block of them, whether they share a word run or lack the same word or not."""
    code = 0x0123456789ABCDEF
    facts = [([1, 2, 3, 4], []), ([5, 6, 7, 8], []), ([9], [5]), ([], [])]
    rows = [(10 * far + n, code ^ (1 << n) - 1 ^ far << 60, code + far * 0x5555, lacking, runs) for far in (0, 1) for n, (runs, lacking) in enumerate(facts)]
    rows = [(n, s ^ (0x7FFFFFFF0000 if n >= 10 else 0), o, lacking, runs) for n, s, o, lacking, runs in rows]
    nodes = spark.createDataFrame(rows, "node long, simhash long, other long, lacking array<long>, runs array<int>")
    found = {r.node: r.component for r in graph.components(lines.near_lines(nodes, 8, 4_096)).collect()}
    assert found == {n: n // 10 * 10 for n, *_ in rows}


def test_words_apart_is_no_less_than_the_distance():
    rng = random.Random(5)
    for _ in range(400):
        own = ["".join(rng.choices("abc", k=rng.randint(0, 5))) for _ in range(rng.randint(1, 25))]
        near = [w for w in own if rng.random() > 0.1]
        for _ in range(rng.randint(0, 4)):
            near.insert(rng.randint(0, len(near)), "".join(rng.choices("abc", k=3)))
        a, b = " ".join(own), " ".join(near)
        assert lines.edit_distance(a, b, 999) <= lines.words_apart(a, b) and lines.words_apart(a, a) == 0
        for threshold in (0.6, 0.8, 0.9):
            assert lines.similar(a, b, threshold) == (lines.edit_distance(a, b, 999) <= int((1 - threshold) * max(len(a), len(b)) + 1e-9))


def test_least_runs():
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefg", k=rng.choice([1, 2, 3, 4, 5, 9, 30]))) for _ in range(300)] + ["a " * 50, "a"]
    own = [hashing.WordHasher().words(t)[0] for t in texts]
    sizes = np.array([len(w) for w in own])
    runs, counts = lines.least_runs(np.concatenate(own), np.cumsum(sizes) - sizes, sizes)
    kinds = [{tuple(t.split()[i : i + lines.RUN]) for i in range(len(t.split()) - lines.RUN + 1)} for t in texts]
    assert counts.tolist() == [min(len(k), lines.RUNS) for k in kinds]
    found = [set(part.tolist()) for part in np.split(runs, np.cumsum(counts)[:-1])]
    assert [len(f) for f in found] == counts.tolist()
    for i, j in zip(rng.choices(range(len(texts)), k=2_000), rng.choices(range(len(texts)), k=2_000)):
        assert kinds[i] != kinds[j] or found[i] == found[j]
        assert not found[i] & found[j] or kinds[i] & kinds[j]
        if len(kinds[i] | kinds[j]) <= lines.RUNS:  # all runs are keys
            assert len(found[i] & found[j]) == len(kinds[i] & kinds[j])


def test_workers_drop_what_other_operators_left():
    """An operator without a store of its own begins by dropping those of others; one with a store keeps that."""
    batch = pa.RecordBatch.from_pydict({lines.ROW: [1], "doc_id": [1], "text": ["some words of a line"]})
    rows.worker_store("encoders")["x"] = rows.worker_store("items")["y"] = 1
    rows.vacate("items")
    assert rows.worker_store("items") == {"y": 1} and not rows.worker_store("encoders")
    rows.worker_store("encoders")["x"] = 1
    assert list(lines._lines(iter([batch])))
    assert not rows.worker_store("encoders") and not rows.worker_store("items")


def test_workers_give_back_what_batches_took():
    batches = (pa.RecordBatch.from_pydict({"text": ["x" * 200_000] * 200}) for _ in range(3))
    for part, texts in rows.slices(batches, "text"):
        assert len(texts) == part.num_rows
    with open("/proc/self/smaps_rollup") as f:
        before = next(int(line.split()[1]) for line in f if line.startswith("Rss:"))
    rows.release()
    with open("/proc/self/smaps_rollup") as f:
        after = next(int(line.split()[1]) for line in f if line.startswith("Rss:"))
    assert before - after < 60_000 and pa.default_memory_pool().bytes_allocated() < 60_000_000  # nothing much was left to give back


def test_buckets_without_near_hashes_are_told_at_once(monkeypatch):
    """Only buckets of three and more lines with a near pair are worked through one by one; the edges are those of all pairs."""
    rng, worked, one = np.random.default_rng(4), [], lines.near_pairs
    monkeypatch.setattr(lines, "near_pairs", lambda codes, distance: worked.append(len(codes)) or one(codes, distance))
    sizes = rng.integers(2, 13, 200)
    codes = rng.integers(-(1 << 62), 1 << 62, (sizes.sum(), 2))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    for at, end in list(zip(edges, edges[1:]))[::4]:
        codes[end - 1] = codes[at] ^ 5
    at = np.repeat(np.arange(200), sizes)
    names = ["bucket", "low", "high", "node", "simhash", "other"]
    batch = pa.RecordBatch.from_arrays([pa.array(a) for a in (at, at * 0, at * 0, np.arange(len(at)), codes[:, 0].copy(), codes[:, 1].copy())], names=names)
    found = {tuple(sorted(e)) for out in lines._near(10)(iter([batch])) for e in zip(*(out.column(i).to_pylist() for i in (0, 1)))}
    assert found == {(int(edges[g]), int(edges[g + 1] - 1)) for g in range(0, 200, 4)}
    assert len(worked) == sum(n > lines.SMALL or g % 4 == 0 and n > 2 for g, n in enumerate(sizes))


def test_line_hashes_equal_plain_ones():
    """Bit sums by lanes, and repeats of a word in its line told by sorting, against counting one by one."""
    rng = np.random.default_rng(6)
    sizes = np.array([1, 2, 700, 255, 256, 3, 510, 40])
    line, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    words = rng.integers(0, 1 << 63, 60, dtype=np.uint64)[rng.integers(0, 60, sizes.sum())]
    words[-40:] = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    for n, code in enumerate(lines.simhashes(words, starts).tolist()):
        own = words[line == n].tolist()
        assert code == sum(1 << b for b in range(64) if 2 * sum(w >> b & 1 for w in own) > len(own))
    told = lines.numbered(words, line)
    for n in range(len(sizes)):
        own, seen, wanted = words[line == n], {}, []
        for w in own.tolist():
            seen[w] = seen.get(w, -1) + 1
            wanted.append((w + seen[w] * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
        assert sorted(told[line == n].tolist()) == sorted(hashing.mix(np.array(wanted, dtype=np.uint64)).tolist())
    same_above = (np.arange(50, dtype=np.uint64) * np.uint64(7)) % np.uint64(50) % np.uint64(9)  # told apart by the lowest bits alone
    assert (np.diff(same_above[lines.sorting(same_above)].astype(int)) >= 0).all()


def test_very_long_lines(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(30_000)]
    one = [rng.choice(words) for _ in range(160_000)]
    near = [w if rng.random() > 0.05 else rng.choice(words) for w in one]
    other = [rng.choice(words) for _ in range(160_000)]
    start = time.perf_counter()
    assert lines.similar(" ".join(one), " ".join(near), 0.8) and len(" ".join(one)) > 1_000_000
    assert not lines.similar("z" * 300_000 + " ".join(one), " ".join(one) + "y" * 300_000, 0.8)
    assert time.perf_counter() - start < 10
    got = lines.dedup_lines(spark.createDataFrame([(1, " ".join(one)), (2, " ".join(near)), (3, " ".join(other))], "doc_id long, text string"))
    assert {r.doc_id for r in got.filter("__removed = 1").collect()} == {2}


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row = _next(row, i, c, b)
        assert lines.edit_distance(a, b, 99) == row[len(b)]
        assert lines.distance_below(a, b) <= row[len(b)] <= lines.distance_above(a, b, 99)
        assert lines.edit_distance(a, b, 2) == row[len(b)] or row[len(b)] > 2


def _next(row, i, c, b):
    out = [i]
    for j, d in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (c != d)))
    return out


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1_000, i) for i in range(1_001, 1_050)] + [(5, None), (7, 7)]
    group = {i: i for p in pairs for i in p if i is not None}
    for a, b in pairs:
        if a is not None and b is not None and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {k: low if g == high else g for k, g in group.items()}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ends = {i for a, b in pairs if a is not None and b is not None and a != b for i in (a, b)}
    assert got == {k: g for k, g in group.items() if k in ends}


RULES = [urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"),
         urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]


def test_urls(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://A.Example.org/es/x?q#f", ""), (2, "http://b.net/one", link("http://x.example.org/es/x")), (3, "https://b.net/two", link("one")),
        (4, "http://c.com/fr/1", link("//b.net/one")), (5, "http://d.net", '<META http-equiv=refresh content="0; URL=http://c.com/fr/1">'),
        (6, "http://e.net/", None), (7, None, None), (8, "mailto:x", link("http://b.net/one")), (9, "http://example.org/en/12/", ""),
        (10, "http://notcom/de/1", ""), (11, "http://y.com/de/1", link("")), (11, "http://y.com/de/1", link("")), (12, "http://g.net/?a=1&b=2", ""),
    ]
    more = spark.createDataFrame([("http://g.net/?a=1&b=2#z", "http://h.net/"), ("http://h.net", "https://y.com/de/1"), (None, "x")], "url string, target string")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit(1)).withColumn("node", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, RULES, more).collect()}
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("b.net", "/one", None, "block"), 3: ("b.net", "/two", None, "block"),
        4: ("c.com", "/fr/1", "com/fr/", "allow"), 5: ("d.net", "", None, "block"), 6: ("e.net", "/", None, "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("example.org", "/en/12/", "example.org/en/1", "block"), 10: ("notcom", "/de/1", None, "allow"),
        11: ("y.com", "/de/1", "com/de/", "block"), 12: ("g.net", "/", None, "block"),
    }
    assert urls.judge_urls(df, RULES).count() == len(rows) and urls.judge_urls(df.limit(0), RULES).count() == 0
    assert "Python" not in urls.judge_urls(df, RULES)._jdf.queryExecution().executedPlan().toString()


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, "user", "a<|im_end|>b"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (4, 1, "assistant", "no"), (5, 0, "user", "hi"), (5, 1, "assistant", "no"), (6, None, None, None), (None, 0, "user", "lost"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(9)).withColumn("h1", F.lit("z"))
    got = {r.conv_id: (r.n_turns, r.text) for r in chat.render_chats(df).collect()}
    assert set(got) == {3, 4, 6} and got[4][0] == 2 and got[6] == (1, "<|im_start|>\n<|im_end|>\n")
    assert got[3][1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\na< |im_end|>b<|im_end|>\n"
    assert chat.render_chats(df.limit(0)).count() == 0


def brute_align(a, b):
    best = 0.0
    grid = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            grid[i][j] = max(0, grid[i - 1][j - 1] + (1 if x == y else -0.5), grid[i - 1][j] - 0.5, grid[i][j - 1] - 0.5)
            best = max(best, grid[i][j])
    return best


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        assert decontaminate.align(a, b)[0] == brute_align(a, b)


@pytest.mark.parametrize("rare", [16, 0])
def test_leaks(spark, rare, monkeypatch):
    """Whether seeds are rare or not, the same is found."""
    monkeypatch.setattr(decontaminate, "RARE", rare)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    items = [[word() for _ in range(40)] for _ in range(12)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, ""), (52, "kqx"), (53, "zuv kqx"), (None, "quite another item of some more words here")]
    rows = list(AWKWARD)
    for i, item in enumerate(items[:6]):
        edited = [word() if rng.random() < 0.12 else w for w in item]
        noise = [word() for _ in range(300)]
        rows += [(100 + i, " ".join(noise + item + noise)), (200 + i, " ".join(noise[:90] + edited)), (300 + i, " ".join(noise))]
    rows += [(400, "one Zuv, kqx! two"), (401, "kqxx zuv")]
    df = decontaminate.with_leaks(table(spark, rows), spark.createDataFrame(bench, "item_id long, text string"))
    got = {(r.doc_id, r.leak.item_id): r.leak for r in df.select("doc_id", F.explode("__leaks").alias("leak")).collect()}
    assert set(got) == {(100 + i, i) for i in range(6)} | {(200 + i, i) for i in range(6)} | {(400, 52), (400, 53)}
    assert all(got[100 + i, i].score == 1 and (got[100 + i, i].first_word, got[100 + i, i].end_word) == (300, 340) for i in range(6))
    assert df.count() == len(rows) and decontaminate.with_leaks(table(spark).limit(0), spark.createDataFrame(bench, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("copies", [1, 5, 1_000])
def test_leaks_do_not_depend_on_copies(spark, copies):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=5))
    item = [word() for _ in range(48)]
    edited = [word() if i % 4 == 1 and i % 24 != 1 else w for i, w in enumerate(item)]  # most trigrams are broken
    rows = [(i, " ".join([word() for _ in range(20)] + edited)) for i in range(copies)]
    found = decontaminate.with_leaks(table(spark, rows), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    assert 2 * len(grams(item) & grams(edited)) < len(grams(item)) and brute_align(item, edited) >= 24
    assert found.filter("size(__leaks) = 1 AND __leaks[0].item_id = 7").count() == copies


def test_bound_is_no_less_than_alignment():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a, b = rng.integers(0, 9, rng.integers(1, 12)), rng.integers(0, 9, rng.integers(1, 25))
        hasher = hashing.WordHasher()
        words = [hasher.words(" ".join(f"w{x}" for x in side))[0] for side in (a, b)]
        assert decontaminate.Seeds([(1, decontaminate.Item(words[0], 3, hasher))]).bound(0, words[1]) >= brute_align(a, b)


def test_leaks_equal_brute_force_over_all_pairs(spark, docs):
    """Every text against every item, whole: a pair that reaches the threshold and shares a seed is found, with that score."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hasher = hashing.WordHasher()
    items = [(r.item_id, hasher.words(r.text or "")[0]) for r in bench.collect()]
    want = {}
    for r in docs.select("doc_id", "text").collect():
        words = hasher.words(r.text or "")[0]
        for item_id, item in items:
            if not len(item) or not len(words):
                continue
            score = decontaminate.align(item, words)[0] / len(item)
            n = min(3, len(item))
            if score >= 0.5 and np.intersect1d(hasher.grams(item, n), hasher.grams(words, n)).size:
                want[r.doc_id, item_id] = score
    rows = entry.queries()["op10_decontaminate"](spark, SF).collect()
    assert want and {(r.doc_id, r.item_id): r.score for r in rows} == want


def test_candidates_are_broadcast_by_their_size_in_memory(spark, monkeypatch):
    """Candidates that repeat a long item are small as files and large as rows, which the driver must not get."""
    plans, one = [], decontaminate.materialize

    def spied(df, name, **metrics):
        if name == "leaks":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return one(df, name, **metrics)

    monkeypatch.setattr(decontaminate, "materialize", spied)
    long = " ".join(f"word{i}" for i in range(4_000))  # 32 KB of words as numbers
    bench = spark.createDataFrame([(1, long), (2, "quite another item of some more words")], "item_id long, text string")
    for n, joined in ((700, "SortMergeJoin"), (3, "BroadcastHashJoin")):
        rows = [(i, f"{i} some words, then word{i} word{i + 1} word{i + 2} and more") for i in range(n)] + [(5_000, long), (5_001, None), (5_000, long), (None, "x " + long)]
        df = decontaminate.with_leaks(table(spark, rows), bench)
        assert sorted((r.doc_id or 0, r.leak.item_id, r.leak.score) for r in df.select("doc_id", F.explode("__leaks").alias("leak")).collect()) == [(0, 1, 1.0), (5_000, 1, 1.0), (5_000, 1, 1.0)]
        assert df.count() == n + 4
        plan = plans[0]  # where documents meet their candidates
        plans.clear()
        assert joined in plan and ("SortMergeJoin" in plan) == (n == 700), plan


def test_no_benchmark_text_in_the_driver(spark, docs, monkeypatch):
    """Neither plans nor what is collected hold an item's words: the driver gets a bitmap of bounded size."""
    bench = spark.createDataFrame([(1, "zebra quagga okapi gnu"), (2, "zebra tapir")], "item_id long, text string")
    path = scratch_path(spark, "bench")
    bench.write.parquet(path)
    found = decontaminate.with_leaks(docs, spark.read.parquet(path))
    assert "zebra" not in found._jdf.queryExecution().toString()
    with open(decontaminate.__file__) as file:
        assert file.read().count(".collect()") == 1  # the bitmap's rows

def test_pipeline(spark, tmp_path, docs, library):
    rows = corpus_pipeline.run(spark, SF).collect()
    left = {r.doc_id for r in rows}
    assert left and left <= {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == before.columns
    kept = docs.collect()
    assert {r.doc_id for r in kept} == left and not brute_jaccard([(r.doc_id, r.text) for r in kept])
    check_pieces(rows, [r.text for r in kept], library)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.with_leaks(docs, bench).filter("size(__leaks) > 0").count() == 0


def test_pipeline_rejects_what_is_like_no_language(spark, docs):
    rng = random.Random(4)
    scripts = [[chr(c) for c in span] for span in (range(0x430, 0x450), range(0x3B1, 0x3CA), range(0x4E00, 0x4F00), range(97, 123))]
    noise = [" ".join("".join(rng.choices(s, k=rng.randint(2, 8))) for _ in range(n)) for s in scripts for n in (20, 100, 300) for _ in range(10)]
    clean = [" ".join(r.text.split()[:n]) for r in docs.filter("length(text) > 300").orderBy("doc_id").limit(20).collect() for n in (3, 10, 40)]
    rows = [(10_000 + i, t, None) for i, t in enumerate(noise)] + [(20_000 + i, t, None) for i, t in enumerate(clean)]
    df = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, df, SF).collect()}
    assert not [i for i in kept if 10_000 <= i < 20_000]
    assert len([i for i in kept if i >= 20_000]) == len(clean)
    assert kept >= {r.doc_id for r in docs.filter(r"text RLIKE '\\p{L}'").collect()}


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    spark.createDataFrame([(1, None), (None, "some item of words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (AWKWARD, []):
        df = table(spark, rows).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
        for name in ("__leaks", "__lines", "__removed", "__row", "c0", "ordinary"):
            df = df.withColumn(name, F.lit(1))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            names = df.columns
            df = stage(spark, df, str(tmp_path))
            assert df.columns == names
        left = [r.text for r in df.collect()]
        assert len(left) == len(set(left)) and all(left)
        corpus_pipeline.pack_documents(spark, df, str(tmp_path)).collect()


def test_balance_takes_the_cheapest_sequence_with_room():
    """Dearest first, each to the sequence of least cost so far; first fit would fill the first one."""
    lengths, size = [5, 4, 4, 3, 2, 2], 10
    bins, cost = [[], []], [0.0, 0.0]
    for item, n in enumerate(lengths):  # in descending order already
        best = min((b for b in range(2) if sum(lengths[i] for i in bins[b]) + n <= size), key=lambda b: cost[b])
        bins[best].append(item)
        cost[best] += n + n * n / size
    got = packing.balance(np.array(lengths), size)
    assert sorted([i for i, _, _ in seq] for seq in got) == bins == [[0, 3, 5], [1, 2, 4]]


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
