import heapq
import random

import pytest
from pyspark.sql import functions as F

import pagesift
from pagesift.operators import frontier as FR, report, traversal as TR
from pagesift.plans import bitmaps
from pagesift.plans.buckets import Levels, bucketed
from pagesift.plans.materialize import scratch_path
from pagesift.sources import readers
from pagesift.sources.state import CrawlStore, resume_queue
from pagesift.streaming.seen import SeenUrls


def test_last_put_wins(spark):
    puts = spark.createDataFrame([("a", 3, 1), ("a", 1, 2), ("b", 1, 3), ("b", 3, 4), ("c", 2, 5)], "url string, priority int, put_seq long")
    assert {r.url: r.priority for r in FR.unique_frontier(puts).collect()} == {"a": 1, "b": 3, "c": 2}
    assert {r.url: r.priority for r in FR.unique_frontier(puts, "min").collect()} == {"a": 1, "b": 1, "c": 2}
    assert [r.url for r in FR.pop(FR.unique_frontier(puts), 2).collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        FR.unique_frontier(puts, "max")


def one_worker(seeds, edges, relevance, depth, threshold):
    """A sequential crawl with a unique queue where the last put wins."""
    live, heap, crawled = {}, [], set()

    def put(p, u):
        live[u] = p
        heapq.heappush(heap, (p, u))

    for s in seeds:
        put(1, s)
    while heap:
        p, u = heapq.heappop(heap)
        if live.get(u) != p:
            continue
        del live[u]
        if u in crawled:
            continue
        crawled.add(u)
        if u not in relevance:
            continue
        own = 1 if relevance[u] > threshold else p + 1
        if own < depth:
            for v in edges.get(u, ()):
                if v not in crawled:
                    put(own, v)
    return crawled


GRAPHS = {
    "chain": ([("s", "a"), ("a", "b"), ("b", "c"), ("c", "d")], {}),
    "relevant in the middle": ([("s", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], {"a": 1.0}),
    "diamond": ([("s", "a"), ("a", "b"), ("b", "x"), ("s", "x"), ("x", "y"), ("y", "z")], {"b": 1.0}),
    "relevant cycle": ([("s", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "s")], {"s": 1.0, "a": 1.0, "b": 1.0}),
    "better label later": ([("s", "p"), ("p", "t"), ("t", "u"), ("u", "v"), ("s", "r"), ("r", "t")], {"r": 1.0}),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_traversal_contains_every_sequential_crawl(spark, name):
    pairs, relevant = GRAPHS[name]
    urls = {u for p in pairs for u in p}
    relevance = {u: relevant.get(u, -1.0) for u in urls}
    adjacent = {}
    for a, b in pairs:
        adjacent.setdefault(a, []).append(b)
    seeds = spark.createDataFrame([("s", 1)], "url string, priority int")
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([(u, "html", r) for u, r in relevance.items()], "url string, type string, relevance double")
    labels = {r.url: r.label for r in TR.focused_traversal(seeds, edges, nodes, -0.5, 3).collect()}
    best = {"s": 1}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a in best:
                own = 1 if relevance[a] > -0.5 else best[a] + 1
                if own < 3 and own < best.get(b, 99):
                    best[b], changed = own, True
    assert labels == best
    assert one_worker(["s"], adjacent, relevance, 3, -0.5) <= set(labels)


def test_schedule(spark):
    df = spark.createDataFrame([(f"u{i:02d}", 1 + i % 2) for i in range(23)], "url string, priority int")
    rows = sorted(FR.fetch_schedule(df, 5).collect(), key=lambda r: (r.priority, r.url))
    assert [r.slot for r in rows] == [i // 5 for i in range(23)]


def test_resume_and_finished(spark):
    queued = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 1), (2, "a", 1)], "crawl_id long, url string, priority int")
    crawled = spark.createDataFrame([(1, "b"), (2, "x")], "crawl_id long, url string")
    assert {tuple(r) for r in resume_queue(queued, crawled, ("crawl_id", "url")).collect()} == {(1, "a", 1), (2, "a", 1)}
    none = queued.limit(0)
    assert not FR.is_finished(queued.select("url"), crawled, none)
    assert FR.is_finished(crawled.select("url"), crawled, none) and not FR.is_finished(none.select("url"), crawled, queued)


def test_rates(spark):
    df = spark.sql("select timestamp_seconds(x) as ts from values (0.1), (0.2), (3.0), (3.5), (3.9) t(x)")
    r = report.download_rate(df).first()
    assert (r.latest_per_s, r.downloads, r.elapsed_s, r.mean_per_s) == (3, 5, 4, 1.25)


def test_readers(spark, tmp_path):
    (tmp_path / "train.csv").write_text('1,x,"Ein Satz.\nNoch ""einer""."\n2,y,Zwei\n2,y,Zwei\n', encoding="utf-8")
    docs = readers.training_texts(spark, str(tmp_path / "train.csv")).collect()
    assert sorted(d.text for d in docs) == ['Ein Satz.\nNoch "einer".', "Zwei", "Zwei"] and len({d.doc_id for d in docs}) == 3
    (tmp_path / "stop").write_text("Der\nder\nund so\n", encoding="utf-8")
    table = readers.stopwords(spark, str(tmp_path / "stop"))
    assert readers.stopword_tuple(table) == ("der", "und so")
    with pytest.raises(ValueError):
        readers.stopword_tuple(table, 1)


def test_store(spark):
    store = CrawlStore(spark, scratch_path(spark, "store"))
    settings = {"name": "x", "full_url": "https://x.de", "search_subdomains": True, "search_single_domain": False, "search_pdfs": False}
    assert [store.new_crawl(settings), store.new_crawl(settings)] == [1, 2]
    crawled = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "url string, last_fetched double")
    queue = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1)], "url string, priority int")
    for _ in range(2):
        store.save_crawl(1, crawled, queue)
    state = store.load_crawl(1)
    assert [tuple(r) for r in state.crawled.collect()] == [("a", 2.0)]
    assert [tuple(r) for r in state.queue.collect()] == [("b", 1)]
    store.save_crawl(1, crawled, queue.limit(0))
    assert store.load_crawl(1).queue.count() == 0 and store.load_crawl(2).crawled.count() == 0
    assert store.crawls().count() == 2 and store.settings(1).last_change >= store.settings(1).started
    with pytest.raises(KeyError):
        store.load_crawl(9)
    assert store.joined("crawled_urls").count() >= 1


WORDS = "Bürger beteiligen sich an der Planung der Stadt und der Rat hört den Bürgern gern zu wenn sie planen und fragen und bauen wollen. "


def page(url, links, relevant, head="", content_type="text/html"):
    body = WORDS * 3 if relevant else "Xaver zählt lauter quietschende Quallen jenseits blauer Zypressen ohne Pause durch Nacht Wind Regen Schnee Eis Hagel Sturm Donner. " * 3
    anchors = "".join(f'<p><a href="{h}">l</a></p>' for h in links)
    return (url, content_type, f"<html><head>{head}</head><body><p>{body}</p>{anchors}</body></html>", 5.0)


def test_focused_crawl(spark):
    h = "https://www.x.de"
    rows = [
        page(f"{h}/", ["/rel", "/dull", "https://other.org/", "http://shop.x.de/s", "/pdf"], True),
        page(f"{h}/rel", ["/move", "/blocked", "/hidden", "/hop"], True),
        page(f"{h}/dull", ["/d2"], False), page(f"{h}/d2", ["/d3"], False), page(f"{h}/d3", [], True),
        page(f"{h}/move", [], False, '<meta http-equiv="refresh" content="0; url=/final">'),
        page(f"{h}/final", ["/end"], True), page(f"{h}/blocked", ["/never"], True),
        page(f"{h}/hop", [], False, '<meta http-equiv="refresh" content="0; url=/blocked/sub">'), page(f"{h}/blocked/sub", [], True),
        page(f"{h}/hidden", ["/never"], True, '<meta name="robots" content="noindex">'),
        page(f"{h}/pdf", [], True, content_type="image/png"), page("https://other.org/", [], True), page("http://shop.x.de/s", [], True),
    ]
    pages = spark.createDataFrame(rows, "url string, content_type string, html string, last_fetched double")
    robots = spark.createDataFrame([(0, "User-agent: *"), (1, "Disallow: /blocked")], "line_no int, line string")
    docs = spark.createDataFrame([(1, WORDS), (2, WORDS)], "doc_id long, text string")
    config = pagesift.CrawlConfig(steps=0)
    model = pagesift.train(docs, "doc_id", config)
    model.rho_units -= 1  # one repeated sentence: its score is the threshold itself
    store = CrawlStore(spark, scratch_path(spark, "crawl"))
    settings = {"name": "x", "full_url": h, "search_subdomains": False, "search_single_domain": True, "search_pdfs": False}
    crawl = pagesift.FocusedCrawl(spark, store, model, config)
    crawl_id = crawl.initialize(crawl_settings=settings, start_urls=[f"{h}/"])
    crawl.run(pages, robots)
    found = {r.url for r in store.of_crawl("relevant_documents", crawl_id).collect()}
    assert found == {f"{h}/", f"{h}/rel", f"{h}/final", f"{h}/blocked/sub"}
    crawled = {r.url for r in crawl.crawled.collect()}
    assert crawled == {f"{h}{p}" for p in ("/", "/rel", "/dull", "/d2", "/move", "/final", "/blocked", "/hidden", "/pdf", "/hop", "/blocked/sub")}
    assert {r.url: r.priority for r in crawl.queue.collect()} == {f"{h}/end": 1}
    assert not crawl.finished()
    # Neither the blocked page nor those without document are extracted; unreached ones are, since reaching needs scores.
    assert crawl.pages_scored == 9
    state = store.load_crawl(crawl_id)  # saved with the documents, before any stop
    assert {r.url for r in state.crawled.collect()} == crawled and {r.url for r in state.queue.collect()} == {f"{h}/end"}
    r = crawl.report().first()
    assert (r.crawled, r.queued, r.parse_queued, r.relevant) == (11, 1, 0, 4)
    crawl.stop()
    again = pagesift.FocusedCrawl(spark, store, model, config)
    again.initialize(crawl_id=crawl_id)
    again.run(spark.createDataFrame([page(f"{h}/end", ["/", "/last"], True), *rows], pages.schema), robots)
    # Of all pages only the new one, one that was never reached and that behind no crawled URL are looked into.
    assert again.pages_scored == 4
    assert {r.url for r in again.queue.collect()} == {f"{h}/last"}
    assert store.of_crawl("relevant_documents", crawl_id).count() == 5


def test_waves_leave_edges_where_they_lie(spark):
    """From the second wave on nothing of the edges or the known labels is shuffled; old labels are merged."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.createDataFrame([(f"u{i}", f"u{i + 1}", "html", 1.0) for i in range(40)], "src string, dst string, type string, relevance double")
        out, known = bucketed(edges, "src", "edges"), Levels("url", "label", most=2, waves=2)
        new, _ = known.add(spark.createDataFrame([("u0", 1)], "url string, label int"))
        for _ in range(9):
            new, n = known.add(TR.wave(out, new, known, -0.5, 3))
            assert n == 1 and len(known.tables) <= 2
        plan = TR.wave(out, new, known, -0.5, 3)._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.split("\n") if "Scan parquet" in line and "Bucketed: true" in line]
        assert len(scans) >= 2, plan
        # The only exchanges are of the new labels (by source) and of their finds (by URL).
        assert plan.count("Exchange hashpartitioning") == 2, plan
        assert {r.url for r in known.all().collect()} == {f"u{i}" for i in range(10)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bitmaps_lose_no_key(spark):
    keys = spark.range(0, 5_000, 3).withColumnRenamed("id", "k").select(F.concat(F.lit("u"), F.col("k").cast("string")).alias("url"))
    rows = spark.range(5_000).select("id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    kept = {r.id for r in bitmaps.may_be_in(rows, "url", keys, 1_667).collect()}
    assert kept >= set(range(0, 5_000, 3)) and len(kept) < 1_667 + 0.1 * 3_333
    assert bitmaps.may_be_in(rows, "url", keys.limit(0), 0).count() == 0


SETTINGS = {"name": "n", "full_url": "https://a.org", "search_subdomains": True, "search_single_domain": False, "search_pdfs": False}


def rows_of(spark, urls, column, kind, crawl_id=1):
    return spark.createDataFrame([(u, v, crawl_id) for u, v in urls], f"url string, {column} {kind}, crawl_id long")


def test_save_is_all_or_nothing(spark):
    """A save that breaks between its writes leaves the old state whole."""
    store = CrawlStore(spark, scratch_path(spark, "store"))
    ids = store.new_crawls([SETTINGS, SETTINGS])
    crawled, queued = rows_of(spark, [("a", 1.0)], "last_fetched", "double"), rows_of(spark, [("b", 1), ("c", 2)], "priority", "int")
    store.save_crawls(ids, crawled, queued)

    def broken():
        raise RuntimeError("lost")

    more = rows_of(spark, [("a", 1.0), ("b", 2.0)], "last_fetched", "double")
    with pytest.raises(RuntimeError):
        store.save_crawls(ids, more, queued.limit(0), before_commit=broken)
    with pytest.raises(RuntimeError):
        store.save_batch("s", 0, crawled=more, queued=queued, before_commit=broken)
    state = CrawlStore(spark, store.path).load_crawl(1)
    assert [r.url for r in state.crawled.collect()] == ["a"] and sorted(r.url for r in state.queue.collect()) == ["b", "c"]
    store.save_crawls(ids, more, queued)
    assert store.vacuum() == 2  # the first save and the broken one
    state = store.load_crawl(1)
    assert sorted(r.url for r in state.crawled.collect()) == ["a", "b"] and [r.url for r in state.queue.collect()] == ["c"]
    assert store.load_crawl(2).crawled.count() == 0


def test_batches_count_once(spark):
    """A batch that comes again changes nothing, whatever it holds; a snapshot takes in what came before it."""
    store = CrawlStore(spark, scratch_path(spark, "store"))
    store.new_crawl(SETTINGS)
    docs = spark.createDataFrame([("a", 0.5, "html", "text", 1)], "url string, relevance double, type string, content string, crawl_id long")
    first = {"documents": docs, "crawled": rows_of(spark, [("a", 1.0)], "last_fetched", "double"), "queued": rows_of(spark, [("b", 1), ("b", 3), ("a", 1)], "priority", "int")}
    assert store.save_batch("s", 0, **first)
    other = {"documents": docs.withColumn("url", F.lit("z")), "crawled": rows_of(spark, [("z", 1.0)], "last_fetched", "double")}
    assert not store.save_batch("s", 0, **other)
    assert store.save_batch("s", 1, **first)  # the same rows in a later batch are no new rows
    assert [r.url for r in store.of_crawl("relevant_documents", 1).collect()] == ["a"]
    state = store.load_crawl(1)
    assert [(r.url, r.last_fetched) for r in state.crawled.collect()] == [("a", 1.0)] and [(r.url, r.priority) for r in state.queue.collect()] == [("b", 1)]
    store.save_crawl(1, state.crawled, state.queue.withColumn("priority", F.lit(2)))
    assert [(r.url, r.priority) for r in store.load_crawl(1).queue.collect()] == [("b", 2)]
    store.save_batch("s", 2, queued=rows_of(spark, [("c", 1)], "priority", "int"))
    assert sorted(r.url for r in store.load_crawl(1).queue.collect()) == ["b", "c"]
    with pytest.raises(ValueError):
        store.save_batch("a/b", 0, **first)


def test_two_writers_get_two_ids(spark):
    """A writer that finds its number taken reads again."""
    path = scratch_path(spark, "store")
    store, other = CrawlStore(spark, path), CrawlStore(spark, path)
    read, calls = store.manifest.read, []

    def slow():
        state = read()
        if not calls:
            calls.append(other.new_crawl(SETTINGS))
        return state

    store.manifest.read = slow
    assert store.new_crawl(SETTINGS) == 2 and calls == [1] and store.crawls().count() == 2


def test_seen_urls(spark):
    seen = SeenUrls(spark, scratch_path(spark, "seen"), buckets=3, least=20)
    table = lambda urls: spark.createDataFrame([(u,) for u in urls], "url string")
    known, rng = set(), random.Random(3)
    for batch in range(8):
        urls = [f"u{rng.randrange(60)}" for _ in range(25)] + [None]
        new = {r.url for r in seen.add(table(urls), batch).collect()}
        assert new == {u for u in urls if u} - known
        assert {r.url for r in seen.add(table(["never"]), batch).collect()} == new  # again: what it gave
        known |= new
        rows = [r.url for r in seen.urls().collect()]
        assert len(rows) == len(known) and set(rows) == known
    assert seen.manifest.read()[1]["generation"] >= 2
