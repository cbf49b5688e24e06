import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagesift.catalog import queries as Q
from pagesift.catalog.oracles import ORACLES
from pagesift.operators import features, oneclass
from pagesift.plans.materialize import scratch_path
from pagesift.streaming import jobs
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUICK = [
    "url_parts", "page_links", "page_blocks", "content_density", "content_largest", "redirect_chain", "charset_decode", "robots_filter", "tokens",
    "tfidf_vectors", "oneclass_linear", "relevant_docs", "frontier_unique", "priority_step", "focused_traversal", "fetch_schedule", "crawl_report", "stream_rate", "frontier_union", "focused_crawl", "documents_sink", "stream_sinks", "stream_dedupe", "stopword_table", "period_words",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_entry_hides_no_import_error(tmp_path):
    """A fault inside the training-data operators is told; only their absence is none."""
    root = os.path.dirname(entry.__file__)
    for name, text, fails in (("broken", "import no_such_module\n", True), ("without", None, False)):
        copy = tmp_path / name
        shutil.copytree(f"{root}/pagesift", copy / "pagesift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(f"{root}/__spark_entry__.py", copy)
        if text:
            (copy / "corpus_pipeline.py").write_text(text)
            (copy / "pagesift/llm").mkdir()
            (copy / "pagesift/llm/__init__.py").write_text("")
        run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
        assert (run.returncode != 0) == fails, run.stderr
        assert fails or int(run.stdout) == len(Q.QUERIES)


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(ORACLES) <= set(entry.oracle_sql())


def test_stream_in_several_batches_equals_batch(spark):
    pages = Q.read(spark, SF, "pages")
    folder = scratch_path(spark, "in")
    pages.repartition(4).write.parquet(folder)
    terms = Q._training(spark, SF)
    model = oneclass.fit_centroid(terms, features.vocabulary(terms, 0.8), "doc_id")
    stream = jobs.page_stream(spark, folder, pages.schema, files_per_trigger=1)
    out = scratch_path(spark, "out")
    Q._done(jobs.start_scoring(stream, model, Q.SETTINGS, out, scratch_path(spark, "mark"), -0.5))
    got = spark.read.parquet(out)
    want = oneclass.relevant(jobs.score_pages(pages, model, Q.SETTINGS), -0.5)
    assert got.select("batch").distinct().count() == 4
    assert {(r.page_id, r.relevance) for r in got.collect()} == {(r.page_id, r.relevance) for r in want.collect()}


def test_stream_dedupe_with_watermark(spark):
    folder, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    df = spark.sql("select url, timestamp_seconds(t) as ts from values ('a', 1), ('b', 2), ('a', 3), ('a', 4) x(url, t)")
    df.write.parquet(folder)
    Q._done(jobs.start_dedupe(jobs.page_stream(spark, folder, df.schema), out, scratch_path(spark, "mark"), "ts"))
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_plans_stay_narrow(spark):
    """Pages become text and links without a shuffle, and unused columns are not read."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    from pagesift.operators import content, links

    for df in (content.with_content(pages).select("page_id", "content"), links.page_links(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    plan = content.with_content(pages).select("page_id", "content")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan
    assert F is not None


def test_scoring_delivers_documents(spark, tmp_path):
    from pagesift.catalog import queries as Q
    from pagesift.streaming import jobs

    sf, model = "/root/testdata/sf0.001", Q._fit(spark, "/root/testdata/sf0.001", 0)
    args = (model, Q.SETTINGS, f"{tmp_path}/out", f"{tmp_path}/mark", -1e9)
    query = jobs.start_scoring(Q._stream(spark, sf, "pages"), *args, keep=("url", "content"), trigger={"processingTime": "1 second"})
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.read.parquet(f"{tmp_path}/out").join(spark.read.parquet(f"{sf}/pages.parquet"), ["page_id", "url"])
    assert got.count() == spark.read.parquet(f"{tmp_path}/out").count() > 0
    assert got.filter("content <> ''").count() > 0


def test_streams_take_tables_of_one_file_and_folders(spark):
    """The same rows come from a table that is one file and from one that is a folder of files."""
    rows = [(i, f"http://h{i}.{tld}/{i}", f'<html lang="{"de" if i % 3 else "fr"}">') for i, tld in enumerate(["com", "net", "org"] * 7)]
    got = []
    for files in (1, 3):
        folder = scratch_path(spark, "sf")
        for name, df in (("pages", spark.createDataFrame(rows, "page_id long, url string, html string")),
                         ("events", spark.range(5).select(F.timestamp_seconds(F.col("id") * 7200).alias("ts")))):
            df.repartition(files).write.parquet(made := f"{folder}/{name}.parquet" if files > 1 else scratch_path(spark, "made"))
            if files == 1:
                os.makedirs(folder, exist_ok=True)
                shutil.copy(next(f"{made}/{f}" for f in os.listdir(made) if f.endswith(".parquet")), f"{folder}/{name}.parquet")
        found = sorted((r.crawl_id, r.relevant) for r in Q.stream_found(spark, folder).collect())
        got.append((found, Q.stream_rate(spark, folder).count()))
    assert got == [([(2, 7), (3, 7)], 4)] * 2


def test_finished_looks_at_the_queue_of_every_crawl(spark):
    folder = scratch_path(spark, "sf")
    rows = [(1, "https://a.com/1", ""), (2, "http://a.net/1", ""), (3, "http://a.org/1", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    assert {r.crawl_id: r.finished for r in Q.finished_test(spark, folder).collect()} == {1: False, 2: True, 3: True}


def test_counting_tasks_hold_bounded_text(spark, tmp_path, monkeypatch):
    """However a file is cut into scan tasks: no task counts much more than TASK_TEXT, equal and null texts included."""
    monkeypatch.setattr(Q.S, "TASK_TEXT", 6_000)
    rows = [(None if i % 9 == 0 else i % 40, None if i % 50 == 0 else f"Haus{i % 30} Baum{i} steht dort. Er ist da.") for i in range(2_000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = Q.counted(Q.documents(spark, str(tmp_path)))
    size = docs.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n"), F.count("*")).first()
    assert size[0] <= 6_000 and size[1] >= 10
    assert docs.count() == 2_000
    few = Q.ngrams(spark, str(tmp_path))
    monkeypatch.setattr(Q.S, "TASK_TEXT", 1 << 30)
    many = Q.ngrams(spark, str(tmp_path))
    dealt = ["RoundRobin" in q._jdf.queryExecution().executedPlan().toString() for q in (few, many)]
    assert dealt == [True, False], few._jdf.queryExecution().executedPlan().toString()
    assert rows_of(few.columns, few.collect()) == rows_of(many.columns, many.collect())


@pytest.mark.parametrize("name", ["sentence_votes", "doc_relevance"])
def test_votes_come_from_a_whole_fit(spark, con, monkeypatch, name):
    """The model has made all its steps, here and in the SQL."""
    steps, fit = [], oneclass.fit_linear
    monkeypatch.setattr(oneclass, "fit_linear", lambda *a, **b: steps.append(a[4]) or fit(*a, **b))
    df = Q.QUERIES[name](spark, SF)
    assert steps == [20]
    cur = con.execute(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())
