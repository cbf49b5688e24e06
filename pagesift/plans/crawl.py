"""A focused crawl over tables of fetched pages: initialize, run, report, stop, resume."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import html as H, urls as U
from ..operators import directives, features, frontier, links, oneclass, report, sentences as S, traversal
from ..operators.content import with_content
from ..sources.state import CrawlStore
from .bitmaps import may_be_in
from .materialize import materialize, portioned, spread


@dataclass(frozen=True)
class CrawlConfig:
    """Parameters of a crawl; the defaults are those of the documented example."""

    user_agent: str = "pagesift"
    threshold: float = -0.5
    search_depth: int = 3
    extractor: str = "density"
    feature_percentage: float = 0.8
    nu: float = 0.05
    steps: int = 20
    respect_nofollow: bool = False
    per_host_robots: bool = False
    text: S.TextSettings = field(default_factory=S.TextSettings)


def train(docs: DataFrame, key: str, config: CrawlConfig = CrawlConfig(), text: str = "text") -> oneclass.OneClassModel:
    """Positive texts to a one-class model: sentences, terms, vocabulary, fit."""
    terms = training_terms(docs, key, config.text, text)
    vocab = features.vocabulary(terms, config.feature_percentage)
    return oneclass.fit_linear(terms, vocab, key, config.nu, config.steps, config.text.vectorizer)


def training_terms(docs: DataFrame, key: str, settings: S.TextSettings, text: str = "text") -> DataFrame:
    """Materialized ``(key, sent_no, terms)`` of the training sentences, read in tasks of at most about TASK_TERMS terms; the texts are read once."""
    sents = S.to_sentences(spread(docs.select(key, text)), key, settings, text)
    terms = materialize(S.with_terms(sents, settings, key).drop("sentence"), "training-terms")
    return portioned(terms, F.size("terms"), S.TASK_TERMS)


class FocusedCrawl:
    """One crawl in a store. Pages come as a table ``url, content_type, html`` (``last_fetched``, ``text``)."""

    def __init__(self, spark: SparkSession, store: CrawlStore, model: oneclass.OneClassModel, config: CrawlConfig = CrawlConfig()):
        self.spark, self.store, self.model, self.config = spark, store, model, config
        self.crawl_id: int | None = None
        self.crawled = self.queue = None
        self.pages_scored = 0

    def initialize(self, crawl_id: int | None = None, crawl_settings: dict | None = None, start_urls=()) -> int:
        """Start a new crawl or load one; seeds enter the frontier at priority 1."""
        if crawl_id is None:
            crawl_id = self.store.new_crawl(crawl_settings)
        state = self.store.load_crawl(crawl_id)
        self.crawl_id, self.settings, self.crawled = crawl_id, state.settings, materialize(state.crawled, "crawled")
        puts = [state.queue.withColumn("put_seq", F.lit(-1).cast("long"))]
        if start_urls:
            puts.append(frontier.seeds(self.spark, list(start_urls)))
        self.queue = materialize(frontier.unique_frontier(frontier.union_puts(*puts)), "queue")
        return crawl_id

    def _facts(self, pages: DataFrame, robots_lines: DataFrame | None) -> DataFrame:
        """What headers, meta tags and robots rules say of each page; no text and no link is looked at."""
        p = spread(pages.select("url", "content_type", "html", "last_fetched"))
        p = p.withColumn("type", H.document_type(F.col("content_type"), self.settings["search_pdfs"]))
        p = directives.with_refresh(directives.with_directive(p)).drop("html", "content_type")
        p = p.withColumn("document", F.col("type").isNotNull() & (F.col("directive") >= 0) & F.col("refresh").isNull())
        p = p.withColumn("follow", F.col("directive") == 1).withColumn("host", U.host(F.col("url")))
        if robots_lines is None:
            return p.withColumn("allowed", F.lit(True))
        site = "host" if self.config.per_host_robots else None
        return directives.with_allowed(p, directives.robots_rules(robots_lines, self.config.user_agent, site), site)

    def _extracted(self, pages: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
        """Links and main text of the wanted pages; the HTML is left behind.

        A bitmap of the wanted URLs stands below the extraction, so other pages are hardly ever looked into and no HTML
        moves; the exact test comes after it, on slim rows.
        """
        p = may_be_in(spread(pages.select("url", "content_type", "html", "text")), "url", wanted, n_wanted)
        p = p.withColumn("type", H.document_type(F.col("content_type"), self.settings["search_pdfs"]))
        p = with_content(links.with_links(p), self.config.extractor)
        content = F.when(F.col("type") == "html", F.col("content")).otherwise(F.coalesce("text", F.lit("")))
        return p.select("url", "links", content.alias("content")).join(wanted, "url", "left_semi")

    def run(self, pages: DataFrame, robots_lines: DataFrame | None = None) -> DataFrame:
        """Crawl until the frontier holds only URLs that are not among the pages.

        Saves relevant documents, crawled URLs and the new frontier in one step, and returns the outcome per URL. A URL without page
        stays queued; a page refused by robots rules, type or directive counts as crawled. Pages that were crawled
        before or may not be fetched are neither extracted nor scored, unless a redirect leads to them;
        ``pages_scored`` tells how many were.
        """
        cfg = self.config
        for name, kind in (("last_fetched", "double"), ("text", "string")):
            if name not in pages.columns:
                pages = pages.withColumn(name, F.lit(None).cast(kind))
        facts = materialize(self._facts(pages, robots_lines), "facts")
        fresh = frontier.not_crawled(facts.filter("allowed"), self.crawled)
        # Robots rules judge the URL that is popped, not the hops behind it.
        moving = facts.filter("type = 'html' AND directive >= 0 AND target IS NOT NULL")
        hops = directives.follow_redirects(fresh.join(moving.select("url"), "url", "left_semi").select("url"), moving.select("url", "target"))
        hops = materialize(hops, "hops")
        moved = hops.filter("outcome = 'page' AND hop > 0").select("start", F.col("url").alias("final"))
        wanted = fresh.filter("document").select("url").unionByName(moved.select(F.col("final").alias("url")))
        wanted, seen = materialize(wanted.distinct().join(facts.filter("document").select("url"), "url", "left_semi"), "wanted", n=F.count("*"))
        extracted, scored = materialize(self._extracted(pages, wanted, seen["n"] or 0), "pages", n=F.count("*"))
        self.pages_scored = scored["n"] or 0
        terms = S.with_terms(S.to_sentences(extracted.select("url", F.col("content").alias("text")), "url", cfg.text, keep_empty=True), cfg.text, "url")
        relevance = oneclass.document_relevance(oneclass.sentence_votes(terms, self.model, "url"), "url")
        docs = facts.filter("document").select("url", "type", "allowed", "follow", "last_fetched")
        nodes = materialize(docs.join(relevance, "url"), "nodes")
        scope = links.in_scope(F.col("l.link_class"), self.settings["search_singledomain"], self.settings["search_subdomains"])
        edges = extracted.select("url", F.explode("links").alias("l")).filter(scope).select(F.col("url").alias("src"), F.col("l.link").alias("dst"))
        if cfg.respect_nofollow:
            edges = edges.join(docs.filter("follow").select(F.col("url").alias("src")), "src", "left_semi")
        own = edges.join(docs.filter("allowed").select(F.col("url").alias("src")), "src", "left_semi")
        all_nodes = nodes.filter("allowed").select("url", "type", "relevance").unionByName(
            moved.join(nodes.withColumnRenamed("url", "final"), "final").select(F.col("start").alias("url"), "type", "relevance")
        )
        all_edges = own.unionByName(moved.join(edges.withColumnRenamed("src", "final"), "final").select(F.col("start").alias("src"), "dst"))
        labels = materialize(
            traversal.focused_traversal(self.queue.select("url", "priority"), all_edges, all_nodes, cfg.threshold, cfg.search_depth, self.crawled),
            "labels",
        )
        # A refresh without target is an error: that page is neither a document nor crawled.
        fetched = facts.filter("refresh IS NULL OR target IS NOT NULL").select("url", "last_fetched")
        visited = labels.join(fetched, "url")
        via = visited.select(F.col("url").alias("start")).join(hops.select("start", "url"), "start").select("url")
        now = time.time()
        hop_rows = via.distinct().select("url", F.lit(now).alias("last_fetched"))
        new_crawled = visited.select("url", F.coalesce("last_fetched", F.lit(now)).alias("last_fetched")).unionByName(hop_rows)
        direct = visited.select("url").join(facts.filter("allowed").select("url"), "url")
        found = oneclass.relevant(nodes, cfg.threshold).join(direct.unionByName(via).distinct(), "url", "left_semi")
        found = materialize(frontier.not_crawled(found, self.crawled), "found")
        # Only the found pages meet their HTML again.
        raw = pages.select("url", F.col("html").alias("raw_content")).join(found.select("url", "last_fetched", "type", "follow", "relevance"), "url")
        new_crawled = materialize(new_crawled, "new-crawled")
        self.crawled = materialize(self.crawled.unionByName(new_crawled).groupBy("url").agg(F.max("last_fetched").alias("last_fetched")), "crawled")
        left = labels.select("url", F.col("label").alias("priority"))
        self.queue = materialize(frontier.not_crawled(left, self.crawled), "queue")
        crawl = F.lit(self.crawl_id).cast("long").alias("crawl_id")
        source = f"crawl-{self.crawl_id}"
        self.store.save_batch(
            source, self.store.last_batch(source) + 1, extracted.select("url", "content").join(raw, "url").select("*", crawl),
            new_crawled.select("*", crawl), self.queue.select("*", crawl),
        )
        return traversal.crawl_outcome(labels, all_nodes, cfg.threshold)

    def finished(self) -> bool:
        """Is nothing queued that was not crawled? A run leaves no page unscored."""
        return frontier.is_finished(self.queue, self.crawled, self.queue.limit(0))

    def report(self) -> DataFrame:
        """Crawled, queued, to-parse and relevant counts of this crawl."""
        tag = lambda df: df.withColumn("crawl_id", F.lit(self.crawl_id).cast("long"))
        docs = self.store.of_crawl("relevant_documents", self.crawl_id)
        one = self.store.crawls().filter(F.col("crawl_id") == self.crawl_id)
        return report.crawl_report(one, tag(self.crawled), tag(self.queue), tag(self.queue.limit(0)), docs, -math.inf)

    def stop(self) -> None:
        """Save the progress; ``initialize(crawl_id=...)`` goes on from it."""
        self.store.save_crawl(self.crawl_id, self.crawled, self.queue)
