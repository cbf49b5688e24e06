"""Links of pages: extraction, classes, scope, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html as H, urls as U
from ..plans.unnest import unnest


def with_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Add ``links``: the distinct ``(link, link_class)`` pairs of each page, as one array.

    Distinctness is per page and a page is one row, so ``array_distinct`` replaces
    a shuffle. A link with no host is left out; one without href is the site root.
    """
    found = (
        pages.withColumn("_root", U.site_root(F.col(url)))
        .withColumn("_base", F.when(U.host(F.col(url)).isNotNull(), U.labels(U.host(F.col(url)))))
        .withColumn("_tags", H.tags(F.col(html), "a"))
        .withColumn("_hrefs", F.array_distinct(F.transform("_tags", lambda t: H.attribute(t, "href"))))
        .withColumn("_urls", F.array_distinct(F.transform("_hrefs", lambda h: U.resolve(h, F.col("_root")))))
    )
    pair = lambda u: F.struct(u.alias("link"), U.link_class(u, F.col("_base")).alias("link_class"))
    return found.withColumn(
        "links", F.filter(F.transform("_urls", pair), lambda p: p["link_class"].isNotNull())
    ).drop("_root", "_base", "_tags", "_hrefs", "_urls")


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Rows ``(src, link, link_class)``, distinct per page."""
    found = with_links(pages.select(url, html), url, html).withColumnRenamed(url, "src")
    return unnest(found, ["src"], "links", "l").select("src", "l.link", "l.link_class")


def in_scope(link_class: Column, search_single_domain: bool, search_subdomains: bool) -> Column:
    """Internal links always; external and subdomain links by the crawl's settings."""
    return (
        (link_class == "internal")
        | ((link_class == "external") & F.lit(not search_single_domain))
        | ((link_class == "subdomain") & F.lit(search_subdomains))
    )


def link_class_counts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Per page: number of distinct internal, subdomain and external links (no shuffle)."""
    def count_of(name: str) -> Column:
        return F.size(F.filter("links", lambda p: p["link_class"] == name)).cast("long").alias(name)

    counted = with_links(pages.select(url, html), url, html)
    return counted.select(F.col(url).alias("src"), *[count_of(c) for c in ("internal", "subdomain", "external")])


def host_link_counts(counts: DataFrame) -> DataFrame:
    """Roll the page counts up to hosts; partial sums are combined before the shuffle."""
    return (
        counts.filter(U.host(F.col("src")).isNotNull())
        .groupBy(U.host(F.col("src")).alias("host"))
        .agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("internal", "subdomain", "external")])
    )
