"""URL filters whose decisions reach the aliases of a URL. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .graph import components

# How alias links stand in HTML, and what a reference may begin with.
CANONICAL = r"(?i)<link\s[^>]*rel\s*=\s*[\"']?canonical[\"'\s/>][^>]*>?"
REFRESH = r"(?i)<meta\s[^>]*http-equiv\s*=\s*[\"']?refresh[\"'\s/>][^>]*>?"
HREF = r"(?i)\shref\s*=\s*[\"']?([^\"'\s>]*)"
CONTENT_URL = r"(?i)\scontent\s*=\s*[\"'][^\"';,]*[;,]\s*(?:url\s*=\s*)?([^\"'\s>]*)"
OTHER_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """A URL's name in the alias graph: host, path and query; null without a host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    path = F.when(url_path(url) == "", "/").otherwise(url_path(url))
    return F.when(url_host(url) != "", F.concat(url_host(url), path, query))


def alias_node(reference: Column, url: Column) -> Column:
    """The node that a reference in the page ``url`` names; null if it is empty or of another kind."""
    ref = F.replace(F.regexp_replace(reference, "#.*$", ""), F.lit("&amp;"), F.lit("&"))
    folder = F.regexp_extract(url_path(url), r"^(?s)(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    inside = (
        F.when(ref.startswith("/"), ref)
        .when(ref.startswith("?"), F.concat(F.when(url_path(url) == "", "/").otherwise(url_path(url)), ref))
        .otherwise(F.concat(folder, ref))
    )
    return (
        F.when(ref.isNull() | (ref == ""), F.lit(None))
        .when(ref.startswith("//"), url_node(F.concat(F.lit("x:"), ref)))
        .when(ref.rlike(OTHER_SCHEME + "//"), url_node(ref))
        .when(ref.rlike(OTHER_SCHEME) | (url_host(url) == ""), F.lit(None))
        .otherwise(F.concat(url_host(url), inside))
    )


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (host and path together) that fits as ``struct(rule, verdict)``; null if none does.

    Of equally long rules an allow comes before a block, then the text decides.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict != "allow", r.host + r.path), reverse=False):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def page_aliases(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges ``a, b`` from a page to its canonical link and its refresh target."""
    u, h = F.col(url), F.col(html)
    canonical = F.regexp_extract(F.regexp_extract(h, CANONICAL, 0), HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract(h, REFRESH, 0), CONTENT_URL, 1)
    found = pages.select(u.alias("u"), F.array(canonical, refresh).alias("refs"))
    # The outer form keeps Catalyst from computing the patterns once more in an inferred filter.
    found = found.select("u", F.explode_outer("refs").alias("ref")).filter("ref <> ''")
    return found.select(url_node(F.col("u")).alias("a"), alias_node(F.col("ref"), F.col("u")).alias("b"))


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    The longest rule that fits the URL decides. A URL without a rule is blocked if one of its
    aliases, near or far, is blocked by a rule, whether there is a page of that alias or not; else it is allowed. So an explicit
    allow holds against any blocked alias. Aliases are connected by the canonical links and meta refreshes of the
    pages and by ``redirects`` (``url, target``, absolute URLs), in either direction. In that graph scheme and fragment
    do not count and an empty path is ``/``; dot segments are not folded.

    Rules are literals of the plan, for lists of some hundreds. Components come from distributed
    rounds on the edges; pages without an alias take part in none of it.

    A null URL or one without ``://`` has an empty host and path, and no alias. A null html has no links. Pages that
    repeat get a row each. Other columns are not looked at. No rows give no rows.
    """
    edges = page_aliases(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_node(F.col("url")).alias("a"), url_node(F.col("target")).alias("b")))
    groups = components(edges)
    host, path = F.substring_index("node", "/", 1), F.regexp_extract("node", r"(?s)^[^/]*([^?]*)", 1)
    bad = groups.filter(matching_rule(host, path, rules)["verdict"] == "block").select("component").distinct()
    tainted = groups.join(bad, "component", "left_semi").select("node")

    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"))
    own = own.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), url_node(F.col("url")).alias("node"))
    own = own.withColumn("own", matching_rule(F.col("host"), F.col("path"), rules))
    judged = own.join(tainted.withColumn("tainted", F.lit(True)), "node", "left")
    verdict = F.coalesce("own.verdict", F.when(F.col("tainted"), "block"), F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))
