"""Page directives, redirects, charsets and robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import html as H, urls as U
from ..plans.joins import BROADCAST_BYTES, BROADCAST_ROWS, lookup
from ..plans.materialize import materialize


# --- meta directives --------------------------------------------------------
def with_directive(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``directive``: -1 noindex, 0 nofollow, 1 neither."""
    return pages.withColumn("directive", H.robots_directive(F.col(html)))


def indexable(pages: DataFrame) -> DataFrame:
    """Drop noindex pages; ``follow`` is true where links may be followed."""
    return pages.filter(F.col("directive") >= 0).withColumn("follow", F.col("directive") == 1)


def with_refresh(pages: DataFrame, base_url: str | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """Add ``refresh`` (raw content) and ``target``.

    With ``base_url`` the target is glued to it, even an absolute one; without,
    targets are resolved against the page's site root. A refresh without
    ``;`` has no target: such a page is dropped, and not marked crawled.
    """
    out = pages.withColumn("refresh", H.refresh_content(F.col(html)))
    target = (
        U.refresh_target(F.col("refresh"), F.lit(base_url))
        if base_url is not None
        else U.refresh_target(F.col("refresh"), F.lit(""), F.col(url))
    )
    return out.withColumn("target", target)


HOPS = 8  # hops that one row holds


def follow_redirects(starts: DataFrame, redirects: DataFrame) -> DataFrame:
    """Follow ``redirects(url, target)`` from each ``starts(url)`` to its end.

    Returns ``(start, hop, url, outcome)``, one row per visited URL: every hop
    counts as crawled. ``outcome`` is 'page' on the last URL of a finished chain,
    'loop' on the last one before a repeat, and NULL in between. There is no hop limit: a chain ends
    at a page or before the first URL that it has seen.

    Each redirect first learns its next HOPS URLs, which ends nearly all chains. For longer ones jumps over HOPS
    hops are doubled (a table of jumps joined with itself), so a chain of L hops takes log2(L / HOPS) rounds, and as many
    again to list its URLs. No row grows with its chain.
    """
    edges = redirects.filter(F.col("url").isNotNull() & F.col("target").isNotNull()).groupBy("url").agg(F.min("target").alias("to"))
    edges, seen = materialize(edges, "redirects", n=F.count("*"), size=F.sum(F.octet_length("url") + F.octet_length("to")))
    n_edges = seen["n"] or 0 if (seen["size"] or 0) <= BROADCAST_BYTES else BROADCAST_ROWS + 1
    ways, found = materialize(_ways(edges, n_edges), "ways", long=F.count_if(F.col("n").isNull()))
    chains = starts.select(F.col("url").alias("start")).filter("start IS NOT NULL").distinct().withColumn("url", F.col("start"))
    whole = ways.select("url", "n", "outcome")
    jumps: list[DataFrame] = []
    if found["long"]:
        jumps, whole = _long_ways(ways)
    heads = lookup(chains, whole, "url").select(
        "start", F.lit(0).cast("long").alias("hop"), "url", F.coalesce("n", F.lit(1).cast("long")).alias("n"), F.coalesce("outcome", F.lit("page")).alias("outcome")
    )
    if jumps:
        heads = _heads(heads, jumps)
    rows = lookup(heads, ways.select("url", "path"), "url")
    own = F.concat(F.array("url"), F.coalesce("path", F.array().cast("array<string>")))
    own = F.slice(own, F.lit(1), F.least(F.lit(HOPS).cast("long"), F.col("n") - F.col("hop")).cast("int"))
    rows = rows.select("start", "n", "outcome", F.col("hop").alias("_first"), F.posexplode(own).alias("_i", "url")).withColumn("hop", F.col("_first") + F.col("_i"))
    return rows.select("start", F.col("hop").cast("int").alias("hop"), "url", F.when(F.col("hop") == F.col("n") - 1, F.col("outcome")).alias("outcome"))


def _ways(edges: DataFrame, n_edges: int) -> DataFrame:
    """``url, path, n, outcome``: the next HOPS URLs of each redirect, and how many URLs its chain has and how it ends, if that shows in them."""
    step = edges.select(F.col("url").alias("_at"), F.col("to").alias("_to"))
    far = edges.select("url", F.array("to").alias("path"))
    for k in range(1, HOPS):
        at = F.when(F.size("path") == k, F.get("path", F.lit(k - 1)))
        far = lookup(far.withColumn("_at", at), step, "_at", one_rows=n_edges)
        far = far.select("url", F.when(F.col("_to").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("_to"))).alias("path"))
    distinct = F.size(F.array_distinct(F.concat(F.array("url"), "path"))).cast("long")
    loops, ends = distinct <= F.size("path"), F.size("path") < HOPS
    return far.select("url", "path", F.when(loops | ends, distinct).alias("n"), F.when(loops, "loop").when(ends, "page").alias("outcome"))


def _long_ways(ways: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Doubled jumps of the long chains, and ``url, n, outcome`` of every redirect."""
    behind = ways.select(F.col("url").alias("_to"), F.col("path").alias("_path"), F.col("n").alias("_n"), F.col("outcome").alias("_outcome"))
    long = lookup(ways.filter(F.col("n").isNull()).select("url", "path", F.get("path", F.lit(HOPS - 1)).alias("_to")), behind, "_to")
    # The last jump of a chain leads to a URL whose end is known. A loop may begin within that jump, so the two ways count as one.
    both = F.concat(F.array("url"), "path", F.coalesce("_path", F.array().cast("array<string>")))
    tail = F.when(F.col("_path").isNull() | F.col("_n").isNotNull(), F.size(F.array_distinct(both)).cast("long"))
    long = materialize(long.select("url", "path", tail.alias("tail"), F.coalesce("_outcome", F.lit("page")).alias("outcome")), "long-ways")
    low = F.least("url", F.array_min(F.slice("path", 1, HOPS - 1)))
    jumps, open_urls = _jumps(long.select("url", F.get("path", F.lit(HOPS - 1)).alias("to"), low.alias("low"), "tail", "outcome"))
    n = (F.col("dist") - 1) * HOPS + F.col("tail")
    done = ways.filter(F.col("n").isNotNull()).select("url", "n", "outcome").unionByName(jumps[-1].filter("ended").select("url", n.alias("n"), "outcome"))
    if open_urls is None:
        return jumps, materialize(done, "lengths")
    # Jumps of more hops than any way into a cycle land on every URL of the cycles, and on no other.
    on = materialize(open_urls.join(open_urls.select(F.col("to").alias("url")).distinct(), "url", "left_semi").select("url", F.col("low").alias("cycle")), "cycles")
    sizes = on.groupBy("cycle").agg(F.count("*").alias("n"))
    on = materialize(on.join(sizes, "cycle").select("url", "n"), "cycle-lengths")
    # The ways into the cycles hop by hop, ended by the first URL of a cycle.
    inward = long.join(open_urls.select("url"), "url", "left_semi").join(on.select("url"), "url", "left_anti")
    inward, _ = _jumps(inward.select("url", F.get("path", F.lit(0)).alias("to"), F.col("url").alias("low"), F.lit(0).alias("tail"), F.lit("").alias("outcome")))
    into = lookup(inward[-1].select("url", F.col("to").alias("_entry"), "dist"), on.select(F.col("url").alias("_entry"), "n"), "_entry")
    looping = on.unionByName(into.select("url", (F.col("dist") + F.col("n")).alias("n")))
    return jumps, materialize(done.unionByName(looping.withColumn("outcome", F.lit("loop"))), "lengths")


def _jumps(edges: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables of 2^k jumps along ``edges(url, to, low, tail, outcome)``, and of the last one the URLs whose chain never ends.

    A chain ends at a URL without an edge and stays there, after ``dist`` jumps, with ``tail`` and ``outcome`` of the last of
    them; ``low`` is the least URL of those left behind. Rounds
    end when no chain has ended in one (a chain of more jumps than the round makes would hold one that does), and, if chains are
    left, when each of their jumps lands on a cycle and knows the least URL of it: then a round changes neither the
    number of URLs that are landed on nor any ``low``.
    """
    edges = materialize(edges, "edges")
    goes_on = edges.select(F.col("url").alias("to"), F.lit(False).alias("ended"))
    first = edges.join(goes_on, "to", "left").select("url", "to", F.lit(1).cast("long").alias("dist"), F.coalesce("ended", F.lit(True)).alias("ended"), "low", "tail", "outcome")
    one, seen = materialize(first, "jump", open=F.count_if(~F.col("ended")), n=F.count("*"), size=F.sum(F.octet_length("url") + F.octet_length("to") + F.octet_length("low")))
    jumps, landed, left = [one], None, seen["open"]
    n = seen["n"] if (seen["size"] or 0) <= BROADCAST_BYTES else BROADCAST_ROWS + 1
    while left:
        last = jumps[-1]
        second = last.select(F.col("url").alias("_at"), *[F.col(c).alias(f"_{c}") for c in ("to", "dist", "ended", "low", "tail", "outcome")])
        going = lookup(last.filter(~F.col("ended")).drop("tail", "outcome").withColumnRenamed("to", "_at"), second, "_at", one_rows=n)
        going = going.select(
            "url", F.col("_to").alias("to"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_ended").alias("ended"), F.least("low", "_low").alias("low"),
            F.col("_tail").alias("tail"), F.col("_outcome").alias("outcome"), ((F.col("_low") < F.col("low")) & ~F.col("_ended")).alias("_moved"),
        )
        stay = last.filter("ended").withColumn("_moved", F.lit(False))
        table, found = materialize(going.unionByName(stay), "jump", open=F.count_if(~F.col("ended")), moved=F.count_if("_moved"))
        jumps.append(table.drop("_moved"))
        if found["open"] == left:  # what is left runs in cycles
            image = table.filter(~F.col("ended")).select("to").distinct().count()
            if image == landed and not found["moved"]:
                return jumps, jumps[-1].filter(~F.col("ended"))
            landed = image
        left = found["open"]
    return jumps, None


def _heads(heads: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """Every HOPS-th URL of each chain, the number of rows doubled in each round."""
    heads, seen = materialize(heads, "heads", n=F.max("n"))
    for k, jump in enumerate(jumps):
        wide = HOPS << k
        if wide >= (seen["n"] or 0):
            break
        far = F.col("hop") + wide
        more = lookup(heads.filter(far < F.col("n")), jump.filter(F.col("dist") == 1 << k).select("url", "to"), "url")
        heads = heads.unionByName(materialize(more.select("start", far.alias("hop"), F.col("to").alias("url"), "n", "outcome"), "heads"))
    return heads


# --- charset ----------------------------------------------------------------
def site_charset(pages: DataFrame, raw: str = "raw", site: str = "host", last_valid_wins: bool = False) -> DataFrame:
    """Charset per site over all its pages.

    The candidates are UTF-8, ISO-8859-1 and ASCII. By default the first one that
    decodes every page wins; with ``last_valid_wins`` the last, so pure ASCII sites are
    ASCII and all others ISO-8859-1.
    """
    agg = pages.groupBy(site).agg(
        F.bool_and(H.is_utf8(F.col(raw))).alias("_utf8"), F.bool_and(H.is_ascii(F.col(raw))).alias("_ascii")
    )
    utf8, latin, ascii_ = H.CHARSETS
    choice = (
        F.when(F.col("_ascii"), ascii_).otherwise(latin)
        if last_valid_wins
        else F.when(F.col("_utf8"), utf8).otherwise(latin)
    )
    return agg.select(site, choice.alias("charset"))


def decode_pages(pages: DataFrame, charsets: DataFrame, raw: str = "raw", site: str = "host") -> DataFrame:
    """Add ``html`` and ``decoded``; a page its site's charset cannot decode has no text."""
    table = materialize(charsets, "charsets")
    out = lookup(pages, table, site)
    return out.withColumn("html", H.decode_page(F.col(raw), F.col("charset"))).withColumn("decoded", F.col("html").isNotNull())


# --- robots -----------------------------------------------------------------
def _unquote(text: Column) -> Column:
    """Percent decoding; a plus sign stays, broken escapes leave the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def robots_rules(lines: DataFrame, user_agent: str, site: str | None = None) -> DataFrame:
    """Rules that apply to ``user_agent``, one array per robots file.

    ``lines`` holds ``(line_no, line)`` and, with ``site``, the file's site. A file
    is small, so its windows are per file. The first group naming the agent wins,
    else the first ``*`` group; a blank line ends a group.
    """
    file = [F.col(site)] if site else [F.lit(0).alias("_file")]
    key = site or "_file"
    agent = user_agent.split("/")[0].lower()
    raw = F.col("line")
    text = F.trim(F.regexp_replace(raw, r"#.*$", ""))
    field = F.lower(F.trim(F.regexp_extract(text, r"^([^:]*):", 1)))
    value = F.regexp_extract(text, r"^[^:]*:\s*(.*)$", 1)
    parsed = lines.select(*file, "line_no", (raw == "").alias("blank"), field.alias("field"), value.alias("value"))
    order = W.partitionBy(key).orderBy("line_no")
    parsed = parsed.withColumn("seg", F.sum(F.col("blank").cast("int")).over(order)).filter(
        F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay", "request-rate")
    )
    in_seg = W.partitionBy(key, "seg").orderBy("line_no")
    is_agent = F.col("field") == "user-agent"
    starts = is_agent & (F.coalesce(F.lag("field").over(in_seg), F.lit("")) != "user-agent")
    parsed = parsed.withColumn("grp", F.sum(starts.cast("int")).over(in_seg)).filter(F.col("grp") > 0)
    name = F.lower("value")
    rule = F.struct(
        "line_no",
        ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"),
        U.quote(_unquote(F.col("value"))).alias("path"),
    )
    groups = parsed.groupBy(key, "seg", "grp").agg(
        F.min("line_no").alias("first"),
        F.bool_or(is_agent & (name != "*") & F.contains(F.lit(agent), name)).alias("named"),
        F.bool_or(is_agent & (name == "*")).alias("star"),
        F.array_sort(F.collect_list(F.when(F.col("field").isin("allow", "disallow"), rule))).alias("rules"),
    )
    groups = groups.filter((F.col("named") | F.col("star")) & (F.size("rules") > 0))
    chosen = F.min_by("rules", F.struct((~F.col("named")).alias("d"), "first"))
    return groups.groupBy(key).agg(chosen.alias("rules"))


def rule_verdict(rules: Column, url: Column) -> Column:
    """First rule whose path prefixes the URL's quoted path decides; no match allows."""
    asked = F.regexp_replace(_unquote(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", "")
    asked = U.quote(F.when(asked == "", "/").otherwise(asked))
    hit = F.filter(rules, lambda r: (r["path"] == "*") | asked.startswith(r["path"]))
    return F.coalesce(F.get(hit, F.lit(0))["allow"], F.lit(True))


def with_allowed(urls: DataFrame, rules: DataFrame, site: str | None = None, url: str = "url") -> DataFrame:
    """Add ``allowed``. Rules come as one array per file, so a URL stays one row.

    Without ``site`` the base URL's single file judges every URL; with it each site
    has its own. A blocked URL is not fetched, but marked crawled.
    """
    if site:
        table = materialize(rules, "robots")
        out = lookup(urls, table, site)
    else:
        out = urls.withColumn("_file", F.lit(0)).join(F.broadcast(rules), "_file", "left").drop("_file")
    return out.withColumn("allowed", rule_verdict(F.col("rules"), F.col(url))).drop("rules")
