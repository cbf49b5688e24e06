"""URL column expressions: parts, resolution, link class, quoting.

Everything is a ``Column -> Column`` function over built-in expressions, so a
URL job is one map stage with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let

# The URL grammar these columns rely on (RFC 3986).
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
FRAGMENT = r"^[^#]*#(.*)$"


def scheme(url: Column) -> Column:
    """Lower-cased scheme, '' if there is none."""
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, NETLOC, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def host(url: Column) -> Column:
    """Lower-cased host without user info and port; NULL for ``mailto:`` and the like."""
    bare = F.regexp_replace(netloc(url), r"^.*@", "")
    name = F.lower(F.regexp_extract(bare, r"^(\[[^\]]*\]|[^:]*)", 1))
    return F.when(name != "", F.regexp_replace(name, r"[\[\]]", ""))


def site_root(url: Column) -> Column:
    """``scheme://netloc/`` of a page."""
    return F.concat(scheme(url), F.lit("://"), netloc(url), F.lit("/"))


def labels(hostname: Column) -> Column:
    """Host labels without one leading ``www``."""
    return F.split(F.regexp_replace(F.regexp_replace(hostname, r"^www\.", ""), r"^www$", ""), r"\.")


def _last_two(parts: Column) -> Column:
    return F.when(F.size(parts) < 2, parts).otherwise(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)))


def link_class(link: Column, base_labels: Column) -> Column:
    """``internal`` / ``subdomain`` / ``external`` against the source page's labels; NULL without a host."""
    def classify(own: Column) -> Column:
        return (
            F.when(own.isNull() | base_labels.isNull(), F.lit(None).cast("string"))
            .when(_last_two(own) != _last_two(base_labels), F.lit("external"))
            .when(F.get(own, F.lit(0)) == F.get(base_labels, F.lit(0)), F.lit("internal"))
            .otherwise(F.lit("subdomain"))
        )

    return let(labels(host(link)), classify)


def _collapse_dots(p: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(p, "/")
    last = F.element_at(parts, F.lit(-1))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    joined = F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve(link: Column, root: Column) -> Column:
    """Resolve an href against the *site root* (not the page), NULL or '' giving the root.

    ``root`` must end in ``/``. A link with another scheme is returned as it
    stands; an empty query or fragment is dropped.
    """
    def absolute(own_path: Column) -> Column:
        rooted = F.when(own_path.startswith("/"), own_path).otherwise(
            F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(own_path, r"/{2,}", "/"), r"^/", ""))
        )
        return let(rooted, lambda p: F.when(p.rlike(r"/\.\.?(/|$)"), _collapse_dots(p)).otherwise(p))

    def resolved(ref: Column) -> Column:
        tail = F.concat(
            F.regexp_replace(F.regexp_extract(ref, r"^[^?#]*(\?[^#]*)", 1), r"^\?$", ""),
            F.regexp_replace(F.regexp_extract(ref, r"^[^#]*(#.*)$", 1), r"^#$", ""),
        )
        return (
            F.when(ref.isNull() | (ref == ""), root)
            .when(ref.rlike(r"^/(?:[^/?#][^?#]*)?$") & ~F.contains(ref, F.lit("/.")), F.concat(F.substring(root, F.lit(1), F.length(root) - 1), ref))  # the usual case
            .when(ref.rlike(SCHEME) & (scheme(ref) != scheme(root)), ref)
            .when(netloc(ref) != "", F.concat(scheme(root), F.lit("://"), netloc(ref), path(ref), tail))
            .otherwise(F.concat(scheme(root), F.lit("://"), netloc(root), absolute(path(ref)), tail))
        )

    return let(F.regexp_replace(F.regexp_replace(link, r"^[\x00-\x20]+", ""), r"[\t\r\n]", ""), resolved)


# The characters the fetcher leaves alone when it quotes a URL.
QUOTE_SAFE = {"%3A": ":", "%2F": "/", "%3F": "?", "%3D": "=", "%23": "#", "%26": "&"}
# Where form encoding and percent quoting differ.
FORM_TO_QUOTE = {"+": "%20", "*": "%2A", "%7E": "~"}


def quote(url: Column) -> Column:
    """Percent-quote a URL; ``%`` is not safe, so quoting twice changes the text."""
    out = F.url_encode(url)
    for found, wanted in {**FORM_TO_QUOTE, **QUOTE_SAFE}.items():
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def refresh_target(content: Column, base_url: Column, page_url: Column | None = None) -> Column:
    """Target of a meta refresh: the text after the first ``;`` without ``url=``.

    With no ``page_url`` the target is glued to ``base_url`` even if it is
    absolute; with it the target is resolved properly. NULL without a ``;``.
    """
    target = F.replace(F.trim(F.get(F.split(content, ";"), F.lit(1))), F.lit("url="), F.lit(""))
    if page_url is None:
        return F.concat(base_url, target)
    return F.when(target.isNotNull(), resolve(target, site_root(page_url)))
