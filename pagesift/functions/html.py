"""HTML column expressions: text blocks, block features, content rules, attributes.

One page is one row, so every step here works inside the row: a page turns
into an array of blocks and back into text without a shuffle. The patterns stay
in the common subset of Java and RE2 expressions.
"""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column, functions as F

from .binding import let

# Private-use marks: start and end of a link, and a block boundary.
LINK_ON, LINK_OFF, BREAK = "\ue000", "\ue001", "\ue002"

# Comments vanish; ignorable elements turn into an empty tag, which breaks the block.
IGNORED = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|(<)(?:"
    r"head\b.*?(?:</head\s*(>)|\z)"
    r"|script\b.*?(?:</script\s*(>)|\z)"
    r"|style\b.*?(?:</style\s*(>)|\z)"
    r"|noscript\b.*?(?:</noscript\s*(>)|\z)"
    r"|option\b.*?(?:</option\s*(>)|\z)"
    r"|object\b.*?(?:</object\s*(>)|\z)"
    r"|applet\b.*?(?:</applet\s*(>)|\z))"
)
# Same, for tag lookups: the head stays, since meta tags live there.
IGNORED_FOR_TAGS = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
ANCHOR_OPEN = r"(?i)<a(?:\s[^>]*)?>"
ANCHOR_CLOSE = r"(?i)</a\s*>"
# Tags that do not end a block.
INLINE_TAG = (
    r"(?i)</?(?:abbr|acronym|b|code|em|font|i|span|strike|strong|sub|sup|tt|u|var)(?:[\s/][^>]*)?>"
)
ANY_TAG = r"<(?:[!/?a-zA-Z][^>]*)?(?:>|\z)"
BLANKS = r"[ \t\n\x0B\f\r\x{00A0}]+"

MARKS = "\ue000\ue001\ue002\ue003\ue004"  # of this module and of the sentence splitter
REPLACED = "\ufffd"


def without_marks(text: Column) -> Column:
    """Text rid of the private-use characters that serve as marks, so that no page can forge one."""
    return F.translate(text, MARKS, "")


@cache
def _reference_decoder() -> str:
    """The function from text to text as SQL: one call into the JVM, where single columns would be hundreds.

    Named references (without ``&``) stand in a literal that the optimizer parses once per plan, by their first two letters: short
    lists instead of one long one. Zero, surrogates and numbers beyond Unicode give U+FFFD, marks give nothing.
    """
    groups: dict[str, dict[str, str]] = {}
    for name, sign in sorted(html5.items()):
        if name.endswith(";"):
            groups.setdefault(name[:2], {})[name] = " " if name == "nbsp;" else sign.translate({ord(m): None for m in MARKS})
    names = json.dumps(groups).replace("'", "\\u0027")
    number = """case when regexp_like(head, r'^#0*[0-9]{1,7};') then cast(regexp_extract(head, r'^#0*([0-9]{1,7});', 1) as bigint)
        when regexp_like(head, r'^#[xX]0*[0-9a-fA-F]{1,6};') then cast(conv(regexp_extract(head, r'^#[xX]0*([0-9a-fA-F]{1,6});', 1), 16, 10) as bigint) end"""
    sign = f"""case when n is null or n = 0 or n between 55296 and 57343 or n > 1114111 then '{REPLACED}'
        when n between {ord(MARKS[0])} and {ord(MARKS[-1])} then '' else decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') end"""
    piece = f"""case when i = 0 then piece when head = '' then concat('&', piece)
        when startswith(head, '#') then concat(get(transform(array({number}), n -> {sign}), 0), substring(piece, length(head) + 1))
        else coalesce(concat(try_element_at(try_element_at(from_json(r'{names}', 'map<string,map<string,string>>'), substring(head, 1, 2)), head),
            substring(piece, length(head) + 1)), concat('&', piece)) end"""
    head = "regexp_extract(piece, r'^(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]{1,31};)', 0)"
    pieces = f"transform(split(t, '&'), (piece, i) -> get(transform(array({head}), head -> {piece}), 0))"
    return f"t -> if(contains(t, '&'), array_join({pieces}, ''), t)"


def decode_entities(text: Column) -> Column:
    """Decode all named references of HTML that end in ``;`` and all numeric ones, in one pass."""
    return F.get(F.call_function("transform", F.array(text), F.expr(_reference_decoder())), F.lit(0))


def marked_text(html: Column) -> list[Column]:
    """The successive rewrites from HTML to marked text, each a function of the one before."""
    def cut(c: Column) -> Column:
        c = F.regexp_replace(without_marks(c), IGNORED, "$1$2$3$4$5$6$7$8")
        c = F.regexp_replace(c, ANCHOR_OPEN, f" {LINK_ON}")
        c = F.regexp_replace(c, ANCHOR_CLOSE, f"{LINK_OFF} ")
        c = F.regexp_replace(c, INLINE_TAG, " ")
        return F.regexp_replace(c, ANY_TAG, BREAK)

    def fold(c: Column) -> Column:
        return F.regexp_replace(c, BLANKS, " ")

    def balance(c: Column) -> Column:
        """Close a link at each block end and reopen it in the next block."""
        def segment(s: Column, i: Column) -> Column:
            inside = F.substring_index(s, LINK_OFF, 1)
            outside = F.substring(s, F.length(inside) + F.lit(1), F.length(s))
            return F.when(i == 0, s).otherwise(
                F.concat(F.replace(inside, F.lit(BREAK), F.lit(LINK_OFF + BREAK + LINK_ON)), outside)
            )

        spread = F.array_join(F.transform(F.split(c, LINK_ON), segment), LINK_ON)
        return F.when(c.rlike(f"{LINK_ON}[^{LINK_OFF}]*{BREAK}"), spread).otherwise(c)

    return [cut, decode_entities, fold, balance]


def words(text: Column) -> Column:
    """Words of single-spaced, trimmed text."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("int")


def blocks(marked: Column) -> Column:
    """Array of non-blank blocks with words, link words, link density and text density."""

    def block(b: Column) -> Column:
        text = F.trim(F.regexp_replace(b, f"[ {LINK_ON}{LINK_OFF}]+", " "))
        linked = F.when(
            F.contains(b, F.lit(LINK_ON)),
            words(F.trim(F.regexp_replace(
                F.array_join(F.regexp_extract_all(b, F.lit(f"{LINK_ON}([^{LINK_ON}{LINK_OFF}]*)"), F.lit(1)), " "), " +", " "))),
        ).otherwise(0)
        return F.struct(text.alias("text"), linked.alias("link_words"))

    def features(b: Column) -> Column:
        n = words(b["text"])
        return F.struct(
            b["text"].alias("text"),
            n.alias("words"),
            b["link_words"].alias("link_words"),
            (b["link_words"] / n).alias("link_density"),
            (n / F.ceil(F.length(b["text"]) / 80.0)).alias("text_density"),
        )

    found = F.filter(F.transform(F.split(marked, BREAK), block), lambda b: b["text"] != "")
    return F.transform(found, features)


# Thresholds of the published shallow-text rules (Kohlschütter et al. 2010).
MAX_LINK_DENSITY, MAX_PREVIOUS_LINK_DENSITY = 0.333333, 0.555556


def density_rule(own: Column, before: Column, after: Column) -> Column:
    """Keep a block by text density of itself and its neighbours."""
    ptd, ntd = F.coalesce(before["text_density"], F.lit(0.0)), F.coalesce(after["text_density"], F.lit(0.0))
    pld = F.coalesce(before["link_density"], F.lit(0.0))
    return (
        F.when(own["link_density"] > MAX_LINK_DENSITY, False)
        .when((pld <= MAX_PREVIOUS_LINK_DENSITY) & (own["text_density"] <= 9), (ntd > 10) | (ptd > 4))
        .when(pld <= MAX_PREVIOUS_LINK_DENSITY, ntd > 0)
        .otherwise(ntd > 11)
    )


def word_rule(own: Column, before: Column, after: Column) -> Column:
    """Keep a block by word counts of itself and its neighbours."""
    pnw, nnw = F.coalesce(before["words"], F.lit(0)), F.coalesce(after["words"], F.lit(0))
    pld = F.coalesce(before["link_density"], F.lit(0.0))
    return (
        F.when(own["link_density"] > MAX_LINK_DENSITY, False)
        .when(pld <= MAX_PREVIOUS_LINK_DENSITY, (own["words"] > 16) | (nnw > 15) | (pnw > 4))
        .otherwise((own["words"] > 40) | (nnw > 17))
    )


RULES = {"density": density_rule, "words": word_rule}


def fused_content(block_array: Column, rule: str) -> Column:
    """Kept blocks, neighbours fused: an array of texts in page order."""
    keep = RULES[rule]

    def line(b: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(block_array, i - 1))
        return F.when(keep(b, before, F.get(block_array, i + 1)), F.concat(b["text"], F.lit("\n"))).otherwise(BREAK)

    runs = F.split(F.array_join(F.transform(block_array, line), ""), f"{BREAK}+")
    return F.filter(F.transform(runs, lambda r: F.rtrim(F.regexp_replace(r, r"\n\z", ""))), lambda r: r != "")


def all_content(fused: Column) -> Column:
    return F.array_join(fused, "\n")


def largest_content(fused: Column) -> Column:
    """The fused text with most words, the first of equals."""
    def n_words(t: Column) -> Column:
        return words(F.replace(t, F.lit("\n"), F.lit(" ")))

    ranked = F.transform(fused, lambda t, i: F.struct(n_words(t).alias("n"), (-i).alias("o"), t.alias("t")))
    return F.array_max(ranked)["t"]


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag, NULL if it is missing."""
    opened = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.regexp_replace(F.regexp_substr(tag, F.lit(opened)), rf"""(?is)^[\s"'/]{name}\s*=\s*""", "")
    return decode_entities(F.regexp_replace(value, r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2"))


def tags(html: Column, name: str) -> Column:
    """All start tags of one element, outside comments, scripts and styles."""
    bare = F.regexp_replace(html, IGNORED_FOR_TAGS, "")
    return F.regexp_extract_all(bare, F.lit(rf"(?i)(<{name}(?:[\s/][^>]*)?>)"), F.lit(1))


def robots_directive(html: Column) -> Column:
    """-1 noindex, 0 nofollow, 1 neither; the first tag that says either one decides."""

    def verdict(tag: Column) -> Column:
        tokens = F.transform(F.split(attribute(tag, "content"), ","), lambda x: F.trim(x))
        said = let(tokens, lambda t: F.when(F.array_contains(t, "noindex"), -1).when(F.array_contains(t, "nofollow"), 0))
        return F.when(attribute(tag, "name") == "robots", said)

    said = F.filter(F.transform(tags(html, "meta"), verdict), lambda v: v.isNotNull())
    return F.coalesce(F.get(said, F.lit(0)), F.lit(1))


def refresh_content(html: Column) -> Column:
    """Content of the first meta refresh, NULL if there is none."""
    found = F.filter(
        F.transform(tags(html, "meta"), lambda t: F.when(attribute(t, "http-equiv") == "refresh", attribute(t, "content"))),
        lambda c: c.isNotNull(),
    )
    return F.get(found, F.lit(0))


def document_type(content_type: Column, fetch_pdfs: bool) -> Column:
    """``html``, ``pdf`` or NULL (not a document) from the Content-Type header."""
    return F.when(F.contains(content_type, F.lit("text/html")), "html").when(
        F.contains(content_type, F.lit("application/pdf")) & F.lit(fetch_pdfs), "pdf"
    )


# The charsets that are tried, in this order.
CHARSETS = ("UTF-8", "ISO-8859-1", "ASCII")


def is_utf8(raw: Column) -> Column:
    return F.is_valid_utf8(raw.cast("string"))


def is_ascii(raw: Column) -> Column:
    """True if every byte is a character of its own."""
    return is_utf8(raw) & (F.octet_length(raw) == F.char_length(raw.cast("string")))


def decode_page(raw: Column, charset: Column) -> Column:
    """Text of a page in its site's charset; NULL if the bytes do not fit."""
    return (
        F.when((charset == "UTF-8") & is_utf8(raw), F.decode(raw, "UTF-8"))
        .when((charset == "ASCII") & is_ascii(raw), F.decode(raw, "UTF-8"))
        .when(charset == "ISO-8859-1", F.decode(raw, "ISO-8859-1"))
    )
