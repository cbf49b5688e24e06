"""Text column expressions: rules, sentences, cleaning, stopwords, stems, n-grams.

A document stays one row until its sentences are exploded, and a sentence stays
one row with an array of terms, so the whole chain is one map stage.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .binding import let

# Default rewrite rules (pattern, replacement), applied in this order:
# unify gender forms, remove hyphenation, remove line breaks.
DEFAULT_RULES = (
    (r"/innen|\*innen|/-innen", "innen"),
    (r"-\s*\n", ""),
    (r"(?:[\t ]*(?:\r?\n|\r)+)", " "),
)

# German abbreviations that do not end a sentence.
DEFAULT_ABBREVIATIONS = (
    "Dr", "Prof", "Nr", "Str", "St", "Hr", "Fr", "Abs", "Art", "bzw", "ca", "evtl", "ggf", "inkl", "vgl", "Tel", "Mio", "Mrd",
)

# A short default list of German function words; real jobs pass their own file.
DEFAULT_STOPWORDS = (
    "aber", "als", "am", "an", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "ein", "eine", "er",
    "es", "für", "im", "in", "ist", "mit", "nicht", "sich", "sie", "sind", "und", "von", "zu",
)

MASK, CUT = "\ue003", "\ue004"
# Fixed value: what cleaning replaces by a blank.
OUTSIDE_ALPHABET = "[^a-zA-Z öÖäÄüÜß]"


def _java_replacement(replacement: str) -> str:
    """A Python replacement string in Java notation."""

    def part(m: re.Match) -> str:
        if m["group"]:
            return f"${m['group']}" if m["group"].isdigit() else f"${{{m['group']}}}"
        if m["digit"]:
            return f"${m['digit']}"
        return {"\\n": "\n", "\\t": "\t"}.get(m[0], "\\" + m[0][-1])

    return re.sub(r"\\g<(?P<group>\w+)>|\\(?P<digit>\d)|\\.|[$\\]", part, replacement)


_usable: dict[tuple, list[tuple[str, str]]] = {}


def usable_rules(spark, rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rules as Java expressions, without those that do not compile (a bad rule is skipped).

    They are compiled by the driver's JVM, once per set of rules. A repeated alternation such as ``(a|b)+``
    recurses in Java for each repetition: over long runs it needs executors with a larger thread stack
    (``-Xss``), or better a character class.
    """
    key = tuple(map(tuple, rules))
    if key not in _usable:
        good = []
        for pattern, replacement in key:
            try:
                re.compile(pattern)
                java = (pattern.replace("(?P<", "(?<"), _java_replacement(replacement))
                spark._jvm.java.util.regex.Pattern.compile(java[0]).matcher("x").replaceAll(java[1])
            except Exception:  # noqa: BLE001 - any broken rule is skipped, as the rule contract says
                continue
            good.append(java)
        _usable[key] = good
    return _usable[key]


def join_lines(text: Column) -> Column:
    """The default line-break rule as built-in steps.

    As a pattern its repeated alternation overflows the thread stack at some thousand line ends in a row, and its
    leading blanks are tried anew at each blank of a run. Cut at line ends, the blanks before each are trimmed in one scan.
    """

    def trimmed(pieces: Column) -> Column:
        return F.transform(pieces, lambda p, i: F.when(i == F.size(pieces) - 1, p).otherwise(F.rtrim(p, F.lit("\t "))))

    return F.array_join(let(F.split(text, r"[\r\n]+", -1), trimmed), " ")


def apply_rules(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered regex rewrites; the rules are Java expressions from :func:`usable_rules`."""
    for pattern, replacement in rules:
        if (pattern, replacement) == DEFAULT_RULES[2]:
            text = let(text, join_lines)
        else:
            text = F.regexp_replace(text, pattern, replacement)
    return text


SPACE = r"[ \t\n\x0B\f\r]"


def sentences(text: Column, abbreviations: Sequence[str] = DEFAULT_ABBREVIATIONS, starters: Sequence[str] = (), pairs: Sequence[tuple[str, str]] = ()) -> Column:
    """Array of trimmed, non-empty sentences; a listed abbreviation does not end one.

    It does so after all if one of ``starters`` comes next, words that mostly begin a sentence. A period between the two words of
    one of ``pairs`` ends none.
    """
    masked = F.translate(text, MASK + CUT, "")
    if abbreviations:
        names = "|".join(re.escape(a) for a in abbreviations)
        masked = F.regexp_replace(masked, rf"(^|[^\p{{L}}])({names})\.", f"$1$2{MASK}")
        if starters:
            words = "|".join(re.escape(w) for w in starters)
            masked = F.regexp_replace(masked, rf"{MASK}(?={SPACE}+(?:{words})(?![\p{{L}}\p{{N}}]))", ".")
    if pairs:
        after: dict[str, list[str]] = {}
        for first, second in pairs:
            after.setdefault(first, []).append(re.escape(second))
        inside = "|".join(
            rf"(?<=(?<![\p{{L}}\p{{N}}]){re.escape(first)})\.(?={SPACE}+(?:{'|'.join(seconds)})(?![\p{{L}}\p{{N}}]))" for first, seconds in after.items()
        )
        masked = F.regexp_replace(masked, inside, MASK)
    cut = F.regexp_replace(masked, rf"([.!?]+){SPACE}+", f"$1{CUT}")
    pieces = F.split(F.replace(cut, F.lit(MASK), F.lit(".")), CUT)
    return F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: s != "")


def clean(sentence: Column) -> Column:
    """Only letters of the German alphabet and spaces are left, lower-cased."""
    return F.lower(F.regexp_replace(sentence, OUTSIDE_ALPHABET, " "))


def tokens(sentence: Column, stopwords: Sequence[str] = ()) -> Column:
    """Cleaned words of two or more letters, stopwords removed, order and repeats kept."""
    words = F.split(clean(sentence), " +")
    if not stopwords:
        return F.filter(words, lambda w: F.length(w) > 1)
    listed = sorted(set(stopwords))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(listed))


# --- German stemming -------------------------------------------------------
# The published Snowball "german" rules, written as rewrites of a whole line of
# words, each word after one space. A digit marks where a region starts: 1 for the
# first region, 2 for the second. Endings are cut from the reversed line, where they
# are the first letters after a space: a word without a known ending costs one look.
# So a line of words is stemmed by a fixed number of linear scans, without a lookup
# table, a join or a Python call.
VOWELS = "aeiouyäöü"
_TO_CONSONANT = f"[^{VOWELS} ]*[{VOWELS}]+[^{VOWELS} ]"
REGION_1 = f" ({_TO_CONSONANT})"
REGION_1_TOO_EARLY = " ([^ 1]{2})1([^ 1])"
REGION_2 = f" ({_TO_CONSONANT}{_TO_CONSONANT})"
STEP_1 = (
    " (?:(?:ne|se|e)s(sin[^ 1]*1|si1n|s1in|1sin)"  # -nissen, -nisses, -nisse leave -nis
    "|(?:nre|me|re|ne|se|e)([^ 1]*1)"
    "|s([bdfghklmnrt][^ 1]*1|1[bdfghklmnrt]))"
)
STEP_2 = (
    " (?:(?:tse|ne|re)([^ 1]*1)"
    "|ts([bdfghklmnt][^ 1]*1|1[bdfghklmnt][^ ]{3}))"
)
_NOT_AFTER_E = "([^ e2][^ 2]*2|2[^ e])"
STEP_3 = (
    f" (?:(?:dne|gnu)gi{_NOT_AFTER_E}"
    f"|(?:hcsi|gi|ki){_NOT_AFTER_E}"
    "|(?:hcil|tieh)[rn]e([^ 2]*2)"
    "|(?:hcil|tieh)2[rn]e([^ ]{3})"
    "|tiek(?:hcil|gi)([^ 2]*2)"
    "|(?:dne|gnu|hcil|tieh|tiek)([^ 2]*2))"
)


def stem_german_line(line: Column) -> Column:
    """Stem every word of ``' w1 w2'`` (each word after one space)."""
    line = F.replace(line, F.lit("ß"), F.lit("ss"))
    between = f"([{VOWELS}])([uy])([{VOWELS}])"
    marked = line
    for _ in range(2):  # the second scan finds vowels that overlap the first one's matches
        marked = F.regexp_replace(marked, between, "$1#$2$3")
        marked = F.replace(F.replace(marked, F.lit("#u"), F.lit("U")), F.lit("#y"), F.lit("Y"))
    line = F.when(line.rlike(between), marked).otherwise(line)
    line = F.regexp_replace(line, REGION_1, " $11")
    line = F.regexp_replace(line, REGION_1_TOO_EARLY, " $1$21")
    line = F.reverse(line)
    # The reversed line starts with a letter: the space has moved to the end.
    line = F.concat(F.lit(" "), line)
    line = F.regexp_replace(line, STEP_1, " $1$2$3")
    line = F.regexp_replace(line, STEP_2, " $1$2")
    line = F.reverse(F.replace(line, F.lit("1"), F.lit("")))
    line = F.reverse(F.regexp_replace(line, REGION_2, " $12"))
    line = F.reverse(F.regexp_replace(line, STEP_3, " $1$2$3$4$5$6"))
    for found, wanted in (("2", ""), ("U", "u"), ("Y", "y"), ("ä", "a"), ("ö", "o"), ("ü", "u")):
        line = F.replace(line, F.lit(found), F.lit(wanted))
    return F.trim(line)


def stems(token_array: Column, language: str = "german") -> Column:
    """Stem an array of tokens; languages other than German pass through."""
    if language != "german":
        return token_array
    line = F.concat(F.lit(" "), F.array_join(token_array, " "))
    return F.array_remove(F.split(stem_german_line(line), " "), "")  # no tokens leave one empty word


def stem_word(word: Column) -> Column:
    return stem_german_line(F.concat(F.lit(" "), word))


def ngrams(token_array: Column, low: int, high: int) -> Column:
    """All n-grams of sizes low..high, words joined by one space."""
    def one_longer(grams: Column, n: int) -> Column:
        """Grams of n words from grams of n - 1 and the word after each."""
        count = F.greatest(F.size(token_array) - (n - 1), F.lit(0))
        return F.zip_with(
            F.slice(grams, F.lit(1), count), F.slice(token_array, F.lit(n), count), lambda g, w: F.concat(g, F.lit(" "), w)
        )

    grams, sizes = token_array, []
    for n in range(1, high + 1):
        grams = grams if n == 1 else one_longer(grams, n)
        if n >= low:
            sizes.append(grams)
    return F.concat(*sizes)
