"""Text normalisation, the eight caption fixes and the fifteen caption checks."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: White space as Unicode text sees it, for Java and RE2 alike.
WS = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NBSP = "\u00a0"
#: Zero-width characters, curly quotes, dashes.
ZERO_WIDTH = "\u200b\u200c\u200d\u200e\u200f\u2060\u00ad\ufeff"
CURLY = "‘’“”‚„"
STRAIGHT = "''\"\"'\""
DASHES = "–—"
ESCAPED_QUOTES = [("\\\\'", "'"), ('\\\\"', '"'), ("\\'", "'"), ('\\"', '"'), ("/'", "'")]
ENTITY = r"&(?:[A-Za-z][A-Za-z0-9]*|#\d+|#x[0-9A-Fa-f]+);"
REPEATED = r"([!?.\-,;:])\1+"
BRACKETS = [("(", ")"), ("[", "]"), ("{", "}")]


def edge_stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def normalised(c: Column) -> Column:
    """Lower case, only letters, digits, ``_`` and white space, runs of white
    space as one blank, edges stripped.  Letters are Unicode letters."""
    kept = F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{N}}_{WS}]", "")
    return F.trim(F.regexp_replace(kept, f"[{WS}]+", " "))


def letter_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), F.lit(0))


def space_words(c: Column) -> Column:
    """Split at white space; no words in empty text, null for null."""
    return F.filter(F.split(c, f"[{WS}]+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    k = F.size(words) - n + 1
    return F.when(k >= 1, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(
        F.array().cast("array<string>")
    )


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html.unescape(t))


def without_non_ascii(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def decoded_entities(c: Column) -> Column:
    """HTML entities decoded; only texts with an ampersand go to Python's rules."""
    return F.when(c.contains("&"), _unescape(c)).otherwise(c)


def straight_quotes(c: Column) -> Column:
    return F.translate(c, CURLY, STRAIGHT)


def unescaped_quotes(c: Column) -> Column:
    for old, new in ESCAPED_QUOTES:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def plain_dashes(c: Column) -> Column:
    return F.translate(c, DASHES, "-" * len(DASHES))


def single_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, REPEATED, "$1")


def sentence_case(c: Column, above: int = 18) -> Column:
    """Texts of more than ``above`` capitals in lower case with a capital at the
    start of each sentence."""
    parts = F.split(F.lower(c), r"(?<=[.!?])")
    capital = lambda p: F.concat(
        F.regexp_extract(p, r"^([^\p{L}]*)", 1),
        F.upper(F.regexp_extract(p, r"^[^\p{L}]*(\p{L})", 1)),
        F.regexp_extract(p, r"(?s)^[^\p{L}]*\p{L}?(.*)$", 1),
    )
    return F.when(F.regexp_count(c, F.lit(r"\p{Lu}")) > above, F.array_join(F.transform(parts, capital), "")).otherwise(c)


def unpaired(c: Column, left: str, right: str) -> Column:
    """Whether the brackets of one kind do not pair up."""
    only = F.split(F.regexp_replace(c, rf"[^\{left}\{right}]", ""), "")
    first = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("bad"))
    step = lambda acc, x: F.struct(
        (acc["depth"] + F.when(x == left, 1).when(x == right, -1).otherwise(0)).alias("depth"),
        (acc["bad"] | ((x == right) & (acc["depth"] < 1))).alias("bad"),
    )
    done = F.aggregate(only, first, step)
    return done["bad"] | (done["depth"] != 0)


def odd_quotes(c: Column) -> Column:
    return F.length(F.regexp_replace(c, '[^"]', "")) % 2 == 1


def _let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` looks at it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def without_unpaired(c: Column) -> Column:
    """All brackets of a kind that does not pair up, and odd double quotes, go."""

    def without(a: str, b: str) -> Callable[[Column], Column]:
        return lambda t: F.when((t.contains(a) | t.contains(b)) & unpaired(t, a, b), F.translate(t, a + b, "")).otherwise(t)

    for left, right in BRACKETS:
        c = _let(c, without(left, right))
    return _let(c, lambda t: F.when(odd_quotes(t), F.replace(t, F.lit('"'), F.lit(""))).otherwise(t))


def tidied(c: Column) -> Column:
    return edge_stripped(F.regexp_replace(c, " {2,}", " "))


def has_letters(c: Column) -> Column:
    return c.rlike(r"\p{L}")


#: The fixes in their order.  The first drops the characters that the third and
#: fourth would map, unless the second brings them back from entities.
FIXES: list[tuple[str, Callable[[Column], Column]]] = [
    ("F1_non_ascii", without_non_ascii),
    ("F2_entities", decoded_entities),
    ("F3_curly_quotes", straight_quotes),
    ("F3b_escaped_quotes", unescaped_quotes),
    ("F4_dashes", plain_dashes),
    ("F5_repeated_punctuation", single_punctuation),
    ("F6_sentence_case", sentence_case),
    ("F7_unpaired", without_unpaired),
]

#: name, whether a text has it.
CHECKS: list[tuple[str, Callable[[Column], Column]]] = [
    ("01_non_ascii", lambda c: c.rlike(r"[^\x00-\x7F]")),
    ("02_html_entities", lambda c: c.rlike(ENTITY)),
    ("03_multiple_spaces", lambda c: c.contains("  ")),
    ("04_edge_white_space", lambda c: c.rlike(f"^[{WS}]|[{WS}]$")),
    ("05_no_break_space", lambda c: c.contains(NBSP)),
    ("06_zero_width", lambda c: c.rlike(f"[{ZERO_WIDTH}]")),
    ("07_control", lambda c: c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")),
    ("08_curly_quotes", lambda c: c.rlike(f"[{CURLY}]")),
    ("09_dashes", lambda c: c.rlike(f"[{DASHES}]")),
    ("10_ellipsis", lambda c: c.contains("…")),
    ("11_repeated_punctuation", lambda c: c.rlike(REPEATED)),
    ("12_all_caps", lambda c: (F.length(F.regexp_replace(c, r"[^\p{L}]", "")) >= 4) & ~c.rlike(r"\p{Lo}") & (F.upper(c) == c)),
    ("13_no_letters", lambda c: ~has_letters(c)),
    ("14_long", lambda c: F.length(c) > 500),
    ("15_unpaired", lambda c: unpaired(c, "(", ")") | unpaired(c, "[", "]") | unpaired(c, "{", "}") | odd_quotes(c)),
]
