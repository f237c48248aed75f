"""Text functions, checks and fixes over the captions."""

from __future__ import annotations

import html
import html.entities
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from tarnloom.functions import text as T
from tarnloom.functions.ids import canonical_split
from tarnloom.functions.kernels import indel_ratio_udf, word_edits, word_lcs
from tarnloom.plans.registry import ORACLE, SPLIT_SQL, WS_SQL, norm_sql, query


def _texts(m: DataFrame) -> DataFrame:
    return m.where(F.col("text").isNotNull())


def _column(name: str, sql: str, f, out: str = "fixed", where: str = "TRUE"):
    """A query of one text function."""
    query(name, "manifest", sql=sql and f"SELECT pos, {sql} AS {out} FROM manifest WHERE text IS NOT NULL AND {where}")(
        lambda m: _texts(m).select("pos", f(F.col("text")).alias(out))
    )


_column("t01_normalised", norm_sql(), T.normalised, "norm")
_column("t02_letter_words", "regexp_extract_all(lower(text), '[a-z'']+')", T.letter_words, "words")
_column("t03_space_words", f"list_filter(string_split_regex(text, '[{WS_SQL}]+'), lambda w: w <> '')", T.space_words, "words")
_column("t04_without_non_ascii", r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')", T.without_non_ascii)


def _entities_sql(c: str) -> tuple[str, str]:
    """Character references decoded by HTML's rules, from the standard library's own
    tables: numbers, exact names, else the longest name that begins it.  Two tables of one
    row, and the expression over them."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'" if "\0" not in t else "''"
    table = lambda d: f"map([{', '.join(quoted(k) if isinstance(k, str) else str(k) for k in d)}], [{', '.join(map(quoted, d.values()))}])"
    names = "entity_names.m"
    number = "CASE WHEN regexp_matches(p, '^&#[xX]') THEN ('0x' || regexp_extract(p, '^&#[xX]([0-9a-fA-F]+)', 1))::BIGINT ELSE regexp_extract(p, '^&#([0-9]+)', 1)::BIGINT END"
    longest = f"list_max(list_filter(range(2, length(p)), lambda k: {names}[p[2:k]] IS NOT NULL))"
    piece = f"""CASE WHEN regexp_matches(p, '^&#([0-9]|[xX][0-9a-fA-F])') THEN coalesce(entity_numbers.m[{number}],
        CASE WHEN {number} BETWEEN 55296 AND 57343 OR {number} > 1114111 THEN chr(65533) ELSE chr(({number})::INT) END)
      WHEN p[1] = '&' AND length(p) > 1 THEN coalesce({names}[p[2:]], {names}[p[2:{longest}]] || p[{longest} + 1:], p) ELSE p END"""
    pieces = rf"regexp_extract_all({c}, '&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\x0C <&#;]{{1,32}};?|(?s).')"
    tables = f"entity_names AS (SELECT {table(html.entities.html5)} AS m), entity_numbers AS (SELECT {table(html._invalid_charrefs | {n: '' for n in html._invalid_codepoints - set(html._invalid_charrefs)})} AS m)"
    return tables, f"CASE WHEN contains({c}, '&') THEN array_to_string(list_transform({pieces}, lambda p: {piece}), '') ELSE {c} END"


_ENTITY_TABLES, _F2 = _entities_sql("text")
query("t05_entities", "manifest", sql=f"WITH {_ENTITY_TABLES} SELECT pos, {_F2} AS fixed FROM manifest, entity_names, entity_numbers WHERE text IS NOT NULL")(
    lambda m: _texts(m).select("pos", T.decoded_entities(F.col("text")).alias("fixed"))
)
_column("t06_straight_quotes", "translate(text, '‘’“”‚„', '''''\"\"''\"')", T.straight_quotes)
_column(
    "t07_escaped_quotes",
    "replace(replace(replace(replace(replace(text, repeat(chr(92), 2) || '''', ''''), repeat(chr(92), 2) || '\"', '\"'), chr(92) || '''', ''''), chr(92) || '\"', '\"'), '/''', '''')",
    T.unescaped_quotes,
)
_column("t08_dashes", "translate(text, '–—', '--')", T.plain_dashes)
_F5 = "text"
for _c in ("!", "?", ".", "-", ",", ";", ":"):
    _F5 = rf"regexp_replace({_F5}, '\{_c}{{2,}}', '{_c}', 'g')"
_column("t09_repeated_punctuation", _F5, T.single_punctuation)
_column(
    "t10_sentence_case",
    r"""CASE WHEN len(regexp_extract_all(text, '\p{Lu}')) > 18 THEN array_to_string(list_transform(regexp_extract_all(lower(text), '(?s)[^.!?]*[.!?]|[^.!?]+$'),
      lambda p: regexp_extract(p, '^[^\p{L}]*') || upper(regexp_extract(p, '^[^\p{L}]*(\p{L})', 1)) || regexp_extract(p, '(?s)^[^\p{L}]*\p{L}?(.*)$', 1)), '') ELSE text END""",
    T.sentence_case,
)
_column("t12_tidied", f"regexp_replace(regexp_replace(text, ' {{2,}}', ' ', 'g'), '^[{WS_SQL}]+|[{WS_SQL}]+$', '', 'g')", T.tidied)
_column("t34_display_cut", "substring(text, 1, 80)", lambda c: F.substring(c, 1, 80), "cut")
_column("t36_length", f"length(regexp_replace(text, '^[{WS_SQL}]+|[{WS_SQL}]+$', '', 'g'))", lambda c: F.length(T.edge_stripped(c)), "chars")


_CHECK_SQL = {
    "01_non_ascii": r"regexp_matches(text, '[^\x00-\x7F]')",
    "02_html_entities": r"regexp_matches(text, '&(?:[A-Za-z][A-Za-z0-9]*|#\d+|#x[0-9A-Fa-f]+);')",
    "03_multiple_spaces": "contains(text, '  ')",
    "04_edge_white_space": f"regexp_matches(text, '^[{WS_SQL}]|[{WS_SQL}]$')",
    "05_no_break_space": "contains(text, chr(160))",
    "06_zero_width": r"regexp_matches(text, '[\x{200B}-\x{200F}\x{2060}\x{AD}\x{FEFF}]')",
    "07_control": r"regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')",
    "08_curly_quotes": "regexp_matches(text, '[‘’“”‚„]')",
    "09_dashes": "regexp_matches(text, '[–—]')",
    "10_ellipsis": "contains(text, '…')",
    "11_repeated_punctuation": r"regexp_matches(text, '!!|\?\?|\.\.|--|,,|;;|::')",
    "12_all_caps": r"(length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 4 AND NOT regexp_matches(text, '\p{Lo}') AND NOT regexp_matches(text, '\p{Ll}') AND upper(text) = text)",
    "13_no_letters": r"NOT regexp_matches(text, '\p{L}')",
    "14_long": "length(text) > 500",
}
# brackets of one kind as +1 and -1: their running sum must never fall below 0 and end at 0
_DEPTH = """list_reduce(list_transform(string_split(regexp_replace({c}, '[^\\{l}\\{r}]', '', 'g'), ''), lambda x: [CASE x WHEN '{l}' THEN 1 WHEN '{r}' THEN -1 ELSE 0 END, 0]),
  lambda a, x: [a[1] + x[1], greatest(a[2], CASE WHEN a[1] + x[1] < 0 THEN 1 ELSE 0 END)], [0, 0])"""
_ODD_SQL = """length(regexp_replace({c}, '[^"]', '', 'g')) % 2 = 1"""


def _unpaired_sql(left: str, right: str, c: str = "text") -> str:
    return "(" + _DEPTH.replace("{c}", c).replace("{l}", left).replace("{r}", right) + " <> [0, 0])"


_CHECK_SQL["15_unpaired"] = "(" + " OR ".join([*(_unpaired_sql(a, b) for a, b in T.BRACKETS), _ODD_SQL.replace("{c}", "text")]) + ")"
_HIT_SQL = " UNION ALL ".join(f"SELECT pos, split, '{k}' AS issue FROM t WHERE {v}" for k, v in _CHECK_SQL.items())


def issues(m: DataFrame, checks=T.CHECKS) -> DataFrame:
    """``(pos, split, issue)``: one row per text and check that it fails, in one
    scan."""
    hit = F.array_compact(F.array(*[F.when(check(F.col("text")), name) for name, check in checks]))
    return _texts(m).select("pos", canonical_split(F.col("split")).alias("split"), F.explode(hit).alias("issue"))


_PAIRED = "SELECT pos, text AS t0 FROM manifest WHERE text IS NOT NULL"
for _i, (_a, _b) in enumerate(T.BRACKETS):
    _PAIRED = f"SELECT pos, CASE WHEN {_unpaired_sql(_a, _b, f't{_i}')} THEN translate(t{_i}, '{_a}{_b}', '') ELSE t{_i} END AS t{_i + 1} FROM ({_PAIRED})"
query("t11_unpaired_removed", "manifest", sql=f"""SELECT pos, CASE WHEN {_ODD_SQL.replace('{c}', 't3')} THEN replace(t3, '"', '') ELSE t3 END AS fixed FROM ({_PAIRED})""")(
    lambda m: _texts(m).select("pos", T.without_unpaired(F.col("text")).alias("fixed"))
)


def _pipeline_sql() -> str:
    """The fixes one after the other, as the columns s1 to s8, by the twins of the single
    ones; ends in the table ``s``."""
    steps = [f"f0 AS (SELECT pos, text AS original, text AS s0 FROM manifest WHERE text IS NOT NULL AND regexp_matches(text, '\\p{{L}}'))"]
    single = ["t04_without_non_ascii", None, "t06_straight_quotes", "t07_escaped_quotes", "t08_dashes", "t09_repeated_punctuation", "t10_sentence_case"]
    for i, name in enumerate(single):
        if name:
            fix, more = ORACLE[name].removeprefix("SELECT pos, ").split(" AS fixed FROM manifest")[0].replace("text", f"s{i}"), ""
        else:
            fix, more = _entities_sql(f"s{i}")[1], ", entity_names, entity_numbers"
        steps.append(f"f{i + 1} AS (SELECT f{i}.*, {fix} AS s{i + 1} FROM f{i}{more})")
    last = "s7"
    for i, (left, right) in enumerate(T.BRACKETS):
        steps.append(f"b{i} AS (SELECT *, CASE WHEN {_unpaired_sql(left, right, last)} THEN translate({last}, '{left}{right}', '') ELSE {last} END AS p{i} FROM {f'b{i - 1}' if i else 'f7'})")
        last = f"p{i}"
    steps.append(f"""s AS (SELECT *, CASE WHEN {_ODD_SQL.replace('{c}', last)} THEN replace({last}, '"', '') ELSE {last} END AS s8 FROM b{len(T.BRACKETS) - 1})""")
    return f"{_ENTITY_TABLES}, {', '.join(steps)}"


_FIRED_SQL = "list_filter([" + ", ".join(f"CASE WHEN s{i + 1} <> s{i} THEN '{name}' END" for i, (name, _) in enumerate(T.FIXES)) + "], lambda x: x IS NOT NULL)"
_TIDIED_SQL = ORACLE["t12_tidied"].removeprefix("SELECT pos, ").split(" AS fixed FROM manifest")[0].replace("text", "s8")
PIPELINE_SQL = f"{_pipeline_sql()}, fixes AS (SELECT pos, {_TIDIED_SQL} AS fixed, {_FIRED_SQL} AS fired, {_TIDIED_SQL} <> original AS modified FROM s)"


@query("t13_fix_pipeline", "manifest", sql=f"WITH {PIPELINE_SQL} SELECT * FROM fixes")
def fix_pipeline(m: DataFrame, *more: str) -> DataFrame:
    """``(pos, fixed, fired, modified)`` and the columns ``more``: the fixes in order, with the names of
    those that changed the text.  Texts without a letter are removed, by their
    original form; the final tidying is no fix, but counts as a modification."""
    df = _texts(m).where(T.has_letters(F.col("text"))).select("pos", *more, "text", F.col("text").alias("s0"))
    for i, (_, fix) in enumerate(T.FIXES):
        df = df.withColumn(f"s{i + 1}", fix(F.col(f"s{i}")))
    fired = F.array_compact(F.array(*[F.when(F.col(f"s{i + 1}") != F.col(f"s{i}"), name) for i, (name, _) in enumerate(T.FIXES)]))
    done = T.tidied(F.col(f"s{len(T.FIXES)}"))
    return df.select("pos", done.alias("fixed"), fired.alias("fired"), (done != F.col("text")).alias("modified"), *more)


for _i, (_name, _check) in enumerate(T.CHECKS):
    _sql = _CHECK_SQL.get(_name)
    query(f"t{14 + _i}_check_{_name}", "manifest", sql=_sql and f"SELECT pos FROM manifest WHERE text IS NOT NULL AND {_sql}")(
        lambda m, check=_check: _texts(m).where(check(F.col("text"))).select("pos")
    )


@query(
    "t29_issue_summary", "manifest",
    sql=f"""WITH t AS (SELECT pos, text, {SPLIT_SQL} AS split FROM manifest WHERE text IS NOT NULL), h AS ({_HIT_SQL})
      SELECT issue, split, count(*) AS texts FROM h GROUP BY issue, split
      UNION ALL SELECT 'any' AS issue, split, count(DISTINCT pos) AS texts FROM h GROUP BY split""",
)
def issue_summary(m: DataFrame) -> DataFrame:
    """Texts per issue and split, and those with any issue, by all fifteen checks."""
    h = issues(m)
    any_issue = h.groupBy("split").agg(F.countDistinct("pos").alias("texts")).select(F.lit("any").alias("issue"), "split", "texts")
    return h.groupBy("issue", "split").agg(F.count("*").alias("texts")).unionByName(any_issue)


@F.pandas_udf(StringType())
def _char_name(c: pd.Series) -> pd.Series:
    return c.map(lambda x: unicodedata.name(x, f"U+{ord(x):04X}"))


@query("t14_odd_characters", "manifest")
def odd_characters(m: DataFrame) -> DataFrame:
    """``(ch, name, texts)``: non-ASCII characters with the number of texts."""
    chars = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\x00-\x7F]"), F.lit(0)))
    per = _texts(m).select(F.explode(chars).alias("ch")).groupBy("ch").agg(F.count("*").alias("texts"))
    return per.select("ch", _char_name("ch").alias("name"), "texts")


@query(
    "t16_space_runs", "manifest",
    sql="""SELECT pos, len(regexp_extract_all(text, ' {2,}')) AS runs, list_max(list_transform(regexp_extract_all(text, ' {2,}'), lambda x: length(x))) AS longest
      FROM manifest WHERE contains(text, '  ')""",
)
def space_runs(m: DataFrame) -> DataFrame:
    runs = F.regexp_extract_all("text", F.lit(" {2,}"), F.lit(0))
    hit = _texts(m).where(F.col("text").contains("  ")).select("pos", runs.alias("r"))
    return hit.select("pos", F.size("r").cast("long").alias("runs"), F.array_max(F.transform("r", F.length)).cast("long").alias("longest"))


def _at():
    return F.unix_micros(F.col("logged_at").cast("timestamp")).alias("t")


_SIDES_SQL = f"""sides AS (SELECT *, list_filter(string_split_regex(coalesce(reference, ''), '[{WS_SQL}]+'), lambda w: w <> '') AS r,
  list_filter(string_split_regex(coalesce(hypothesis, ''), '[{WS_SQL}]+'), lambda w: w <> '') AS h FROM gen_samples)"""


def lcs_sql(a: str, b: str) -> str:
    """The length of the longest common subsequence of two lists of integers: a row of
    the table per element of the first, whose greatest values so far are the next row."""
    step = f"list_transform(range(1, len({b}) + 1), lambda j: CASE WHEN ({b})[j] = x[1] THEN (CASE WHEN j > 1 THEN s[j - 1] ELSE 0 END) + 1 ELSE s[j] END)"
    best = f"list_transform([{step}], lambda v: list_transform(range(1, len({b}) + 1), lambda k: list_max(v[1:k])))[1]"  # the step once
    return f"CASE WHEN len({b}) = 0 THEN 0 ELSE coalesce(list_max(list_reduce(list_transform({a}, lambda e: [e::BIGINT]), lambda s, x: {best}, list_transform({b}, lambda e: 0::BIGINT))), 0) END"


@query(
    "t30_indel_ratio", "gen_samples",
    sql=f"""WITH c AS (SELECT logged_at, reference, hypothesis, list_transform(string_split(reference, ''), lambda x: unicode(x)) AS a, list_transform(string_split(hypothesis, ''), lambda x: unicode(x)) AS b
        FROM gen_samples WHERE reference IS NOT NULL AND hypothesis IS NOT NULL),
      k AS (SELECT *, length(reference) + length(hypothesis) AS n FROM c)
      SELECT epoch_us(logged_at) AS t, reference, hypothesis, CASE WHEN n = 0 THEN 100.0 WHEN reference = '' OR hypothesis = '' THEN 0.0 ELSE round(200.0 * {lcs_sql('a', 'b')} / n, 4) END AS score FROM k""",
)
def indel_ratios(g: DataFrame) -> DataFrame:
    ok = g.where(F.col("reference").isNotNull() & F.col("hypothesis").isNotNull())
    return ok.select(_at(), "reference", "hypothesis", F.round(indel_ratio_udf("reference", "hypothesis"), 4).alias("score"))


# the words of a pair as single ASCII characters, for DuckDB's levenshtein
_CODED_SQL = f"""{_SIDES_SQL}, u AS (SELECT *, list_distinct(r || h) AS w FROM sides),
  coded AS (SELECT *, array_to_string(list_transform(r, lambda x: chr(list_position(w, x)::INT)), '') AS rc, array_to_string(list_transform(h, lambda x: chr(list_position(w, x)::INT)), '') AS hc FROM u)"""


@query("t31_word_edits", "gen_samples", sql=f"WITH {_CODED_SQL} SELECT epoch_us(logged_at) AS t, reference, hypothesis, levenshtein(rc, hc)::INT AS edits FROM coded")
def word_edit_counts(g: DataFrame) -> DataFrame:
    a, b = T.space_words(F.col("reference")), T.space_words(F.col("hypothesis"))
    return g.select(_at(), "reference", "hypothesis", word_edits(a, b).alias("edits"))


@query(
    "t32_word_lcs", "gen_samples",
    sql=f"""WITH {_SIDES_SQL}, u AS (SELECT *, list_distinct(r || h) AS w FROM sides),
      c AS (SELECT *, list_transform(r, lambda x: list_position(w, x)) AS a, list_transform(h, lambda x: list_position(w, x)) AS b FROM u)
      SELECT epoch_us(logged_at) AS t, reference, hypothesis, ({lcs_sql('a', 'b')})::INT AS lcs FROM c""",
)
def word_lcs_lengths(g: DataFrame) -> DataFrame:
    a, b = T.space_words(F.col("reference")), T.space_words(F.col("hypothesis"))
    return g.select(_at(), "reference", "hypothesis", word_lcs(a, b).alias("lcs"))


@query(
    "t33_bigrams", "manifest",
    sql=f"""WITH w AS (SELECT pos, list_filter(string_split_regex(text, '[{WS_SQL}]+'), lambda w: w <> '') AS w FROM manifest WHERE text IS NOT NULL),
      g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w)
      SELECT bigram, count(*) AS n FROM g GROUP BY bigram""",
)
def bigrams(m: DataFrame) -> DataFrame:
    return _texts(m).select(F.explode(T.ngrams(T.space_words(F.col("text")), 2)).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


@query("t35_token_counts", "manifest")
def token_counts(m: DataFrame) -> DataFrame:
    """Tokens per caption by a counting function that is a parameter of
    ``count_tokens``; here pieces of letters, digits and signs."""
    return count_tokens(_texts(m).select("pos", "text"), lambda t: len(_pieces().findall(t)))


def _pieces():
    import regex

    return regex.compile(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+")


def count_tokens(df: DataFrame, count) -> DataFrame:
    """``(pos, tokens)`` by ``count(text) -> int``, in Arrow batches."""

    @F.pandas_udf("int")
    def n(s: pd.Series) -> pd.Series:
        return s.map(count).astype("int32")

    return df.select("pos", n("text").alias("tokens"))
