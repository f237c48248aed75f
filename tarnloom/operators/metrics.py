"""Metrics of hypotheses against references, as ratios of sums.

Each row is turned into counts by one kernel; all aggregation is Spark's.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tarnloom.functions.kernels import word_edits, word_lcs
from tarnloom.functions.text import ngrams, space_words


def wer(g: DataFrame, by: list[str]) -> DataFrame:
    """100 x edits / reference words (an empty reference counts as one)."""
    r, h = space_words(F.col("reference")), space_words(F.col("hypothesis"))
    rows = g.select(*by, word_edits(r, h).alias("e"), F.greatest(F.size(F.coalesce(r, F.array())), F.lit(1)).alias("n"))
    return rows.groupBy(*by).agg(F.sum("e").alias("edits"), F.sum("n").alias("words"), F.round(100.0 * F.sum("e") / F.sum("n"), 4).alias("wer"))


def rouge_l(g: DataFrame, by: list[str]) -> DataFrame:
    """Mean F1 of the longest common subsequence; an empty side scores 0."""
    r, h = space_words(F.lower("reference")), space_words(F.lower("hypothesis"))
    rows = g.select(*by, word_lcs(r, h).alias("l"), F.size(F.coalesce(r, F.array())).alias("nr"), F.size(F.coalesce(h, F.array())).alias("nh"))
    # 2PR / (P + R) is 2 LCS / (words of both)
    f1 = F.when(F.col("l") > 0, 2.0 * F.col("l") / (F.col("nr") + F.col("nh"))).otherwise(0.0)
    return rows.groupBy(*by).agg(F.count("*").alias("pairs"), F.round(100.0 * F.avg(f1), 4).alias("rouge_l"))


def distinct_n(g: DataFrame, n: int, column: str = "hypothesis") -> DataFrame:
    grams = g.where(F.col(column).isNotNull()).select(F.explode(ngrams(space_words(F.lower(column)), n)).alias("x"))
    return grams.agg(F.countDistinct("x").alias("unique_grams"), F.count("*").alias("grams"), F.round(F.coalesce(F.try_divide(F.countDistinct("x"), F.count("*")), F.lit(0.0)), 6).alias("distinct_n"))


def tokens_13a(text: str) -> list[str]:
    """The mteval-13a tokenization: entities decoded, signs set apart."""
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(old, new)
    text = f" {text} "
    text = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", text)
    text = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", text)
    text = re.sub(r"([\.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


def _gram_counts(a, b, most: int) -> tuple[list[int], list[int]]:
    hits, totals = [], []
    for n in range(1, most + 1):
        x = Counter(tuple(a[i : i + n]) for i in range(len(a) - n + 1))
        y = Counter(tuple(b[i : i + n]) for i in range(len(b) - n + 1))
        hits.append(sum((x & y).values()))
        totals.append(max(len(b) - n + 1, 0))
    return hits, totals


def _sums(g: DataFrame, by: list[str], kernel, width: int) -> DataFrame:
    """Sums, per group, of the number vector that ``kernel(reference, hypothesis)``
    gives for every pair."""

    @F.pandas_udf("array<long>")
    def vector(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([kernel(x or "", y or "") for x, y in zip(r, h)])

    rows = g.select(*by, vector("reference", "hypothesis").alias("v"))
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).alias("s"))


def bleu(g: DataFrame, by: list[str], order: int = 4, smoothed: bool = True) -> DataFrame:
    """Corpus BLEU on 13a tokens.  ``smoothed``: the k-th order without a match
    counts as 1 / 2^k matches, and orders without any n-gram are left out, as the
    public scorer does; else a zero precision makes the score 0."""

    def kernel(r: str, h: str) -> list[int]:
        a, b = tokens_13a(r), tokens_13a(h)
        hits, totals = _gram_counts(a, b, order)
        return [*hits, *totals, len(a), len(b)]

    s = _sums(g, by, kernel, 2 * order + 2)
    at = lambda i: F.get("s", F.lit(i)).cast("double")
    logs, used, zeros = F.lit(0.0), F.lit(0), F.lit(0)
    for n in range(order):
        hit, total = at(n), at(order + n)
        zeros = zeros + F.when((hit == 0) & (total > 0), 1).otherwise(0)
        p = F.when(hit > 0, hit / F.greatest(total, F.lit(1.0))).otherwise(1.0 / (F.pow(F.lit(2.0), zeros) * F.greatest(total, F.lit(1.0))))
        logs, used = logs + F.when(total > 0, F.log(p)).otherwise(0.0), used + F.when(total > 0, 1).otherwise(0)
    brevity = F.when(at(2 * order + 1) >= at(2 * order), 1.0).otherwise(F.exp(1.0 - at(2 * order) / F.greatest(at(2 * order + 1), F.lit(1.0))))
    score = 100.0 * brevity * F.exp(logs / F.greatest(used, F.lit(1)))
    none = (at(0) == 0) | (at(2 * order + 1) == 0)
    if not smoothed:
        none = none | (zeros > 0) | (used < order)
    return s.select(*by, F.round(F.when(none, 0.0).otherwise(score), 4).alias("bleu"))


def chrf(g: DataFrame, by: list[str], order: int = 6, beta: float = 2.0) -> DataFrame:
    """Character n-gram F-score of the corpus, white space left out."""

    def kernel(r: str, h: str) -> list[int]:
        a, b = "".join(r.split()), "".join(h.split())
        hits, totals = _gram_counts(a, b, order)
        return [*hits, *totals, *[max(len(a) - n + 1, 0) for n in range(1, order + 1)]]

    s = _sums(g, by, kernel, 3 * order)
    at = lambda i: F.get("s", F.lit(i)).cast("double")
    p = r = n = F.lit(0.0)
    for i in range(order):
        has = (at(order + i) > 0) & (at(2 * order + i) > 0)
        p = p + F.when(has, at(i) / F.greatest(at(order + i), F.lit(1.0))).otherwise(0.0)
        r = r + F.when(has, at(i) / F.greatest(at(2 * order + i), F.lit(1.0))).otherwise(0.0)
        n = n + F.when(has, 1.0).otherwise(0.0)
    p, r = p / F.greatest(n, F.lit(1.0)), r / F.greatest(n, F.lit(1.0))
    b2 = beta * beta
    return s.select(*by, F.round(F.when(p + r > 0, 100.0 * (1 + b2) * p * r / (b2 * p + r)).otherwise(0.0), 4).alias("chrf"))


def length_stats(g: DataFrame, by: list[str]) -> DataFrame:
    """Mean lengths in words, their ratio, and the upper median of the hypotheses."""
    n = lambda c: F.size(F.coalesce(space_words(F.col(c)), F.array()))
    rows = g.select(*by, n("reference").alias("r"), n("hypothesis").alias("h"))
    # the upper median from counts per length, not from a list of all values
    return rows.groupBy(*by).agg(
        F.round(F.avg("r"), 6).alias("mean_ref"), F.round(F.avg("h"), 6).alias("mean_hyp"),
        F.round(F.coalesce(F.try_divide(F.avg("h"), F.avg("r")), F.lit(0.0)), 6).alias("ratio"),
        F.expr("CAST(percentile_disc(1 - 0.5) WITHIN GROUP (ORDER BY h DESC) AS INT)").alias("median_hyp"),
    )
