"""Problem 6: text that looks the same brought to one form.

Look-alike letters, full-width forms and fixed spaces are mapped one by one;
composed against decomposed accents and characters without width are left to
ICU: values are grouped in SQL under its accent- and case-sensitive collation,
every class takes one member as canonical, and that is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnloom.llm.near import expanded
from tarnloom.llm.norm import captions, display, look_alike_mapped
from tarnloom.plans.lineage import cut, drop


def _classes(texts: DataFrame, least: int = 1) -> DataFrame:
    """``texts(text, ...)``, distinct, with ``shown`` and the ``canonical`` member of
    their class; only classes of at least ``least`` texts."""
    mapped = texts.select("*", look_alike_mapped(F.col("text")).alias("mapped"), display(F.col("text")).alias("shown"))
    return mapped.sparkSession.sql(
        """
        WITH named AS (
          SELECT collate(mapped, 'UNICODE') AS class, min(shown) AS canonical
          FROM {mapped} GROUP BY collate(mapped, 'UNICODE') HAVING count(*) >= {least}
        )
        SELECT m.*, n.canonical
        FROM {mapped} m JOIN named n ON collate(m.mapped, 'UNICODE') = n.class
        """,
        mapped=mapped,
        least=least,
    ).drop("mapped")


def unify(df: DataFrame, column: str = "text", out: str = "canonical") -> DataFrame:
    """``df`` with ``out``: the canonical member of the class of ``column``, the
    display form that comes first by code point.  Null stays null."""
    texts = df.where(F.col(column).isNotNull()).select(F.col(column).alias("text")).distinct()
    named = _classes(cut(texts, "texts")).select(F.col("text").alias("_seen"), F.col("canonical").alias(out))
    return df.drop(out).join(named, F.col(column) == F.col("_seen"), "left").drop("_seen")


def look_alike_pairs(manifest: DataFrame) -> DataFrame:
    """``(pos_a, pos_b)``: rows of six or more words whose texts are different
    strings of one display form.

    Only distinct strings are compared; rows of one string come in by a join, so
    a string that many rows share is no group to be paired with itself."""
    rows = captions(manifest).select("pos", "text")
    texts = cut(rows.groupBy("text").agg(F.min("pos").alias("rid")), "texts")
    named = cut(_classes(texts, least=2), "variants")
    drop(texts)
    side = lambda s: named.select("canonical", F.col("rid").alias(s), F.col("shown").alias(f"shown_{s}"))
    # the class proposes; an exact check follows the collation, which also ignores control characters
    pairs = side("a").join(side("b"), "canonical").where("a < b AND shown_a = shown_b").select("a", "b")
    member = cut(rows.join(named.select("text", "rid"), "text").select("rid", "pos"), "members")
    out = expanded(pairs, member.withColumnRenamed("pos", "p"), member.withColumnRenamed("pos", "q"))
    return out.select(F.least("p", "q").alias("pos_a"), F.greatest("p", "q").alias("pos_b"))
