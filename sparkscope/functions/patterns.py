"""Pattern banks: tables of (pattern, group, score) applied to text, with the places of their matches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    rule: str
    regex: str
    group: int
    score: int


def matches(text: Column, regex: str, group: int) -> Column:
    """array<struct<pos,value>> of a pattern's matches, pos counting from 0; the pattern must not match nothing."""
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    parts = F.split(text, regex, -1)
    length = lambda array, n: F.aggregate(F.slice(array, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    return F.transform(value, lambda v, i: F.struct((length(parts, i + 1) + length(whole, i)).alias("pos"), v.alias("value")))


def pattern_hits(texts: DataFrame, id_col: str, text_col: str, bank: Sequence[Pattern], keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep, rule, base, pos, value): every match of every pattern, with further columns of its text's row; one pass over the text, no join."""

    def tagged(p: Pattern) -> Column:
        return F.transform(matches(F.col(text_col), p.regex, p.group), lambda m: F.struct(F.lit(p.rule).alias("rule"), F.lit(p.score).alias("base"), m["pos"].alias("pos"), m["value"].alias("value")))

    found = [tagged(p) for p in bank]
    return texts.select(id_col, *keep, F.explode(F.concat(*found)).alias("h")).select(id_col, *keep, "h.*")


def best_match(hits: DataFrame, id_col: str, score: Column) -> DataFrame:
    """(id, value, score, pos): per text the value of best score; of equal ones the earliest place, then the least value."""
    scored = hits.withColumn("score", score)
    per_value = scored.groupBy(id_col, "value").agg(F.max(F.struct("score", (-F.col("pos")).alias("p"))).alias("b"))
    return per_value.groupBy(id_col).agg(F.min_by(F.struct("value", "b"), F.struct((-F.col("b.score")).alias("s"), (-F.col("b.p")).alias("p"), "value")).alias("x")).select(
        id_col, F.col("x.value").alias("value"), F.col("x.b.score").alias("score"), (-F.col("x.b.p")).alias("pos")
    )
