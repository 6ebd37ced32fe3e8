"""Rule tables: findings with penalties, verdicts, and the choice among candidates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.operators.ordered import first_wins

PASS_MARK = 60


@dataclass(frozen=True)
class Rule:
    """A finding with its penalty. It fires once where ``when`` holds, or once per match of ``per_match``, up to ``most`` times."""

    rule: str
    level: str
    penalty: int
    critical: bool
    when: str | None
    most: int = 1
    per_match: str | None = None

    def times(self, text: Column) -> Column:
        if self.per_match:
            n = F.least(F.size(F.regexp_extract_all(text, F.lit(self.per_match), F.lit(0))), F.lit(self.most))
            return n if self.when is None else F.when(F.expr(self.when), n).otherwise(0)
        return F.expr(self.when).cast("int")


def findings(df: DataFrame, keys: Sequence[str], text: str, rules: Sequence[Rule]) -> DataFrame:
    """(keys, rule, level, penalty, critical, n): the rules that fire on each row, by one pass and without a join."""
    each = [F.struct(F.lit(r.rule).alias("rule"), F.lit(r.level).alias("level"), F.lit(r.penalty).alias("penalty"), F.lit(r.critical).alias("critical"), F.coalesce(r.times(F.col(text)), F.lit(0)).alias("n")) for r in rules]
    return df.select(*keys, F.explode(F.filter(F.array(*each), lambda x: x["n"] > 0)).alias("f")).select(*keys, "f.*")


def evaluate(df: DataFrame, keys: Sequence[str], text: str, rules: Sequence[Rule], pass_mark: int = PASS_MARK) -> DataFrame:
    """(keys, score, findings, ok): 100 less all penalties, 0 at least; ok needs the mark and no critical finding."""
    each = F.array(*(F.struct(F.lit(r.penalty).alias("p"), F.lit(r.critical).alias("c"), F.coalesce(r.times(F.col(text)), F.lit(0)).alias("n")) for r in rules))
    lost = F.aggregate("_f", F.lit(0), lambda s, x: s + x["p"] * x["n"])
    critical = F.exists("_f", lambda x: x["c"] & (x["n"] > 0))
    return df.select(*keys, each.alias("_f")).select(
        *keys,
        F.greatest(F.lit(0), 100 - lost).cast("long").alias("score"),
        F.aggregate("_f", F.lit(0), lambda s, x: s + x["n"]).cast("long").alias("findings"),
        (~critical & (100 - lost >= pass_mark)).alias("ok"),
    )


def verdicts(found: DataFrame, keys: Sequence[str], pass_mark: int = PASS_MARK) -> DataFrame:
    """The same verdict from finding rows (keys, penalty, critical), one row per finding."""
    left = 100 - F.sum("penalty")
    return found.groupBy(*keys).agg(
        F.greatest(F.lit(0), left).cast("long").alias("score"), F.count("*").alias("findings"), (~F.bool_or("critical") & (left >= pass_mark)).alias("ok")
    )


def best_candidate(reports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One report per key: ok first, then score, relations that hold, fewest violations, fewest warnings, first given."""
    order = {"_a": ~F.col("ok"), "_b": -F.col("score"), "_c": -F.col("relations_ok"), "_d": F.col("violations"), "_e": F.col("warnings")}
    ranked = first_wins(reports.withColumns(order), list(keys), [*order, "ord"])
    return ranked.drop(*order)
