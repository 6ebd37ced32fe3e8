"""Greedy excerpts: best lines that fit a budget, put back in order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words and signs that make a line of C worth keeping, and a call.
IMPORTANT = r"(?i)\b(if|switch|case|for|while|return|goto|free|realloc|malloc|calloc|memcpy|memmove|assert|sizeof|NULL|break)\b|->|&&|\|\|"
CALL = r"\b[a-zA-Z_]\w*\s*\("
GAP = "    // ..."


def line_score(line: Column) -> Column:
    """1, and 3 more for control flow or memory, and 2 more for a call; null for a blank line."""
    text = F.trim(line)
    score = 1 + F.when(text.rlike(IMPORTANT), 3).otherwise(0) + F.when(text.rlike(CALL) & ~text.startswith("//"), 2).otherwise(0)
    return F.when(text != "", score)


def greedy_excerpt(lines: DataFrame, keys: Sequence[str], line_no: str, line: str, score: str, budget: int, gap: str = GAP) -> DataFrame:
    """(keys, n_lines, excerpt): lines by score, skipping those that do not fit, joined in order with a mark for each hole.

    A line costs its length and one. The lines of a key are folded as one array,
    which is bounded by the text the key came from.
    """
    rows = lines.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.collect_list(F.struct(F.col(score).alias("s"), F.col(line_no).cast("long").alias("i"), F.col(line).alias("t"))).alias("_lines"))
    return _excerpts(rows, keys, F.col("_lines"), budget, gap)


def text_excerpt(texts: DataFrame, keys: Sequence[str], text: str, score: Callable[[Column], Column], budget: int, gap: str = GAP) -> DataFrame:
    """As :func:`greedy_excerpt`, of whole texts with a row each, inside the row; texts whose lines all score null are left out."""
    lines = F.transform(F.split(text, "\n"), lambda t, i: F.struct(score(t).alias("s"), i.cast("long").alias("i"), t.alias("t")))
    scored = F.filter(lines, lambda x: x["s"].isNotNull())
    return _excerpts(texts.withColumn("_lines", scored).where(F.size("_lines") > 0), keys, F.col("_lines"), budget, gap)


def _excerpts(rows: DataFrame, keys: Sequence[str], lines: Column, budget: int, gap: str) -> DataFrame:
    best = F.array_sort(F.transform(lines, lambda x: F.struct((-x["s"]).alias("s"), x["i"].alias("i"), x["t"].alias("t"))))
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<struct<i:bigint,t:string>>").alias("kept"))

    def take(state: Column, x: Column) -> Column:
        cost = F.length(x["t"]) + 1
        fits = (cost <= state["left"]) & (state["left"] > 0)
        kept = F.concat(state["kept"], F.array(F.struct(x["i"].alias("i"), x["t"].alias("t"))))
        return F.struct(F.when(fits, state["left"] - cost).otherwise(state["left"]).alias("left"), F.when(fits, kept).otherwise(state["kept"]).alias("kept"))

    picked = F.array_sort(F.aggregate(best, start, take, lambda s: s["kept"]))
    marked = F.transform("_kept", lambda x, n: F.when((n > 0) & (x["i"] > F.element_at(F.col("_kept"), F.greatest(n, F.lit(1)))["i"] + 1), F.concat(F.lit(gap + "\n"), x["t"])).otherwise(x["t"]))
    return rows.withColumn("_kept", picked).select(*keys, F.size("_kept").cast("long").alias("n_lines"), F.array_join(marked, "\n").alias("excerpt"))
