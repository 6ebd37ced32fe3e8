"""Lists of plan items as rows: each once, pruned by dropped names, kept by anchors, merged over stages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.functions.names import anchor_tokens
from sparkscope.functions.tolerant import canonical_text
from sparkscope.operators.ordered import first_wins, known


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, (left[c].eqNullSafe(right[c]) for c in columns))


def unique_texts(items: DataFrame, keys: Sequence[str], text: str, order: Sequence[str], drop_empty: bool = False) -> DataFrame:
    """The first row of each text of a key; with ``drop_empty`` none for missing and empty ones."""
    rows = items.where(F.coalesce(F.col(text), F.lit("")) != "") if drop_empty else items
    return first_wins(rows, [*keys, text], order)


def unique_objects(items: DataFrame, keys: Sequence[str], item: str, order: Sequence[str]) -> DataFrame:
    """The first row of each item of a key; JSON objects whose keys stand in another order, at any depth, are one."""
    marked = items.withColumn("_same", canonical_text(F.col(item)))
    return first_wins(marked, [*keys, "_same"], order).drop("_same")


def merged_stages(contracts: DataFrame, keys: Sequence[str], stages: Sequence[str], item: str, order: Sequence[str], limit: int) -> DataFrame:
    """(keys, place, item): the items of some stages (column ``stage``) in the order of ``stages``, each object once, ``limit`` at most.

    Items are deduplicated before they are ranked, and Spark keeps no more
    than ``limit`` of a key and task, so a key with very many items moves few.
    """
    rank = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    listed = contracts.where(F.col("stage").isin(*stages)).withColumn("_rank", rank)
    once = unique_objects(listed, keys, item, ["_rank", *order])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_rank", *order)) - 1
    return once.withColumn("place", place).where(F.col("place") < limit).select(*keys, "place", item)


def prune_fields(items: DataFrame, dropped: DataFrame, keys: Sequence[str], equal: Sequence[str] = (), containing: Sequence[str] = ()) -> DataFrame:
    """Items none of whose ``equal`` fields is a dropped name (keys, name) of their key and none of whose ``containing`` fields holds one; case counts.

    Names that equal a field are found by an equi join. A key's names are held
    against the texts of its own items; missing fields are empty, and blank
    names drop nothing.
    """
    names = dropped.where(known(F.col("name")).isNotNull()).select(*(F.col(k).alias(f"_d{i}") for i, k in enumerate(keys)), F.col("name").alias("_name")).distinct()
    on = reduce(Column.__and__, (F.col(k) == F.col(f"_d{i}") for i, k in enumerate(keys)))
    out = items
    for c in equal:
        out = out.join(names, on & (F.col(c) == F.col("_name")), "left_anti")
    for c in containing:
        out = out.join(names, on & F.contains(F.coalesce(F.col(c), F.lit("")), "_name"), "left_anti")
    return out


def anchored(items: DataFrame, anchors: DataFrame, keys: Sequence[str], fields: Sequence[str], stop: tuple[str, ...] = ()) -> DataFrame:
    """Items of which some field, a text or a list of texts, shares a meaningful word with their key's anchors (keys, token); repeated rows stay."""
    listed = lambda c: F.col(c) if dict(items.dtypes)[c].startswith("array") else F.array(F.col(c).cast("string"))
    words = F.array_distinct(F.flatten(F.transform(F.array_compact(F.concat(*(F.coalesce(listed(c), F.array().cast("array<string>")) for c in fields))), lambda t: anchor_tokens(t, stop))))
    exploded = items.distinct().withColumn("_token", F.explode(words))
    given = anchors.select(*keys, F.col("token").alias("_token")).distinct()
    hit = exploded.join(given, [*keys, "_token"], "left_semi").drop("_token").distinct()
    return items.join(hit, _same(items, hit, items.columns), "left_semi")
