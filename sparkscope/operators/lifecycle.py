"""Families of functions: lifecycle bases, candidates for a phase, and roles that two sources disagree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.operators.ordered import precedence, top_k

# Endings of lifecycle functions, and those of each phase.
ENDINGS = ("Init", "Open", "Create", "Setup", "Begin", "Start", "Update", "Write", "Append", "Push", "Feed", "Finish", "Final", "Flush", "Close", "Destroy", "Free", "Cleanup", "End", "Reset")
PHASE_ENDINGS = {
    "setup": ("Init2_", "Init_", "Init2", "Init", "Open", "Create", "Setup", "Begin", "Start"),
    "update": ("Update", "Write", "Append", "Push", "Feed"),
    "cleanup": ("End", "Close", "Destroy", "Cleanup", "Free", "Reset"),
}


def lifecycle_base(name: Column) -> Column:
    """Lower-cased name without trailing digits, underscores and lifecycle endings; an ending that is the whole name stays."""
    text = F.regexp_replace(F.coalesce(name, F.lit("")), "[_0-9]+$", "")
    return F.lower(F.regexp_replace(text, "(?<=.)(?:(?:" + "|".join(ENDINGS) + ")[_0-9]*)+$", ""))


def lifecycle_candidates(api: str, public: DataFrame, phase: str, limit: int = 8) -> DataFrame:
    """(name): public functions of the same base with an ending of the phase; else those whose name holds the API's."""
    ends = F.col("name").rlike("(" + "|".join(PHASE_ENDINGS[phase]) + ")$")
    others = public.select("name").distinct().where((F.col("name") != api) & ends).withColumn("one", F.lit(1))
    family = others.where(lifecycle_base(F.col("name")) == lifecycle_base(F.lit(api)))
    return top_k(precedence([family, others.where(F.lower("name").contains(api.lower()))], ["one"]).select("name"), [], ["name"], limit)


def phase_candidates(helpers: DataFrame, api: str, public: DataFrame, phase: str, limit: int = 8) -> DataFrame:
    """(name): helpers (ord, name, phase) of the phase and the API's base that are public; else :func:`lifecycle_candidates`."""
    own = helpers.where((F.col("phase") == phase) & (lifecycle_base(F.col("name")) == lifecycle_base(F.lit(api))))
    own = own.groupBy("name").agg(F.min("ord").alias("ord")).join(public.select("name").distinct(), "name", "left_semi")
    listed = own.select("name", "ord").unionByName(lifecycle_candidates(api, public, phase, limit).select("name", F.lit(None).cast("int").alias("ord")).join(own.limit(1).select(F.lit(1).alias("x")), how="left_anti"))
    return top_k(listed, [], [F.col("ord").asc_nulls_last(), "name"], limit).select("name")


def parameter_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"^\*+", ""))


def role_points(role: Column, mentioned: Column) -> Column:
    base = (
        F.when(role == "control", 4).when(role == "state", 2).when(role.isin("size", "numeric") & mentioned, 2)
        .when(role.isin("input-buffer", "output-buffer") & mentioned, 1).when(role == "support-buffer", -1).otherwise(0)
    )
    return base + F.when(mentioned, 3).otherwise(0)


def choose_roles(signature: DataFrame, context: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Per key all rows of one side: the signature's if names mostly agree or evidence speaks for it, else the context's.

    Sides have (keys, name, role); evidence has (keys, name).
    """
    named = evidence.select(*keys, parameter_name(F.col("name")).alias("p")).distinct().withColumn("hit", F.lit(True))

    def side(df: DataFrame, tag: str) -> DataFrame:
        rows = df.withColumn("p", parameter_name(F.col("name"))).join(named, [*keys, "p"], "left")
        return rows.groupBy(*keys).agg(F.collect_set("p").alias(f"{tag}_names"), F.sum(role_points(F.col("role"), F.coalesce("hit", F.lit(False)))).alias(f"{tag}_score"))

    both = side(signature, "s").join(side(context, "c"), keys, "full")
    overlap = F.size(F.array_intersect("s_names", "c_names"))
    agree = (overlap > 0) & (overlap * 2 > F.greatest(F.size("s_names"), F.size("c_names")))
    wins = F.col("c_names").isNull() | (F.col("s_names").isNotNull() & (agree | (F.col("s_score") > F.col("c_score"))))
    chosen = both.select(*keys, F.coalesce(wins, F.lit(True)).alias("s"))
    left = signature.join(chosen.where("s"), keys, "left_semi")
    return left.unionByName(context.join(chosen.where("not s"), keys, "left_semi"))
