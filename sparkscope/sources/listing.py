"""Source files by name among a listing of files: of an advisory's path, and of the IR that a file was compiled to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.operators.ordered import known

# Endings of sources in the order in which they are tried.
ENDINGS = (".c", ".cc", ".cpp", ".cxx")


def _base(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def find_sources(wanted: DataFrame, files: DataFrame, root: str, id_col: str = "id", path_col: str = "path") -> DataFrame:
    """(id, path, found): the file that a path below ``root`` names, else the first one with its base name; null if there is neither.

    ``files`` has path. Both lookups are equi joins; of a base name one file is
    kept before the join, so a name that thousands of files have is one row. A
    missing path finds nothing.
    """
    top = root.rstrip("/")
    below = files.select(F.col("path").alias("f_path")).where(F.col("f_path").startswith(f"{top}/")).distinct()
    asked = wanted.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"))
    relative = known(F.col("path"))
    asked = asked.withColumns({"_direct": F.when(relative.startswith("/"), relative).otherwise(F.concat(F.lit(f"{top}/"), relative)), "_base": F.when(_base(relative) != "", _base(relative))})
    named = below.groupBy(_base(F.col("f_path")).alias("f_base")).agg(F.min("f_path").alias("f_first"))
    placed = asked.join(below, F.col("_direct") == F.col("f_path"), "left").join(named, F.col("_base") == F.col("f_base"), "left")
    return placed.select("id", "path", F.coalesce("f_path", "f_first").alias("found"))


def ir_sources(listed: DataFrame, files: DataFrame, root: str, guess: bool = False) -> DataFrame:
    """(path, source): of each IR file (path, perhaps with a line behind a colon) the source of its stem, by ending and then by path.

    A path with another ending stands for itself. Without a source ``source``
    is empty, or with ``guess`` the stem as a C file right below ``root``.
    """
    top = root.rstrip("/")
    plain = F.split_part("path", F.lit(":"), F.lit(1))
    stem = F.when(plain.endswith(".ll"), F.regexp_replace(_base(plain), r"\.ll$", ""))
    base = _base(F.col("f_path"))
    rank = F.coalesce(*(F.when(base.endswith(e), F.lit(i)) for i, e in enumerate(ENDINGS)))
    below = files.select(F.col("path").alias("f_path")).where(F.col("f_path").startswith(f"{top}/")).withColumn("rank", rank).where("rank is not null")
    best = below.groupBy(F.regexp_replace(base, r"\.[^.]*$", "").alias("f_stem")).agg(F.min_by("f_path", F.struct("rank", "f_path")).alias("f_best"))
    rows = listed.select("path", stem.alias("_stem"), plain.alias("_plain")).join(best, F.col("_stem") == F.col("f_stem"), "left")
    missing = F.concat(F.lit(f"{top}/"), "_stem", F.lit(".c")) if guess else F.lit("")
    return rows.select("path", F.when(F.col("_stem").isNull(), F.col("_plain")).otherwise(F.coalesce("f_best", missing)).alias("source"))
