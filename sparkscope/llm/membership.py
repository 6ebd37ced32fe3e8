"""Which rows can have an id of a given table: a bit set of fixed size, so that the others need not be shuffled.

Ids are hashed to BITS places; the set is built by Spark's bitmap aggregates
and sent to all tasks (BITS / 8 bytes at most, whatever the number of ids). A
set bit may be another id's, so what passes is still joined exactly; a clear
bit is certain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
_BUCKET_BITS = 32768


def _place(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(BITS))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mark(df: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a further boolean column, and its name: false for rows whose id is certainly not in ``ids`` (one column); null ids are not."""
    place = _place(F.col(ids.columns[0]).cast("long"))
    bucket, number, bits, may = (fresh(df, n) for n in ("_bucket", "_set", "_bits", "_may"))
    sets = ids.where(F.col(ids.columns[0]).isNotNull()).groupBy(F.bitmap_bucket_number(place).alias(number)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(bits))
    own = _place(F.col(id_col).cast("long"))
    at = F.pmod(F.bitmap_bit_position(own), F.lit(_BUCKET_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, at.bitwiseAND(7)).bitwiseAND(1)
    joined = df.withColumn(bucket, F.bitmap_bucket_number(own)).join(F.broadcast(sets), F.col(bucket) == F.col(number), "left")
    return joined.withColumn(may, F.col(id_col).isNotNull() & F.coalesce(bit == 1, F.lit(False))).drop(bucket, number, bits), may


def split(df: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the ids, rows that certainly have none)"""
    marked, may = mark(df, id_col, ids)
    return marked.where(F.col(may)).drop(may), marked.where(~F.col(may)).drop(may)


def possible(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows that may have one of the ids."""
    return split(df, id_col, ids)[0]


def without(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows that have none of the ids; only those that may have one are shuffled."""
    doubtful, sure = split(df, id_col, ids)
    name = fresh(df, "_id")
    kept = doubtful.join(ids.select(F.col(ids.columns[0]).alias(name)), F.col(id_col) == F.col(name), "left_anti")
    return sure.unionByName(kept)
