"""Seed inputs as data: constants in text, dictionary tokens, and the codec of recorded seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.functions.names import decode_seed

NUMBER = r"\b(0[xX][0-9a-fA-F]+|[0-9]+)(?:[uUlL]+)?\b"
STRING = r'"([^"\\\n]{2,16})"'
LEAST, MOST = 16, 1 << 48
# The corpus used when no seed is valid.
DEFAULT_SEEDS = ("{}", "[]", "null", "true", "false", "123", '"hello"', '{"key":"value"}', "[1,2,3]", '{"nested":{"key":1}}')


def numeric_constants(text: Column, pattern: str = NUMBER, limit: int = 20) -> Column:
    """array<struct<value,token>>: literals from 16 to 2^48, each once in order; the token is hexadecimal from 256 on."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    hexa = lambda t: t.rlike("^0[xX]")
    value = lambda t: F.when(hexa(t), F.when(F.length(F.regexp_replace(t, "^0[xX]0*", "")) <= 15, F.conv(F.substring(t, 3, 1 << 20), 16, 10))).otherwise(t).try_cast("long")
    values = F.array_distinct(F.filter(F.transform(found, value), lambda v: (v >= LEAST) & (v <= MOST)))
    token = lambda v: F.when(v >= 256, F.concat(F.lit("0x"), F.lower(F.hex(v)))).otherwise(v.cast("string"))
    return F.transform(F.slice(values, 1, limit), lambda v: F.struct(v.alias("value"), token(v).alias("token")))


def changed_text(diff: Column) -> Column:
    """Changed lines of a diff without their sign and without file headers."""
    lines = F.filter(F.split(F.coalesce(diff, F.lit("")), "\r?\n"), lambda x: x.rlike("^[+-]") & ~x.rlike(r"^(\+\+\+|---)"))
    return F.array_join(F.transform(lines, lambda x: F.substring(x, 2, 1 << 30)), "\n")


def little_endian(value: Column, n: int) -> Column:
    """``\\xNN`` text of a value in n bytes, least first; null if it does not fit."""
    digits = F.lower(F.lpad(F.hex(value), 2 * n, "0"))
    pairs = F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), lambda i: F.concat(F.lit("\\x"), F.substr(digits, 2 * i + 1, F.lit(2))))
    return F.when((value >= 0) & (F.length(F.hex(value)) <= 2 * n), F.array_join(pairs, ""))


def dictionary_tokens(source: Column, diff: Column, limit: int = 30) -> Column:
    """Quoted dictionary lines: constants of the diff, then of the source, as text and in 1, 2, 4 and 8 bytes; then short strings."""
    constants = F.slice(F.array_distinct(F.concat(numeric_constants(changed_text(diff), limit=15), numeric_constants(source))), 1, limit)
    quoted = lambda t: F.concat(F.lit('"'), t, F.lit('"'))
    forms = lambda c: F.array_compact(F.array(quoted(c["token"]), *(quoted(little_endian(c["value"], n)) for n in (1, 2, 4, 8))))
    strings = F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(STRING), F.lit(1)), lambda s: s.rlike(r"^[\x20-\x7e]+$") & (F.trim(s) != "")))
    return F.array_distinct(F.concat(F.flatten(F.transform(constants, forms)), F.transform(F.slice(strings, 1, 30), quoted)))


def validate_seeds(seeds: DataFrame) -> DataFrame:
    """``seeds`` (content, encoding) with bytes, ok and error."""
    kind = F.coalesce("encoding", F.lit("utf8"))
    bytes_ = F.when((F.coalesce("content", F.lit("")) != "") & kind.isin("base64", "hex", "utf8"), decode_seed(F.col("content"), kind))
    error = (
        F.when(F.coalesce("content", F.lit("")) == "", "missing 'content'")
        .when(~kind.isin("base64", "hex", "utf8"), F.concat(F.lit("has invalid encoding: "), kind))
        .when(F.col("bytes").isNull(), "decode error")
        .when(F.length("bytes") == 0, "decoded to empty content")
    )
    return seeds.withColumn("bytes", bytes_).withColumn("error", error).withColumn("ok", F.col("error").isNull())


def corpus(seeds: DataFrame) -> DataFrame:
    """(file, bytes) of valid seeds (name, content, encoding, ord); the default corpus if there are none."""
    good = validate_seeds(seeds).where("ok")
    safe = F.regexp_replace(F.coalesce("name", F.concat(F.lit("seed_"), F.col("ord").cast("string"))), r"[^\p{L}\p{N}_-]", "_")
    named = good.select(F.concat_ws("_", safe, F.col("ord").cast("string")).alias("file"), "bytes")
    rows = [(f"default_{i}", s) for i, s in enumerate(DEFAULT_SEEDS)]
    default = seeds.sparkSession.createDataFrame(rows, "file string, text string").select("file", F.encode("text", "UTF-8").alias("bytes"))
    from sparkscope.operators.ordered import fallback_if_empty

    return fallback_if_empty(named, default)
