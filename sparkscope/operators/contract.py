"""Contracts of sinks: predicates that gate them, support objects behind these, and calls that set them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.functions.names import contains_any, field_parts, field_tail, has_lowercase, identifier_tokens, is_null_like, semantic_match
from sparkscope.operators.facts import REGISTER_WORDS, SETUP_WORDS, TASK_FUNCTIONS
from sparkscope.operators.ordered import top_k
from sparkscope.session import materialise, spread

# Words of size and buffer fields, generic owners, and fields of streams and state machines.
SIZE_WORDS = ("max", "size", "len", "length", "count", "capacity", "limit")
BUFFER_WORDS = ("buf", "buffer", "data", "row", "rows", "extra", "table", "palette", "image", "out", "dst", "src")
GENERIC_OWNERS = ("state", "strm", "stream", "ctx", "context", "self", "this")
STREAM_FIELDS = (
    "next_in", "next_out", "avail_in", "avail_out", "msg", "adler", "data_type", "total_in", "total_out", "opaque", "zalloc", "zfree", "reserved",
    "length",
)
MACHINE_FIELDS = ("mode", "wrap", "flags", "check", "state", "status", "phase", "stage", "step")
ALLOCATORS = ("allocate", "deallocate", "reallocate", "malloc", "calloc", "realloc", "free", "new", "delete")
INTERMEDIARIES = ("in", "input", "output", "buf", "buffer", "raw", "stream", "reader", "writer", "internal", "priv", "private", "impl", "pending")
CALLBACK_WORDS = (
    "callback", "handler", "hook", "func", "fn", "start", "end", "document", "element", "characters", "comment", "processing", "instruction", "warning",
    "error", "fatal", "cdata", "entity", "notation", "attribute", "namespace", "reference", "declaration", "enddocument", "startdocument",
    "startelement", "endelement", "getentity", "setdocumentlocator",
)
CALLBACK_PARTS = ("callback", "handler", "enddocument", "startdocument", "startelement", "endelement")


def _any_of(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def is_size_field(name: Column) -> Column:
    return _any_of(identifier_tokens(name), SIZE_WORDS)


def is_buffer_field(name: Column) -> Column:
    tokens = identifier_tokens(name)
    callback = _any_of(tokens, CALLBACK_WORDS) | contains_any(F.array_join(tokens, ""), *CALLBACK_PARTS)
    return ~callback & _any_of(tokens, BUFFER_WORDS)


def predicate_score(target: Column, operator: Column, value: Column) -> Column:
    tail = F.lower(field_tail(target))
    null = is_null_like(value, zero=True)
    hops = F.size(F.split(target, r"->|\.")) - 1
    return (
        F.when((operator == "!=") & null, 5).when(operator.isin("==", "!="), 2).when(operator.isin("<", ">", "<=", ">="), 1).otherwise(0)
        + F.when(contains_any(tail, *BUFFER_WORDS), 3).otherwise(0)
        + F.when(contains_any(tail, *SIZE_WORDS), 2).otherwise(0)
        + F.when(tail.isin(*MACHINE_FIELDS), 3).otherwise(0)
        + F.when(hops >= 2, 2).otherwise(0)
    )


def _owner(target: Column) -> Column:
    parts = field_parts(target)
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def is_relevant(target: Column, operator: Column, value: Column) -> Column:
    """Whether a predicate can gate a sink: not stream bookkeeping, sizes, bounds or plain values of a generic owner."""
    owner, tail = F.lower(_owner(target)), F.lower(field_tail(target))
    plain = operator.isin("==", "!=") & ~is_null_like(value, zero=True) & ~tail.isin(*MACHINE_FIELDS)
    noise = tail.isin(*STREAM_FIELDS) | tail.isin(*SIZE_WORDS) | operator.isin("<", ">", "<=", ">=") | plain
    return _owner(target).isNotNull() & ~(owner.isin(*GENERIC_OWNERS) & F.coalesce(noise, F.lit(False)))


def support_object(target: Column, operator: Column, value: Column) -> Column:
    """struct<name,field> of the object a predicate stands for; null for internal chains and direct state."""
    owner, tail = _owner(target), field_tail(target)
    generic = F.lower(owner).isin(*GENERIC_OWNERS)
    linked = is_null_like(value, zero=True) & operator.isin("==", "!=") & ~F.lower(tail).isin(*STREAM_FIELDS, *MACHINE_FIELDS) & ~F.lower(tail).isin(*INTERMEDIARIES)
    chain = F.lower(owner).isin(*INTERMEDIARIES) & (F.size(field_parts(target)) >= 3)
    pair = lambda n, f: F.struct(n.alias("name"), f.alias("field"))
    return F.when(generic & linked, pair(tail, F.lit(""))).when(owner.isNotNull() & ~generic & ~chain, pair(owner, tail))


def activation_predicates(conditions: DataFrame, limit: int = 8) -> DataFrame:
    """(path, fn, ord, target, operator, value, score, importance): the best relevant predicates of score 4 and more, each once.

    Scored ones are written once, counted and dealt by function over as many
    tasks as their number asks for; all that follows stays in these. A shuffle
    that Spark sizes by bytes would gather them in a few tasks.
    """
    t, o, v = F.col("target"), F.col("operator"), F.col("value")
    scored = conditions.where(is_relevant(t, F.coalesce(o, F.lit("")), v)).withColumn("score", predicate_score(t, F.coalesce(o, F.lit("")), v)).where("score >= 4")
    dealt = spread(materialise(scored.select("path", "fn", "ord", "target", "operator", "value", "score")), TASK_FUNCTIONS, "path", "fn")
    once = dealt.groupBy("path", "fn", "target", "operator", "value").agg(F.max("score").alias("score"), F.min("ord").alias("first"))
    order = [F.desc("score"), F.col("target"), F.col("first")]
    ranked = top_k(once, ["path", "fn"], order, limit).withColumn("ord", F.row_number().over(Window.partitionBy("path", "fn").orderBy(*order)) - 1).drop("first")
    return ranked.withColumn("importance", F.when(F.col("score") >= 7, "high").otherwise("medium"))


def support_objects(predicates: DataFrame, fields: DataFrame, limit: int = 4) -> DataFrame:
    """(path, fn, ord, name, required_fields, evidence): predicates grouped by their object, with size and buffer siblings.

    Required fields come from predicates, then from observed size or buffer
    fields; each is followed by observed size fields that match its words.
    """
    resolved = predicates.withColumn("o", support_object(F.col("target"), F.coalesce("operator", F.lit("")), F.col("value"))).where("o is not null and o.name != ''")
    grouped = resolved.groupBy("path", "fn", F.col("o.name").alias("name")).agg(
        F.min("ord").alias("ord"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "target"))), lambda x: x["target"]).alias("evidence"),
        F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("o.field").alias("f")))), lambda x: x["f"]), lambda f: f != "")).alias("asked"),
    )
    seen = fields.groupBy("path", "fn", F.col("owner").alias("name")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "field"))), lambda x: x["field"])).alias("observed"))
    both = grouped.join(seen, ["path", "fn", "name"], "left").withColumn("observed", F.coalesce("observed", F.array().cast("array<string>")))
    observed = F.col("observed")
    base = F.array_distinct(F.concat("asked", F.filter(observed, lambda f: contains_any(f, *SIZE_WORDS, *BUFFER_WORDS))))
    sibling = lambda f: F.filter(observed, lambda x: (x != f) & is_size_field(x) & (semantic_match(identifier_tokens(x), identifier_tokens(f)) >= 2))
    full = F.array_distinct(F.flatten(F.transform(base, lambda f: F.concat(F.array(f), sibling(f)))))
    return both.select("path", "fn", "ord", "name", F.slice(full, 1, limit).alias("required_fields"), "evidence")


def field_constraints(objects: DataFrame) -> DataFrame:
    """(path, fn, ord, name, fields, rule): vary a buffer against its size, a buffer's own length, or populate all."""
    required = F.col("required_fields")
    sizes = F.filter(required, lambda f: is_size_field(f))
    others = F.filter(required, lambda f: ~is_size_field(f))
    near = lambda f: F.filter(sizes, lambda s: semantic_match(identifier_tokens(s), identifier_tokens(f)) >= 2)
    item = lambda rule, fields: F.struct(F.lit(rule).alias("rule"), fields.alias("fields"))
    each = F.array_compact(F.transform(others, lambda f: F.when(F.size(near(f)) > 0, item("vary_against_size", F.concat(F.array(f), F.slice(near(f), 1, 1)))).when(is_buffer_field(f), item("vary_length", F.array(f)))))
    generic = F.exists(each, lambda x: x["rule"] == "vary_length")
    whole = F.when((F.size(required) > 0) & ~generic, F.array(item("populate", required))).otherwise(F.array().cast("array<struct<rule:string,fields:array<string>>>"))
    return objects.select("path", "fn", "ord", "name", F.posexplode(F.concat(whole, each)).alias("at", "c")).select("path", "fn", "ord", "at", "name", "c.*")


def setup_calls(related: DataFrame, objects: DataFrame, limit: int = 6) -> DataFrame:
    """(path, fn, ord, name, score): related set-up and registration functions that fit the support objects, score 4 and more."""
    words = objects.groupBy("path", "fn").agg(F.flatten(F.collect_list(F.flatten(F.transform(F.concat(F.array("name"), "required_fields"), identifier_tokens)))).alias("words"))
    both = related.join(words, ["path", "fn"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    tokens, params = identifier_tokens(F.col("name")), identifier_tokens(F.col("params"))
    match = semantic_match(F.concat(tokens, params), F.col("words"))
    is_setup = (F.col("relation") == "init") | _any_of(tokens, SETUP_WORDS)
    is_register = (F.col("relation") == "register") | _any_of(tokens, REGISTER_WORDS)
    score = F.when(is_setup, 6).otherwise(0) + F.when(is_register, 4).otherwise(0) + F.col("match") - F.when((F.col("match") == 0) & (F.col("relation") == "register"), 3).otherwise(0)
    public = has_lowercase(F.col("name")) & (F.lower("name") != F.lower("fn")) & ~F.lower("name").isin(*ALLOCATORS)
    scored = both.where(public).withColumn("match", match).withColumn("score", score).where("score >= 4").select("path", "fn", "name", "score")
    order = [F.desc("score"), F.col("name")]
    return top_k(scored, ["path", "fn"], order, limit).withColumn("ord", F.row_number().over(Window.partitionBy("path", "fn").orderBy(*order)) - 1)
