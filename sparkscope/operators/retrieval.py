"""Snippets of source that show where a stage runs: scored blocks around calls, ranked and classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.functions.names import clip_lines, contains_any, identifier_tokens
from sparkscope.functions.patterns import matches
from sparkscope.operators import facts, ordered

# Folders and stems of low priority, folders that are skipped, and words of parsed state and of transforms.
LOW_FOLDERS = (
    "contrib", "test", "tests", "example", "examples", "fuzz", "python", "ruby", "java", "csharp", "go", "rust", "bindings", "binding", "wrappers",
    "wrapper", "swig",
)
LOW_STEMS = ("test", "fuzz", "example", "demo", "bench")
SKIPPED_FOLDERS = ("oss-fuzz", "__pycache__", "build", "dist", ".git", "node_modules")
SOURCE = r"(?i)\.(c|cc|cpp|cxx|h|hh|hpp)$"
PARSED_WORDS = ("update_info", "get_ihdr", "get_header", "progressive_ptr", "info_ptr", "row_info", "rowbytes", "color_type", "bit_depth")
TRANSFORM_WORDS = ("transform", "quant", "quantize", "palette", "gamma", "color", "background", "expand", "convert", "scale")


def source_files(listing: DataFrame, preferred: DataFrame, limit: int = 240) -> DataFrame:
    """(path): preferred sources first, then up to ``limit`` others by path, without skipped folders."""
    first = preferred.select("path").where(F.col("path").rlike(SOURCE)).distinct()
    rest = listing.select("path").where(F.col("path").rlike(SOURCE) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED_FOLDERS)))).join(first, "path", "left_anti")
    return first.unionByName(ordered.top_k(rest, [], ["path"], limit))


def is_callback(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return low.contains("callback") | low.rlike("(^|_)(cb|fn)$") | (low.contains("progressive") & low.rlike("(cb|fn)$"))


def is_low_priority(path: Column) -> Column:
    stem = F.lower(F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", ""))
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, LOW_FOLDERS))) | contains_any(stem, *LOW_STEMS)


def _holds(text: Column, tokens: Column) -> Column:
    return F.exists(tokens, lambda t: F.lower(text).contains(t))


def block_score(name: Column, body: Column, path: Column, wrapper: Column, config: Column, support: Column) -> Column:
    """How much a block looks like the place of a stage; the last three are token arrays."""
    yes = lambda condition, points: F.when(condition, points).otherwise(0)
    return (
        yes(is_callback(name), 5) + yes(contains_any(body, *PARSED_WORDS), 4) + yes(_holds(name, wrapper), 3) + yes(_holds(body, wrapper), 3)
        + yes(_holds(body, config), 3) + yes(_holds(body, support), 2) + yes(contains_any(name, *TRANSFORM_WORDS), 1) - yes(is_low_priority(path), 5)
    )


def placement(name: Column, body: Column) -> Column:
    return F.when(is_callback(name), "post-parse-callback").when(contains_any(body, *PARSED_WORDS), "post-parse-transition").otherwise("deferred-config")


def is_registration(name: Column, body: Column) -> Column:
    """Stores at least two function pointers in a struct, or is a short ``set_`` function."""
    low = F.lower(body)
    count = lambda p: F.size(F.regexp_extract_all(low, F.lit(p), F.lit(0)))
    stores = count(r"->\s*[a-z_]+_fn\s*=") + count(r"->\s*(?:info|row|end|read|write)_fn\s*=")
    short = F.lower(name).rlike("set_.*(read|write|progressive|callback|fn)") & (F.size(F.split(body, "\n")) - 1 < 20)
    return (F.coalesce(body, F.lit("")) != "") & ((stores >= 2) | short)


def search_tokens(*names: Column) -> Column:
    """Words of three letters and more of name arrays, in order, each once."""
    words = F.flatten(F.concat(*(F.transform(n, identifier_tokens) for n in names)))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def stage_evidence(files: DataFrame, blocks: DataFrame | None, apis: DataFrame, wrapper: Column, config: Column, support: Column, search: Column, limit: int = 6, lines: int = 24) -> DataFrame:
    """(file, function, api, placement, score, snippet, registers): the best blocks that call an API.

    Calls are found in each file by one pass over its text; each falls into
    the first block that holds it. If there are none, blocks that match the
    search words with a score of 6 and more stand in; both are ranked in one
    pass, those that stand in behind. Without ``blocks`` those of the files are
    taken, in the files' rows, so that no text is joined; a path is one row.
    """
    if blocks is None:
        rows = _rows_in_files(files, apis)
    else:
        rows = _rows_of_blocks(files, blocks, apis)
    matched = _holds(F.concat_ws(" ", "name", "body"), search)
    score = block_score(F.col("name"), F.col("body"), F.col("path"), wrapper, config, support)
    scored = rows.where(~F.col("stands_in") | matched).withColumn("score", score + F.when(F.col("stands_in"), 2).otherwise(0)).where("not stands_in or score >= 6")
    # of the few best rows, those that stand in count if there are no others
    best = ordered.top_k(scored, [], ["stands_in", F.desc("score"), "name", "api", "path", "body"], limit)
    best = best.withColumn("_some", F.min("stands_in").over(Window.partitionBy(F.lit(0)))).where("stands_in = _some")
    return best.select(F.col("path").alias("file"), F.col("name").alias("function"), "api", placement(F.col("name"), F.col("body")).alias("placement"), "score", clip_lines(F.col("body"), lines).alias("snippet"), is_registration(F.col("name"), F.col("body")).alias("registers"))


#: What stands for the API of a block that none is called in.
NO_API = "deferred_transform"


def _rows_in_files(files: DataFrame, apis: DataFrame) -> DataFrame:
    """(stands_in, path, api, name, body): each block with each of the APIs that it calls, and once by itself."""
    blocks = facts.called_blocks(files)
    one = lambda stands_in, api: F.struct(F.lit(stands_in).alias("stands_in"), api.alias("api"))
    said = lambda calls: F.explode(F.concat(F.transform(calls, lambda c: one(False, c)), F.array(one(True, F.lit(NO_API))))).alias("r")
    listed = apis.select(F.col("name").alias("_n")).where("_n is not null").distinct()
    if (all_ := ordered.told(listed, "_n")) is not None:
        return blocks.crossJoin(F.broadcast(all_)).select("path", "name", "body", said(F.array_intersect("calls", "_names"))).select("r.*", "path", "name", "body")
    rows = blocks.select("path", "name", "body", said(F.col("calls"))).select("r.*", "path", "name", "body")
    wanted = rows.where("not stands_in").join(listed, F.col("api") == F.col("_n"), "left_semi")
    return wanted.unionByName(rows.where("stands_in"))


def _rows_of_blocks(files: DataFrame, blocks: DataFrame, apis: DataFrame) -> DataFrame:
    """The same for blocks of any kind, which are joined with the files' calls; not by sending either to all tasks, as texts that compress well look small to Spark."""
    called = files.select("path", F.explode(matches(F.col("text"), facts.CALL, 1)).alias("m")).select("path", F.col("m.pos").alias("pos"), F.col("m.value").alias("api"))
    wanted = called.join(apis.select(F.col("name").alias("api")), "api", "left_semi")
    inside = wanted.join(blocks.hint("merge"), "path").where((F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("end")))
    held = inside.groupBy("path", "pos", "api").agg(F.min_by(F.struct("name", "body"), "start").alias("b")).select("path", "api", "b.*").distinct()
    own = held.select(F.lit(False).alias("stands_in"), "path", "api", "name", "body")
    return own.unionByName(blocks.select(F.lit(True).alias("stands_in"), "path", F.lit(NO_API).alias("api"), "name", "body"))


def placement_candidates(evidence: DataFrame, limit: int = 4) -> DataFrame:
    """(name): functions that run the stage, then those that register them."""
    ranked = evidence.groupBy("function").agg(F.min("registers").alias("r"), F.max("score").alias("s"))
    return ordered.top_k(ranked, [], ["r", F.desc("s"), "function"], limit).select(F.col("function").alias("name"))
