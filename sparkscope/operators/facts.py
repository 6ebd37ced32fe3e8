"""Facts of C functions: one scan in Arrow batches, then tables by Spark expressions.

``scan_functions`` is the only step that runs Python, once: it finds each function's
definition, blanks comments and literals and cuts balanced spans. All tables
below are projections of its columns, so a query that needs one table computes
just that one. ``ord`` columns keep the order of the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.functions import ctext
from sparkscope.functions.classify import call_phase, field_kind, parameter_role
from sparkscope.functions.names import condition_value, contains_any, identifier_tokens, is_null_like
from sparkscope.functions.patterns import matches
from sparkscope.operators.ordered import top_k
from sparkscope.session import materialise, workers_see_package

# Calls that say nothing about a function's needs.
SKIPPED_CALLS = (
    "if", "for", "while", "switch", "return", "sizeof", "memcpy", "memmove", "memset", "memcmp", "malloc", "calloc", "realloc", "free", "strlen",
    "strcpy", "strncpy", "strcat", "strcmp", "fprintf", "printf", "abort", "assert", "allocate", "deallocate", "reallocate",
)
# Owners and fields that are not state, and words that mark plural names.
NOT_OWNERS = (
    "this", "file", "files", "function", "functions", "line", "lines", "ret", "result", "rv", "rc", "res", "err", "error", "status", "tmp", "temp",
    "val", "ok",
)
NOT_FIELDS = ("returns", "better")
PLURALS = ("list", "array", "items", "entries", "texts", "records", "chunks", "rows", "cols", "names")
# Words of names that set up or register state.
SETUP_WORDS = ("init", "open", "create", "setup", "begin", "start")
REGISTER_WORDS = ("get", "set", "register", "attach", "assign", "config", "load")
FIELD = r"[A-Za-z_][A-Za-z0-9_]*(?:->|\.)[A-Za-z_][A-Za-z0-9_]*"
COMPARED = r"\s*(==|!=|<=|>=|<|>|&)\s*([^&|]+(?:\([^\)]*\)[^&|]*)?)"

#: Characters of texts that one task scans, and functions that one task looks up or gathers the facts of.
TASK_CHARS = 4 << 20
TASK_FUNCTIONS = 20_000

_TEXTS = pa.list_(pa.string())
_PARAMETER = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))
_SWITCH = pa.list_(pa.struct([("variable", pa.string()), ("body", pa.string())]))
_COLUMNS = (("source", pa.string()), ("plain", pa.string()), ("params", _PARAMETER), ("ifs", _TEXTS), ("whiles", _TEXTS), ("switches", _SWITCH))
SCANNED = "path string, fn string, source string, plain string, params array<struct<name:string,type:string>>, ifs array<string>, whiles array<string>, switches array<struct<variable:string,body:string>>"


def scan_functions(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Scan (path, text) for the functions wanted (path, fn); one row each, ``source`` empty if the file lacks it.

    The scan is written once: the tables of facts, of which a model joins many,
    read its columns instead of scanning the sources again.
    """
    workers_see_package(files.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, fn in zip(batch.column("text").to_pylist(), batch.column("fn").to_pylist(), strict=True):
                code, plain, params, ifs, whiles, switches = ctext.scan(text or "", fn or "")
                rows.append((code, plain, [{"name": n, "type": t} for n, t in params], ifs, whiles, [{"variable": v, "body": b} for v, b in switches]))
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True) if rows else [[]] * len(_COLUMNS), _COLUMNS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("fn"), *arrays], ["path", "fn", *(n for n, _ in _COLUMNS)])

    return materialise(_asked(files, wanted).mapInArrow(run, SCANNED))


def _asked(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, text, fn) of each function wanted, once.

    Both sides are dealt by path over as many tasks as the characters of the
    texts and the functions wanted ask for, and repeated ones are dropped where
    they are dealt to: rows that compress well look small to Spark, which would
    send all of them to all tasks or gather them in a few.
    """
    n_chars, n_wanted = files.agg(F.sum(F.length("text"))).first()[0] or 0, wanted.count()
    n_tasks = 1 + max(n_chars // TASK_CHARS, n_wanted // TASK_FUNCTIONS)
    texts = files.select("path", "text").repartition(n_tasks, "path")
    asked = wanted.select("path", "fn").repartition(n_tasks, "path").distinct()
    return texts.join(asked.hint("merge"), "path")


def blank_noise(text: Column) -> Column:
    """Comments and literals blanked; layout stays."""

    @F.arrow_udf("string")
    def blank(values: pa.Array) -> pa.Array:
        return pa.array([ctext.blank_noise(v) for v in values.to_pylist()], pa.string())

    return blank(text)


def function_blocks(files: DataFrame) -> DataFrame:
    """(path, name, start, end, body) of blocks that look like functions."""
    workers_see_package(files.sparkSession)
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<name:string,start:long,end:long>>")
    def scan(values: pa.Array) -> pa.Array:
        return pa.array([[{"name": n, "start": s, "end": e} for n, s, e in ctext.Source(v).blocks()] for v in values.to_pylist()], kind)

    rows = files.select("path", "text", F.explode(scan(F.col("text"))).alias("b"))
    body = F.substr("text", (F.col("b.start") + 1).cast("int"), (F.col("b.end") - F.col("b.start")).cast("int"))
    return rows.select("path", "b.*", body.alias("body"))


#: A name before an opening parenthesis.
CALL = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("


def called_blocks(files: DataFrame) -> DataFrame:
    """(path, name, body, calls array<string>): like ``function_blocks``, with the names called in each block, found in the file's row without a join.

    A call falls into the first block that holds it; of a file's blocks of one
    name and body the first gets the calls of all.
    """
    workers_see_package(files.sparkSession)
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("calls", pa.list_(pa.int32()))]))

    @F.arrow_udf("array<struct<name:string,start:long,end:long,calls:array<int>>>")
    def scan(texts: pa.Array, places: pa.Array) -> pa.Array:
        return pa.array([_called(t or "", at or []) for t, at in zip(texts.to_pylist(), places.to_pylist(), strict=True)], kind)

    rows = files.select("path", "text", matches(F.col("text"), CALL, 1).alias("m"))
    rows = rows.select("path", "text", "m", F.explode(scan("text", F.transform("m", lambda x: x["pos"]))).alias("b"))
    body = F.substr("text", (F.col("b.start") + 1).cast("int"), (F.col("b.end") - F.col("b.start")).cast("int"))
    return rows.select("path", "b.name", body.alias("body"), F.array_distinct(F.transform("b.calls", lambda i: F.get("m", i)["value"])).alias("calls"))


def _called(text: str, places: list[int]) -> list[dict]:
    """The blocks of a text with the numbers of the places, which are in order, that fall into each."""
    blocks = ctext.Source(text).blocks()
    calls: list[list[int]] = [[] for _ in blocks]
    first: dict[tuple[str, str], int] = {}
    owner = [first.setdefault((name, text[start:end]), i) for i, (name, start, end) in enumerate(blocks)]
    b = 0
    for i, at in enumerate(places):
        # blocks are in order of their starts, so the first that has not ended is the only one that may be the first to hold the place
        while b < len(blocks) and blocks[b][2] <= at:
            b += 1
        if b < len(blocks) and blocks[b][1] <= at:
            calls[owner[b]].append(i)
    return [{"name": n, "start": s, "end": e, "calls": c} for (n, s, e), c in zip(blocks, calls, strict=True)]


def parameter_roles(scan: DataFrame) -> DataFrame:
    """(path, fn, ord, name, type, role)"""
    rows = scan.select("path", "fn", F.posexplode("params").alias("ord", "p")).select("path", "fn", "ord", "p.name", "p.type")
    return rows.withColumn("role", parameter_role(F.col("name"), F.col("type")))


def helper_calls(scan: DataFrame, limit: int = 20) -> DataFrame:
    """(path, fn, ord, name, phase): called names, each once, in order."""
    called = F.regexp_extract_all("plain", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    fn = F.col("fn")
    useful = F.filter(F.array_distinct(called), lambda c: (c != fn) & ~c.isin(*SKIPPED_CALLS) & (F.length(c) > 2))
    return scan.select("path", "fn", F.posexplode(F.slice(useful, 1, limit)).alias("ord", "name")).withColumn("phase", call_phase(F.col("name")))


def state_fields(scan: DataFrame, limit: int = 12) -> DataFrame:
    """(path, fn, ord, owner, field, reads, kind): accessed fields, most read first.

    Accesses are dealt by function over as many tasks as there are functions, so
    that counts and ranks follow in these: names compress well, and a shuffle
    that Spark sizes by bytes would gather them in a few tasks.
    """
    pattern = F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*(?:->|\.)\s*([A-Za-z_][A-Za-z0-9_]*)")
    pairs = F.arrays_zip(F.regexp_extract_all("plain", pattern, F.lit(1)).alias("owner"), F.regexp_extract_all("plain", pattern, F.lit(2)).alias("field"))
    rows = scan.select("path", "fn", F.explode(pairs).alias("p")).select("path", "fn", "p.owner", "p.field")
    rows = rows.where(~F.lower("owner").isin(*NOT_OWNERS) & ~F.lower("field").isin(*NOT_FIELDS))
    rows = rows.repartition(1 + scan.count() // TASK_FUNCTIONS, "path", "fn")
    counts = rows.groupBy("path", "fn", "owner", "field").agg(F.count("*").alias("reads")).withColumn("kind", field_kind(F.col("field")))
    order = [F.desc("reads"), F.col("owner"), F.col("field")]
    return _numbered(top_k(counts, ["path", "fn"], order, limit), ["path", "fn"], order)


def _numbered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def _comparisons(texts: Column, pattern: str, name: str) -> Column:
    """array<struct<name,operator,value>> of the comparisons in condition texts, without those that have no value."""

    def one(text: Column) -> Column:
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
        return F.transform(F.sequence(F.lit(1), F.size(parts[0])), lambda i: F.struct(F.get(parts[0], i - 1).alias(name), F.get(parts[1], i - 1).alias("operator"), condition_value(F.get(parts[2], i - 1)).alias("value")))

    some = F.filter(texts, lambda t: F.regexp_like(t, F.lit(pattern)))
    return F.filter(F.flatten(F.transform(some, one)), lambda c: c["value"] != "")


def field_conditions(scan: DataFrame) -> DataFrame:
    """(path, fn, ord, target, operator, value, type): comparisons of fields in if and while, then switches on fields."""
    compared = F.transform(_comparisons(F.concat("ifs", "whiles"), f"({FIELD}){COMPARED}", "target"), lambda c: F.struct(c["target"].alias("target"), c["operator"].alias("operator"), c["value"].alias("value"), F.lit("comparison").alias("type")))
    member = F.filter("switches", lambda s: s["variable"].rlike(f"^{FIELD}$"))
    none = F.lit(None).cast("string")
    switched = F.transform(member, lambda s: F.struct(s["variable"].alias("target"), none.alias("operator"), none.alias("value"), F.lit("switch").alias("type")))
    return scan.select("path", "fn", F.posexplode(F.concat(compared, switched)).alias("ord", "c")).select("path", "fn", "ord", "c.*")


def parameter_conditions(scan: DataFrame) -> DataFrame:
    """(path, fn, ord, parameter, operator, value, type): per parameter its comparisons and switches, then switches on members."""
    rows = scan.select("path", "fn", "ifs", "switches", F.posexplode("params").alias("p", "param")).withColumn("parameter", F.col("param.name"))
    # the name must stand alone and not be a field, so the sign before it is matched and not kept
    pattern = F.concat(F.lit(r"(?:^|[^A-Za-z0-9_>.])("), F.col("parameter"), F.lit(r")\b" + COMPARED))
    hits = rows.select("path", "fn", "p", "parameter", F.posexplode("ifs").alias("i", "text")).withColumn("pattern", pattern).where(F.regexp_like("text", F.col("pattern")))
    zipped = F.arrays_zip(*(F.regexp_extract_all("text", F.col("pattern"), F.lit(i)).alias(n) for i, n in ((2, "operator"), (3, "value"))))
    compared = hits.select("path", "fn", "p", "parameter", "i", F.posexplode(zipped).alias("j", "c")).select(
        "path", "fn", F.struct(F.col("p").alias("a"), F.lit(0).alias("b"), F.col("i").alias("c"), F.col("j").alias("d")).alias("ord"), "parameter", F.col("c.operator").alias("operator"), condition_value(F.col("c.value")).alias("value"), F.lit("comparison").alias("type")
    ).where("value != ''")
    none = F.lit(None).cast("string")
    own = rows.select("path", "fn", "p", "parameter", F.posexplode("switches").alias("i", "s")).where("s.variable = parameter")
    own = own.select("path", "fn", F.struct(F.col("p").alias("a"), F.lit(1).alias("b"), F.col("i").alias("c"), F.lit(0).alias("d")).alias("ord"), "parameter", none.alias("operator"), none.alias("value"), F.lit("switch").alias("type"))
    member = scan.select("path", "fn", F.posexplode("switches").alias("i", "s")).where(F.col("s.variable").rlike(r"^\w+(?:->|\.)\w+$"))
    member = member.select("path", "fn", F.struct(F.lit(1 << 20).alias("a"), F.lit(2).alias("b"), F.col("i").alias("c"), F.lit(0).alias("d")).alias("ord"), F.col("s.variable").alias("parameter"), none.alias("operator"), none.alias("value"), F.lit("switch").alias("type"))
    return compared.unionByName(own).unionByName(member)


def switch_branches(scan: DataFrame) -> DataFrame:
    """(path, fn, ord, variable, cases, has_default, num_paths); plain variables first, then members that have cases."""
    body = F.col("s.body")
    cases = F.regexp_extract_all(body, F.lit(r"case\s+(-?\d+|0x[0-9a-fA-F]+|\w+):"), F.lit(1))
    rows = scan.select("path", "fn", F.posexplode("switches").alias("i", "s")).select("path", "fn", "i", F.col("s.variable").alias("variable"), cases.alias("cases"), body.contains("default:").alias("has_default"))
    plain, member = F.col("variable").rlike(r"^\w+$"), F.col("variable").rlike(r"^\w+(->|\.)\w+$")
    kept = rows.where(plain | (member & (F.size("cases") > 0)))
    return kept.select("path", "fn", F.struct(member.alias("m"), F.col("i").alias("i")).alias("ord"), "variable", "cases", "has_default", (F.size("cases") + F.col("has_default").cast("int")).alias("num_paths"))


def loop_features(scan: DataFrame) -> DataFrame:
    """(path, fn, loop_count, count_controlled, buffer_loops, record_like)"""
    heads = F.regexp_extract_all("plain", F.lit(r"(for|while)\s*\(([^\)]*)\)"), F.lit(2))
    having = lambda *words: F.transform(F.filter(heads, lambda h: contains_any(h, *words)), lambda h: F.trim(h))
    plural = F.transform(F.filter("params", lambda p: contains_any(p["name"], *PLURALS)), lambda p: p["name"])
    return scan.select(
        "path", "fn", F.size(heads).alias("loop_count"), having("len", "size", "count", "num", "avail").alias("count_controlled"),
        having("next", "buf", "data", "input", "output", "offset", "chunk").alias("buffer_loops"), plural.alias("record_like"),
    )


def format_checks(scan: DataFrame, text: str = "plain") -> DataFrame:
    """(path, fn, type, buffer, expected map<int,string>, signature, length): byte comparisons of a buffer at two places or more, and memcmp."""
    pattern = F.lit(r"(\w+)\s*\[\s*(\d+)\s*\]\s*==\s*(0x[0-9a-fA-F]+|\d+)")
    hits = F.arrays_zip(*(F.regexp_extract_all(text, pattern, F.lit(i)).alias(n) for i, n in ((1, "buffer"), (2, "at"), (3, "byte"))))
    rows = scan.select("path", "fn", F.posexplode(hits).alias("i", "h")).select("path", "fn", "i", "h.buffer", F.col("h.at").cast("int").alias("at"), "h.byte")
    last = rows.groupBy("path", "fn", "buffer", "at").agg(F.max_by("byte", "i").alias("byte"))
    bytes_ = last.groupBy("path", "fn", "buffer").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("at", "byte")))).alias("expected")).where(F.size("expected") >= 2)
    memory = F.lit(r'memcmp\s*\(\s*(\w+)\s*,\s*"([^"]+)"\s*,\s*(\d+)\s*\)')
    compared = F.arrays_zip(*(F.regexp_extract_all(text, memory, F.lit(i)).alias(n) for i, n in ((1, "buffer"), (2, "signature"), (3, "length"))))
    none = F.lit(None)
    seq = bytes_.select("path", "fn", F.lit("byte_sequence").alias("type"), "buffer", "expected", none.cast("string").alias("signature"), none.cast("int").alias("length"))
    mem = scan.select("path", "fn", F.explode(compared).alias("m")).select("path", "fn", F.lit("memcmp").alias("type"), "m.buffer", none.cast("map<int,string>").alias("expected"), "m.signature", F.col("m.length").cast("int").alias("length"))
    return seq.unionByName(mem)


def constants(files: DataFrame) -> DataFrame:
    """(path, kind, ord, name, value): numeric defines, and members of unnamed enums."""
    define = F.lit(r"#define\s+(\w+)\s+(-?\d+|0x[0-9a-fA-F]+)")
    pairs = F.arrays_zip(F.regexp_extract_all("text", define, F.lit(1)).alias("name"), F.regexp_extract_all("text", define, F.lit(2)).alias("value"))
    defines = files.select("path", F.lit("define").alias("kind"), F.posexplode(pairs).alias("ord", "p")).select("path", "kind", "ord", "p.*")
    bodies = F.regexp_extract_all("text", F.lit(r"enum\s*\{([^}]+)\}"), F.lit(1))
    item = F.trim(F.regexp_replace("item", r"^\s+|\s+$", ""))
    members = files.select("path", F.posexplode(F.flatten(F.transform(bodies, lambda b: F.split(b, ",")))).alias("ord", "item")).where((item != "") & ~item.startswith("//"))
    eq = F.regexp_extract(item, r"^(\w+)\s*=\s*(.+)", 1)
    enums = members.select("path", F.lit("enum").alias("kind"), "ord", F.when(eq != "", eq).otherwise(item).alias("name"), F.when(eq != "", F.trim(F.regexp_extract(item, r"^(\w+)\s*=\s*(.+)", 2))).otherwise("auto").alias("value"))
    return defines.unionByName(enums)


def state_machines(files: DataFrame) -> DataFrame:
    """(path, kind, ord, name, values): named enums with up to 20 members, and assignments to state-like variables."""
    named = F.lit(r"enum\s+(\w+)\s*\{([^}]+)\}")
    enums = F.arrays_zip(F.regexp_extract_all("text", named, F.lit(1)).alias("name"), F.regexp_extract_all("text", named, F.lit(2)).alias("body"))
    clean = lambda b: F.slice(F.filter(F.transform(F.split(b, ","), lambda m: F.regexp_replace(m, r"^\s+|\s+$", "")), lambda m: (m != "") & ~m.startswith("//")), 1, 20)
    one = files.select("path", F.lit("enum").alias("kind"), F.posexplode(enums).alias("ord", "e")).select("path", "kind", "ord", "e.name", clean(F.col("e.body")).alias("values"))
    assign = F.lit(r"(?i)(\w*state\w*)\s*=\s*(\w+)")
    sets = F.arrays_zip(F.regexp_extract_all("text", assign, F.lit(1)).alias("name"), F.regexp_extract_all("text", assign, F.lit(2)).alias("value"))
    two = files.select("path", F.lit("assignment").alias("kind"), F.posexplode(sets).alias("ord", "s")).select("path", "kind", "ord", "s.name", F.array("s.value").alias("values"))
    return one.unionByName(two)


def related_functions(files: DataFrame, wanted: DataFrame, limit: int = 8) -> DataFrame:
    """(path, fn, ord, name, params, relation): set-up and registration functions whose name holds the wanted one's."""
    signature = F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(([^;{}()]*(?:\([^)]*\)[^;{}()]*)*)\)\s*(?:\{|;)")
    found = F.arrays_zip(F.regexp_extract_all("text", signature, F.lit(1)).alias("name"), F.regexp_extract_all("text", signature, F.lit(2)).alias("params"))
    rows = _asked(files, wanted).select("path", "fn", F.posexplode(found).alias("i", "s")).select("path", "fn", "i", "s.name", F.trim("s.params").alias("params"))
    tokens = identifier_tokens(F.col("name"))
    is_setup, is_register = (F.arrays_overlap(tokens, F.array(*map(F.lit, words))) for words in (SETUP_WORDS, REGISTER_WORDS))
    near = rows.where((F.col("name") != F.col("fn")) & F.lower("name").contains(F.lower("fn")) & (is_setup | is_register))
    once = near.groupBy("path", "fn", "name").agg(F.min_by("params", "i").alias("params"))
    tagged = once.withColumn("relation", F.when(F.arrays_overlap(identifier_tokens(F.col("name")), F.array(*map(F.lit, SETUP_WORDS))), "init").otherwise("register"))
    order = [(F.col("relation") != "init"), F.length("name"), F.col("name")]
    return _numbered(top_k(tagged, ["path", "fn"], order, limit), ["path", "fn"], order)


def failure_indicators(scan: DataFrame, limit: int = 8) -> DataFrame:
    """(path, fn, goto_targets, error_labels, return_checks, error_calls, partial_marks)"""
    all_ = lambda p: F.regexp_extract_all("plain", F.lit(p), F.lit(1))
    targets = all_(r"goto\s+([A-Za-z_][A-Za-z0-9_]*)\s*;")
    checks = F.transform(all_(r"if\s*\(([^\)]{1,120})\)\s*return\s+[^;]+;"), lambda c: F.trim(c))
    calls = F.array_distinct(F.filter(all_(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), lambda c: contains_any(c, "error", "warn", "fail", "invalid")))
    marks = {"equal_null": r"\bif\s*\([^\)]*==\s*(?:NULL|Z_NULL|0)\)", "not_null": r"\bif\s*\([^\)]*!=\s*(?:NULL|Z_NULL|0)\)", "setjmp": r"\bsetjmp\s*\(", "longjmp": r"\blongjmp\s*\(", "warning": r"\bwarning\b", "error": r"\berror\b"}
    partial = F.array_compact(F.array(*(F.when(F.col("plain").rlike(p), F.lit(n)) for n, p in marks.items())))
    return scan.select(
        "path", "fn", F.slice(targets, 1, limit).alias("goto_targets"), F.slice(F.filter(targets, lambda t: contains_any(t, "fail", "error", "cleanup", "end")), 1, limit).alias("error_labels"),
        F.slice(checks, 1, limit).alias("return_checks"), F.slice(calls, 1, limit).alias("error_calls"), partial.alias("partial_marks"),
    )


def guidance_conditions(conditions: DataFrame, roles: DataFrame) -> DataFrame:
    """The conditions worth telling: a control parameter's symbolic equalities if it has any, else those without bounds and plain numbers."""
    from pyspark.sql import Window

    typed = conditions.join(roles.select("path", "fn", F.col("name").alias("parameter"), "role"), ["path", "fn", "parameter"], "left")
    number = F.coalesce("value", F.lit("")).rlike(r"^-?\d+$")
    symbolic = (F.col("type") == "comparison") & F.col("operator").isin("==", "&") & ~number
    some = F.max(symbolic).over(Window.partitionBy("path", "fn", "parameter"))
    plain = (F.col("type") != "comparison") | (~F.col("operator").isin("<", ">", "<=", ">=") & ~number)
    marked = typed.withColumns({"_symbolic": symbolic, "_some": some, "_plain": plain})
    keep = (F.coalesce("role", F.lit("")) != "control") | F.when(F.col("_some"), F.col("_symbolic")).otherwise(F.col("_plain"))
    return marked.where(keep).drop("_symbolic", "_some", "_plain", "role")


def sensitive_controls(roles: DataFrame, conditions: DataFrame, branches: DataFrame, fields_: DataFrame, states: DataFrame, limit: int = 10) -> DataFrame:
    """(path, fn, ord, target, source_kind, score, reasons): controls by the sum of what five kinds of facts say, reasons in that order."""
    from functools import reduce

    key = ["path", "fn"]
    internal = lambda c: c.contains("->") | c.contains(".")
    kind = lambda c: F.when(internal(c), "field").otherwise("parameter")

    def branch(i: int, df: DataFrame, target: Column, kind_: Column, points: Column, reason: Column, order: Column) -> DataFrame:
        return df.select(*key, target.alias("target"), kind_.alias("source_kind"), points.cast("int").alias("points"), reason.alias("reason"), F.lit(i).alias("b"), F.to_json(F.struct(order.alias("o"))).alias("o"))

    role_of = roles.select(*key, F.col("name").alias("parameter"), "role")
    useful = conditions.join(role_of, [*key, "parameter"], "left").where(
        internal(F.col("parameter")) | (F.col("type") != "comparison") | ~(F.coalesce("role", F.lit("")).isin("input-buffer", "output-buffer", "size", "support-buffer") & is_null_like(F.col("value")))
    )
    parts = [
        branch(0, roles.where("role = 'control'"), F.col("name"), F.lit("parameter"), F.lit(2), F.lit("exposed as a control-like parameter"), F.col("ord")),
        branch(1, useful, F.col("parameter"), kind(F.col("parameter")), F.when(F.col("type") == "comparison", 3).otherwise(5), F.concat(F.lit("appears in "), "type", F.lit(" logic")), F.col("ord")),
        branch(2, branches, F.col("variable"), kind(F.col("variable")), F.least(F.lit(6), "num_paths"), F.concat(F.lit("controls "), F.col("num_paths").cast("string"), F.lit(" distinct branch paths")), F.col("ord")),
        branch(3, fields_, F.col("target"), F.lit("field"), F.when(F.col("type") == "switch", 4).otherwise(2), F.concat(F.lit("state field participates in "), "type"), F.col("ord")),
        branch(4, states.where("kind = 'control-state'"), F.concat_ws(".", "owner", "field"), F.lit("field"), F.least(F.lit(4), F.col("reads").cast("int")), F.lit("control-state field is read repeatedly"), F.col("ord")),
    ]
    rows = reduce(DataFrame.unionByName, parts)
    grouped = rows.groupBy(*key, "target").agg(
        F.min_by("source_kind", F.struct("b", "o")).alias("source_kind"), F.sum("points").cast("long").alias("score"),
        F.transform(F.array_sort(F.collect_list(F.struct("b", "o", "reason"))), lambda x: x["reason"]).alias("reasons"),
    )
    order = [F.desc("score"), F.col("target")]
    return _numbered(top_k(grouped, key, order, limit), key, order)
