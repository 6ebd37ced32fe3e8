"""Recorded run logs: stack symbols, evidence classes, compile diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What ends the crash stack in a sanitizer log, a stack frame, and the file name of generated code.
STACK_END = r"(?m)^\s*(?:allocated by|freed by|previously allocated by|Thread T\d|SUMMARY:|==\d+==ABORTING)"
FRAME = r"#\d+\s+[^\n]*?in\s+([A-Za-z_][A-Za-z0-9_:]*)"
GENERATED = "/fuzzer.cc:"
# Compiler and linker phrases that name an identifier, in order of precedence.
DIAGNOSTICS = (
    r"use of undeclared identifier '([A-Za-z_][A-Za-z0-9_]*)'",
    r"unknown type name '([A-Za-z_][A-Za-z0-9_]*)'",
    r"no member named '([A-Za-z_][A-Za-z0-9_]*)'",
    r"'([A-Za-z_][A-Za-z0-9_]*)' was not declared in this scope",
    r"no matching function for call to '([A-Za-z_][A-Za-z0-9_]*)'",
    r"undefined reference to `([A-Za-z_][A-Za-z0-9_]*)'",
)
DID_YOU_MEAN = r"use of undeclared identifier '([^']+)';\s*did you mean '([^']+)'\?"


def stack_symbols(output: Column) -> Column:
    """Function names of the first stack only; what was allocated or freed elsewhere does not count."""
    crash = F.element_at(F.split(F.coalesce(output, F.lit("")), STACK_END, 2), 1)
    return F.regexp_extract_all(crash, F.lit(FRAME), F.lit(1))


def classify_runs(logs: DataFrame, sink: Column, entry: Column, path: Column, output: str = "output", returncode: str = "returncode") -> DataFrame:
    """``logs`` with classification, score, stack_symbols and rationale of each run.

    Order of classes: the sink (100), one of the last three functions of the
    path (80), the entry (50), any function of the path (40), a crash elsewhere
    (5), no crash (15). Unless the sink or its neighbours were reached, a stack
    in generated code makes it a fault of the set-up (10 at most).
    """
    text = F.coalesce(F.col(output), F.lit(""))
    stack = F.col("_stack")
    generated = text.contains(GENERATED)
    silent = generated & (F.size(stack) == 0)
    near = F.filter(F.slice(path, F.greatest(F.size(path) - 2, F.lit(1)), 3), lambda f: F.array_contains(stack, f))
    hit = F.filter(path, lambda f: F.array_contains(stack, f))
    base = (
        F.when(~silent & F.array_contains(stack, sink), "sink-hit")
        .when(~silent & (F.size(near) > 0), "sink-adjacent")
        .when(~silent & F.array_contains(stack, entry), "entry-reached")
        .when(~silent & (F.size(hit) > 0), "path-reached")
        .when(F.col(returncode) != 0, "harness-or-setup-fault")
        .otherwise("smoke-only")
    )
    start = F.when(F.col(returncode) != 0, 5).otherwise(15)
    score = F.when(F.col("_base") == "sink-hit", 100).when(F.col("_base") == "sink-adjacent", 80).when(F.col("_base") == "entry-reached", 50).when(F.col("_base") == "path-reached", 40).otherwise(start)
    fault = generated & ~F.col("_base").isin("sink-hit", "sink-adjacent")
    said = lambda text, names: F.concat(F.lit(text), F.array_join(names, ", "))
    why = F.array_compact(F.array(
        F.when(F.col(returncode) != 0, "the runtime probe crashed"),
        F.when(F.col("_base") == "sink-hit", F.concat(F.lit("the crash stack reached the selected sink function "), sink))
        .when(F.col("_base") == "sink-adjacent", said("the stack reached sink-adjacent path functions ", near))
        .when(F.col("_base") == "entry-reached", F.concat(F.lit("the stack reached the selected public entry function "), entry))
        .when(F.col("_base") == "path-reached", said("the stack reached part of the wrapper path ", F.slice(hit, 1, 4))),
        F.when(fault, "the stack points primarily into generated harness code rather than the target path"),
    ))
    return (
        logs.withColumn("_stack", stack_symbols(F.col(output)))
        .withColumn("_base", base)
        .withColumns({
            "classification": F.when(fault, "harness-or-setup-fault").otherwise(F.col("_base")),
            "score": F.when(fault, F.least(score, F.lit(10))).otherwise(score),
            "stack_symbols": F.slice(stack, 1, 16),
            "rationale": why,
        })
        .drop("_stack", "_base")
    )


def error_identifiers(text: Column) -> Column:
    """Identifiers that diagnostics name, each once, in order of phrase and place."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in DIAGNOSTICS)))


def suggestions(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, wrong, right): the first suggestion for each wrong name."""
    pairs = F.arrays_zip(*(F.regexp_extract_all(F.col(text_col), F.lit(DID_YOU_MEAN), F.lit(i)).alias(n) for i, n in ((1, "wrong"), (2, "right"))))
    rows = texts.select(id_col, F.posexplode(pairs).alias("at", "p"))
    return rows.groupBy(id_col, F.col("p.wrong").alias("wrong")).agg(F.min_by("p.right", "at").alias("right"))
