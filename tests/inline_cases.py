"""Small inline inputs of the program-side operators with the rows they must give, written out."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import inline_fixtures as fixtures
from sparkscope.functions import classify, names
from sparkscope.operators import advisory, contract, derive, evidence, facts, graph, lifecycle, retrieval, seeds, validate
from sparkscope.plans import assemble, models
from sparkscope.sources import advisories, build_log, headers, ir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def rows(columns: str, *values: tuple) -> Callable[[Query], Query]:
    """Register a query with the rows it must give; integers are compared as 64-bit ones."""
    listed = ", ".join("(" + ", ".join(map(_literal, v)) + ")" for v in values)
    kinds = [("BIGINT" if type(x) is int else "BOOLEAN" if isinstance(x, bool) else "VARCHAR") for x in values[0]]
    quoted = [f'"{c.strip()}"' for c in columns.split(",")]
    cast = ", ".join(f"CAST({c} AS {k}) AS {c}" for c, k in zip(quoted, kinds, strict=True))

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf: _wide(f(spark, sf).select(*(c.strip() for c in columns.split(","))))
        ORACLES[f.__name__] = f"SELECT {cast} FROM (VALUES {listed}) t({", ".join(quoted)})"
        return f

    return add


def _wide(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t in ("int", "smallint")})


def _facts(spark: SparkSession) -> ir.ProgramFacts:
    return ir.parse_ir(ir.lines_of(spark.createDataFrame([("a.ll", fixtures.IR)], "file string, text string")))


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a.c", fixtures.SOURCE)], "path string, text string")


def _wanted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a.c", "inflate"), ("a.c", "ansi")], "path string, fn string")


def _scan(spark: SparkSession) -> DataFrame:
    return facts.scan_functions(_files(spark), _wanted(spark))


def _commands(spark: SparkSession) -> DataFrame:
    return build_log.parse_build_log(spark.createDataFrame(list(enumerate(fixtures.BUILD_LOG)), "ord int, line string"))


def _names(spark: SparkSession, *n: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in n], "name string")


@rows("name, defined, params", ("set", True, "%struct.S* s"), ("other", True, "%struct.S* s"), ("parse_doc", True, "%struct.S* s, i8* data, i32 mode"), ("target_func", True, "i8* p"), ("func_b", True, "i8* p"), ("helper", False, "i8* a, i32 b"), ("virt", True, "ptr o"))
def ir_functions(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark).functions.withColumn("params", F.array_join(F.transform("params", lambda p: F.concat_ws(" ", p["type"], p["name"])), ", "))


@rows("caller, callee, kind", ("parse_doc", "helper", "direct"), ("parse_doc", "target_func", "indirect"), ("virt", "_ZN4Base3fooEv", "indirect"))
def ir_call_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.call_edges(_facts(spark))


@rows("caller, callee, caller_idx, callee_idx", ("parse_doc", "helper", 1, 0), ("parse_doc", "helper", 2, 1))
def ir_edge_flow(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark)
    return graph.edge_flow(f.call_sites, f.functions, f.fields)


# two data places and one control: 20 + 4; parse 8; one hop -1; two flows 16; two survive 12
@rows("path_id, score, controlled", (1, 59, "0<-1, 1<-2"), (2, 0 - 1 - 2, ""))
def ir_path_flow_score(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark)
    paths = spark.createDataFrame([(1, ["parse_doc", "helper"]), (2, ["unknown", "helper"])], "path_id long, hops array<string>")
    scored = graph.trace_flow(paths, f.functions, graph.edge_flow(f.call_sites, f.functions, f.fields))
    pairs = F.array_sort(F.transform(F.map_entries("controlled"), lambda e: F.concat(e["key"].cast("string"), F.lit("<-"), e["value"].cast("string"))))
    return scored.withColumn("controlled", F.array_join(pairs, ", "))


@rows("path", ("/p/build/inc",), ("/p/sys",))
def build_include_paths(spark: SparkSession, sf: str) -> DataFrame:
    return build_log.include_paths(_commands(spark))


@rows("question, answer", ("link", "bin/tool"), ("shared", "libfoo.so.1"), ("compile", "a.o"), ("root", "/p"))
def build_commands(spark: SparkSession, sf: str) -> DataFrame:
    c = _commands(spark)
    said = lambda q, df, column: df.select(F.lit(q).alias("question"), F.col(column).alias("answer"))
    return (
        said("link", build_log.link_command(c), "output").union(said("shared", build_log.shared_library(c), "output"))
        .union(said("compile", build_log.outputs(build_log.compile_command(c)), "output")).union(said("root", build_log.project_root(c), "root"))
    )


@rows("flag", ("-pthread",), ("-lm",), ("-lz",))
def build_link_flags(spark: SparkSession, sf: str) -> DataFrame:
    return build_log.link_flags(_commands(spark))


@rows("name, params, source", ("foo_open", "const char path, int flags", "declaration"), ("foo_plain", "", "declaration"), ("prose", "", "declaration"))
def header_signatures(spark: SparkSession, sf: str) -> DataFrame:
    h = spark.createDataFrame([("inc/foo.h", fixtures.HEADER), ("inc/foo_priv.h", "int secret(int a);")], "path string, text string")
    found = headers.signatures(h).where("source = 'declaration'")
    return found.withColumn("params", F.array_join(F.transform("params", lambda p: F.concat_ws(" ", p["type"], p["name"])), ", "))


@rows("library, name", ("a.so", "foo_read"), ("b.a", "bar"))
def exported_symbols(spark: SparkSession, sf: str) -> DataFrame:
    listings = spark.createDataFrame(list(fixtures.SYMBOLS), "library string, tool string, text string")
    return headers.library_api(headers.exported_symbols(listings))


@rows("phase, name", ("setup", "inflateInit2_"), ("setup", "inflateInit_"), ("cleanup", "inflateEnd"))
def lifecycle_candidates(spark: SparkSession, sf: str) -> DataFrame:
    public = _names(spark, "inflateInit_", "inflateInit2_", "inflateEnd", "deflateInit_")
    found = lambda p: lifecycle.lifecycle_candidates("inflate", public, p).select(F.lit(p).alias("phase"), "name")
    return found("setup").union(found("cleanup")).union(found("update"))


@rows("fn, ord, name, type, role", ("inflate", 0, "strm", "struct z *", "state"), ("inflate", 1, "flush", "int", "control"), ("ansi", 0, "name", "const char *", "input-buffer"), ("ansi", 1, "mode", "int", "control"), ("ansi", 2, "out", "char **", "output-buffer"), ("ansi", 3, "len", "size_t", "size"))
def source_parameter_roles(spark: SparkSession, sf: str) -> DataFrame:
    return facts.parameter_roles(_scan(spark))


@rows("fn, ord, name, phase", ("inflate", 0, "inflateGetHeader", "other"), ("inflate", 1, "updatewindow", "update"), ("ansi", 0, "parse_rows", "consume"))
def source_helper_calls(spark: SparkSession, sf: str) -> DataFrame:
    # the scan starts up to five lines before a definition, so a declaration there counts as well
    return facts.helper_calls(_scan(spark)).where("fn = 'inflate' or name = 'parse_rows'").withColumn("ord", F.when(F.col("name") == "parse_rows", 0).otherwise(F.col("ord")))


@rows("owner, field, reads, kind", ("strm", "avail_in", 2, "size-state"), ("head", "extra", 1, "state"), ("head", "extra_max", 1, "state"), ("state", "mode", 1, "control-state"), ("strm", "state", 1, "control-state"))
def source_state_fields(spark: SparkSession, sf: str) -> DataFrame:
    return facts.state_fields(_scan(spark).where("fn = 'inflate'"))


@rows("ord, target, operator, value, type", (0, "strm->state", "==", "Z_NULL", "comparison"), (1, "strm->avail_in", ">", "0", "comparison"), (2, "head->extra", "!=", "Z_NULL", "comparison"), (3, "state->mode", None, None, "switch"))
def source_field_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return facts.field_conditions(_scan(spark).where("fn = 'inflate'"))


@rows("parameter, operator, value, type", ("strm", "==", "Z_NULL", "comparison"), ("flush", "==", "Z_FINISH", "comparison"), ("state->mode", None, None, "switch"))
def source_parameter_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return facts.parameter_conditions(_scan(spark).where("fn = 'inflate'"))


@rows("variable, cases, has_default, num_paths", ("state->mode", "HEAD", True, 2))
def source_switch_branches(spark: SparkSession, sf: str) -> DataFrame:
    return facts.switch_branches(_scan(spark)).withColumn("cases", F.array_join("cases", ","))


@rows("kind, name, value", ("define", "MAX_MODE", "4"), ("enum", "FLAG_A", "1"), ("enum", "FLAG_B", "auto"))
def source_constants(spark: SparkSession, sf: str) -> DataFrame:
    return facts.constants(_files(spark))


@rows("fn, name, relation", ("inflate", "inflateGetHeader", "register"))
def source_related_functions(spark: SparkSession, sf: str) -> DataFrame:
    return facts.related_functions(_files(spark), _wanted(spark))


@rows("ord, target, score, importance", (0, "head->extra", 8, "high"), (1, "strm->state", 5, "medium"))
def contract_predicates(spark: SparkSession, sf: str) -> DataFrame:
    return contract.activation_predicates(facts.field_conditions(_scan(spark)))


@rows("name, fields", ("head", "extra, extra_max"))
def contract_support_objects(spark: SparkSession, sf: str) -> DataFrame:
    s = _scan(spark)
    found = contract.support_objects(contract.activation_predicates(facts.field_conditions(s)), facts.state_fields(s))
    return found.withColumn("fields", F.array_join("required_fields", ", "))


@rows("fn, primary, operators", ("inflate", "semantic-arguments", "chunked-stream,control-biased"), ("ansi", "structured-format", "control-biased"))
def function_models(spark: SparkSession, sf: str) -> DataFrame:
    # the lines before ansi that belong to its scan compare two bytes of a buffer
    done = models.workload_model(models.input_model(models.profile(_scan(spark))))
    return done.withColumn("operators", F.array_join("operators", ","))


@rows("fn, kind, controller, dependent", ("inflate", "boundary-value", "flush", "Z_FINISH"), ("inflate", "boundary-value", "strm", "Z_NULL"), ("ansi", "boundary-value", "len", "(1 << mode)"), ("ansi", "derived-bound", "mode", "len"))
def trigger_relations(spark: SparkSession, sf: str) -> DataFrame:
    return models.trigger_relations(_scan(spark))


@rows("stage, field, items", ("entry", "setup_call", "pngInit"), ("transform", "setup_call", "set_palette"), ("parse", "milestone", "m"), ("parse", "predicate", "head->x"))
def stage_contracts(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.createDataFrame([("k", "setup_call", 0, "pngInit", None), ("k", "setup_call", 1, "set_palette", None), ("k", "milestone", 0, "m", "container-parse"), ("k", "predicate", 0, "head->x", None)], "k string, field string, ord int, text string, kind string")
    return assemble.stage_contracts(items, ["k"], models.path_traits(F.array(F.lit("png_read_row"), F.lit("png_push")))).withColumn("items", F.array_join("items", ","))


def _candidates(spark: SparkSession) -> DataFrame:
    relation = ("setup-state-bound-hypothesis", "state", "num_rows", "", "high")
    plan = {"roles": [("state", "state")], "operators": ["chunked-stream"], "primary": "structured-format", "container_synthesis": True, "controls": 1, "relations": [relation]}
    fields = [x.split()[0] for x in validate.PLAN.split(", ")]
    row = lambda i, code, **p: (i, code, *({**dict.fromkeys(fields), **plan, **p}[f] for f in fields))
    data = [row(0, fixtures.RAW_CODE, entry="feed_it", setup_candidates=["feedInit_"]), row(1, fixtures.SHAPED_CODE, entry="parse_it", setup_candidates=["set_header"])]
    return spark.createDataFrame(data, f"id long, code string, {validate.PLAN}")


@rows(
    "id, rule, penalty, critical", (0, "MISSING_STATE_SETUP", 25, False), (0, "MISSING_CHUNKED_STREAM_LOOP", 20, False), (0, "RAW_BUFFER_STRUCTURED_INPUT", 20, False), (0, "MISSING_CONTAINER_SYNTHESIS", 25, False),
    (0, "RAW_PASSTHROUGH_STAGED_INPUT", 25, False), (0, "MISSING_SELECTOR_LOGIC", 8, False), (0, "TRIGGER_RELATION_MISS", 18, False), (0, "SETJMP_ABORT_CONFLICT", 20, True),
)
def validation_findings(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validate(_candidates(spark), ["id"])


@rows("id, ok, score, relations_ok", (0, False, 0, 0), (1, True, 100, 1))
def candidate_reports(spark: SparkSession, sf: str) -> DataFrame:
    return validate.reports(_candidates(spark), ["id"])


@rows("function, placement, score, registers", ("row_callback", "post-parse-callback", 15, False), ("set_read_fn", "post-parse-callback", 11, True))
def stage_evidence(spark: SparkSession, sf: str) -> DataFrame:
    text = "static void row_callback(int a)\n{\n  png_set_quantize(info_ptr);\n}\nvoid set_read_fn(int a) {\n  p->read_fn = a;\n  p->row_fn = 0;\n  png_set_quantize(a);\n}\n"
    files = spark.createDataFrame([("src/a.c", text)], "path string, text string")
    token = lambda t: F.array(F.lit(t))
    return retrieval.stage_evidence(files, facts.function_blocks(files), _names(spark, "png_set_quantize"), token("png"), token("quantize"), token("palette"), token("row"))


@rows("sub_no, score", (1, "17.0"), (2, "-8.0"))
def patch_scores(spark: SparkSession, sf: str) -> DataFrame:
    lines = advisory.patch_lines(spark.createDataFrame([(1, fixtures.PATCH)], "id int, text string"), ["id"], "text")
    return advisory.score_sub_patches(lines, ["id"]).withColumn("score", F.col("score").cast("string"))


@rows("removed, added, functions", ("old = 1 << n;", "if (n > 0x100) return;", "foo_bar"))
def patch_changes(spark: SparkSession, sf: str) -> DataFrame:
    got = derive.changes(spark.createDataFrame([("a", 0, fixtures.PATCH)], "cve_id string, patch_no int, text string"))
    return got.withColumns({c: F.array_join(c, ";;") for c in ("removed", "added", "functions")})


@rows("id, value", (0, "doContent"), (1, "png_read"), (2, "foo_bar"), (3, "tick_me"))
def advisory_functions(spark: SparkSession, sf: str) -> DataFrame:
    texts = ["An issue in the doContent function in xmlparse.c", "crash via png_read at pngread.c", "overflow in tiff_jpeg.c in foo_bar, remote", "`tick_me()` and other()", "nothing"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    return advisory.function_from_text(frame, "id", "t", _names(spark, "other"))


@rows("cve_id, value, step", ("a", "foo_bar", 0), ("b", "c_func", 1), ("c", "from_outside", 5))
def affected_functions(spark: SparkSession, sf: str) -> DataFrame:
    patches = spark.createDataFrame([("a", 0, fixtures.PATCH)], "cve_id string, patch_no int, text string")
    texts = spark.createDataFrame([("a", 0, "Overflow in foo_bar"), ("b", 0, "crash in the c_func function")], "cve_id string, rank int, text string")
    empty = lambda s: spark.createDataFrame([], s)
    override = spark.createDataFrame([("c", "from_outside")], "cve_id string, value string")
    return derive.affected_function(texts, patches, empty("cve_id string, file string"), empty("cve_id string, place int, text string"), _names(spark, "nothing"), empty("name string"), override)


@rows("id, name", (1, "foo"), (1, "baz"))
def error_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    text = "error: use of undeclared identifier 'foo'; did you mean 'bar'?\nundefined reference to `baz'"
    return spark.createDataFrame([(1, text)], "id long, t string").select("id", F.explode(evidence.error_identifiers(F.col("t"))).alias("name"))


@rows("place, token", (0, '"0x100"'), (1, r'"\x00\x01"'), (2, r'"\x00\x01\x00\x00"'), (3, r'"\x00\x01\x00\x00\x00\x00\x00\x00"'), (4, '"GIF"'))
def seed_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    frame = spark.createDataFrame([('s = "GIF";', fixtures.PATCH)], "s string, d string")
    return frame.select(F.posexplode(seeds.dictionary_tokens(F.col("s"), F.col("d"))).alias("place", "token"))


@rows("text, value", ("Z_FINISH) && x", "Z_FINISH"), ("a[3] || b", "a[3]"), ("f(x));", "f(x)"))
def condition_values(spark: SparkSession, sf: str) -> DataFrame:
    frame = spark.createDataFrame([("Z_FINISH) && x",), ("a[3] || b",), ("f(x));",)], "text string")
    return frame.withColumn("value", names.condition_value(F.col("text")))


@rows("rule, broken, kept", *((rule, 1, 0) for rule, *_ in fixtures.RULE_CASES))
def validation_rule_cases(spark: SparkSession, sf: str) -> DataFrame:
    """How often each rule fires on a text that breaks it, and on one that keeps it."""
    fields = [x.split()[0] for x in validate.PLAN.split(", ")]
    cases = [
        (rule, kind, code, *({"entry": "feed_it", **plan}.get(f) for f in fields))
        for rule, plan, broken, kept in fixtures.RULE_CASES
        for kind, code in (("broken", broken), ("kept", kept))
    ]
    found = validate.validate(spark.createDataFrame(cases, f"wanted string, kind string, code string, {validate.PLAN}"), ["wanted", "kind"]).where("rule = wanted")
    fired = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    return found.groupBy(F.col("wanted").alias("rule")).agg(fired("broken"), fired("kept"))


def _answers(spark: SparkSession, *answers: tuple) -> DataFrame:
    return spark.createDataFrame([(c, j if isinstance(j, str) else json.dumps(j)) for c, j in answers], "cve_id string, json string")


def _united(spark: SparkSession) -> DataFrame:
    nvd = advisories.nvd(_answers(spark, ("a", fixtures.NVD), ("b", "broken"), ("c", {"vulnerabilities": []})))
    github = advisories.github(_answers(spark, ("a", [{"summary": "gs", "severity": "high"}]), ("b", [])))
    return advisories.united(nvd, advisories.osv(_answers(spark, ("a", fixtures.OSV))), github)


@rows("cve_id, description, vector, cwe, n_refs", ("a", "An overflow in the doContent function in xmlparse.c", "v3", "CWE-787", 3))
def advisory_records(spark: SparkSession, sf: str) -> DataFrame:
    found = advisories.nvd(_answers(spark, ("a", fixtures.NVD), ("b", "broken"), ("c", {"vulnerabilities": []})))
    return found.select("cve_id", "description", F.col("cvss_vector").alias("vector"), F.array_join("cwe_ids", ",").alias("cwe"), F.size("refs").cast("long").alias("n_refs"))


@rows("cve_id, repo, commit", ("a", "https://github.com/o/r.git", "abcdef1234"))
def advisory_fixes(spark: SparkSession, sf: str) -> DataFrame:
    return advisories.osv(_answers(spark, ("a", fixtures.OSV))).select("cve_id", F.explode("fixes").alias("f")).select("cve_id", F.col("f.repo").alias("repo"), F.col("f.commit").alias("commit"))


@rows("cve_id, severity", ("a", "high"))
def advisory_severity(spark: SparkSession, sf: str) -> DataFrame:
    return advisories.github(_answers(spark, ("a", [{"summary": "gs", "severity": "high"}]), ("b", []))).select("cve_id", "severity")


@rows("url, kind", ("https://github.com/o/r/commit/abcdef1234", "commit"), ("https://github.com/o/r/commit/1234567", "commit"), ("https://github.com/o/r/pull/7", "pull"))
def advisory_patch_urls(spark: SparkSession, sf: str) -> DataFrame:
    return advisories.patch_urls(_united(spark))


@rows("patch_no, text", (0, "first"), (1, "second"))
def advisory_patches(spark: SparkSession, sf: str) -> DataFrame:
    recorded = spark.createDataFrame([("https://github.com/o/r/pull/7", "second"), ("https://github.com/o/r/commit/1234567", "first"), ("https://github.com/o/r/commit/abcdef1234", "")], "url string, text string")
    return advisories.fix_patches(advisories.patch_urls(_united(spark)), recorded)


@rows("message", ("one\nbody",))
def commit_messages(spark: SparkSession, sf: str) -> DataFrame:
    text = "From 0123456789012345678901234567890123456789 x\nSubject: [PATCH] one\nbody\n---\n file | 2\n"
    return derive.commit_messages(spark.createDataFrame([("a", 0, text)], "cve_id string, patch_no int, text string")).select("message")


@rows("hash", ("1234567aaaaaa",))
def earliest_fix(spark: SparkSession, sf: str) -> DataFrame:
    commits = spark.createDataFrame([("abcdef1234567", 5), ("1234567aaaaaa", 3), ("fffffffffffff", 1)], "hash string, time int")
    fixes = spark.createDataFrame([("git@github.com:o/r.git", "abcdef1"), ("https://github.com/o/r", "1234567"), ("https://github.com/x/y", "fffffff")], "repo string, commit string")
    return derive.earliest_fix(commits, fixes, F.lit("https://github.com/O/r/")).select("hash")


@rows("id, rules", (1, "use_real_objects,vary_constants"), (2, "rewrite"))
def repair_rules(spark: SparkSession, sf: str) -> DataFrame:
    said = spark.createDataFrame([(1, "keeps palette constant"), (1, "null placeholders"), (2, "odd")], "id int, text string")
    return derive.repair_rules(said, ["id"]).select("id", F.array_join("rules", ",").alias("rules"))


@rows("library, flag", ("tiff", "-lz"), ("tiff", "-ljpeg"))
def extra_libraries(spark: SparkSession, sf: str) -> DataFrame:
    undefined = [("tiff", "inflateInit_"), ("tiff", "gzread"), ("tiff", "jpeg_start"), ("zlib", "deflateInit_"), ("png16", "png_x")]
    return build_log.extra_libraries(spark.createDataFrame(undefined, "library string, symbol string")).select("library", "flag")


@rows("path", ("/p/libfo.so",))
def library_to_link(spark: SparkSession, sf: str) -> DataFrame:
    return build_log.find_library(spark.createDataFrame([("/p/sub/.libs/libfoo.a",), ("/p/libfoo_util.so",), ("/p/libfo.so",)], "path string"), "/p")


@rows("text, code", ("```python\nx = 1\n```", "x = 1"), ('{"code": "int x;"}', "int x;"), ("int y;", "int y;"))
def unwrapped_texts(spark: SparkSession, sf: str) -> DataFrame:
    frame = spark.createDataFrame([("```python\nx = 1\n```",), ('{"code": "int x;"}',), ("int y;",)], "text string")
    return frame.withColumn("code", names.unwrapped_code(names.without_fence(F.col("text"))))


@rows("k, name", ("a", "*a"), ("a", "b"), ("b", "mode"), ("c", "mode"))
def chosen_roles(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda *r: spark.createDataFrame(list(r), "k string, name string, role string")
    signature = side(("a", "*a", "size"), ("a", "b", "size"), ("b", "x", "value"), ("c", "mode", "control"))
    context = side(("a", "a", "state"), ("a", "b", "control"), ("b", "mode", "control"), ("c", "x", "value"))
    return lifecycle.choose_roles(signature, context, spark.createDataFrame([(k, "mode") for k in "abc"], "k string, name string"), ["k"]).select("k", "name")


def _roles(spark: SparkSession) -> DataFrame:
    given = [("n", "size"), ("m", "size"), ("t", "support-buffer"), ("u", "support-buffer"), ("s", "state")]
    return spark.createDataFrame([("k", i, n, r) for i, (n, r) in enumerate(given)], "k string, ord int, name string, role string")


@rows("name, role", ("n", "control"), ("m", "size"), ("t", "support-buffer"), ("u", "support-buffer"), ("s", "state"), ("z", "value"))
def merged_roles(spark: SparkSession, sf: str) -> DataFrame:
    given = spark.createDataFrame([("k", "N", "control"), ("k", "z", "value")], "k string, name string, role string")
    return assemble.merge_roles(_roles(spark), given, ["k"])


@rows("controller, dependent", ("n", "t"), ("n", "u"), ("m", "t"))
def signature_relations(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.signature_relations(_roles(spark), ["k"], 3)


@rows("controller, dependent", ("s", "n"), ("s", "m"))
def setup_state_relations(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.setup_state_relations(_roles(spark), ["k"])


def _items(spark: SparkSession) -> DataFrame:
    given = [("setup_call", 0, "pngInit", None), ("setup_call", 1, "set_palette", None), ("milestone", 0, "m", "container-parse"), ("predicate", 0, "head->x", None)]
    return spark.createDataFrame([("k", *x) for x in given], "k string, field string, ord int, text string, kind string")


@rows("text", ("pngInit",), ("m",), ("head->x",))
def pruned_items(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.prune_dropped(_items(spark), spark.createDataFrame([("k", "Palette")], "k string, name string"), ["k"], F.col("text"))


@rows("text", ("set_palette",))
def anchored_items(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.anchored_items(_items(spark), spark.createDataFrame([("k", "palette"), ("k", "init")], "k string, token string"), ["k"], F.col("text"), ("init",))


@rows("name", ("png_a",), ("png_b",))
def selected_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.selected_signatures(_names(spark, "png_a", "png_b", "pnx_c", "zip"), _names(spark, "png_a"), _names(spark, "q"), 1)


@rows("entry, sink, hops, score", ("api", "ansi", "api,ansi", 12))
def plan_records(spark: SparkSession, sf: str) -> DataFrame:
    path = spark.createDataFrame([("ansi", "api", ["api", "ansi"], 12)], "fn string, entry string, hops array<string>, score int")
    plan = assemble.plan_record(models.analyse(_scan(spark)).where("fn = 'ansi'"), path)
    of = lambda key: F.get_json_object("plan", f"$.{key}")
    hops = F.array_join(F.from_json(of("call_path"), "array<string>"), ",")
    return plan.select(of("entry_function").alias("entry"), of("sink_function").alias("sink"), hops.alias("hops"), of("path_score").cast("long").alias("score"))


@rows("name, kind, role", ("num_rows", "int", "size"), ("mode", "int", "control"), ("info_ptr", "void", "state"), ("out", "char **", "output-buffer"))
def signature_roles(spark: SparkSession, sf: str) -> DataFrame:
    frame = spark.createDataFrame([("num_rows", "int"), ("mode", "int"), ("info_ptr", "void"), ("out", "char **")], "name string, kind string")
    return frame.withColumn("role", classify.signature_role(F.col("name"), F.col("kind")))
