"""Queries of the program-side operators over texts rendered from the given tables, with SQL over the same tables.

Each row of ``part`` or ``supplier`` gives IR, source, log lines, patches or
answers of its own; ``<<k>>`` and the like are numbers of that row. Small inline
inputs with written-out results are tests (``tests/inline_cases.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope import templates
from sparkscope.functions import classify, names
from sparkscope.operators import advisory, contract, derive, evidence, facts, graph, lifecycle, retrieval, seeds, validate
from sparkscope.plans import assemble, models
from sparkscope.rendered import PART, SUPPLIER, Base, Query, Sql, When
from sparkscope.session import materialise, shared_dir, table
from sparkscope.sources import advisories, build_log, headers, ir, recorded

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    """Register a query with SQL for its rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf: _wide(f(spark, sf))
        ORACLES[f.__name__] = oracle
        return f

    return add


def per(base: Base, columns: str, *values: Sequence[object]):
    """Register a query that gives ``values`` for each row of a table; only the named columns are compared."""
    listed = [c.strip() for c in columns.split(",")]

    def add(f: Query) -> Query:
        query(base.oracle(listed, *values))(f)
        QUERIES[f.__name__] = lambda spark, sf: _wide(f(spark, sf).select(*listed))
        return f

    return add


def _wide(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t in ("int", "smallint")})


def _joined(params: str = "params") -> Column:
    return F.array_join(F.transform(params, lambda p: F.concat_ws(" ", p["type"], p["name"])), ", ")


# Compiler IR: one linked file of all parts.


def _facts(spark: SparkSession, sf: str) -> ir.ProgramFacts:
    text = PART.table(spark, sf).select("p_partkey", PART.filled(templates.IR).alias("text"))
    lines = text.select(F.lit("linked.ll").alias("file"), "p_partkey", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return ir.parse_ir(lines.select("file", (F.col("p_partkey") * 64 + F.col("i") + 1).alias("line_no"), "text"))


@per(
    PART, "name, defined, params", ("set<<k>>", True, "%struct.S<<k>>* s"), ("other<<k>>", True, "%struct.S<<k>>* s"), ("parse_doc<<k>>", True, "%struct.S<<k>>* s, i8* data, i32 mode"),
    ("target<<k>>", True, "i8* p"), ("func<<k>>", True, "i8* p"), ("helper<<k>>", False, "i8* a, i32 b"), ("virt<<k>>", True, "ptr o"),
)
def ir_functions(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).functions.withColumn("params", _joined())


# a caller loads one of four fields; two setters fill one each
@per(
    PART, "caller, callee, kind", ("parse_doc<<k>>", "helper<<k>>", "direct"), ("parse_doc<<k>>", "target<<k>>", "indirect", When("p_partkey % 4 = p_size % 4")), ("parse_doc<<k>>", "func<<k>>", "indirect", When("p_partkey % 4 = (p_size + 1) % 4")),
    ("virt<<k>>", "_ZN4Base3fooEv", "indirect", When("p_size % 2 = 0")), ("virt<<k>>", "_ZN4Base3barEv", "indirect", When("p_size % 2 = 1")),
)
def ir_call_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.call_edges(_facts(spark, sf))


@per(PART, "caller, callee, caller_idx, callee_idx", ("parse_doc<<k>>", "helper<<k>>", 1, 0), ("parse_doc<<k>>", "helper<<k>>", 2, 1))
def ir_edge_flow(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf)
    return graph.edge_flow(f.call_sites, f.functions, f.fields)


# two data places and one control: 20 + 4; parse 8; one hop -1; two flows 16; two survive 12
@per(PART, "path_id, score, controlled", (Sql("2 * p_partkey"), 59, "0<-1, 1<-2"), (Sql("2 * p_partkey + 1"), 0 - 1 - 2, ""))
def ir_path_flow_score(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf)
    paths = PART.rows(spark, sf, "path_id long, hops array<string>", (Sql("2 * p_partkey"), ["parse_doc<<k>>", "helper<<k>>"]), (Sql("2 * p_partkey + 1"), ["unknown<<k>>", "helper<<k>>"]))
    scored = graph.trace_flow(paths, f.functions, graph.edge_flow(f.call_sites, f.functions, f.fields))
    pairs = F.array_sort(F.transform(F.map_entries("controlled"), lambda e: F.concat(e["key"].cast("string"), F.lit("<-"), e["value"].cast("string"))))
    return scored.withColumn("controlled", F.array_join(pairs, ", "))


# Build logs, headers and symbols.


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    lines = [(Sql(f"p_partkey * 8 + {i}"), line) for i, line in enumerate(templates.BUILD_LOG)]
    return build_log.parse_build_log(PART.rows(spark, sf, "ord int, line string", *lines))


@query("SELECT DISTINCT '/p/build/inc' || p_size % 4 AS path FROM part UNION ALL SELECT DISTINCT '/p/sys' || p_partkey % 4 FROM part")
def build_include_paths(spark: SparkSession, sf: str) -> DataFrame:
    return build_log.include_paths(_commands(spark, sf)).select("path")


@query("""WITH last AS (SELECT max(p_partkey) AS k FROM part), short AS (SELECT p_partkey AS k FROM part ORDER BY length(CAST(p_partkey AS VARCHAR)), p_partkey DESC LIMIT 1)
SELECT 'link' AS question, 'bin/tool' || k AS answer FROM last UNION ALL SELECT 'shared', 'libfoo' || k || '.so.1' FROM short UNION ALL SELECT 'compile', 'a' || k || '.o' FROM last UNION ALL SELECT 'root', '/p' FROM last""")
def build_commands(spark: SparkSession, sf: str) -> DataFrame:
    c = _commands(spark, sf)
    said = lambda q, df, column: df.select(F.lit(q).alias("question"), F.col(column).alias("answer"))
    return (
        said("link", build_log.link_command(c), "output").union(said("shared", build_log.shared_library(c), "output"))
        .union(said("compile", build_log.outputs(build_log.compile_command(c)), "output")).union(said("root", build_log.project_root(c), "root"))
    )


@query("SELECT DISTINCT '-lz' || p_size % 4 AS flag FROM part UNION ALL SELECT DISTINCT unnest(['-pthread', '-lm']) FROM part")
def build_link_flags(spark: SparkSession, sf: str) -> DataFrame:
    return build_log.link_flags(_commands(spark, sf)).select("flag")


@per(PART, "name, params, source", ("foo<<k>>_open", "const char path, int flags<<a>>", "declaration"), ("foo<<k>>_plain", "", "declaration"), ("prose<<k>>", "", "declaration"))
def header_signatures(spark: SparkSession, sf: str) -> DataFrame:
    h = PART.rows(spark, sf, "path string, text string", ("inc/foo<<k>>.h", templates.HEADER), ("inc/foo_priv.h", "int secret<<k>>(int a);"))
    return headers.signatures(h).where("source = 'declaration'").withColumn("params", _joined())


@per(PART, "library, name", ("a<<k>>.so", "foo<<s>>_read"), ("b<<k>>.a", "bar<<s>>"))
def exported_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return headers.library_api(headers.exported_symbols(PART.rows(spark, sf, "library string, tool string, text string", *templates.SYMBOLS)))


@query("""WITH names AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w, p_size % 2 AS even, p_size % 5 AS five FROM part), api AS (SELECT min(w) AS w FROM names)
SELECT 'setup' AS phase, w || CASE WHEN even = 0 THEN 'Init' ELSE 'Create' END AS name FROM names JOIN api USING (w) GROUP BY ALL
UNION ALL SELECT 'cleanup', w || 'End' FROM names JOIN api USING (w) WHERE five = 0 GROUP BY ALL
UNION ALL SELECT 'update', 'pre' || w || 'Push' FROM names JOIN api USING (w) WHERE five = 1 GROUP BY ALL""")
def lifecycle_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Of all names the ones of the least word's family; without one of a phase, those that hold the word."""
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    forms = F.array(F.concat(word, F.when(F.col("p_size") % 2 == 0, "Init").otherwise("Create")), F.when(F.col("p_size") % 5 == 0, F.concat(word, F.lit("End"))), F.when(F.col("p_size") % 5 == 1, F.concat(F.lit("pre"), word, F.lit("Push"))))
    part = table(spark, sf, "part")
    public = part.select(F.explode(F.array_compact(forms)).alias("name")).distinct()
    api = part.agg(F.min(word)).first()[0] or "none"
    found = lambda p: lifecycle.lifecycle_candidates(api, public, p).select(F.lit(p).alias("phase"), "name")
    return found("setup").union(found("cleanup")).union(found("update"))


@query("SELECT DISTINCT 'tiff' || p_partkey AS library, '-lz' AS flag FROM part UNION ALL SELECT 'tiff' || p_partkey, '-ljpeg' FROM part WHERE p_size % 4 = 1")
def extra_libraries(spark: SparkSession, sf: str) -> DataFrame:
    undefined = PART.rows(spark, sf, "library string, symbol string", ("tiff<<k>>", "inflateInit_"), ("tiff<<k>>", "gzread<<s>>"), ("tiff<<k>>", "jpeg_start<<s>>", When("p_size % 4 = 1")), ("zlib<<k>>", "deflateInit_"), ("png16<<k>>", "png_x"))
    return build_log.extra_libraries(undefined).select("library", "flag")


@query("SELECT '/p/libfo' || p_partkey || '.so' AS path FROM part ORDER BY length(path), path LIMIT 1")
def library_to_link(spark: SparkSession, sf: str) -> DataFrame:
    files = PART.rows(spark, sf, "path string", ("/p/sub/.libs/libf<<k>>.a",), ("/p/libfoo_util<<k>>.so",), ("/p/libfo<<k>>.so",), ("/q/libf<<k>>.a",))
    return build_log.find_library(files, "/p").select("path")


# C source: one file a part, with two functions.


def _files(spark: SparkSession, sf: str, base: Base = PART) -> DataFrame:
    return base.rows(spark, sf, "path string, text string", ("p<<k>>.c", templates.SOURCE))


def _wanted(spark: SparkSession, sf: str, base: Base = PART) -> DataFrame:
    return base.rows(spark, sf, "path string, fn string", ("p<<k>>.c", "inflate"), ("p<<k>>.c", "ansi"))


def _scan(spark: SparkSession, sf: str, base: Base = PART) -> DataFrame:
    return facts.scan_functions(_files(spark, sf, base), _wanted(spark, sf, base))


FILE = "p<<k>>.c"


@per(
    PART, "path, fn, ord, name, type, role", (FILE, "inflate", 0, "strm", "struct z<<a>> *", "state"), (FILE, "inflate", 1, "flush", "int", "control"), (FILE, "ansi", 0, "name", "const char *", "input-buffer"),
    (FILE, "ansi", 1, "mode", "int", "control"), (FILE, "ansi", 2, "out", "char **", "output-buffer"), (FILE, "ansi", 3, "len", "size_t", "size"),
)
def source_parameter_roles(spark: SparkSession, sf: str) -> DataFrame:
    return facts.parameter_roles(_scan(spark, sf))


@per(PART, "path, fn, name, phase", (FILE, "inflate", "inflateGetHeader", "other"), (FILE, "inflate", "updatewindow<<s>>", "update"), (FILE, "ansi", "parse_rows", "consume"))
def source_helper_calls(spark: SparkSession, sf: str) -> DataFrame:
    # the scan starts up to five lines before a definition, so what stands there counts as well
    return facts.helper_calls(_scan(spark, sf)).where("fn = 'inflate' or name = 'parse_rows'")


@per(
    PART, "path, owner, field, reads, kind", (FILE, "strm", "avail_in", 2, "size-state"), (FILE, "head", "extra<<b>>", 1, "state"), (FILE, "head", "extra_max", 1, "state"), (FILE, "state", "mode", 1, "control-state"), (FILE, "strm", "state", 1, "control-state"),
)
def source_state_fields(spark: SparkSession, sf: str) -> DataFrame:
    return facts.state_fields(_scan(spark, sf).where("fn = 'inflate'"))


@per(
    PART, "path, ord, target, operator, value, type", (FILE, 0, "strm->state", "==", "Z_NULL", "comparison"), (FILE, 1, "strm->avail_in", ">", "<<a>>", "comparison"),
    (FILE, 2, "head->extra<<b>>", "!=", "Z_NULL", "comparison"), (FILE, 3, "state->mode", None, None, "switch"),
)
def source_field_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return facts.field_conditions(_scan(spark, sf).where("fn = 'inflate'"))


@per(PART, "path, parameter, operator, value, type", (FILE, "strm", "==", "Z_NULL", "comparison"), (FILE, "flush", "==", "Z_FINISH<<s>>", "comparison"), (FILE, "state->mode", None, None, "switch"))
def source_parameter_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return facts.parameter_conditions(_scan(spark, sf).where("fn = 'inflate'"))


@per(PART, "path, variable, cases, has_default, num_paths", (FILE, "state->mode", "HEAD<<b>>", True, 2))
def source_switch_branches(spark: SparkSession, sf: str) -> DataFrame:
    return facts.switch_branches(_scan(spark, sf)).withColumn("cases", F.array_join("cases", ","))


@per(PART, "path, kind, name, value", (FILE, "define", "MAX_MODE", "<<s>>"), (FILE, "enum", "FLAG_A", "<<k>>"), (FILE, "enum", "FLAG_B", "auto"))
def source_constants(spark: SparkSession, sf: str) -> DataFrame:
    return facts.constants(_files(spark, sf))


@per(PART, "path, fn, name, relation", (FILE, "inflate", "inflateGetHeader", "register"))
def source_related_functions(spark: SparkSession, sf: str) -> DataFrame:
    return facts.related_functions(_files(spark, sf), _wanted(spark, sf))


@per(PART, "path, ord, target, score, importance", (FILE, 0, "head->extra<<b>>", 8, "high"), (FILE, 1, "strm->state", 5, "medium"))
def contract_predicates(spark: SparkSession, sf: str) -> DataFrame:
    return contract.activation_predicates(facts.field_conditions(_scan(spark, sf)))


@per(PART, "path, name, fields", (FILE, "head", "extra<<b>>, extra_max"))
def contract_support_objects(spark: SparkSession, sf: str) -> DataFrame:
    s = _scan(spark, sf)
    found = contract.support_objects(contract.activation_predicates(facts.field_conditions(s)), facts.state_fields(s))
    return found.withColumn("fields", F.array_join("required_fields", ", "))


@per(SUPPLIER, "path, fn, primary, operators", (FILE, "inflate", "semantic-arguments", "chunked-stream,control-biased"), (FILE, "ansi", "structured-format", "control-biased"))
def function_models(spark: SparkSession, sf: str) -> DataFrame:
    # the lines before ansi that belong to its scan compare two bytes of a buffer
    done = models.workload_model(models.input_model(models.profile(_scan(spark, sf, SUPPLIER))))
    return done.withColumn("operators", F.array_join("operators", ","))


@per(
    SUPPLIER, "path, fn, kind, controller, dependent", (FILE, "inflate", "boundary-value", "flush", "Z_FINISH<<s>>"), (FILE, "inflate", "boundary-value", "strm", "Z_NULL"),
    (FILE, "ansi", "boundary-value", "len", "(1 << mode)"), (FILE, "ansi", "derived-bound", "mode", "len"),
)
def trigger_relations(spark: SparkSession, sf: str) -> DataFrame:
    return models.trigger_relations(_scan(spark, sf, SUPPLIER))


@per(SUPPLIER, "path, entry, sink, hops, score", (FILE, "api<<k>>", "ansi", "api<<k>>,ansi", Sql("s_nationkey + 12")))
def plan_records(spark: SparkSession, sf: str) -> DataFrame:
    path = SUPPLIER.rows(spark, sf, "path string, fn string, entry string, hops array<string>, score int", (FILE, "ansi", "api<<k>>", ["api<<k>>", "ansi"], Sql("s_nationkey + 12")))
    analysis = models.analyse(_scan(spark, sf, SUPPLIER)).where("fn = 'ansi'")
    # a function's name is told apart by its file, as the plans of many programs are made at once here
    named = lambda df: df.withColumn("fn", F.concat("path", F.lit(":"), "fn"))
    plan = assemble.plan_record(named(analysis), named(path).drop("path"))
    of = lambda key: F.get_json_object("plan", f"$.{key}")
    hops = F.array_join(F.from_json(of("call_path"), "array<string>"), ",")
    return plan.select("path", of("entry_function").alias("entry"), F.split_part(of("sink_function"), F.lit(":"), F.lit(2)).alias("sink"), hops.alias("hops"), of("path_score").cast("long").alias("score"))


# Stages, roles and relations of one plan each.


_ITEMS = (("setup_call", 0, "pngInit", None), ("setup_call", 1, "set_palette<<s>>", None), ("milestone", 0, "m<<s>>", "container-parse"), ("predicate", 0, "head->x<<s>>", None))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return PART.rows(spark, sf, "k string, field string, ord int, text string, kind string", *(("k<<k>>", *i) for i in _ITEMS))


@per(PART, "k, stage, field, items", ("k<<k>>", "entry", "setup_call", "pngInit"), ("k<<k>>", "transform", "setup_call", "set_palette<<s>>"), ("k<<k>>", "parse", "milestone", "m<<s>>"), ("k<<k>>", "parse", "predicate", "head->x<<s>>"))
def stage_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.stage_contracts(_items(spark, sf), ["k"], models.path_traits(F.array(F.lit("png_read_row"), F.lit("png_push")))).withColumn("items", F.array_join("items", ","))


@per(PART, "k, text", ("k<<k>>", "pngInit"), ("k<<k>>", "m<<s>>"), ("k<<k>>", "head->x<<s>>"))
def pruned_items(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.prune_dropped(_items(spark, sf), PART.rows(spark, sf, "k string, name string", ("k<<k>>", "Palette<<s>>")), ["k"], F.col("text"))


@per(PART, "k, text", ("k<<k>>", "set_palette<<s>>", When("p_size % 4 = 1")))
def anchored_items(spark: SparkSession, sf: str) -> DataFrame:
    anchors = PART.rows(spark, sf, "k string, token string", ("k<<k>>", "palette<<s>>", When("p_size % 4 = 1")), ("k<<k>>", "init"))
    return assemble.anchored_items(_items(spark, sf), anchors, ["k"], F.col("text"), ("init",))


@per(PART, "k, name", ("a<<k>>", "*a<<s>>"), ("a<<k>>", "b"), ("b<<k>>", "mode"), ("c<<k>>", "mode"))
def chosen_roles(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda *r: PART.rows(spark, sf, "k string, name string, role string", *r)
    signature = side(("a<<k>>", "*a<<s>>", "size"), ("a<<k>>", "b", "size"), ("b<<k>>", "x", "value"), ("c<<k>>", "mode", "control"))
    context = side(("a<<k>>", "a<<s>>", "state"), ("a<<k>>", "b", "control"), ("b<<k>>", "mode", "control"), ("c<<k>>", "x", "value"))
    return lifecycle.choose_roles(signature, context, PART.rows(spark, sf, "k string, name string", *((f"{k}<<k>>", "mode") for k in "abc")), ["k"])


def _roles(spark: SparkSession, sf: str) -> DataFrame:
    given = [("n", "size"), ("m<<s>>", "size"), ("t", "support-buffer"), ("u", "support-buffer"), ("s", "state")]
    return PART.rows(spark, sf, "k string, ord int, name string, role string", *(("k<<k>>", i, n, r) for i, (n, r) in enumerate(given)))


@per(PART, "k, name, role", ("k<<k>>", "n", "control"), ("k<<k>>", "m<<s>>", "size"), ("k<<k>>", "t", "support-buffer"), ("k<<k>>", "u", "support-buffer"), ("k<<k>>", "s", "state"), ("k<<k>>", "z<<a>>", "value"))
def merged_roles(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.merge_roles(_roles(spark, sf), PART.rows(spark, sf, "k string, name string, role string", ("k<<k>>", "N", "control"), ("k<<k>>", "z<<a>>", "value")), ["k"])


@per(PART, "k, controller, dependent", ("k<<k>>", "n", "t"), ("k<<k>>", "n", "u"), ("k<<k>>", "m<<s>>", "t"))
def signature_relations(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.signature_relations(_roles(spark, sf), ["k"], 3)


@per(PART, "k, controller, dependent", ("k<<k>>", "s", "n"), ("k<<k>>", "s", "m<<s>>"))
def setup_state_relations(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.setup_state_relations(_roles(spark, sf), ["k"])


@query("""WITH names AS (SELECT replace(p_name, ' ', '_') || '_' || p_partkey AS name, p_size FROM part), own AS (SELECT name FROM names WHERE p_size = 50),
others AS (SELECT name FROM names WHERE p_size <> 50 AND substr(name, 1, 3) IN (SELECT substr(name, 1, 3) FROM own) ORDER BY name LIMIT 60)
SELECT name FROM own UNION ALL SELECT name FROM others""")
def selected_signatures(spark: SparkSession, sf: str) -> DataFrame:
    listed = table(spark, sf, "part").select(F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), "p_partkey").alias("name"), "p_size")
    path = listed.where("p_size = 50").select("name")
    return assemble.selected_signatures(listed.select("name"), path, path.where("false"))


@per(PART, "name, kind, role", ("num_rows<<k>>", "int", "size"), ("mode<<k>>", "int", "control"), ("info<<k>>_ptr", "void", "state"), ("out<<k>>", "char **", "output-buffer"))
def signature_roles(spark: SparkSession, sf: str) -> DataFrame:
    frame = PART.rows(spark, sf, "name string, kind string", ("num_rows<<k>>", "int"), ("mode<<k>>", "int"), ("info<<k>>_ptr", "void"), ("out<<k>>", "char **"))
    return frame.withColumn("role", classify.signature_role(F.col("name"), F.col("kind")))


@query("SELECT 'row_callback' || p_partkey AS function, 'post-parse-callback' AS placement, CAST(15 AS BIGINT) AS score, false AS registers FROM part ORDER BY function LIMIT 6")
def stage_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The six best blocks of all files; those that run the stage come before those that register for it."""
    files = PART.rows(spark, sf, "path string, text string", ("src/a<<k>>.c", templates.CALLBACKS))
    token = lambda t: F.array(F.lit(t))
    called = spark.createDataFrame([("png_set_quantize",)], "name string")
    found = retrieval.stage_evidence(files, None, called, token("png"), token("quantize"), token("palette"), token("row"))
    return found.select("function", "placement", "score", "registers")


# Candidate texts against plans.

_PLAN_FIELDS = [x.split()[0] for x in validate.PLAN.split(", ")]


def _planned(spark: SparkSession, sf: str, first: str, rows: list[tuple]) -> DataFrame:
    """(k, first..., code, plan fields): fixed rows for each supplier, with its number in their codes."""
    fixed = spark.createDataFrame(rows, f"{first}, code string, {validate.PLAN}")
    keys = SUPPLIER.table(spark, sf).select(F.col("s_suppkey").alias("k"))
    return keys.crossJoin(F.broadcast(fixed)).withColumn("code", F.replace("code", F.lit("<<k>>"), F.col("k").cast("string")))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    relation = ("setup-state-bound-hypothesis", "state", "num_rows", "", "high")
    plan = {"roles": [("state", "state")], "operators": ["chunked-stream"], "primary": "structured-format", "container_synthesis": True, "controls": 1, "relations": [relation]}
    row = lambda i, code, **p: (i, code, *({**dict.fromkeys(_PLAN_FIELDS), **plan, **p}[f] for f in _PLAN_FIELDS))
    return _planned(spark, sf, "id long", [row(0, templates.RAW_CODE, entry="feed_it", setup_candidates=["feedInit_"]), row(1, templates.SHAPED_CODE, entry="parse_it", setup_candidates=["set_header"])])


@per(
    SUPPLIER, "k, id, rule, penalty, critical",
    *((Sql("s_suppkey"), 0, rule, penalty, critical) for rule, penalty, critical in (
        ("MISSING_STATE_SETUP", 25, False), ("MISSING_CHUNKED_STREAM_LOOP", 20, False), ("RAW_BUFFER_STRUCTURED_INPUT", 20, False), ("MISSING_CONTAINER_SYNTHESIS", 25, False),
        ("RAW_PASSTHROUGH_STAGED_INPUT", 25, False), ("MISSING_SELECTOR_LOGIC", 8, False), ("TRIGGER_RELATION_MISS", 18, False), ("SETJMP_ABORT_CONFLICT", 20, True),
    )),
)
def validation_findings(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validate(_candidates(spark, sf), ["k", "id"])


@per(SUPPLIER, "k, id, ok, score, relations_ok", (Sql("s_suppkey"), 0, False, 0, 0), (Sql("s_suppkey"), 1, True, 100, 1))
def candidate_reports(spark: SparkSession, sf: str) -> DataFrame:
    return validate.reports(_candidates(spark, sf), ["k", "id"])


@query("\nUNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS broken, CAST(0 AS BIGINT) AS kept FROM supplier HAVING count(*) > 0" for rule, *_ in templates.RULE_CASES))
def validation_rule_cases(spark: SparkSession, sf: str) -> DataFrame:
    """How often each rule fires on texts that break it, and on texts that keep it: one of each a supplier."""
    cases = [
        (rule, kind, code.replace("int f(", "int f<<k>>("), *({"entry": "feed_it", **plan}.get(f) for f in _PLAN_FIELDS))
        for rule, plan, broken, kept in templates.RULE_CASES
        for kind, code in (("broken", broken), ("kept", kept))
    ]
    found = validate.validate(_planned(spark, sf, "wanted string, kind string", cases), ["k", "wanted", "kind"]).where("rule = wanted")
    fired = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    return found.groupBy(F.col("wanted").alias("rule")).agg(fired("broken"), fired("kept"))


# Patches and texts of advisories.


def _patches(spark: SparkSession, sf: str, base: Base = PART) -> DataFrame:
    return base.rows(spark, sf, "cve_id string, patch_no int, text string", ("a<<k>>", 0, templates.PATCH))


@per(PART, "cve_id, sub_no, score", ("a<<k>>", 1, "17.0"), ("a<<k>>", 2, "-8.0"))
def patch_scores(spark: SparkSession, sf: str) -> DataFrame:
    lines = advisory.patch_lines(_patches(spark, sf), ["cve_id"], "text")
    return advisory.score_sub_patches(lines, ["cve_id"]).withColumn("score", F.col("score").cast("string"))


@per(PART, "cve_id, removed, added, functions", ("a<<k>>", "old = 1 << n<<s>>;", "if (n<<s>> > 0x100) return;", "foo_bar<<k>>"))
def patch_changes(spark: SparkSession, sf: str) -> DataFrame:
    return derive.changes(_patches(spark, sf)).withColumns({c: F.array_join(c, ";;") for c in ("removed", "added", "functions")})


@per(PART, "id, value", (Sql("p_partkey * 8"), "doContent<<s>>"), (Sql("p_partkey * 8 + 1"), "png_read<<s>>"), (Sql("p_partkey * 8 + 2"), "foo_bar<<s>>"), (Sql("p_partkey * 8 + 3"), "tick_me<<s>>"))
def advisory_functions(spark: SparkSession, sf: str) -> DataFrame:
    texts = ["An issue in the doContent<<s>> function in xmlparse.c", "crash via png_read<<s>> at pngread.c", "overflow in tiff_jpeg.c in foo_bar<<s>>, remote", "`tick_me<<s>>()` and other<<a>>()", "nothing"]
    frame = PART.rows(spark, sf, "id long, t string", *((Sql(f"p_partkey * 8 + {i}"), t) for i, t in enumerate(texts)))
    return advisory.function_from_text(frame, "id", "t", PART.rows(spark, sf, "name string", ("other<<a>>",)).distinct())


@per(PART, "cve_id, value, step", ("a<<k>>", "foo_bar<<k>>", 0), ("b<<k>>", "c_func<<s>>", 1), ("c<<k>>", "from_outside<<s>>", 5))
def affected_functions(spark: SparkSession, sf: str) -> DataFrame:
    texts = PART.rows(spark, sf, "cve_id string, rank int, text string", ("a<<k>>", 0, "Overflow in foo_bar<<k>>"), ("b<<k>>", 0, "crash in the c_func<<s>> function"))
    empty = lambda s: spark.createDataFrame([], s)
    override = PART.rows(spark, sf, "cve_id string, value string", ("c<<k>>", "from_outside<<s>>"))
    return derive.affected_function(texts, _patches(spark, sf), empty("cve_id string, file string"), empty("cve_id string, place int, text string"), spark.createDataFrame([("nothing",)], "name string"), empty("name string"), override)


@per(PART, "cve_id, message", ("a<<k>>", "fix <<s>>\nbody"))
def commit_messages(spark: SparkSession, sf: str) -> DataFrame:
    text = "From 0123456789012345678901234567890123456789 x\nSubject: [PATCH] fix <<s>>\nbody\n---\n file | 2\n"
    return derive.commit_messages(PART.rows(spark, sf, "cve_id string, patch_no int, text string", ("a<<k>>", 0, text)))


@query("""SELECT c.hash FROM (SELECT substr(md5(CAST(p_partkey AS VARCHAR)), 1, 12) AS hash, p_size AS time FROM part) c
JOIN (SELECT substr(md5(CAST(p_partkey AS VARCHAR)), 1, 7) AS prefix FROM part WHERE p_partkey % 4 = 1) f ON starts_with(c.hash, f.prefix) ORDER BY time, hash LIMIT 1""")
def earliest_fix(spark: SparkSession, sf: str) -> DataFrame:
    md5 = F.md5(F.col("p_partkey").cast("string").cast("binary"))
    part = table(spark, sf, "part")
    commits = part.select(F.substring(md5, 1, 12).alias("hash"), F.col("p_size").alias("time"))
    repo = F.when(F.col("p_partkey") % 4 == 1, F.when(F.col("p_size") % 2 == 0, "git@github.com:o/r.git").otherwise("https://github.com/o/r")).otherwise("https://github.com/x/y")
    return derive.earliest_fix(commits, part.select(repo.alias("repo"), F.substring(md5, 1, 7).alias("commit")), F.lit("https://github.com/O/r/")).select("hash")


@per(PART, "id, rules", (Sql("2 * p_partkey"), "use_real_objects,vary_constants"), (Sql("2 * p_partkey + 1"), "rewrite"))
def repair_rules(spark: SparkSession, sf: str) -> DataFrame:
    said = PART.rows(spark, sf, "id long, text string", (Sql("2 * p_partkey"), "keeps palette<<s>> constant"), (Sql("2 * p_partkey"), "null placeholders"), (Sql("2 * p_partkey + 1"), "odd <<s>>"))
    return derive.repair_rules(said, ["id"]).withColumn("rules", F.array_join("rules", ","))


@per(PART, "k, name", (Sql("p_partkey"), "foo<<s>>"), (Sql("p_partkey"), "baz<<s>>"))
def error_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    text = "error: use of undeclared identifier 'foo<<s>>'; did you mean 'bar'?\nundefined reference to `baz<<s>>'"
    return PART.rows(spark, sf, "k long, t string", (Sql("p_partkey"), text)).select("k", F.explode(evidence.error_identifiers(F.col("t"))).alias("name"))


_TOKENS = ('"0x100"', r'"\x00\x01"', r'"\x00\x01\x00\x00"', r'"\x00\x01\x00\x00\x00\x00\x00\x00"', '"GIF<<s>>"')


@per(PART, "k, place, token", *((Sql("p_partkey"), i, token) for i, token in enumerate(_TOKENS)))
def seed_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    frame = PART.rows(spark, sf, "k long, s string, d string", (Sql("p_partkey"), 's = "GIF<<s>>";', templates.PATCH))
    return frame.select("k", F.posexplode(seeds.dictionary_tokens(F.col("s"), F.col("d"))).alias("place", "token"))


@per(PART, "text, value", ("Z_<<k>>) && x", "Z_<<k>>"), ("a[<<k>>] || b", "a[<<k>>]"), ("f(x<<k>>));", "f(x<<k>>)"))
def condition_values(spark: SparkSession, sf: str) -> DataFrame:
    return PART.rows(spark, sf, "text string", ("Z_<<k>>) && x",), ("a[<<k>>] || b",), ("f(x<<k>>));",)).withColumn("value", names.condition_value(F.col("text")))


@per(PART, "text, code", ("```python\nx = <<k>>\n```", "x = <<k>>"), ('{"code": "int x<<k>>;"}', "int x<<k>>;"), ("int y<<k>>;", "int y<<k>>;"))
def unwrapped_texts(spark: SparkSession, sf: str) -> DataFrame:
    frame = PART.rows(spark, sf, "text string", ("```python\nx = <<k>>\n```",), ('{"code": "int x<<k>>;"}',), ("int y<<k>>;",))
    return frame.withColumn("code", names.unwrapped_code(names.without_fence(F.col("text"))))


# Recorded answers of advisory services: rendered, written to the shared folder, and read as their data source.

CVE = "'CVE-' || (2000 + p_size) || '-' || p_partkey"


def _recorded(spark: SparkSession, sf: str) -> str:
    """A folder of answers about all parts."""
    cve = "CVE-<<y>>-<<k>>"
    base = Base("part", PART.numbers | {"y": "2000 + p_size", "h1": "substr(md5(cast(p_partkey as string)), 1, 10)", "h2": "substr(md5(cast(p_partkey as string)), 11, 10)", "h3": "substr(md5(cast(p_partkey as string)), 21, 10)", "cvss": "cast(p_size / 5.0D as string)"})
    metrics = [("V2", "p_size % 3 = 0"), ("V30", "p_size % 3 = 1"), ("V31", "p_size % 3 = 1 and p_partkey % 2 = 0")]
    scored = F.concat_ws(", ", *(F.when(F.expr(when), base.filled(f'"cvssMetric{v}": [{{"cvssData": {{"baseScore": <<cvss>>, "vectorString": "{v}/<<b>>"}}}}]')) for v, when in metrics))
    part = PART.table(spark, sf).withColumn("metrics", scored)
    nvd = F.replace(base.filled(templates.NVD), F.lit("<<metrics>>"), F.col("metrics"))
    answers = {"nvd": F.when(F.col("p_size") == 50, F.lit("broken")).otherwise(nvd), "osv": F.when(F.col("p_partkey") % 2 == 0, base.filled(templates.OSV)), "gh": F.when(F.col("p_partkey") % 3 == 0, base.filled(templates.GITHUB)).when(F.col("p_partkey") % 3 == 1, F.lit("[]"))}
    each = F.array(*(F.struct(F.lit(n).alias("source"), a.alias("json")) for n, a in answers.items()))
    rows = part.select(base.filled(cve).alias("cve_id"), F.explode(each).alias("a")).select("cve_id", "a.*").where("json is not null")
    folder = f"{shared_dir(spark)}/answers-{spark.sql('select uuid()').first()[0]}"
    recorded.record_answers(rows, folder)
    return folder


def _united(spark: SparkSession, sf: str) -> DataFrame:
    folder = _recorded(spark, sf)
    of = lambda source: recorded.read_answers(spark, folder, source=source)
    return materialise(advisories.united(advisories.nvd(of("nvd")), advisories.osv(of("osv")), advisories.github(of("gh"))))


@query(f"""SELECT {CVE} AS cve_id, 'An overflow in fn' || p_partkey || ' of release ' || p_size AS description, CASE WHEN p_size % 3 = 1 AND p_partkey % 2 = 0 THEN 'V31/' || p_size % 4 WHEN p_size % 3 = 1 THEN 'V30/' || p_size % 4 WHEN p_size % 3 = 0 THEN 'V2/' || p_size % 4 END AS vector,
CASE WHEN p_size % 3 < 2 THEN p_size / 5.0 END AS score, 'CWE-' || p_size || CASE WHEN p_size <> p_partkey % 4 THEN ',CWE-' || p_partkey % 4 ELSE '' END AS cwe, CAST(3 AS BIGINT) AS n_refs FROM part WHERE p_size <> 50""")
def advisory_records(spark: SparkSession, sf: str) -> DataFrame:
    found = advisories.nvd(recorded.read_answers(spark, _recorded(spark, sf), pushdown=True).where("source = 'nvd'"))
    return found.select("cve_id", "description", F.col("cvss_vector").alias("vector"), F.col("cvss_score").alias("score"), F.array_join("cwe_ids", ",").alias("cwe"), F.size("refs").cast("long").alias("n_refs"))


@query(f"SELECT {CVE} AS cve_id, 'https://github.com/o/r' || p_size || '.git' AS repo, substr(md5(CAST(p_partkey AS VARCHAR)), 1, 10) AS commit FROM part WHERE p_partkey % 2 = 0")
def advisory_fixes(spark: SparkSession, sf: str) -> DataFrame:
    found = advisories.osv(recorded.read_answers(spark, _recorded(spark, sf), pushdown=True).where("source = 'osv'"))
    return found.select("cve_id", F.explode("fixes").alias("f")).select("cve_id", F.col("f.repo").alias("repo"), F.col("f.commit").alias("commit"))


@query(f"SELECT {CVE} AS cve_id, 'rated ' || p_size AS severity FROM part WHERE p_partkey % 3 = 0")
def advisory_severity(spark: SparkSession, sf: str) -> DataFrame:
    return advisories.github(recorded.read_answers(spark, _recorded(spark, sf), pushdown=True).where("source = 'gh'")).select("cve_id", "severity")


#: A fixed commit, the references of one source tagged as patches, and the other's; each commit once, commits before pull requests.
PATCH_URLS = f"""told AS (SELECT {CVE} AS cve_id, p_partkey AS k, p_size AS s, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part),
listed AS (SELECT cve_id, 0 AS a, 0 AS b, substr(h, 1, 10) AS commit, 'https://github.com/o/r' || s || '/commit/' || substr(h, 1, 10) AS url FROM told WHERE k % 2 = 0
  UNION ALL SELECT cve_id, 1, 0, substr(h, 1, 10), 'https://github.com/o/r' || s || '/commit/' || substr(h, 1, 10) FROM told WHERE s <> 50
  UNION ALL SELECT cve_id, 1, 3, NULL, 'https://github.com/o/r' || s || '/pull/' || k FROM told WHERE s <> 50
  UNION ALL SELECT cve_id, 2, 0, substr(h, 1, 10), 'https://github.com/mirror/r/commit/' || substr(h, 1, 10) FROM told WHERE k % 2 = 0
  UNION ALL SELECT cve_id, 2, 1, substr(h, 11, 10), 'https://github.com/o/r' || s || '/commit/' || substr(h, 11, 10) FROM told WHERE k % 2 = 0),
urls AS (SELECT cve_id, url, commit, CASE WHEN commit IS NULL THEN 'pull' ELSE 'commit' END AS kind, commit IS NULL AS p, a, b FROM listed QUALIFY row_number() OVER (PARTITION BY cve_id, coalesce(commit, url) ORDER BY commit IS NULL, a, b) = 1)"""


@query(f"WITH {PATCH_URLS} SELECT cve_id, url, kind FROM urls")
def advisory_patch_urls(spark: SparkSession, sf: str) -> DataFrame:
    return advisories.patch_urls(_united(spark, sf)).select("cve_id", "url", "kind")


@query(f"""WITH {PATCH_URLS}, texts AS (SELECT *, CASE WHEN length(url) % 3 = 0 THEN '' ELSE 'patch of ' || url END AS text FROM urls)
SELECT cve_id, row_number() OVER w - 1 AS patch_no, text FROM texts WHERE text <> '' WINDOW w AS (PARTITION BY cve_id ORDER BY p, a, b) QUALIFY row_number() OVER w <= 2""")
def advisory_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Of the addresses, two of which the patch is recorded; of every third kind of address nothing was."""
    urls = materialise(advisories.patch_urls(_united(spark, sf)))
    texts = urls.select("url", F.when(F.length("url") % 3 == 0, "").otherwise(F.concat(F.lit("patch of "), "url")).alias("text")).distinct()
    return advisories.fix_patches(urls, texts).select("cve_id", "patch_no", "text")
