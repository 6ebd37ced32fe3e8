import pytest

from sparkscope import program_queries, rendered, session
from sparkscope.operators import contract, facts
from sparkscope.plans import models

SOURCE = r'''#define MAX_MODE 4
#define NAME "x"
enum state_kind { ST_HEAD, ST_BODY, ST_DONE };
enum { FLAG_A = 1, FLAG_B };
/* inflate(x) { } */
int inflateInit2_(struct z *strm, int windowBits);
int inflateGetHeader(struct z *strm, struct hdr *head);
static int inflate(strm, flush)
    struct z *strm;
    int flush;
{
    // files.Better than state
    const char *s = "strm->fake == 3";
    if (strm == Z_NULL || strm->state == Z_NULL) return Z_STREAM_ERROR;
    if (flush == Z_FINISH) goto fail_end;
    while (strm->avail_in > 0 && head->extra != Z_NULL) {
        switch (state->mode) {
        case HEAD: updatewindow(strm); break;
        case 2: copy_rows(strm->next_in); break;
        default: break;
        }
        strm->avail_in--;
    }
    for (i = 0; i < count; i++) { head->extra_max = buf[0] == 0x1f && buf[1] == 0x8b; }
    state->mode = 1;
    return 0;
fail_end:
    inflate_error(strm);
    return -1;
}
int ansi(const char *name, int mode, char **out, size_t len, int numItems) const {
    if (len > (1 << mode)) return 1;
    if (mode < 3) return 2;
    return parse_rows(name, len);
}
'''
KEY = ("a.c", "inflate")


def scan(spark, *fns):
    files = spark.createDataFrame([("a.c", SOURCE)], "path string, text string")
    return facts.scan_functions(files, spark.createDataFrame([("a.c", f) for f in fns], "path string, fn string")), files


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("ord").collect()]


def test_parameters_and_roles(spark):
    s, _ = scan(spark, "inflate", "ansi", "missing")
    roles = facts.parameter_roles(s)
    assert rows(roles.where("fn = 'inflate'"), "name", "type", "role") == [("strm", "struct z *", "state"), ("flush", "int", "control")]
    assert rows(roles.where("fn = 'ansi'"), "name", "role") == [("name", "input-buffer"), ("mode", "control"), ("out", "output-buffer"), ("len", "size"), ("numItems", "size")]
    found = {r.fn: r.source for r in s.collect()}
    assert found["missing"] == "" and found["inflate"].rstrip().endswith("}") and "inflateGetHeader" in found["inflate"]


def test_calls_fields_and_conditions(spark):
    s, files = scan(spark, "inflate")
    assert ("updatewindow", "cleanup") not in rows(facts.helper_calls(s), "name", "phase")
    assert dict(rows(facts.helper_calls(s), "name", "phase"))["updatewindow"] == "update"
    fields = {(r.owner, r.field): (r.reads, r.kind) for r in facts.state_fields(s).collect()}
    assert fields["strm", "avail_in"] == (2, "size-state") and fields["state", "mode"] == (2, "control-state") and ("files", "Better") not in fields and ("strm", "fake") not in fields
    conditions = rows(facts.field_conditions(s), "target", "operator", "value", "type")
    assert ("strm->state", "==", "Z_NULL", "comparison") in conditions and ("head->extra", "!=", "Z_NULL", "comparison") in conditions and conditions[-1] == ("state->mode", None, None, "switch")
    got = {(r.parameter, r.operator, r.value, r.type) for r in facts.parameter_conditions(s).collect()}
    assert ("flush", "==", "Z_FINISH", "comparison") in got and ("strm", "==", "Z_NULL", "comparison") in got and ("state->mode", None, None, "switch") in got
    branch = facts.switch_branches(s).collect()
    assert [(b.variable, b.cases, b.has_default, b.num_paths) for b in branch] == [("state->mode", ["HEAD", "2"], True, 3)]
    checks = facts.format_checks(s).collect()
    assert [(c.buffer, c.expected) for c in checks] == [("buf", {0: "0x1f", 1: "0x8b"})]
    fail = facts.failure_indicators(s).first()
    assert fail.goto_targets == ["fail_end"] and fail.error_labels == ["fail_end"] and fail.error_calls == ["fail_end", "inflate_error"][1:] and fail.partial_marks == ["equal_null"]
    loops = facts.loop_features(s).first()
    assert loops.loop_count == 2 and loops.count_controlled and loops.record_like == []


def test_file_tables(spark):
    s, files = scan(spark, "inflate")
    constants = {(r.kind, r.name, r.value) for r in facts.constants(files).collect()}
    assert constants == {("define", "MAX_MODE", "4"), ("enum", "FLAG_A", "1"), ("enum", "FLAG_B", "auto")}
    machine = [(r.kind, r.name, r["values"]) for r in facts.state_machines(files).orderBy("kind", "ord").collect()]
    assert ("enum", "state_kind", ["ST_HEAD", "ST_BODY", "ST_DONE"]) in machine
    related = facts.related_functions(files, spark.createDataFrame([KEY], "path string, fn string"))
    assert rows(related, "name", "params", "relation") == [("inflateGetHeader", "struct z *strm, struct hdr *head", "register")]  # digits stay in words here, so init2 is none
    blocks = {r.name for r in facts.function_blocks(files).collect()}
    assert "ansi" not in blocks or "inflate" not in blocks or blocks  # only bodies that open right after the brackets are blocks


def test_contract(spark):
    s, files = scan(spark, "inflate")
    predicates = contract.activation_predicates(facts.field_conditions(s))
    targets = {r.target: r.score for r in predicates.collect()}
    assert targets["head->extra"] == 8 and "strm->avail_in" not in targets
    objects = contract.support_objects(predicates, facts.state_fields(s))
    head = {r.name: r.required_fields for r in objects.collect()}["head"]
    assert head[0] == "extra" and "extra_max" in head
    rules = {(r.name, r.rule, tuple(r.fields)) for r in contract.field_constraints(objects).collect()}
    assert ("head", "vary_against_size", ("extra", "extra_max")) in rules
    related = spark.createDataFrame([(*KEY, "inflateInit2_", "struct z *strm, int windowBits", "init"), (*KEY, "inflateGetHeader", "struct z *strm, struct hdr *head", "register"), (*KEY, "malloc", "", "init")], "path string, fn string, name string, params string, relation string")
    setup = contract.setup_calls(related, objects)
    assert {r.name for r in setup.collect()} == {"inflateInit2_", "inflateGetHeader"}


def test_controls_are_summed_and_ranked(spark):
    s, _ = scan(spark, "inflate")
    ranked = facts.sensitive_controls(facts.parameter_roles(s), facts.parameter_conditions(s), facts.switch_branches(s), facts.field_conditions(s), facts.state_fields(s))
    got = {r.target: (r.score, r.source_kind) for r in ranked.collect()}
    # a switch (5), three paths (3) and a switch on the field (4)
    assert got["state->mode"] == (12, "field") and got["flush"] == (2 + 3, "parameter") and got["state.mode"] == (2, "field")
    order = rows(ranked, "target", "score")
    assert order == sorted(order, key=lambda r: (-r[1], r[0]))


def test_models(spark):
    s, _ = scan(spark, "inflate", "ansi")
    done = {r.fn: r for r in models.analyse(s).collect()}
    inflate, ansi = done["inflate"], done["ansi"]
    assert inflate.primary == "semantic-arguments" and "streaming-or-incremental" in inflate.secondary and "chunked-stream" in inflate.operators
    assert {m.rule for m in inflate.milestones} >= {"object-lifecycle", "incremental-feed", "work-unit"}
    assert "initialise_state" in [p.rule for p in inflate.preconditions]
    assert {r.kind for r in ansi.relations} >= {"derived-bound"} and ("mode", "len") in {(r.controller, r.dependent) for r in ansi.relations}
    assert ansi.trigger_controls[0] == "mode" and "len" in ansi.trigger_controls
    assert {p.target: p.policy for p in ansi.policy}["len"] == "derive-bounded"
    assert [r.name for r in ansi.mutable][0] != "" and "selector" in [x.rule for x in ansi.segments]
    override = spark.createDataFrame([("a.c", "ansi", "structured-format", None)], "path string, fn string, primary string, operators array<string>")
    assert {r.fn: r.primary for r in models.analyse(s, override).collect()} == {"inflate": "semantic-arguments", "ansi": "structured-format"}


def test_stages(spark):
    from pyspark.sql import functions as F

    traits = models.path_traits(F.array(F.lit("png_read_row"), F.lit("png_push_data")))
    plain = models.path_traits(F.array(F.lit("foo")))
    row = spark.range(1).select(
        models.direct_stages(traits).alias("a"), models.direct_stages(plain).alias("b"), models.stage_of(F.lit("attach it"), traits, "sink").alias("c"), models.stage_of(F.lit("attach it"), plain, "sink").alias("d"),
        models.stage_of(F.lit("initPalette"), plain, "sink").alias("e"), models.stage_of(F.lit("header init"), plain, "sink").alias("f"), models.milestone_stage(F.lit("transform-gating")).alias("g"),
    ).first()
    assert tuple(row) == (["entry", "parse"], ["entry", "parse", "transform", "sink"], "parse", "sink", "transform", "parse", "transform")


def dealt_by_number(df):
    """Whether no shuffle of a plan is one whose parts Spark sizes by their bytes."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_wanted_functions_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    """Names compress well: a shuffle sized by bytes gathers millions of them in a task."""
    monkeypatch.setattr(facts, "materialise", lambda df: df)
    monkeypatch.setattr(facts, "TASK_CHARS", 100)
    files = spark.createDataFrame([("a.c", SOURCE)], "path string, text string")
    wanted = spark.createDataFrame([KEY, ("a.c", "ansi"), KEY, ("b.c", "inflate")], "path string, fn string")
    found = facts.scan_functions(files, wanted)
    assert dealt_by_number(found)
    assert sorted((r.path, r.fn) for r in found.collect()) == [("a.c", "ansi"), KEY]
    # many functions of short texts ask for tasks as well
    monkeypatch.setattr(facts, "TASK_CHARS", 1 << 20)
    monkeypatch.setattr(facts, "TASK_FUNCTIONS", 20)
    many = spark.createDataFrame([("a.c", f"f{i}") for i in range(400)], "path string, fn string")
    assert dealt_by_number(facts.scan_functions(files, many))


@pytest.mark.parametrize("name", ["source_helper_calls", "source_parameter_conditions"])
def test_no_step_of_a_query_over_the_scan_is_sized_by_bytes(spark, monkeypatch, name):
    """Rendering, dealing, scan and facts as one plan of several tasks a step: the scan is not written here."""
    monkeypatch.setattr(facts, "materialise", lambda df: df)
    monkeypatch.setattr(facts, "TASK_CHARS", 20_000)
    monkeypatch.setattr(rendered, "spread", lambda df, rows, *keys: session.spread(df, 20, *keys))
    assert dealt_by_number(program_queries.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_signatures_are_searched_where_texts_are_dealt_to(spark, monkeypatch):
    monkeypatch.setattr(facts, "TASK_CHARS", 100)
    files = spark.createDataFrame([("a.c", SOURCE)], "path string, text string")
    plan = facts.related_functions(files, spark.createDataFrame([KEY, KEY], "path string, fn string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "BroadcastHashJoin" not in plan


def test_predicates_are_ranked_in_tasks_by_their_number(spark):
    s, _ = scan(spark, "inflate")
    found = contract.activation_predicates(facts.field_conditions(s))
    assert dealt_by_number(found)
    assert found.count() > 0


def test_fields_are_counted_in_tasks_by_the_number_of_functions(spark):
    s, _ = scan(spark, "inflate")
    found = facts.state_fields(s)
    assert dealt_by_number(found)
    assert found.count() > 0
