"""Models and plans of a function from its facts, one row per (path, fn).

``profile`` gathers the fact tables into array columns; everything else is an
expression over them, so a plan is one projection. Lists of findings are
arrays of ``struct<rule, args>``: a rule's code and the names it is about, in
the order in which the rules are written here. A renderer may turn them into
sentences; nothing downstream depends on wording.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.functions.classify import sink_role
from sparkscope.functions.names import contains_any, is_bound_like, is_count_like, is_internal_reference, is_public_name
from sparkscope.operators import facts

KEY = ["path", "fn"]
# Fields of streams, words of work units and transforms, and the objects that words hint at.
STREAM_FIELDS = ("avail_in", "avail_out", "next_in", "next_out", "pending_out")
WORK_UNIT_WORDS = ("row", "rows", "frame", "block", "record", "chunk")
REGION_WORDS = ("row", "rows", "scanline", "frame", "block", "record", "chunk", "pixel", "image")
TRANSFORM_WORDS = ("transform", "quantize", "convert", "scale", "expand")
SUPPORT_HINTS = (
    (("lookup", "lut"), "lookup-table", "table", False),
    (("row", "rows"), "row-buffer", "buffer", False),
    (("info", "header", "metadata", "profile"), "metadata-structure", "metadata", True),
    (("transform", "convert"), "transform-config", "config", True),
)
# Words that place an item in a stage, in order of precedence.
PARSE_STAGE = ("head", "header", "chunk", "signature", "magic", "container", "prefix", "record", "frame", "packet", "section", "metadata", "parse", "parser")
TRANSFORM_STAGE = ("transform", "quant", "quantize", "convert", "scale", "expand", "palette", "lookup", "hist")
ENTRY_STAGE = ("init", "open", "create", "setup", "begin", "start", "alloc")
REGISTER_STAGE = ("register", "attach", "assign", "load", "get")
# Words of a call path that show what kind of path it is.
TRAITS = {
    "parser_like": ("read", "parse", "decode", "process", "handle"),
    "container_like": ("chunk", "header", "signature", "magic", "metadata", "record", "frame", "section", "packet", "table"),
    "incremental_like": ("push", "feed", "update", "stream", "progressive", "some_data"),
    "work_unit_like": ("row", "rows", "frame", "block", "record"),
    "transform_like": TRANSFORM_WORDS,
}


def profile(scan: DataFrame) -> DataFrame:
    """(path, fn) with roles, helpers, fields, conditions, branches, checks and loops; co-grouped on the key."""

    def listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("ord", *columns)))
        return df.groupBy(*KEY).agg(F.transform(ordered, lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias(name))

    checks = facts.format_checks(scan).groupBy(*KEY).agg(F.count("*").alias("n_checks"))
    loops = facts.loop_features(scan).select(*KEY, F.struct("loop_count", "count_controlled", "buffer_loops", "record_like").alias("loops"))
    failures = facts.failure_indicators(scan).select(*KEY, F.struct("error_labels", "return_checks", "error_calls").alias("failures"))
    parts = [
        listed(facts.parameter_roles(scan), "roles", "name", "role"),
        listed(facts.helper_calls(scan), "helpers", "name", "phase"),
        listed(facts.state_fields(scan), "fields", "owner", "field", "reads", "kind"),
        listed(facts.field_conditions(scan), "conditions", "target", "operator", "value", "type"),
        listed(facts.switch_branches(scan), "branches", "variable", "num_paths"),
        listed(facts.sensitive_controls(facts.parameter_roles(scan), facts.parameter_conditions(scan), facts.switch_branches(scan), facts.field_conditions(scan), facts.state_fields(scan)), "controls", "target", "source_kind", "score"),
        checks, loops, failures,
    ]
    out = scan.select(*KEY).distinct()
    for p in parts:
        out = out.join(p, KEY, "left")
    empty = {"roles": "struct<name:string,role:string>", "helpers": "struct<name:string,phase:string>", "fields": "struct<owner:string,field:string,reads:bigint,kind:string>", "conditions": "struct<target:string,operator:string,value:string,type:string>", "branches": "struct<variable:string,num_paths:int>", "controls": "struct<target:string,source_kind:string,score:bigint>"}
    return out.withColumns({c: F.coalesce(c, F.array().cast(f"array<{t}>")) for c, t in empty.items()} | {"n_checks": F.coalesce("n_checks", F.lit(0))})


def with_role(role: str) -> Column:
    return F.transform(F.filter("roles", lambda r: r["role"] == role), lambda r: r["name"])


def with_phase(*phases: str) -> Column:
    return F.transform(F.filter("helpers", lambda h: h["phase"].isin(*phases)), lambda h: h["name"])


def some(array: Column) -> Column:
    return F.size(array) > 0


def has(array: Column, value: str) -> Column:
    return F.array_contains(array, value)


def tags(*pairs: tuple[str, Column]) -> Column:
    """Names whose conditions hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in pairs)))


def ruled(*rules: tuple[str, Column, Column | None]) -> Column:
    """array<struct<rule,args>> of the rules whose conditions hold, in order."""
    none = F.array().cast("array<string>")
    return F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("rule"), (none if a is None else a.cast("array<string>")).alias("args"))) for n, c, a in rules)))


def first_per_rule(items: Column, limit: int) -> Column:
    return F.slice(F.array_distinct(items), 1, limit)


def _streaming() -> Column:
    return F.exists("fields", lambda f: F.lower(f["field"]).isin(*STREAM_FIELDS))


def input_model(df: DataFrame) -> DataFrame:
    """Adds primary and secondary: how inputs should be shaped."""
    state = some(with_role("state")) | some(F.col("fields"))
    scalar = some(with_role("size")) | some(with_role("numeric")) | some(with_role("control"))
    indirect = ~some(with_role("input-buffer")) & (some(with_role("support-buffer")) | scalar)
    checked = F.col("n_checks") > 0
    secondary = tags(
        ("magic-or-container-header", checked), ("mode-selection", F.exists("branches", lambda b: b["num_paths"] > 1)), ("stateful-object", state), ("direct-api-arguments", indirect),
        ("streaming-or-incremental", some(with_phase("update")) | _streaming()), ("numeric-controls", scalar),
    )
    return df.withColumns({"primary": F.when(indirect, "semantic-arguments").when(checked, "structured-format").otherwise("raw-buffer"), "secondary": secondary})


def workload_model(df: DataFrame) -> DataFrame:
    """Adds operators: how a compact input should be expanded."""
    repeated = some(F.col("loops.record_like")) | (some(with_role("size")) & some(F.col("loops.count_controlled")))
    control = some(with_role("control")) | F.exists("fields", lambda f: f["kind"] == "control-state") | F.exists("conditions", lambda c: c["type"] == "switch")
    strong = tags(("repeated-records", F.coalesce(repeated, F.lit(False))), ("chunked-stream", some(with_phase("update")) | _streaming()), ("control-biased", control))
    weak = F.when(some(with_role("input-buffer")) & some(with_role("size")), F.array(F.lit("bounded-buffer"))).otherwise(F.array(F.lit("direct-buffer")))
    return df.withColumn("operators", F.when(some(strong), strong).otherwise(weak))


def exploration_policy(df: DataFrame) -> DataFrame:
    """Adds policy: array<struct<target,kind,policy>> per parameter, and for the workload."""
    top = F.transform(F.slice("controls", 1, 2), lambda c: c["target"])

    def of(r: Column) -> Column:
        role = r["role"]
        policy = (
            F.when(role == "input-buffer", "shape-from-payload").when(role == "size", "derive-bounded").when(role == "output-buffer", "allocate-valid")
            .when(F.array_contains(top, r["name"]) | (role == "control"), "bias-valid-space").when(role == "state", "initialize-via-api").otherwise("stabilize")
        )
        return F.struct(r["name"].alias("target"), role.alias("kind"), policy.alias("policy"))

    work = lambda o, t, p: F.when(has(F.col("operators"), o), F.struct(F.lit(t).alias("target"), F.lit("workload").alias("kind"), F.lit(p).alias("policy")))
    extra = F.array_compact(F.array(work("repeated-records", "workload.records", "expand-small-to-many"), work("chunked-stream", "workload.chunks", "split-into-bounded-chunks")))
    return df.withColumn("policy", F.concat(F.transform("roles", of), extra))


def support_objects(df: DataFrame) -> DataFrame:
    """Adds support: array<struct<name,kind>> of auxiliary objects that names near the function hint at."""
    strong = F.lower(F.concat_ws(" ", F.col("fn"), F.transform("helpers", lambda h: h["name"]), F.transform("conditions", lambda c: c["target"]), with_role("support-buffer")))
    weak = F.lower(F.concat_ws(" ", F.transform("fields", lambda f: F.concat_ws(" ", f["owner"], f["field"]))))
    structured = F.col("primary") == "structured-format"
    item = lambda n, k: F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"))
    hints = []
    for words, name, kind, needs_strong in SUPPORT_HINTS:
        near, far = contains_any(strong, *words), contains_any(weak, *words)
        hints.append(F.when(near | (far & (structured if needs_strong else F.lit(True))), item(name, kind)))
    meta = F.coalesce(contains_any(strong, *SUPPORT_HINTS[2][0]) | contains_any(weak, *SUPPORT_HINTS[2][0]), F.lit(False))
    hints.append(F.when(structured & ~meta, item("container-metadata", "metadata")))
    return df.withColumn("support", F.slice(F.array_compact(F.array(*hints)), 1, 6))


def milestones(df: DataFrame) -> DataFrame:
    """Adds milestones: array<struct<rule,args>> of states that must be reached first; rules are the kinds."""
    state_names = F.transform(F.slice("fields", 1, 4), lambda f: F.concat_ws(".", f["owner"], f["field"]))
    targets = F.transform(F.slice("conditions", 1, 4), lambda c: c["target"])
    support = F.transform(F.slice("support", 1, 4), lambda s: s["name"])
    words = F.lower(F.concat_ws(" ", F.col("fn"), F.transform("helpers", lambda h: h["name"]), state_names, targets, support))
    setup, update = with_phase("setup"), with_phase("update", "consume")
    four = lambda *parts: F.slice(F.concat(*parts), 1, 4)
    found = ruled(
        ("object-lifecycle", some(with_role("state")) | some(F.col("fields")) | some(setup), four(setup, state_names)),
        ("container-parse", F.col("primary") == "structured-format", four(support)),
        ("incremental-feed", has(F.col("operators"), "chunked-stream") | has(F.col("secondary"), "streaming-or-incremental"), four(update)),
        ("work-unit", contains_any(words, *WORK_UNIT_WORDS), four(state_names, targets)),
        ("transform-gating", contains_any(words, *TRANSFORM_WORDS), four(support, targets)),
        ("cleanup-lifecycle", sink_role(F.col("fn")) == "cleanup", four(setup, update)),
    )
    return df.withColumn("milestones", F.slice(found, 1, 6))


def regions(df: DataFrame) -> DataFrame:
    """Adds mutable, stabilized, derived and constraints: where changes should go and what must stay consistent."""
    structured, chunked = F.col("primary") == "structured-format", has(F.col("operators"), "chunked-stream")
    unit = F.exists("fields", lambda f: contains_any(f["field"], *REGION_WORDS))
    region = lambda n, k, p: F.struct(n.alias("name"), k.alias("kind"), p.alias("priority"))
    lit = lambda n, k, p: region(F.lit(n), F.lit(k), F.lit(p))
    own = F.array_compact(F.array(F.when(unit, lit("decoded-work-unit", "row-or-block-data", "high"))))
    objects = F.transform(F.slice("support", 1, 4), lambda s: region(s["name"], s["kind"], F.when(s["kind"].isin("table", "config"), "high").otherwise("medium")))
    steer = F.array_compact(F.array(F.when(some(F.col("controls")), lit("bounded-controls", "selector-or-control", "medium"))))
    bounds = F.transform(F.filter("relations", lambda r: is_public_name(r["dependent"])), lambda r: region(r["dependent"], F.lit("derived-bound-target"), F.lit("high")))
    gate = F.array_compact(F.array(F.when(F.exists("milestones", lambda m: m["rule"] == "transform-gating"), lit("transform-config", "bounded-controls", "high"))))
    named = F.concat(own, objects, steer, bounds, gate)
    once = F.filter(named, lambda r, i: F.array_position(F.transform(named, lambda x: x["name"]), r["name"]) == i + 1)
    payload = F.array(lit("primary-payload", "buffer", "high"))
    sized = F.filter(F.transform(F.slice("conditions", 1, 4), lambda c: c["target"]), lambda t: contains_any(t, "size", "len", "count", "width", "height", "depth", "offset"))
    constraints = ruled(("recompute_container_lengths", structured, None), ("bound_chunks", chunked, None), ("keep_unit_layout", unit, None), ("keep_sizes", some(sized), sized))
    return df.withColumns({
        "mutable": F.slice(F.when(some(once), once).otherwise(payload), 1, 8),
        "stabilized": F.array_compact(F.array(F.when(structured, lit("container-skeleton", "container", "high")))),
        "derived": F.array_compact(F.array(F.when(structured, lit("container-lengths", "derived-lengths", "high")), F.when(chunked, lit("chunk-boundaries", "derived-chunking", "medium")))),
        "constraints": F.slice(constraints, 1, 8),
    })


def trigger_relations(scan: DataFrame, limit: int = 8) -> DataFrame:
    """(path, fn, ord, kind, controller, dependent, evidence, priority): bounds, edge values, and guesses if there are neither.

    Conditions are matched with parameters by exploding a condition's own
    words, an equi join, rather than by comparing all with all.
    """
    roles = facts.parameter_roles(scan)
    fields = facts.state_fields(scan).where("ord < 8")
    numeric = roles.where("role in ('numeric', 'size', 'control')")
    controllers = numeric.select(*KEY, F.struct(F.lit(0).alias("a"), "ord").alias("c_ord"), F.col("name").alias("controller"), F.lower("name").alias("word")).unionByName(
        fields.select(*KEY, F.struct(F.lit(1).alias("a"), "ord").alias("c_ord"), F.concat_ws(".", "owner", "field").alias("controller"), F.lower("field").alias("word"))
    )
    texts = scan.select(*KEY, F.posexplode("ifs").alias("i", "evidence")).withColumn("low", F.lower("evidence"))
    words = texts.select(*KEY, "i", "evidence", "low", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z_][a-z0-9_]*"), F.lit(0)))).alias("word"))
    dependents = numeric.where(is_count_like(F.col("name"))).select(*KEY, F.col("ord").alias("d_ord"), F.col("name").alias("dependent"))
    shifted = F.col("low").contains("<<") | F.col("low").contains(">>")
    bounds = words.join(controllers, [*KEY, "word"]).join(dependents, KEY).where(
        F.col("low").contains(F.lower("dependent")) & (F.col("controller") != F.col("dependent")) & (is_bound_like(F.col("controller")) | shifted)
    )
    row = lambda kind, priority: [*KEY, F.lit(kind).alias("kind"), "controller", "dependent", "evidence", F.lit(priority).alias("priority")]
    derived = bounds.select(*row("derived-bound", "high"))
    told = facts.guidance_conditions(facts.parameter_conditions(scan), roles).where("type = 'comparison'").join(roles.select(*KEY, F.col("name").alias("parameter"), "role"), [*KEY, "parameter"], "left")
    number, role = F.col("value").rlike(r"^-?\d+$"), F.coalesce("role", F.lit(""))
    useless = (role.isin("input-buffer", "output-buffer", "size", "support-buffer") & F.lower("value").isin("null", "nullptr", "z_null")) | ((role == "control") & (F.col("operator").isin("<", ">", "<=", ">=") | number))
    edges = told.where(~useless).select(*KEY, F.lit("boundary-value").alias("kind"), F.col("parameter").alias("controller"), F.col("value").alias("dependent"), F.concat_ws(" ", "parameter", "operator", "value").alias("evidence"), F.lit("medium").alias("priority"))
    found = derived.unionByName(edges)
    near = controllers.where(is_bound_like(F.col("controller")))
    guess = dependents.join(near, KEY).join(roles.select(*KEY, F.col("name").alias("dependent"), "role"), [*KEY, "dependent"])
    guess = guess.where((F.col("controller") != F.col("dependent")) & ~(is_internal_reference(F.col("controller")) & F.col("role").isin("size", "input-buffer", "output-buffer")))
    guess = guess.select(*KEY, F.lit("count-vs-bound-hypothesis").alias("kind"), "controller", "dependent", F.concat_ws(" / ", "controller", "dependent").alias("evidence"), F.lit("medium").alias("priority")).join(found.select(*KEY).distinct(), KEY, "left_anti")
    order = [~F.col("evidence").contains("=="), F.col("evidence"), F.col("kind"), F.col("controller"), F.col("dependent")]
    rows = found.unionByName(guess).distinct()
    once = rows.groupBy(*KEY, "controller", "dependent").agg(F.min_by(F.struct("kind", "evidence", "priority"), F.struct(~F.col("evidence").contains("=="), "evidence", "kind")).alias("x")).select(*KEY, "controller", "dependent", "x.*")
    return facts._numbered(facts.top_k(once, KEY, order, limit), KEY, order)


def trigger_controls(df: DataFrame) -> DataFrame:
    """Adds trigger_controls: public controls, parameters first if any, then public ends of relations."""
    public = F.filter(F.slice("controls", 1, 8), lambda c: is_public_name(c["target"]))
    own = F.filter(public, lambda c: c["source_kind"] == "parameter")
    chosen = F.transform(F.when(some(own), own).otherwise(public), lambda c: c["target"])

    def ends(r: Column) -> Column:
        open_ = is_public_name(r["controller"])
        counted = is_public_name(r["dependent"]) & is_count_like(r["dependent"]) & ((r["kind"] != "count-vs-bound-hypothesis") | open_)
        return F.array_compact(F.array(F.when(open_, r["controller"]), F.when(counted, r["dependent"])))

    return df.withColumn("trigger_controls", F.slice(F.array_distinct(F.concat(chosen, F.flatten(F.transform("relations", ends)))), 1, 8))


def notes(df: DataFrame) -> DataFrame:
    """Adds hints, preconditions, activation, cleanup, ownership, api_roles, requirements and segments."""
    role, structured = sink_role(F.col("fn")), F.col("primary") == "structured-format"
    op = lambda n: has(F.col("operators"), n)
    stabilise = F.exists("policy", lambda p: p["policy"] == "stabilize")
    public = F.array_distinct(F.transform(F.filter("controls", lambda c: is_public_name(c["target"])), lambda c: c["target"]))
    told = F.slice(F.when(some(public), public).otherwise(F.transform("controls", lambda c: c["target"])), 1, 4)
    state = some(with_role("state"))
    cap = lambda c: F.slice(c, 1, 6)
    hints = ruled(
        ("build_valid_structure", F.col("n_checks") > 0, None), ("initialise_through_api", state | some(F.col("fields")), None), ("use_setup_helpers", some(with_phase("setup")), F.array("fn")),
        ("feed_incrementally", some(with_phase("update")), None), ("reserve_selector_bits", F.exists("branches", lambda b: b["num_paths"] > 2), None), ("keep_sizes_consistent", some(with_role("size")), cap(with_role("size"))),
        ("allocate_outputs", some(with_role("output-buffer")), cap(with_role("output-buffer"))), ("populate_support", some(with_role("support-buffer")), cap(with_role("support-buffer"))),
        ("expand_records", op("repeated-records"), None), ("derive_chunks", op("chunked-stream"), None), ("bias_controls", some(told), told), ("stabilise_the_rest", stabilise, None),
    )
    given = F.transform(F.slice("support", 1, 4), lambda s: F.struct(F.lit("provide_object").alias("rule"), F.array(s["kind"], s["name"]).alias("args")))
    needs = F.concat(
        ruled(("initialise_state", state, None), ("valid_prefix", structured, None)), given,
        ruled(("populate_before_update", some(with_phase("update")), None), ("clean_up_after_use", role == "cleanup", None)),
    )
    gates = F.transform(F.filter("conditions", lambda c: F.coalesce(c["value"].isin("NULL", "Z_NULL", "0", "nullptr") | c["operator"].isin("==", "!="), F.lit(False))), lambda c: F.struct(c["target"].alias("target"), F.concat_ws(" ", c["target"], c["operator"], c["value"]).alias("text")))
    fields = F.transform(F.filter("fields", lambda f: f["kind"] != "state"), lambda f: F.struct(F.concat(f["owner"], F.lit("->"), f["field"]).alias("target"), F.concat(f["owner"], F.lit("->"), f["field"]).alias("text")))
    gated = F.concat(gates, fields)
    once = F.transform(F.filter(gated, lambda g, i: F.array_position(F.transform(gated, lambda x: x["target"]), g["target"]) == i + 1), lambda g: g["text"])
    moved = F.concat(
        F.transform(F.filter("helpers", lambda h: h["phase"].isin("setup", "update", "cleanup")), lambda h: F.concat_ws(" ", h["phase"], h["name"])),
        F.transform(F.filter("conditions", lambda c: contains_any(c["target"], "buffer", "data", "row", "image", "info", "ptr", "next")), lambda c: F.concat_ws(" ", F.lit("field"), c["target"])),
    )
    live = ruled(("structure_accepted", structured, None), ("fed_repeatedly", op("chunked-stream"), None), ("objects_valid", some(F.col("support")), F.transform(F.slice("support", 1, 4), lambda s: s["name"])))
    segments = ruled(
        ("selector", some(with_role("control")) | some(F.col("branches")), None), ("trigger-controls", some(F.col("trigger_controls")), F.slice("trigger_controls", 1, 5)), ("record-count", op("repeated-records"), None), ("container-shape", structured, None),
        ("bounded-lengths", some(with_role("size")), F.slice(with_role("size"), 1, 5)), ("support-objects", some(with_role("support-buffer")), F.slice(with_role("support-buffer"), 1, 5)),
        ("payload", (F.col("primary") != "semantic-arguments") | ~some(with_role("support-buffer")), None), ("relation-bias", some(F.col("relations")), None),
        ("chunking", has(F.col("secondary"), "streaming-or-incremental"), None), ("control-bias", op("control-biased"), None),
    )
    default = lambda c, rule: F.when(some(c), c).otherwise(ruled((rule, F.lit(True), None)))
    kept = F.transform(F.filter(F.slice("relations", 1, 6), lambda r: r["kind"].isin("derived-bound", "count-vs-bound-hypothesis")), lambda r: F.concat_ws("/", r["controller"], r["dependent"]))
    sink = ruled(
        ("vary_states_before_cleanup", role == "cleanup", None), ("clean_up_after_errors", (role == "cleanup") & (some(F.col("failures.error_labels")) | some(F.col("failures.return_checks"))), None),
        ("check_states", (role == "cleanup") & some(once), F.slice(once, 1, 4)), ("vary_before_setup", role == "setup", None), ("follow_resources", some(moved), F.slice(F.array_distinct(moved), 1, 4)),
    )
    return df.withColumns({
        "hints": default(hints, "direct_consumer"), "preconditions": F.slice(F.array_distinct(needs), 1, 8), "activation": F.slice(live, 1, 6), "cleanup": F.slice(once, 1, 6), "ownership": F.slice(F.array_distinct(moved), 1, 8),
        "api_roles": tags(("stateful", state), ("buffer-consuming", some(with_role("input-buffer"))), ("mode-driven", some(with_role("control"))), ("incremental", some(with_phase("update")))),
        "workload_rules": tags(("bounded_records", op("repeated-records")), ("ordered_chunks", op("chunked-stream")), ("small_selectors", op("control-biased")), ("stabilise", stabilise)),
        "invariants": kept, "trigger_hints": default(sink, "translate_inputs"), "segments": segments, "sink_role": role,
    })


def analyse(scan: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """All models of each scanned function; ``override`` (path, fn, primary, operators) replaces what it gives, and only that."""
    relations = trigger_relations(scan)
    ordered = F.array_sort(F.collect_list(F.struct("ord", "kind", "controller", "dependent", "evidence", "priority")))
    listed = relations.groupBy(*KEY).agg(F.transform(ordered, lambda r: F.struct(*(r[c].alias(c) for c in ("kind", "controller", "dependent", "evidence", "priority")))).alias("relations"))
    df = profile(scan).join(listed, KEY, "left").withColumn("relations", F.coalesce("relations", F.array().cast("array<struct<kind:string,controller:string,dependent:string,evidence:string,priority:string>>")))
    for step in (input_model, workload_model, exploration_policy, support_objects, milestones, regions, trigger_controls, notes):
        df = step(df)
    if override is not None:
        given = override.select(*KEY, F.col("primary").alias("_p"), F.col("operators").alias("_o"))
        df = df.join(given, KEY, "left").withColumns({"primary": F.coalesce("_p", "primary"), "operators": F.coalesce("_o", "operators")}).drop("_p", "_o")
    return df


def path_traits(names: Column) -> Column:
    """struct of booleans about a call path, by words in its joined names."""
    text = F.array_join(names, " ")
    return F.struct(*(contains_any(text, *words).alias(n) for n, words in TRAITS.items()))


def structured_path(t: Column) -> Column:
    """Whether a path's traits imply a structured input."""
    return t["container_like"] | (t["parser_like"] & t["work_unit_like"] & (t["incremental_like"] | t["transform_like"]))


def stage_of(text: Column, traits: Column, default: str) -> Column:
    parsing = traits["parser_like"] & structured_path(traits) & contains_any(text, *REGISTER_STAGE)
    return (
        F.when(contains_any(text, *PARSE_STAGE), "parse").when(contains_any(text, *TRANSFORM_STAGE), "transform")
        .when(contains_any(text, *ENTRY_STAGE), "entry").when(parsing, "parse").otherwise(default)
    )


def milestone_stage(kind: Column) -> Column:
    return F.when(kind == "object-lifecycle", "entry").when(kind.isin("container-parse", "incremental-feed", "support-contract"), "parse").when(kind == "transform-gating", "transform").otherwise("sink")


def direct_stages(traits: Column) -> Column:
    stages = lambda *s: F.array(*map(F.lit, s))
    return F.when(traits["parser_like"] & structured_path(traits), stages("entry", "parse")).when(traits["transform_like"], stages("entry", "transform")).otherwise(stages("entry", "parse", "transform", "sink"))


def stage_items(items: DataFrame, keys: Sequence[str], traits: Column) -> DataFrame:
    """Items (keys, field, ord, text, kind) with their stage: milestones by kind, calls from entry on, the rest from the sink."""
    stage = F.when(F.col("field") == "milestone", milestone_stage(F.col("kind"))).when(F.col("field") == "setup_call", stage_of(F.col("text"), traits, "entry")).otherwise(stage_of(F.col("text"), traits, "sink"))
    return items.withColumn("stage", stage)


def refine_by_path(df: DataFrame, traits: Column) -> DataFrame:
    """Input and workload models with what the wrapper path shows."""
    wrapped = traits["parser_like"] & structured_path(traits)
    add = lambda array, *pairs: F.array_union(array, tags(*pairs))
    return df.withColumns({
        "primary": F.when(wrapped, "structured-format").otherwise(F.col("primary")),
        "secondary": add(F.col("secondary"), ("magic-or-container-header", wrapped), ("parser-lifecycle", wrapped), ("streaming-or-incremental", traits["incremental_like"]), ("post-parse-work-units", traits["work_unit_like"])),
        "operators": add(F.col("operators"), ("chunked-stream", traits["incremental_like"]), ("structured-container", wrapped)),
    })
