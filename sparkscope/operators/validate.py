"""Validation of recorded candidate texts against a plan: text features, then a table of rules.

Candidates are (id, code); plans are columns beside it (see ``PLAN``). Features
and rules are Spark expressions; only what needs balanced bodies runs in Arrow
batches. Each finding is a row, so a rule may fire several times.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.functions import ctext
from sparkscope.functions.names import contains_any, relation_token
from sparkscope.operators.rules import verdicts

#: Plan columns beside (id, code); all may be null.
PLAN = (
    "entry string, sink string, cwe string, setup_candidates array<string>, setup_calls array<string>, roles array<struct<name:string,role:string>>, has_state_fields boolean, operators array<string>, "
    "primary string, container_synthesis boolean, milestones array<string>, controls int, policies array<string>, trigger_controls array<string>, "
    "relations array<struct<kind:string,controller:string,dependent:string,evidence:string,priority:string>>, profiles int, setup_requirements array<string>, invariants array<string>, error_calls int, "
    "support array<struct<name:string,required_fields:array<string>>>, support_words array<string>, regions array<struct<name:string,kind:string,priority:string>>, stabilized int, "
    "deferred_transform boolean, transform_calls array<string>, placement array<string>"
)
# Weakness classes that are leaks, and those for which some warnings do not apply.
LEAKS = ("CWE-401", "CWE-772", "CWE-775")
UNBOUNDED = ("CWE-190", "CWE-191", "CWE-674", "CWE-770", "CWE-789")
GATED = ("CONSTANT_SUPPORT_TABLE", "ENTROPY_TOO_BROAD", "WEAK_INVARIANT_EVIDENCE")
# Text patterns of the features.
PARSER_NAME = r"(?i)parse|read|decode|load|deserialize|from_?(?:string|buffer|data|bytes|json|xml|yaml|cbor|msgpack)"
SELECTOR = r"%|switch|static\s+const\s+.*\[\]|case\s+[-_A-Za-z0-9]+\s*:"
STATE_SETUP = r"(?i)\b[A-Za-z_][A-Za-z0-9_:]*(?:init|create|open|setup|begin|alloc)[A-Za-z0-9_:]*\s*\("
APPEND = (
    r"(?is)memcpy\s*\([^\)]*\+\s*[A-Za-z_][A-Za-z0-9_]*\s*,\s*data\s*,\s*[A-Za-z_][A-Za-z0-9_]*\)|\b(?:append|insert|assign)\s*\([^\)]*\bdata\b"
    r"|if\s*\([^\)]*extra[^\)]*\)\s*std::memcpy\s*\([^\)]*data[^\)]*\)|ConsumeRemainingBytes\s*\("
)
SHAPING = (
    r"(?i)\b(?:header|magic|signature|container|record|frame|section|packet|block|table|prefix|payload)\b",
    r"(?i)\b(?:append|push_back|insert|resize|reserve|assign|emplace_back|clear)\s*\(",
    r"(?i)\b(?:memcpy|memmove|copy|fill_n)\s*\(",
    r"(?i)\b(?:crc|checksum|adler|hash|htonl|htons|writebe|writele|bswap)\w*\s*\(",
    r"(?i)\b(?:std::)?(?:vector|string|array)\s*<",
    r"(?i)\b(?:uint(?:8|16|32|64)_t|unsigned\s+char|char)\s+[A-Za-z_][A-Za-z0-9_]*\s*\[[^\]]+\]",
)
STAGED = r"payload_buffer|container|record|frame|section|packet|row_storage\.data\(|scratch\.data\(|staged\.data\(|assembled\.data\("
NULL_WORD = r"(?i)\b(?:nullptr|null|z_null)\b"
HELPER_WORDS = ("set", "init", "create", "config", "transform", "update", "combine", "progressive", "record", "header", "frame")
CLEANUP_WORDS = ("delete", "free", "destroy", "close", "release", "cleanup", "teardown", "finalize")
CREATE_WORDS = ("create", "init", "open", "setup", "begin", "alloc")
SKIPPED_SETUP = ("create", "destroy", "free", "cleanup", "close", "setjmp", "longjmp", "memcpy", "memmove", "memset")
MODE_MARKS = r"TYPE|MODE|FORMAT|KIND|CLASS|PROFILE|COLOR"


def _array(name: str) -> Column:
    return F.coalesce(F.col(name), F.array())


def calls(code: Column, name: Column) -> Column:
    """Number of calls of a named function."""
    return F.when(F.coalesce(name, F.lit("")) == "", 0).otherwise(F.regexp_count(code, F.concat(F.lit(r"\b"), name, F.lit(r"\s*\("))))


def calls_family(code: Column, name: Column) -> Column:
    """Whether a function, or one with the same stem of four letters or more, is called."""
    stem = F.regexp_replace(name, r"[\d_]+$", "")
    return (calls(code, name) > 0) | ((F.length(stem) >= 4) & F.regexp_like(code, F.concat(F.lit(r"\b"), stem, F.lit(r"[A-Za-z0-9_]*\s*\("))))


def call_arguments(code: Column, name: Column) -> Column:
    """What follows each call's bracket up to the statement's last one, in lower case."""
    found = F.regexp_extract_all(code, F.concat(F.lit(r"(?s)\b"), name, F.lit(r"\s*\(([^;]+)\)")), F.lit(1))
    return F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(found, lambda a: F.lower(a)))


def _own_buffer(args: Column) -> Column:
    return args.contains(".data(") & ~args.rlike(r"\bdata\s*\.data\s*\(")


def features(df: DataFrame) -> DataFrame:
    """Adds the booleans and lists that the rules read."""
    code, args = F.col("code"), F.col("_args")
    words = _array("support_words")
    shaping = F.when(F.exists(args, _own_buffer), 2).otherwise(0)
    for p in SHAPING:
        shaping = shaping + code.rlike(p).cast("int")
    raw = F.exists(args, lambda a: a.rlike(r"\bdata\b") & a.rlike(r"\b(size|payload_size|len)\b") & ~_own_buffer(a) & ~a.rlike(STAGED) & ~a.contains("memcpy"))
    passed = F.exists(args, lambda a: ~_own_buffer(a) & a.rlike(r"data \+|data,|data \)|reinterpret_cast<[^>]+>\s*\(\s*data\b"))
    driven = F.exists(words, lambda w: F.regexp_like(code, F.concat(F.lit(r"(?i)\b"), w, F.lit(r"(?:\s*\[[^\]]+\][^;\n]*|[^\n;=]*)=\s*.*data"))))
    names = F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_][A-Za-z0-9_:]*)\s*\("), F.lit(1))
    configured = F.exists(names, lambda n: ~F.lower(n).isin("setjmp", "memset", "memcpy", "if", "for", "while", "return", "sizeof") & (contains_any(n, "transform", "option", "config", "convert", "scale") | F.exists(words, lambda w: F.lower(n).contains(w))))
    return df.withColumn("code", F.coalesce("code", F.lit(""))).withColumn("_args", call_arguments(code, F.col("entry"))).withColumns({
        "parser_entry": F.coalesce(F.col("entry").rlike(PARSER_NAME), F.lit(False)), "leak": F.coalesce(F.col("cwe").isin(*LEAKS), F.lit(False)), "has_loop": code.rlike(r"\b(for|while|do)\b"), "has_selector": code.rlike(SELECTOR),
        "has_setup": code.rlike(STATE_SETUP), "shaped": shaping >= 2, "raw_call": raw, "passthrough": passed, "appends": code.rlike(APPEND), "driven": driven, "configured": configured,
        "data_uses": F.regexp_count(code, F.lit(r"\bdata\s*(?:\[|\+|,|\))")), "needs_state": F.exists(_array("roles"), lambda r: r["role"] == "state"), "before": F.element_at(F.split(code, F.concat(F.lit(r"\b"), F.coalesce("entry", F.lit("-")), F.lit(r"\s*\(")), 2), 1),
    })


def statements() -> Column:
    """array<struct<fn,args>> of the call statements before the entry call, one call at the start of a line each."""
    found = F.regexp_extract_all("before", F.lit(r"(?m)^[ \t]*([A-Za-z_][A-Za-z0-9_:]*\s*\([^;{}]*\)[^;{}()]*;)"), F.lit(1))
    parts = F.transform(found, lambda s: F.struct(F.regexp_extract(s, r"^([A-Za-z_][A-Za-z0-9_:]*)", 1).alias("fn"), F.regexp_extract(s, r"(?s)^[^(]*\((.*)\)", 1).alias("args")))
    return F.filter(parts, lambda s: ~s["fn"].isin("if", "for", "while", "switch", "return"))


def setup_statements() -> Column:
    """Statements that configure a state parameter: not creation, release or memory calls, and naming it."""
    states = F.transform(F.filter(_array("roles"), lambda r: r["role"] == "state"), lambda r: F.lower(r["name"]))
    return F.filter(statements(), lambda s: ~contains_any(s["fn"], *SKIPPED_SETUP) & F.exists(states, lambda t: F.lower(s["args"]).contains(t)))


def setup_bound(relation: Column) -> Column:
    """struct<ok,reason>: whether words of set-up calls take part in the dependent's bound."""
    identifiers = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), lambda w: F.lower(w))
    dependent, controller = relation_token(relation["dependent"]), relation_token(relation["controller"])
    assigned = F.transform(F.regexp_extract_all("before", F.lit(r"([A-Za-z_][A-Za-z0-9_]*\s*=\s*[^;=]+);"), F.lit(1)), lambda a: F.struct(F.lower(F.regexp_extract(a, r"^(\w+)", 1)).alias("l"), F.regexp_extract(a, r"(?s)=\s*(.*)$", 1).alias("r")))
    bound = F.filter(assigned, lambda a: (a["l"] == dependent) | F.lower(a["r"]).contains(dependent))
    first = F.flatten(F.transform(bound, lambda a: identifiers(a["r"])))
    wide = F.filter(assigned, lambda a: F.array_contains(first, a["l"]) & (a["r"].rlike("<<|>>|max|min|bound|limit") | F.lower(a["r"]).contains(dependent)))
    inside = F.array_distinct(F.concat(first, F.flatten(F.transform(wide, lambda a: identifiers(a["r"])))))
    states = F.flatten(F.transform(F.filter(_array("roles"), lambda r: r["role"] == "state"), lambda r: F.split(F.lower(r["name"]), "[^a-z0-9_]+")))
    ignored = F.concat(states, F.array(F.lit("int"), F.lit("long"), F.lit("short"), F.lit("unsigned"), F.lit("size_t"), F.lit("max"), F.lit("min"), dependent, controller))
    varied = F.flatten(F.transform(setup_statements(), lambda s: identifiers(s["args"])))
    shared = F.array_sort(F.array_intersect(F.array_except(inside, ignored), varied))
    reason = F.when(F.size(states) == 0, "no_state").when(F.size(varied) == 0, "no_setup_call").when(F.size(bound) == 0, "no_bound").when(F.size(shared) == 0, "bound_is_independent").otherwise(F.concat(F.lit("shared: "), F.array_join(F.slice(shared, 1, 4), ", ")))
    return F.struct(reason.startswith("shared").alias("ok"), reason.alias("reason"))


def relation_evidence(relation: Column) -> Column:
    """Whether the text exercises a relation: its ends share a line, a line bounds one of them, or its evidence is there."""
    low = F.lower("code")
    c, d = relation_token(relation["controller"]), relation_token(relation["dependent"])
    holds = lambda line, word: (word != "") & line.contains(word)
    lined = F.exists(F.split(low, "\n"), lambda x: (holds(x, c) & holds(x, d)) | (holds(x, d) & x.rlike("max|min|bound|limit|<<|>>")) | (holds(x, c) & x.rlike("<<|>>|%|max|min")))
    value = low.contains(c) & (low.contains(F.lower(relation["dependent"])) | low.rlike(r"%|switch|if \("))
    said = F.lower(F.coalesce(relation["evidence"], F.lit("")))
    return F.when(relation["kind"] == "boundary-value", value).otherwise(lined | ((said != "") & low.contains(said)))


def relation_diagnostics(relation: Column) -> Column:
    """struct<kind,controller,dependent,priority,ok,reason>"""
    bound = setup_bound(relation)
    special = relation["kind"] == "setup-state-bound-hypothesis"
    ok = F.when(special, bound["ok"]).otherwise(relation_evidence(relation))
    reason = F.when(special, bound["reason"]).otherwise(F.when(ok, "found").otherwise("not_found"))
    return F.struct(*(relation[n].alias(n) for n in ("kind", "controller", "dependent", "priority")), ok.alias("ok"), reason.alias("reason"))


def null_helper_calls() -> Column:
    """Names of helper calls with null placeholders where a real object is due, six at most."""
    found = F.regexp_extract_all("code", F.lit(r"\b([A-Za-z_][A-Za-z0-9_:]*\s*\([^)\n]*)\)\s*;"), F.lit(1))
    parts = F.transform(found, lambda s: F.struct(F.regexp_extract(s, r"^([^\s(]+)", 1).alias("fn"), F.regexp_extract(s, r"\((.*)$", 1).alias("args")))

    def bad(p: Column) -> Column:
        args = F.filter(F.split(p["args"], ","), lambda a: F.trim(a) != "")
        nulls = F.size(F.filter(args, lambda a: a.rlike(NULL_WORD)))
        related = F.exists(_array("support_words"), lambda w: F.lower(p["fn"]).contains(w) | F.lower(p["args"]).contains(w)) | p["args"].rlike(r"(^|[^A-Za-z_])\d{1,6}([^A-Za-z_]|$)")
        return F.lower(p["args"]).contains("null") & ~((F.size(args) >= 3) & (nulls <= 1)) & contains_any(p["fn"], *HELPER_WORDS) & ~contains_any(p["fn"], *CLEANUP_WORDS) & related

    return F.slice(F.transform(F.filter(parts, bad), lambda p: p["fn"]), 1, 6)


def null_setup_calls() -> Column:
    found = F.regexp_extract_all("code", F.lit(r"(?s)\b([A-Za-z_][A-Za-z0-9_:]*\s*\(.*?)\)"), F.lit(1))
    parts = F.filter(found, lambda s: contains_any(F.regexp_extract(s, r"^([^\s(]+)", 1), *CREATE_WORDS) & (F.size(F.regexp_extract_all(s, F.lit(NULL_WORD), F.lit(0))) >= 2))
    return F.slice(F.transform(parts, lambda s: F.regexp_extract(s, r"^([^\s(]+)", 1)), 1, 4)


def requirement_seen(requirement: Column) -> Column:
    """Whether one of the first four longer words of a requirement is in the text."""
    words = F.slice(F.filter(F.split(F.lower(requirement), "[^a-z0-9_]+"), lambda w: F.length(w) >= 5), 1, 4)
    return F.exists(words, lambda w: F.lower("code").contains(w))


def support_built() -> Column:
    """All required fields of the objects that the text mentions are in it."""
    whole = lambda f: F.regexp_like("code", F.concat(F.lit(r"\b"), f, F.lit(r"\b")))
    return F.forall(_array("support"), lambda s: ~F.lower("code").contains(F.lower(s["name"])) | F.forall(F.coalesce(s["required_fields"], F.array()), whole))


_PLACED = pa.struct([("registered", pa.list_(pa.string())), ("empty", pa.list_(pa.string())), ("early", pa.list_(pa.string()))])


def _placements(code: str, entry: str | None, apis: list[str], candidates: list[str]) -> dict[str, list[str]]:
    """Callbacks of a deferred stage: those defined here, those that lack its calls, and stage calls made too early."""
    bodies: dict[str, tuple[int, int] | None] = {}

    def body(name: str) -> tuple[int, int] | None:
        if name not in bodies:
            bodies[name] = ctext.function_body(code, name)
        return bodies[name]

    named = [c for c in candidates if c.isidentifier() and c in code]
    own = [c for c in named if body(c)]
    plain = ctext.Brackets(code, "(", ")")
    for site in (c for c in named if not body(c)):
        for at in ctext.call_places(code, site):
            opener = code.index("(", at)
            words = ctext._IDENTIFIER.findall(code[opener : plain.close(opener)])
            own += [w for w in dict.fromkeys(words) if w not in ("nullptr", "NULL", "void", "static", "const") and w not in own and body(w)]
    own = own[:8]
    inside = {n: {m for m in ctext._IDENTIFIER.findall(code[body(n)[0] : body(n)[1]]) if ctext.call_places(code[body(n)[0] : body(n)[1]], m)} for n in own}
    empty = [n for n in own if apis and not inside[n] & set(apis)]
    limit = min(ctext.call_places(code, entry) if entry else [], default=-1)
    early = [a for a in apis if any(p < limit and not any(body(n)[0] <= p < body(n)[1] for n in own) for p in ctext.call_places(code, a))]
    return {"registered": own, "empty": empty[:4], "early": list(dict.fromkeys(early))[:4]}


def placements(code: Column, entry: Column, apis: Column, candidates: Column) -> Column:
    @F.arrow_udf("struct<registered:array<string>,empty:array<string>,early:array<string>>")
    def place(c: pa.Array, e: pa.Array, a: pa.Array, n: pa.Array) -> pa.Array:
        rows = zip(c.to_pylist(), e.to_pylist(), a.to_pylist(), n.to_pylist(), strict=True)
        return pa.array([_placements(x or "", y, z or [], w or []) for x, y, z, w in rows], _PLACED)

    return place(code, entry, apis, candidates)


def dead_support_state() -> Column:
    """Names with a support word that are only ever assigned, four at most."""
    names = F.array_distinct(F.concat(*(F.regexp_extract_all("code", F.lit(p), F.lit(1)) for p in (r"([A-Za-z_][A-Za-z0-9_]*(?:->|\.)[A-Za-z_][A-Za-z0-9_]*)\s*\[[^\]]+\]\s*=", r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\[[^\]]+\]\s*="))))
    quoted = lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))
    count = lambda p: F.regexp_count("code", p)
    dead = lambda n: (count(quoted(n)) == count(F.concat(quoted(n), F.lit(r"\s*\[[^\]]+\]\s*=")))) & (count(F.concat(F.lit(r"\([^\)]*"), quoted(n), F.lit(r"[^\)]*\)"))) == 0)
    return F.slice(F.filter(names, lambda n: F.exists(_array("support_words"), lambda w: F.lower(n).contains(w)) & dead(n)), 1, 4)


@dataclass(frozen=True)
class Check:
    """A rule: where it applies, what it is about (one finding per item if it lists items), its level and penalty."""

    rule: str
    level: str
    penalty: Column | int
    when: Column | None = None
    items: Column | None = None
    critical: bool = False


def checks() -> list[Check]:
    c = F.col
    op, mile, primary = (lambda n: F.array_contains(_array("operators"), n)), (lambda n: F.array_contains(_array("milestones"), n)), c("primary")
    parser, soft = c("parser_entry"), c("parser_entry") | c("leak")
    missing = F.filter(F.slice(_array("setup_calls"), 1, 4), lambda n: ~calls_family(F.col("code"), n))
    missed = F.filter("diagnostics", lambda r: ~r["ok"])
    hard = lambda r: (r["priority"] == "high") & ~F.col("leak")
    pair = lambda r: F.concat_ws("/", r["controller"], r["dependent"])
    staged = F.coalesce(c("container_synthesis"), F.lit(False)) | mile("container-parse") | mile("incremental-feed") | op("chunked-stream")
    built = support_built() | (F.size(_array("support")) == 0)
    nulls = F.when(c("needs_state") & (F.coalesce("error_calls", F.lit(0)) > 0) & ~c("code").contains("setjmp("), null_setup_calls()).otherwise(F.array().cast("array<string>"))
    any_setup = F.exists(_array("setup_candidates"), lambda n: calls_family(F.col("code"), n))
    modes = F.size(F.array_distinct(F.filter(F.regexp_extract_all("before", F.lit(r"=\s*([A-Z][A-Z0-9_]{2,})\s*;"), F.lit(1)), lambda t: t.rlike(MODE_MARKS)))) >= 3
    broad = (F.coalesce("profiles", F.lit(0)) > 0) & c("before").rlike(r"(?i)\b(setup|state|control|selector|mode|kind|type)\w*\b") & modes
    high = F.exists(_array("regions"), lambda r: r["priority"] == "high")
    deferred = F.coalesce(c("deferred_transform"), F.lit(False))
    unseen = lambda name: F.filter(F.slice(_array(name), 1, 3), lambda r: ~requirement_seen(r))
    direct = c("raw_call")
    v, w = "violation", "warning"
    return [
        Check("MISSING_ENTRY_CALL", v, 40, (F.coalesce("entry", F.lit("")) != "") & (calls(c("code"), c("entry")) == 0), critical=True),
        Check("MISSING_STATE_SETUP", v, 25, (F.size(_array("setup_candidates")) > 0) & (c("needs_state") | F.coalesce("has_state_fields", F.lit(False))) & ~any_setup),
        Check("MISSING_SETUP_CALLS_SOFT", w, 8, soft & (F.size(missing) > 0)),
        Check("MISSING_SETUP_CALLS", v, 20, ~soft & (F.size(missing) > 0)),
        Check("MISSING_REPEATED_RECORDS_LOOP", v, 20, op("repeated-records") & ~c("has_loop") & ~parser),
        Check("MISSING_CHUNKED_STREAM_LOOP", v, 20, op("chunked-stream") & ~c("has_loop") & ~parser),
        Check("RAW_BUFFER_STRUCTURED_INPUT", v, 20, ~parser & (primary == "structured-format") & direct),
        Check("MISSING_CONTAINER_SYNTHESIS", v, 25, ~parser & c("container_synthesis") & direct & ~c("shaped")),
        Check("RAW_PASSTHROUGH_STAGED_INPUT", v, 25, ~parser & staged & c("passthrough") & ~c("shaped")),
        Check("MISSING_SELECTOR_LOGIC", w, 8, (F.coalesce("controls", F.lit(0)) > 0) & ~c("has_selector")),
        Check("ENTROPY_OVER_SPREAD", w, 5, F.array_contains(_array("policies"), "stabilize") & (F.regexp_count("code", F.lit(r"data\[")) > 8)),
        Check("RAW_BUFFER_SEMANTIC_ARGS", v, 20, ~parser & (primary == "semantic-arguments") & direct),
        Check("MISSING_TRIGGER_CONTROL_SELECTOR", w, 8, (F.size(_array("trigger_controls")) > 0) & ~c("has_selector")),
        Check("TRIGGER_RELATION_MISS", v, 18, items=F.transform(F.filter(missed, hard), pair)),
        Check("TRIGGER_RELATION_MISS_SOFT", w, 6, items=F.transform(F.filter(missed, lambda r: ~F.coalesce(hard(r), F.lit(False))), pair)),
        Check("BROAD_SETUP_MODE_SWITCH", w, 8, broad),
        Check("MISSING_SETUP_REQUIREMENT", w, F.when(c("leak"), 2).otherwise(4), items=unseen("setup_requirements")),
        Check("SETJMP_ABORT_CONFLICT", v, 20, c("code").contains("setjmp(") & c("code").contains("abort()"), critical=True),
        Check("NULL_HELPER_CALL", v, 20, items=null_helper_calls()),
        Check("WEAK_SUPPORT_OBJECT_SOFT", w, 6, soft & ~built),
        Check("WEAK_SUPPORT_OBJECT", v, 18, ~soft & ~built),
        Check("NULL_CALLBACK_SETUP_SOFT", w, 8, parser & (F.size(nulls) > 0)),
        Check("NULL_CALLBACK_SETUP", v, 25, ~parser & (F.size(nulls) > 0)),
        Check("MISSING_OBJECT_LIFECYCLE", v, 20, mile("object-lifecycle") & ~any_setup & ~c("has_setup")),
        Check("MISSING_CONTAINER_SHAPING", v, 20, ~parser & mile("container-parse") & (primary == "structured-format") & ~c("shaped")),
        Check("MISSING_INCREMENTAL_FEED", v, 18, mile("incremental-feed") & ~c("has_loop") & ~parser),
        Check("MISSING_TRANSFORM_CONFIG", w, 6, mile("transform-gating") & ~c("configured")),
        Check("MISSING_DEFERRED_TRANSFORM", w, 6, deferred & ~c("configured")),
        Check("EMPTY_TRANSFORM_CALLBACK", v, 20, deferred & (F.size("placed.empty") > 0), critical=True),
        Check("EARLY_TRANSFORM_CALL", v, 20, deferred & (F.size("placed.early") > 0), critical=True),
        Check("DEAD_SUPPORT_STATE", w, 6, deferred & (F.size(dead_support_state()) > 0)),
        Check("WEAK_WORK_UNIT_EVIDENCE", w, 6, mile("work-unit") & ~(c("has_loop") | c("shaped"))),
        Check("TRAILING_APPEND_HIGH_VALUE", v, 20, high & c("appends") & ~c("driven")),
        Check("TRAILING_APPEND_WORK_UNIT", v, 18, F.exists(_array("regions"), lambda r: r["name"] == "decoded-work-unit") & c("appends")),
        Check("CONSTANT_SUPPORT_TABLE", w, 6, F.exists(_array("regions"), lambda r: r["kind"].isin("table", "config")) & ~c("driven")),
        Check("ENTROPY_TOO_BROAD", w, 5, (F.coalesce("stabilized", F.lit(0)) > 0) & (c("data_uses") > 14) & (primary == "structured-format")),
        Check("WEAK_INVARIANT_EVIDENCE", w, 4, items=unseen("invariants")),
    ]


def validate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, level, penalty, critical, item, ord): every finding of every candidate."""
    df = features(candidates).withColumn("diagnostics", F.transform(F.slice(_array("relations"), 1, 6), relation_diagnostics))
    df = df.withColumn("placed", placements(F.col("code"), F.col("entry"), _array("transform_calls"), _array("placement")))
    found = []
    for i, k in enumerate(checks()):
        items = k.items if k.items is not None else F.when(F.coalesce(k.when, F.lit(False)), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        if k.rule in GATED:
            items = F.when(F.coalesce(F.col("cwe").isin(*UNBOUNDED), F.lit(False)), F.array().cast("array<string>")).otherwise(items)
        penalty = k.penalty if isinstance(k.penalty, Column) else F.lit(k.penalty)
        found.append(_tagged(items, k, penalty, i))
    return df.select(*keys, F.explode(F.concat(*found)).alias("f")).select(*keys, "f.*")


def _tagged(items: Column, k: Check, penalty: Column, ord_: int) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit(k.rule).alias("rule"), F.lit(k.level).alias("level"), penalty.alias("penalty"), F.lit(k.critical).alias("critical"), x.alias("item"), F.lit(ord_).alias("ord")))


def reports(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, findings, ok, violations, warnings, relations_ok) of every candidate, the clean ones included."""
    found = validate(candidates, keys)
    scored = verdicts(found, keys).join(found.groupBy(*keys).agg(F.count_if(F.col("level") == "violation").alias("violations"), F.count_if(F.col("level") == "warning").alias("warnings")), keys)
    told = features(candidates).select(*keys, F.size(F.filter(F.transform(F.slice(_array("relations"), 1, 6), relation_diagnostics), lambda r: r["ok"])).alias("relations_ok"))
    zero = {"findings": F.coalesce("findings", F.lit(0)), "violations": F.coalesce("violations", F.lit(0)), "warnings": F.coalesce("warnings", F.lit(0)), "ok": F.coalesce("ok", F.lit(True)), "score": F.coalesce("score", F.lit(100)).cast("long")}
    return told.join(scored, keys, "left").withColumns(zero)
