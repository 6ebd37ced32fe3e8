"""Segmented state machines give what a reader in order gives, wherever files are split; no plan has a window over a file."""

import random
import re
from functools import reduce

import pytest

from sparkscope.operators import segmented
from sparkscope.sources import ir

DEFINE, DECLARE = re.compile(ir.DEFINE, re.ASCII), re.compile(ir.DECLARE, re.ASCII)
KINDS = (
    "define void @f{j}(i32 %a,", "  i32 %b) {{", "define i32 @g{j}(i8* %p) {{", "}}", "  call void @h{j}(i32 1)", "declare void @d{j}(i32,", "  i8*)",
    "declare i32 @e{j}(i8*)", "  store x // )", "declare @k{j}( // c", "  %1 = load", "  }}  ", "{{ x", "",
)


def in_order(lines):
    """(line_no, text, fn, defined, owner) by one reader from the first line to the last."""
    out, rest, owner = [], list(lines), None
    while rest:
        no, text = rest.pop(0)
        if DEFINE.match(text):
            while rest and "{" not in text:
                text += " " + rest.pop(0)[1].strip()
            owner = DEFINE.match(text)[1]
            out.append((no, text, owner, True, owner))
            continue
        if m := DECLARE.match(text):
            whole = text.rstrip().endswith(")")
            while rest and not whole and ")" not in text.split("//")[0]:
                text += " " + rest.pop(0)[1].strip()
            out.append((no, text, m[1], False, owner))
            continue
        owner = None if text.strip() == "}" else owner
        out.append((no, text, None, None, owner))
    return out


def made(rng, n):
    return [(2 * j + 1, rng.choice(KINDS).format(j=j)) for j in range(n)]


def test_summaries_compose():
    machine, rng = ir.SignatureMachine(), random.Random(5)
    for _ in range(3000):
        lines = made(rng, rng.randrange(1, 30))
        cuts = sorted({0, len(lines), *(rng.randrange(len(lines) + 1) for _ in range(rng.randrange(6)))})
        parts = [lines[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        told = [machine.summary(p) for p in parts]
        k = rng.randrange(1, len(told) + 1)
        whole = reduce(machine.compose, told)
        assert whole == reduce(machine.compose, [reduce(machine.compose, told[:k]), *told[k:]])
        state = machine.start
        for t in told:
            state = machine.after(state, t)
        assert state[0] == machine.after(machine.start, whole)[0] and state[2] == machine.after(machine.start, whole)[2] == machine.after(machine.start, machine.summary(lines))[2]


@pytest.mark.parametrize(("size", "fan"), [(7, 2), (4096, 256)])
def test_signature_rows(spark, monkeypatch, size, fan):
    monkeypatch.setattr(segmented, "FAN", fan)
    rng = random.Random(size)
    files = {f"f{i}.ll": made(rng, rng.choice([1, 40, 150])) for i in range(12)} | {"open.ll": [(0, "define void @o("), *made(rng, 60)]}
    df = spark.createDataFrame([(f, no, text) for f, lines in files.items() for no, text in lines], "file string, line_no int, text string").repartition(5)
    rows = ir.signature_rows(df, size)
    got = sorted((r.file, r.line_no, r.text, r.fn, r.defined, r.owner) for r in rows.collect())
    assert got == sorted((f, *r) for f, lines in files.items() for r in in_order(lines))
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert ir.signature_rows(df.where("false"), size).count() == 0


def test_files_in_rows_are_cut_where_they_are(spark):
    """Segments of files that are rows need no shuffle, give the same functions and calls, and a file of one segment has no summary."""
    text = ["define i32 @f{j}(i32 %a,", "    %struct.S* align 8 %s) {{", "  %x = load ptr, ptr @g", "  call void @h(i32 %a, f(i8* %s, 1))", "}}"]
    files = {f"d{j}": [t.format(j=j % 3) for t in text * (1 + j % 4)][: 20 - j] for j in range(8)} | {"none": [], "null": None}
    df = spark.createDataFrame(list(files.items()), "file string, lines array<string>")
    cut = segmented.segments_in_rows(df, 7)
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()
    assert {(r.file, r.seg, r.whole, len(r.lines)) for r in cut.collect() if r.file in ("d0", "d1", "none", "null")} == {("d0", 0, True, 5), ("d1", 0, False, 7), ("d1", 1, False, 3)}
    lines = spark.createDataFrame([(f, i + 1, t) for f, ts in files.items() for i, t in enumerate(ts or ())], "file string, line_no int, text string")
    told = lambda df, *columns: sorted(map(str, df.select(*columns).collect()))
    whole, parts = ir.parse_ir(lines), ir.parse_segments(cut)
    functions = ("name", "defined", "file", "line", "params", "first_seen")
    assert told(ir.read_functions(cut), *functions) == told(whole.functions, *functions) == told(parts.functions, *functions)
    assert told(parts.call_sites, "caller", "callee", "args", "ord") == told(whole.call_sites, "caller", "callee", "args", "ord")
    assert ("@g" in text[2]) and parts.global_loads.count() == whole.global_loads.count() > 0


def test_facts_by_columns_are_those_of_single_lines():
    """From every state before: signatures as they are, and of lines in bodies the matches of each pattern; columns of nulls are not made."""
    plain, machine, machine_of_functions, rng = ir.SignatureMachine(), ir.FactMachine(), ir.FactMachine(()), random.Random(6)
    more = ("  %p = load ptr, ptr @g", "  store ptr @f{j}, ptr %p", "  call void %p(i32 1)", "  invoke void @x(i32 1) call @y(i32 %a)", "  %q = getelementptr %struct.S, ptr %p, i32 0, i32 3", "define broken", "  store i32 %a, ptr %p", "  %a}}", "  call %p call", "@_ZTV{j} = constant {{ [2 x ptr] }} [ptr @f, ptr null]", "@_ZTVx call @z(i32 1) )")
    patterns = [re.compile(p.replace(".*", "[^\n\r\x85\u2028\u2029]*"), re.ASCII) for p in ir.INSTRUCTIONS]
    words = [w for w, _ in ir.INSTRUCTIONS.values()]
    rare = set()
    for _ in range(1500):
        lines = [(2 * j + 1, rng.choice((*KINDS, *more, *more)).format(j=j)) for j in range(rng.randrange(0, 25))]
        state = (rng.randrange(4), rng.choice([None, 0]), rng.choice([None, "before"]))
        truth = []
        for at, head, text, fn, defined, owner, cut in plain.rows(state, lines):
            found = [[g for m in p.findall(text) for g in ((m,) if isinstance(m, str) else m)] or None if any(x in text for x in w) else None for p, w in zip(patterns, words, strict=True)]
            if fn is not None or cut:
                truth.append((at, head, text, fn, defined, owner, cut, None, *[None] * len(found)))
            elif owner is not None and any(found):
                truth.append((at, head, None, fn, defined, owner, cut, True if any(found[1:]) else None, *found))
        got = list(machine.rows(state, lines))
        tables = [r for r in got if r[2] is not None and r[2].startswith("@_ZTV") and not r[6] and r[3] is None]
        assert tables == [(no, no, t, None, None, None, False, True, *[None] * len(patterns)) for no, t in lines if t.startswith("@_ZTV")]
        assert [r for r in got if r not in tables] == truth
        assert all(c is None or any(x is not None for x in c) for c in machine.columns(state, lines)[7:] if truth)
        rare |= {r[7] for r in truth}
        assert all(r[2] is None or not r[2].startswith("@_ZTV") for r in machine_of_functions.rows(state, lines) if r[3] is None and not r[6])
    assert rare == {None, True}


def test_tables_without_a_row_are_not_read(spark):
    """Files of direct calls alone: the tables of other patterns skip their row groups, and functions are written without parameters if none are asked for."""
    text = ["define i32 @f(i32 %a) {", "  call void @h(i32 %a)", "}"]
    df = spark.createDataFrame([(f"d{j}", text * (1 + j)) for j in range(4)], "file string, lines array<string>")
    facts = ir.parse_segments(segmented.segments_in_rows(df, 7), with_parameters=False)
    for found in (facts.flows, facts.indirect_calls, facts.fields, facts.table_slots, facts.global_loads, facts.table_entries):
        assert "IsNotNull(rare)" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 0
    assert facts.call_sites.count() == 10
    assert "ArrowEvalPython" not in facts.functions.select("name")._jdf.queryExecution().executedPlan().toString()
    assert [(r.name, [p.name for p in r.params]) for r in facts.functions.collect()] == [("f", ["a"])]


def test_parameters_of_a_signature():
    text = "define i32 @f(%struct.S* nocapture %s, i8* noundef align(4) %d, metadata i32 %m, ..., i32, [2 x (i8)] align 8 %z) {"
    found = [(p["type"], p["name"]) for p in ir.parameters_of(ir.balanced(text))]
    assert found == [("%struct.S*", "s"), ("i8*", "d"), ("i32", "param_2"), ("[2 x", "param_3")]
    assert ir.balanced("no brackets") == "" and ir.balanced("f(a(b)") == "a(b)"
