import random
from collections import deque

import pytest

from sparkscope.operators import graph
from sparkscope.sources import ir

DISPATCH = """define void @set(%struct.S* %s) {
  %1 = getelementptr inbounds %struct.S, %struct.S* %s, i32 0, i32 3
  store void (i8*)* @target_func, void (i8*)** %1, align 8
  ret void
}
define void @other(%struct.S* %s) {
  %1 = getelementptr inbounds %struct.S, %struct.S* %s, i32 0, i32 5
  store void (i8*)* @func_b, void (i8*)** %1, align 8
}
define i32 @caller(%struct.S* %s,
    i8* noundef %data, i32 %mode)
{
  %2 = getelementptr inbounds %struct.S, %struct.S* %s, i32 0, i32 3
  %3 = load void (i8*)*, void (i8*)** %2, align 8
  call void %3(i8* %data)
  call void @llvm.dbg(i8* %data)
  %4 = call i32 @helper(i8* %data, i32 %mode)
}
define void @target_func(i8* %p) {
}
define void @func_b(i8* %p) {
}
declare i32 @helper(i8*, i32)
define void @virt(ptr %o) {
  %v = load ptr, ptr %o
  %s = getelementptr inbounds ptr, ptr %v, i64 2
  %f = load ptr, ptr %s
  call void %f(ptr %o)
}
@_ZTV4Base = constant { [4 x ptr] } { [4 x ptr] [ptr null, ptr @_ZTI4Base, ptr @_ZN4Base3fooEv, ptr @_ZN4Base3barEv] }
"""


def facts(spark, *texts):
    files = spark.createDataFrame([(f"f{i}.ll", t) for i, t in enumerate(texts)], "file string, text string")
    return ir.parse_ir(ir.lines_of(files))


def edges(df):
    return {(r.caller, r.callee, r.kind) for r in df.collect()}


def test_ir_to_edges(spark):
    found = facts(spark, DISPATCH)
    functions = {r.name: r for r in found.functions.collect()}
    assert [(p.type, p.name) for p in functions["caller"].params] == [("%struct.S*", "s"), ("i8*", "data"), ("i32", "mode")]
    assert not functions["helper"].defined and [p.name for p in functions["helper"].params] == ["param_0", "param_1"]
    assert edges(graph.call_edges(found)) == {("caller", "helper", "direct"), ("caller", "target_func", "indirect"), ("virt", "_ZN4Base3fooEv", "indirect")} | {("caller", "llvm", "direct")} - {("caller", "llvm", "direct")}
    sites = found.call_sites.collect()
    assert [(r.callee, r.args) for r in sites] == [("helper", ["i8* %data", "i32 %mode"])]


def test_registers_belong_to_their_function(spark):
    text = """define void @a() {
  store ptr @f, ptr %x
  %y = load ptr, ptr %x
  call void %y()
}
define void @b() {
  %y = load ptr, ptr %x
  call void %y()
}
define void @c() {
  %g = load ptr, ptr @f
  call void %g()
}
define void @f() {
}
"""
    assert edges(graph.call_edges(facts(spark, text))) == {("a", "f", "indirect"), ("c", "f", "indirect")}


def test_too_many_targets_are_none(spark):
    stores = "\n".join(f"  store ptr @f{i}, ptr %x" for i in range(5))
    bodies = "\n".join(f"define void @f{i}() {{\n}}" for i in range(5))
    text = f"define void @a() {{\n{stores}\n  %y = load ptr, ptr %x\n  call void %y()\n}}\n{bodies}"
    found = facts(spark, text)
    assert edges(graph.call_edges(found, 4)) == set()
    assert len(edges(graph.call_edges(found, 5))) == 5


def test_the_last_definition_counts_and_a_declaration_only_without_one(spark):
    one = "declare void @f(i8*)\ndefine void @f(i32 %a) {\n}\ndeclare void @g(i8* %x)"
    two = "define void @f(i64 %b) {\n}\ndeclare void @f(i8*, i8*)\ndeclare void @g(i32 %y)"
    rows = {r.name: (r.defined, r.file, [p.type for p in r.params]) for r in facts(spark, one, two).functions.collect()}
    assert rows == {"f": (True, "f1.ll", ["i64"]), "g": (False, "f0.ll", ["i8*"])}


def plain_paths(pairs, sink, public):
    callers = {}
    for a, b in pairs:
        callers.setdefault(b, set()).add(a)
    seen, queue, found = {sink}, deque([[sink]]), {}
    if sink in public:
        found[sink] = [sink]
    while queue:
        path = queue.popleft()
        if path[-1] in public and len(path) > 1:
            continue
        for c in sorted(callers.get(path[-1], ())):
            if c not in seen:
                seen.add(c)
                queue.append([*path, c])
                if c in public:
                    found[c] = [*path, c]
    return found


@pytest.mark.parametrize("seed", range(4))
def test_reverse_paths_are_those_of_a_queue(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    pairs = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(28)}
    public = set(rng.sample(nodes, 5))
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    got = graph.reverse_paths(frame(list(pairs), "caller string, callee string"), frame([("n0",)], "name string"), frame([(p,) for p in public], "name string"))
    assert {r.node: r.path for r in got.collect()} == plain_paths(pairs, "n0", public)


def test_long_reverse_paths_are_whole_or_raise(spark):
    chain = spark.createDataFrame([(f"c{i + 1}", f"c{i}") for i in range(20)], "caller string, callee string")
    ends = [spark.createDataFrame([(n,)], "name string") for n in ("c0", "c20")]
    assert [(r.node, r.depth) for r in graph.reverse_paths(chain, *ends).collect()] == [("c20", 20)]
    with pytest.raises(RuntimeError, match="10 levels"):
        graph.reverse_paths(chain, *ends, max_depth=10)


@pytest.mark.parametrize("seed", range(3))
def test_pointer_fixpoint_against_a_plain_model(spark, seed):
    rng = random.Random(seed)
    flows = {(rng.choice("ab"), f"r{rng.randrange(8)}", f"r{rng.randrange(8)}") for _ in range(20)}
    seeds = {(rng.choice("ab"), f"r{rng.randrange(8)}", f"f{rng.randrange(3)}") for _ in range(4)}
    known = set(seeds)
    while True:
        more = {(o, d, t) for o, d, s in flows for p, q, t in known if p == o and q == s} - known
        if not more:
            break
        known |= more
    got = graph.pointer_fixpoint(spark.createDataFrame(list(seeds), "owner string, ptr string, target string"), spark.createDataFrame(list(flows), "owner string, dst string, src string"))
    assert {tuple(r) for r in got.collect()} == known


def test_scores_and_flow(spark):
    text = """define void @parse_doc(i8* %data, i32 %mode, %struct.C* %ctx) {
  %1 = getelementptr inbounds %struct.C, %struct.C* %data, i32 0, i32 1
  call void @mid(i8* %1, i32 %mode)
}
define void @mid(i8* %a, i32 %b) {
  call void @sink(i8* %a, i8* %a, i32 %b)
}
define void @sink(i8* %p, i8* %q, i32 %r) {
  call void @leaf(i32 5)
}
define void @leaf(i32 %z) {
}
"""
    found = facts(spark, text)
    flows = graph.edge_flow(found.call_sites, found.functions, found.fields)
    assert {(r.caller, r.caller_idx, r.callee_idx) for r in flows.collect()} == {("parse_doc", 0, 0), ("parse_doc", 1, 1), ("mid", 0, 0), ("mid", 0, 1), ("mid", 1, 2)}
    paths = spark.createDataFrame([(1, ["parse_doc", "mid", "sink"]), (2, ["parse_doc", "mid", "sink", "leaf"]), (3, ["unknown", "sink"])], "path_id int, hops array<string>")
    got = {r.path_id: r for r in graph.trace_flow(paths, found.functions, flows).collect()}
    # places 0 and 1 count as data (i8* and i32), 1 as a control: 20 + 4; the name 8; hops -2; flows 16 + 24; three survive 18
    assert got[1].score == 20 + 4 + 8 - 2 + 16 + 24 + 18 and got[1].controlled == {0: 0, 1: 0, 2: 1}
    assert got[2].score == 20 + 4 + 8 - 3 + 16 + 24 - 2 and got[2].controlled == {}
    assert got[3].score == -1 - 2


def test_the_last_flow_into_a_place_keeps_its_origin(spark):
    flows = spark.createDataFrame([(1, 1, 0, 2, 1), (1, 1, 1, 2, 2), (1, 2, 2, 0, 1)], "path_id int, hop int, caller_idx long, callee_idx long, ord int")
    assert [tuple(r) for r in graph.trace_hops(flows, 2, 2).collect()] == [(1, 0, 1)]


def test_ir_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.ll").write_text("define void @f() {\n  call void @g()\n}")
    (tmp_path / "b.txt").write_text("define void @no() {")
    lines = ir.read_ir_lines(spark, str(tmp_path))
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == [1, 2, 3]
    (tmp_path / "long").mkdir()
    text = [f"; line {i} " + "x" * (i % 50) for i in range(3000)]
    (tmp_path / "long" / "b.ll").write_text("\n".join(text))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # a file in many splits
    try:
        many = ir.read_ir_lines(spark, str(tmp_path / "long"))
        assert many.rdd.getNumPartitions() > 4 and [r.text for r in many.orderBy("line_no").collect()] == text
        assert [r.line_no for r in many.orderBy("line_no").collect()] == list(range(1, 3001))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert edges(graph.call_edges(ir.parse_ir(lines))) == {("f", "g", "direct")}


def test_empty_input(spark):
    assert edges(graph.call_edges(facts(spark, ""))) == set()
