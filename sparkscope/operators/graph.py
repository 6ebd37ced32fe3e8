"""Program-graph operators: edges, pointer resolution, reverse paths, path scores and parameter flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.functions.names import contains_any
from sparkscope.operators.ordered import top_k
from sparkscope.session import materialise
from sparkscope.sources.ir import ProgramFacts

#: Most targets an indirect call may resolve to before it counts as unresolved.
MAX_TARGETS = 24

# Names that keep a pointer parameter from counting as data, and that mark a control parameter.
NOT_DATA = ("parser", "ctx", "context", "handle", "state", "self", "this", "instance", "userdata", "allocator", "deleter", "traits")
CONTROL = ("mode", "type", "flag", "flags", "strategy", "method", "level", "window", "mem", "kind", "op", "cmd", "count")
# Type texts that count as data pointers; those ending in * also count by their start without it.
DATA_TYPES = ("i8*", "char*", "void*", "uint8_t*", "int8_t*", "i16*", "i32*", "i64*", "short*", "int*", "long*", "float*", "double*", "* nocapture", "* readonly")
# Entry names and what they add to a path's score.
NAME_SCORES = (
    (("free", "destroy", "cleanup", "release", "deallocate", "dispose"), -15),
    (("reset", "close", "shutdown", "finalize"), -10),
    (("parse", "process", "decode", "deserialize", "unmarshal", "from_", "load"), 8),
    (("handle", "run", "execute", "dispatch", "invoke", "apply", "transform"), 5),
)
# Names of container methods.
CONTAINER_METHODS = (
    "begin", "end", "cbegin", "cend", "rbegin", "rend", "size", "empty", "clear", "swap", "at", "front", "back", "push_back", "pop_back", "emplace_back",
    "insert", "erase", "emplace", "resize", "reserve", "capacity",
)


def cap_fanout(edges: DataFrame, keys: Sequence[str], target: str, cap: int = MAX_TARGETS) -> DataFrame:
    """Distinct (keys, target) rows of the keys that have at most ``cap`` targets."""
    pairs = edges.select(*keys, target).distinct()
    few = pairs.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") <= cap).drop("_n")
    return pairs.join(few, list(keys), "left_semi")


#: Rounds or levels after which what is known so far is written as one table.
COMPACT = 8
#: Rounds that follow single copies before shortcuts are made: most pointers are settled by then.
PLAIN_ROUNDS = 3


def pointer_fixpoint(seeds: DataFrame, flows: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Least fixpoint of (owner, ptr, target) under flows (owner, dst, src) within an owner.

    Semi-naive: each round joins the rows that were new in the last one. From
    round PLAIN_ROUNDS on, copies along which a pointer has one source, or one
    destination, are also followed by shortcuts: each round joins the last
    round's shortcuts with themselves, so that they span 1, 2, 4, ... copies,
    and what is known moves over the new ones at once. A chain or a ring is
    settled after the logarithm of its length; only paths on which pointers
    with several sources alternate with pointers with several destinations need
    a round for each. Shortcuts join points that reach each other, so cycles
    need no care. A pass limit of ten, as a reader of lines may have, would
    make the result depend on their order.
    """
    edges = materialise(flows.select("owner", "src", "dst").where("src != dst").distinct())
    known = delta = materialise(seeds.select("owner", "ptr", "target").distinct())
    jumps, steps = None, edges.select(F.col("owner").alias("f_owner"), "src", "dst")
    longest = 0
    for done in range(max_rounds):
        moved = _moved(delta, steps)
        if done == PLAIN_ROUNDS:
            jumps = materialise(_single_steps(edges))
            longest = jumps.count().bit_length()
        elif jumps is not None and done <= PLAIN_ROUNDS + longest and not jumps.isEmpty():
            jumps = materialise(_doubled(jumps))
            new = jumps.select(F.col("owner").alias("f_owner"), F.when(F.col("back"), F.col("far")).otherwise(F.col("node")).alias("src"), F.when(F.col("back"), F.col("node")).otherwise(F.col("far")).alias("dst"))
            moved, steps = moved.unionByName(_moved(known, new)), steps.unionByName(new)
        delta = materialise(moved.distinct().join(known, ["owner", "ptr", "target"], "left_anti"))
        if delta.isEmpty():
            return known
        known = known.unionByName(delta)
        if done % COMPACT == COMPACT - 1:
            known = materialise(known)
    raise RuntimeError(f"pointer targets have not settled in {max_rounds} rounds")


def _moved(held: DataFrame, steps: DataFrame) -> DataFrame:
    return held.join(steps, (F.col("owner") == F.col("f_owner")) & (F.col("ptr") == F.col("src"))).select("owner", F.col("dst").alias("ptr"), "target")


def _single_steps(edges: DataFrame) -> DataFrame:
    """(owner, node, far, back): the source of each pointer that has one, and the destination of each that has one."""
    side = lambda node, far, back: edges.groupBy("owner", F.col(node).alias("node")).agg(F.min(far).alias("far"), F.count("*").alias("n")).where("n = 1").select("owner", "node", "far", F.lit(back).alias("back"))
    return side("dst", "src", True).unionByName(side("src", "dst", False))


def _doubled(jumps: DataFrame) -> DataFrame:
    """Steps of twice the length; a ring's steps to their own start are dropped."""
    on = jumps.select(F.col("owner").alias("o"), F.col("node").alias("via"), F.col("far").alias("further"), F.col("back").alias("b"))
    joined = jumps.join(on, (F.col("owner") == F.col("o")) & (F.col("far") == F.col("via")) & (F.col("back") == F.col("b")))
    return joined.where("node != further").select("owner", "node", F.col("further").alias("far"), "back")


def pointer_targets(facts: ProgramFacts, in_order: bool = False) -> DataFrame:
    """(owner, ptr, target): what each pointer may hold, over stores, loads, struct fields and dispatch tables.

    The first global that a load names is a target if it is a function, wherever
    that stands; with ``in_order`` only if it was defined or declared before the
    load, as a reader of the files in order of their names knows it. What a load
    reads last is followed as a copy, which takes functions wherever they stand.
    """
    fn = facts.functions.select(F.col("name").alias("f"))
    flows = facts.flows.select("owner", "dst", "src").distinct()
    direct = flows.join(fn, F.col("src") == F.col("f")).select("owner", "dst", F.col("src").alias("target"))
    stored = facts.flows.where("kind = 'store_fn'").select("owner", "dst", F.col("src").alias("target"))
    loads = facts.global_loads.join(facts.functions.select(F.col("name").alias("f"), "first_seen"), F.col("src") == F.col("f"))
    before = F.struct("first_seen.file", "first_seen.line_no") < F.struct("ord.file", "ord.line_no")
    loaded = (loads.where(before) if in_order else loads).select("owner", "dst", F.col("src").alias("target"))
    at = facts.fields.select(F.col("owner").alias("g_owner"), F.col("dst").alias("g_dst"), "struct_type", "field_idx", "base")
    held = direct.join(at, (F.col("owner") == F.col("g_owner")) & (F.col("dst") == F.col("g_dst"))).select(
        F.col("struct_type").alias("h_type"), F.col("field_idx").alias("h_idx"), "target"
    ).distinct()
    same_field = (F.col("struct_type") == F.col("h_type")) & (F.col("field_idx") == F.col("h_idx"))
    bridged = flows.join(at, (F.col("owner") == F.col("g_owner")) & (F.col("src") == F.col("g_dst"))).join(held, same_field).select("owner", "dst", "target")
    outer = facts.fields.select(F.col("owner").alias("o_owner"), F.col("dst").alias("o_dst"))
    nested = at.join(outer, (F.col("g_owner") == F.col("o_owner")) & (F.col("base") == F.col("o_dst"))).join(held, same_field).select(F.col("g_owner").alias("owner"), F.col("g_dst").alias("dst"), "target")
    seeds = direct.union(stored).union(loaded).union(bridged).union(nested).toDF("owner", "ptr", "target")
    # a flow whose source is a function is a seed already and carries no pointer
    moves = flows.join(fn, F.col("src") == F.col("f"), "left_anti")
    settled = pointer_fixpoint(seeds, moves)
    slots = facts.table_slots.select(F.col("owner").alias("s_owner"), F.col("dst").alias("s_dst"), "slot")
    virtual = (
        flows.join(slots, (F.col("owner") == F.col("s_owner")) & (F.col("src") == F.col("s_dst")))
        .join(facts.table_entries.where("fn is not null").select(F.col("slot").alias("t_slot"), "fn").distinct(), F.col("slot") == F.col("t_slot"))
        .select("owner", F.col("dst").alias("ptr"), F.col("fn").alias("target"))
    )
    return settled.unionByName(virtual).distinct()


def call_edges(facts: ProgramFacts, max_targets: int = MAX_TARGETS, in_order: bool = False) -> DataFrame:
    """(caller, callee, kind): direct calls, and indirect ones whose pointer has few enough targets (``in_order`` as in :func:`pointer_targets`)."""
    direct = facts.call_sites.select("caller", "callee", F.lit("direct").alias("kind"))
    calls = facts.indirect_calls.select("caller", "ptr").distinct()
    targets = pointer_targets(facts, in_order).withColumnRenamed("ptr", "t_ptr")
    resolved = calls.join(targets, (F.col("caller") == F.col("owner")) & (F.col("ptr") == F.col("t_ptr"))).select("caller", "ptr", F.col("target").alias("callee"))
    few = cap_fanout(resolved, ["caller", "ptr"], "callee", max_targets)
    return direct.unionByName(few.select("caller", "callee", F.lit("indirect").alias("kind"))).distinct()


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing calls."""
    return nodes.select("name").distinct().join(edges.select(F.col("callee").alias("name")), "name", "left_anti")


def reverse_paths(edges: DataFrame, sinks: DataFrame, public: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(sink, node, depth, path): public nodes that reach a sink, with the least shortest path, read from the sink outward.

    Level-synchronous: one equi join, one anti join and one min per level, all
    keyed by node; paths stop at public nodes (but for the sink itself). No
    path is moved on the way: a node keeps one parent link and a rank that
    orders the least paths of its level. The least parent is that of the least
    rank, and nodes sorted by (parent's rank, name) are in order of their own
    paths. Paths are put together at the end, for public nodes alone. A level's
    table is written once, so lost executors cost no earlier level, and tables
    are united every COMPACT levels. Raises if paths go on beyond ``max_depth``.
    """
    callers = materialise(edges.select(F.col("callee").alias("_callee"), F.col("caller").alias("next")).where("_callee is not null and next is not null").distinct())
    stops = materialise(public.select(F.col("name").alias("node")).distinct().withColumn("stop", F.lit(True)))
    columns = ["sink", "node", "parent", "rank", "depth", "stop"]
    stopped = F.coalesce("stop", F.lit(False)).alias("stop")
    start = sinks.select(F.col("name").alias("sink"), F.col("name").alias("node")).distinct().withColumns({"parent": F.lit(None).cast("string"), "rank": F.lit(0).cast("long"), "depth": F.lit(0)})
    links = frontier = materialise(start.join(stops, "node", "left").select(*columns[:-1], stopped))
    for depth in range(1, max_depth + 2):
        alive = frontier if depth == 1 else frontier.where("not stop")
        step = alive.join(callers, F.col("node") == F.col("_callee")).select("sink", F.col("next").alias("node"), F.col("node").alias("parent"), "rank")
        least = step.groupBy("sink", "node").agg(F.min_by("parent", "rank").alias("parent"), F.min("rank").alias("above"))
        fresh = least.join(links.select("sink", "node"), ["sink", "node"], "left_anti").orderBy("above", "node")
        ranked = fresh.select("sink", "node", "parent", F.monotonically_increasing_id().alias("rank"), F.lit(depth).alias("depth"))
        frontier = materialise(ranked.join(stops, "node", "left").select(*columns[:-1], stopped))
        if frontier.isEmpty():
            return _paths(links)
        links = links.unionByName(frontier)
        if depth % COMPACT == 0:
            links = materialise(links)
    raise RuntimeError(f"paths go on beyond {max_depth} levels")


def _paths(links: DataFrame) -> DataFrame:
    """The paths of stops: each is halved until its pieces are nodes, by links over 1, 2, 4, ... levels.

    A piece is (node it starts at, levels before it, its length); only the
    pieces of stops are made, and their nodes are gathered once.
    """
    found = links.where("stop").select("sink", "node", "depth", F.col("node").alias("at"), F.lit(0).alias("before"), (F.col("depth") + 1).alias("length"))
    steps = [links.where("parent is not null").select(F.col("sink").alias("s"), F.col("node").alias("n"), F.col("parent").alias("far"))]
    most = links.where("stop").agg(F.max("depth")).first()[0] or 0
    while 1 << len(steps) <= most:
        last = steps[-1]
        on = last.select(F.col("s").alias("s2"), F.col("n").alias("n2"), F.col("far").alias("further"))
        steps.append(materialise(last.join(on, (F.col("s") == F.col("s2")) & (F.col("far") == F.col("n2"))).select("s", "n", F.col("further").alias("far"))))
    for k in reversed(range(len(steps))):
        size = 1 << k
        long = F.col("length") > size
        cut = found.join(steps[k], long & (F.col("sink") == F.col("s")) & (F.col("at") == F.col("n")), "left")
        near = F.struct("at", "before", F.least("length", F.lit(size)).alias("length"))
        rest = F.when(long, F.struct(F.col("far").alias("at"), (F.col("before") + size).alias("before"), (F.col("length") - size).alias("length")))
        found = cut.select("sink", "node", "depth", F.explode(F.array_compact(F.array(near, rest))).alias("p")).select("sink", "node", "depth", "p.*")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("before")).alias("place"), "at")))
    return found.groupBy("sink", "node", "depth").agg(F.transform(listed, lambda x: x["at"]).alias("path"))


def is_data_pointer(kind: Column) -> Column:
    """Whether an IR or C type text counts as a data pointer; plain scalars count as well, since starts match without ``*``."""
    low = F.lower(F.trim(kind))
    hit = F.lit(False)
    for p in DATA_TYPES:
        hit = hit | low.contains(p) | low.startswith(p.replace("*", ""))
    internal = kind.contains("%struct") | kind.contains("%class") | kind.contains("%union") | kind.contains("...")
    return F.when((F.coalesce(kind, F.lit("")) == "") | internal, False).otherwise((low == "ptr") | hit | F.rtrim(kind).endswith("*"))


def data_parameters(params: Column) -> Column:
    """0-based places of parameters that are data pointers and not named like internal objects."""
    marked = F.transform(params, lambda p, i: F.when(is_data_pointer(p["type"]) & ~contains_any(p["name"], *NOT_DATA), i))
    return F.array_compact(marked)


def control_parameters(params: Column) -> Column:
    return F.array_compact(F.transform(params, lambda p, i: F.when(contains_any(p["name"], *CONTROL), i)))


def name_score(entry: Column) -> Column:
    """What an entry's name adds to its path's score; the terms add up."""
    low = F.lower(entry)
    base = F.element_at(F.split(low, "::"), -1)
    score = F.lit(0)
    for words, points in NAME_SCORES:
        score = score + F.when(contains_any(base, *words), points).otherwise(0)
    score = score + F.when(base.startswith("~") | low.contains("::~"), -15).otherwise(0)
    score = score + F.when(base.isin(*CONTAINER_METHODS), -8).otherwise(0)
    return score + F.when(base.startswith("operator"), -8).otherwise(0)


def edge_flow(call_sites: DataFrame, functions: DataFrame, fields: DataFrame) -> DataFrame:
    """(caller, callee, caller_idx, callee_idx, ord): parameters handed on, over at most two field addresses; first site wins."""
    sized = functions.select(F.col("name").alias("callee"), F.size("params").alias("n"))
    args = call_sites.join(sized, "callee").select("caller", "callee", "ord", F.posexplode(F.slice("args", F.lit(1), F.greatest("n", F.lit(0)))).alias("callee_idx", "arg"))
    regs = args.select("caller", "callee", "ord", "callee_idx", F.regexp_extract("arg", "%([A-Za-z0-9_.]+)", 1).alias("r0")).where("r0 != ''")
    base = fields.select(F.col("owner").alias("caller"), F.col("dst").alias("_d"), F.col("base").alias("_b"))
    for i in (0, 1):
        step = base.toDF(f"_o{i}", f"_d{i}", f"r{i + 1}")
        regs = regs.join(step, (F.col("caller") == F.col(f"_o{i}")) & (F.col(f"r{i}") == F.col(f"_d{i}")), "left").drop(f"_o{i}", f"_d{i}")
    params = functions.select(F.col("name").alias("caller"), F.transform("params", lambda p: p["name"]).alias("names"))
    # a repeated parameter name stands for its last place
    place = lambda r: F.array_max(F.array_compact(F.transform("names", lambda n, i: F.when(n == F.col(r), i))))
    found = regs.join(params, "caller").withColumn("caller_idx", F.coalesce(place("r0"), place("r1"), place("r2"))).where("caller_idx is not null")
    return found.groupBy("caller", "callee", "caller_idx", "callee_idx").agg(F.min(F.struct("ord", "callee_idx")).alias("ord"))


def trace_flow(paths: DataFrame, functions: DataFrame, flows: DataFrame) -> DataFrame:
    """(path_id, score, controlled map<sink place, entry place>) for paths (path_id, hops array<string> from entry to sink).

    Hop by hop: the flows of (caller, callee) map tracked places on; of several
    that reach one place the last flow's origin stays; a hop without any flow
    costs 2 and loses all, one with flows that carry nothing costs 1, and each
    tracked flow earns 8; each place that survives earns 6.
    """
    lists = flows.groupBy("caller", "callee").agg(F.array_sort(F.collect_list(F.struct("ord", "caller_idx", "callee_idx"))).alias("steps"))
    entry = functions.select(F.col("name").alias("entry"), data_parameters(F.col("params")).alias("data"), control_parameters(F.col("params")).alias("control"))
    begun = paths.withColumn("entry", F.element_at("hops", 1)).join(entry, "entry", "left")
    tracked = F.array_distinct(F.concat(F.coalesce("data", F.array().cast("array<int>")), F.coalesce("control", F.array().cast("array<int>"))))
    state = begun.select(
        "path_id", "hops", F.map_from_arrays(tracked, tracked).alias("origin"),
        (10 * F.size(F.coalesce("data", F.array())) + 4 * F.least(F.lit(2), F.size(F.coalesce("control", F.array()))) + name_score(F.col("entry")) - F.size("hops") + 1).alias("score"),
    )
    edges = paths.select("path_id", F.posexplode(F.arrays_zip(F.slice("hops", F.lit(1), F.size("hops") - 1).alias("caller"), F.slice("hops", 2, F.greatest(F.size("hops") - 1, F.lit(0))).alias("callee"))).alias("hop", "e"))
    edges = edges.select("path_id", "hop", F.col("e.caller").alias("caller"), F.col("e.callee").alias("callee")).join(lists, ["caller", "callee"], "left")
    walks = edges.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hop", F.coalesce("steps", F.array()).alias("steps")))), lambda x: x["steps"]).alias("walk"))
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>"))

    def hop(s: Column, steps: Column) -> Column:
        carried = F.filter(steps, lambda f: F.map_contains_key(s["origin"], f["caller_idx"]))
        reached = F.array_distinct(F.transform(carried, lambda f: f["callee_idx"]))
        last = lambda c: F.element_at(F.filter(carried, lambda f: f["callee_idx"] == c), -1)["caller_idx"]
        origin = F.map_from_arrays(reached, F.transform(reached, lambda c: s["origin"][last(c)]))
        points = F.when(F.size(steps) == 0, -2).when(F.size(carried) == 0, -1).otherwise(8 * F.size(carried))
        return F.struct((s["score"] + points).alias("score"), F.when(F.size(steps) == 0, none).otherwise(origin).alias("origin"))

    joined = state.join(walks, "path_id", "left").withColumn("walk", F.coalesce("walk", F.array()))
    folded = F.aggregate("walk", F.struct("score", "origin"), hop)
    return joined.select("path_id", folded.alias("s")).select("path_id", (F.col("s.score") + 6 * F.size("s.origin")).alias("score"), F.col("s.origin").alias("controlled"))


def trace_hops(flows: DataFrame, places: int, hops: int) -> DataFrame:
    """(path_id, sink_idx, entry_idx) after ``hops`` joins over flows (path_id, hop, caller_idx, callee_idx, ord).

    The relational form of :func:`trace_flow` for very many paths: one join and
    one max_by per hop, both keyed by (path, place), so nothing is moved that
    the last hop did not carry.
    """
    state = flows.select("path_id").distinct().select("path_id", F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("at")).withColumn("at", F.col("at").cast("long"))
    state = state.withColumn("entry_idx", F.col("at"))
    for hop in range(1, hops + 1):
        step = flows.where(F.col("hop") == hop).select("path_id", F.col("caller_idx").alias("at"), "callee_idx", "ord")
        state = state.join(step, ["path_id", "at"]).groupBy("path_id", F.col("callee_idx").alias("at")).agg(F.max_by("entry_idx", "ord").alias("entry_idx"))
    return state.select("path_id", F.col("at").alias("sink_idx"), "entry_idx")


def rank_paths(scored: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` paths: by score, then as the search finds them (shorter, then least from the sink outward)."""
    return top_k(scored, [], [F.desc("score"), F.size("path"), "path"], k)
