"""The program-side operators over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkscope.functions import classify, names, spans, tolerant
from sparkscope.functions.patterns import Pattern, best_match, pattern_hits
from sparkscope.operators import advisory, derive, evidence, excerpt, graph, items, ordered, retrieval, rules, seeds
from sparkscope.operators.segmented import segments_in_rows
from sparkscope.plans import assemble
from sparkscope.session import materialise, shared_dir, spread, table
from sparkscope.sources import build_log, headers, ir, listing, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def star_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Part, supplier, nation and region keys as a call graph."""
    pair = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("caller"), F.concat(F.lit(b), y).alias("callee"))
    sold = pair(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct(), "p", "l_partkey", "s", "l_suppkey")
    placed = pair(table(spark, sf, "supplier"), "s", "s_suppkey", "n", "s_nationkey")
    return sold.union(placed).union(pair(table(spark, sf, "nation"), "n", "n_nationkey", "r", "n_regionkey"))


STAR = """star AS (
  SELECT DISTINCT 'p' || l_partkey AS caller, 's' || l_suppkey AS callee FROM lineitem
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
MOVES = """moves AS (SELECT user_id, event_type AS dst, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src FROM events)"""


def event_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive event types of each user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", F.col("event_type").alias("dst"), F.lag("event_type").over(order).alias("src"))


@query(f"""WITH {STAR}, {MOVES}
SELECT 'star' AS kind, caller, callee, count(*) AS n FROM star GROUP BY ALL
UNION ALL SELECT 'event', src, dst, count(*) FROM moves WHERE src IS NOT NULL GROUP BY ALL""")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    star = star_edges(spark, sf).groupBy(F.lit("star").alias("kind"), "caller", "callee").agg(F.count("*").alias("n"))
    moves = event_moves(spark, sf).where("src is not null")
    return star.unionByName(moves.groupBy(F.lit("event").alias("kind"), F.col("src").alias("caller"), F.col("dst").alias("callee")).agg(F.count("*").alias("n")))


@query(f"""WITH RECURSIVE {STAR}, public AS (SELECT 'p' || p_partkey AS name FROM part WHERE p_size <= 10),
walk AS (SELECT 'r1' AS node, ['r1'] AS path
  UNION ALL SELECT s.caller, list_append(w.path, s.caller) FROM walk w JOIN star s ON s.callee = w.node WHERE w.node NOT IN (SELECT name FROM public))
SELECT node, CAST(min(len(path)) - 1 AS BIGINT) AS depth, array_to_string(min(path), '>') AS path FROM walk WHERE node IN (SELECT name FROM public) GROUP BY node""")
def reverse_reachability(spark: SparkSession, sf: str) -> DataFrame:
    public = table(spark, sf, "part").where("p_size <= 10").select(F.concat(F.lit("p"), "p_partkey").alias("name"))
    sink = spark.createDataFrame([("r1",)], "name string")
    return graph.reverse_paths(star_edges(spark, sf), sink, public).select("node", F.col("depth").cast("long").alias("depth"), F.array_join("path", ">").alias("path"))


@query(f"WITH {STAR} SELECT DISTINCT caller AS name FROM star WHERE caller NOT IN (SELECT callee FROM star)")
def root_functions(spark: SparkSession, sf: str) -> DataFrame:
    edges = star_edges(spark, sf)
    return graph.roots(edges.select(F.col("caller").alias("name")), edges)


@query("""WITH exported AS (SELECT DISTINCT n_name AS name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 5000),
declared AS (SELECT DISTINCT n_name AS name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING')
SELECT 'both' AS rule, name FROM exported WHERE name IN (SELECT name FROM declared)
UNION ALL SELECT 'fallback', name FROM exported""")
def public_fallback(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    exported = nation.join(table(spark, sf, "supplier").where("s_acctbal > 5000"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name")).distinct()
    declared = nation.join(table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name")).distinct()
    both = ordered.fallback_if_empty(exported.intersect(declared), exported)
    none = ordered.fallback_if_empty(exported.intersect(declared.where("name = '-'")), exported)
    return both.select(F.lit("both").alias("rule"), "name").unionByName(none.select(F.lit("fallback").alias("rule"), "name"))


@query("""SELECT l_partkey AS caller, l_suppkey AS callee FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
QUALIFY count(*) OVER (PARTITION BY l_partkey) <= 24""")
def fanout_cap(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("callee"))
    return graph.cap_fanout(edges, ["caller"], "callee")


@query(f"""WITH RECURSIVE {MOVES}, flow AS (SELECT DISTINCT user_id AS owner, dst || (user_id % 3) AS dst, src || (user_id % 3) AS src FROM moves WHERE src IS NOT NULL AND src < dst),
held AS (SELECT DISTINCT user_id AS owner, event_type || (user_id % 3) AS ptr, 'f' || (event_id % 5) AS target FROM events WHERE event_type IN ('click', 'error')
  UNION SELECT f.owner, f.dst, h.target FROM held h JOIN flow f ON f.owner = h.owner AND f.src = h.ptr)
SELECT owner, ptr, target FROM held""")
def pointer_fixpoint(spark: SparkSession, sf: str) -> DataFrame:
    tagged = lambda c: F.concat(c, F.col("user_id") % 3)
    flows = event_moves(spark, sf).where("src is not null and src < dst").select(F.col("user_id").alias("owner"), tagged(F.col("dst")).alias("dst"), tagged(F.col("src")).alias("src"))
    seeds_ = table(spark, sf, "events").where("event_type in ('click', 'error')").select(
        F.col("user_id").alias("owner"), tagged(F.col("event_type")).alias("ptr"), F.concat(F.lit("f"), F.col("event_id") % 5).alias("target")
    )
    return graph.pointer_fixpoint(seeds_, flows)


ENTRY_NAMES = ("parse_", "free_", "reset_", "handle_", "operator_", "begin", "load_reset_", "x_")


@query("""WITH named AS (SELECT p_partkey, ['parse_','free_','reset_','handle_','operator_','begin','load_reset_','x_'][p_size % 8 + 1] AS entry, p_size % 4 AS hops FROM part),
scored AS (SELECT p_partkey AS path_id, entry, CAST(hops AS BIGINT) AS hops, CAST(-hops
  + CASE WHEN regexp_matches(entry, 'free|destroy|cleanup|release|deallocate|dispose') THEN -15 ELSE 0 END
  + CASE WHEN regexp_matches(entry, 'reset|close|shutdown|finalize') THEN -10 ELSE 0 END
  + CASE WHEN regexp_matches(entry, 'parse|process|decode|deserialize|unmarshal|from_|load') THEN 8 ELSE 0 END
  + CASE WHEN regexp_matches(entry, 'handle|run|execute|dispatch|invoke|apply|transform') THEN 5 ELSE 0 END
  + CASE WHEN entry = 'begin' THEN -8 ELSE 0 END + CASE WHEN starts_with(entry, 'operator') THEN -8 ELSE 0 END AS BIGINT) AS score FROM named)
SELECT * FROM scored ORDER BY score DESC, hops, path_id LIMIT 10""")
def path_score(spark: SparkSession, sf: str) -> DataFrame:
    entry = F.element_at(F.array(*(F.lit(n) for n in ENTRY_NAMES)), F.col("p_size") % 8 + 1)
    paths = table(spark, sf, "part").select(F.col("p_partkey").alias("path_id"), entry.alias("entry"), (F.col("p_size") % 4).cast("long").alias("hops"))
    return ordered.top_k(paths.withColumn("score", (graph.name_score(F.col("entry")) - F.col("hops")).cast("long")), [], [F.desc("score"), "hops", "path_id"], 10)


@query("""WITH flow AS (SELECT l_orderkey AS path_id, l_linenumber AS hop, CAST(l_partkey % 3 AS BIGINT) AS a, CAST(l_suppkey % 3 AS BIGINT) AS b, 2 * l_partkey AS ord FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, CAST((l_partkey + 1) % 3 AS BIGINT), CAST(l_suppkey % 2 AS BIGINT), 2 * l_partkey + 1 FROM lineitem),
h0 AS (SELECT DISTINCT path_id, i AS entry_idx, i AS place FROM flow, (VALUES (CAST(0 AS BIGINT)), (1), (2)) v(i)),
h1 AS (SELECT path_id, b AS place, arg_max(entry_idx, ord) AS entry_idx FROM flow JOIN h0 USING (path_id) WHERE hop = 1 AND a = place GROUP BY path_id, b),
h2 AS (SELECT path_id, b AS place, arg_max(entry_idx, ord) AS entry_idx FROM flow JOIN h1 USING (path_id) WHERE hop = 2 AND a = place GROUP BY path_id, b)
SELECT path_id, b AS sink_idx, arg_max(entry_idx, ord) AS entry_idx FROM flow JOIN h2 USING (path_id) WHERE hop = 3 AND a = place GROUP BY path_id, b""")
def flow_trace(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").alias("hop"), "l_partkey", "l_suppkey")
    one = line.select("path_id", "hop", (F.col("l_partkey") % 3).alias("caller_idx"), (F.col("l_suppkey") % 3).alias("callee_idx"), (2 * F.col("l_partkey")).alias("ord"))
    two = line.select("path_id", "hop", ((F.col("l_partkey") + 1) % 3).alias("caller_idx"), (F.col("l_suppkey") % 2).alias("callee_idx"), (2 * F.col("l_partkey") + 1).alias("ord"))
    return graph.trace_hops(one.unionByName(two), 3, 3)


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def first_wins_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return ordered.first_wins(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT c_nationkey, c_name, c_acctbal, row_number() OVER w AS rank FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) QUALIFY row_number() OVER w <= 10""")
def ranked_topk(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc("c_acctbal"), F.col("c_name")]
    top = ordered.top_k(table(spark, sf, "customer").select("c_nationkey", "c_name", "c_acctbal"), ["c_nationkey"], order, 10)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*order)).cast("long"))


BRANCHES = (
    ("control", "o_orderpriority = '1-URGENT'", 2, "exposed as control"),
    ("comparison", "o_totalprice > 300000", 3, "appears in comparison"),
    ("switch", "o_orderstatus = 'P'", 5, "appears in switch"),
    ("field", "o_orderkey % 7 = 0", 4, "state field"),
    ("state", "o_custkey % 11 = 0", 1, "read repeatedly"),
)


@query("WITH scored AS (" + " UNION ALL ".join(f"SELECT o_custkey AS target, {i} AS branch, o_orderkey, {points} AS points, '{why}' AS reason FROM orders WHERE {when}" for i, (_, when, points, why) in enumerate(BRANCHES)) + """)
SELECT target, CAST(sum(points) AS BIGINT) AS score, string_agg(reason, '; ' ORDER BY branch, o_orderkey, reason) AS reasons FROM scored GROUP BY target
ORDER BY score DESC, target LIMIT 10""")
def group_sum_reasons(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    hits = F.array_compact(F.array(*(F.when(F.expr(when), F.struct(F.lit(i).alias("branch"), F.lit(p).alias("points"), F.lit(why).alias("reason"))) for i, (_, when, p, why) in enumerate(BRANCHES))))
    rows = orders.select(F.col("o_custkey").alias("target"), "o_orderkey", F.explode(hits).alias("h")).select("target", "o_orderkey", "h.*")
    scored = ordered.group_scores(rows, ["target"], "points", "reason", ["branch", "o_orderkey"], k=10)
    return ordered.top_k(scored, [], [F.desc("score"), "target"], 10).withColumn("reasons", F.array_join("reasons", "; "))


BANK = (
    Pattern("licensed", r"[Ll]icensed under the ([A-Z][a-z]+)", 1, 10),
    Pattern("released", r"Released under the ([A-Za-z]+)", 1, 9),
    Pattern("address", r"([a-z]+)@[a-z]+", 1, 5),
    Pattern("the_word", r"[Tt]he ([a-z]{9,})", 1, 3),
)


def _bank_sql() -> str:
    parts = []
    for p in BANK:
        parts.append(
            f"""SELECT doc_id, {p.score} AS base, value, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS pos
  FROM (SELECT doc_id, string_split_regex(text, '{p.regex}') AS parts, regexp_extract_all(text, '{p.regex}') AS whole,
    unnest(regexp_extract_all(text, '{p.regex}', {p.group})) AS value, generate_subscripts(regexp_extract_all(text, '{p.regex}'), 1) AS i FROM documents)"""
        )
    return " UNION ALL ".join(parts)


@query(f"""WITH hits AS ({_bank_sql()}),
scored AS (SELECT doc_id, value, base + CASE WHEN length(value) >= 5 THEN 1 ELSE 0 END - CASE WHEN length(value) < 4 THEN 2 ELSE 0 END AS score, pos FROM hits),
best AS (SELECT doc_id, value, max(score) AS score, arg_max(pos, score * 10000000 - pos) AS pos FROM scored GROUP BY doc_id, value)
SELECT doc_id, value, CAST(score AS BIGINT) AS score, CAST(pos AS BIGINT) AS pos FROM best QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, value) = 1""")
def pattern_bank(spark: SparkSession, sf: str) -> DataFrame:
    hits = pattern_hits(table(spark, sf, "documents"), "doc_id", "text", BANK)
    best = best_match(hits, "doc_id", F.col("base") + advisory.name_points(F.col("value"), underscore=False))
    return best.withColumns({c: F.col(c).cast("long") for c in ("score", "pos")})


@query("""WITH raw AS (SELECT replace(replace(p_name, ' ', '_'), 'e', 'E') || p_size || p_type AS name FROM part),
cut AS (SELECT 'name' AS rule, unnest(regexp_split_to_array(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[_0-9]+')) AS token FROM raw
  UNION ALL SELECT 'identifier', unnest(regexp_split_to_array(regexp_replace(regexp_replace(name, '[^A-Za-z0-9_]+', '_', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '_')) FROM raw)
SELECT rule, lower(token) AS token, count(*) AS n FROM cut WHERE token <> '' GROUP BY ALL
UNION ALL SELECT 'anchor', lower(token), count(*) FROM cut WHERE rule = 'identifier' AND token <> '' AND lower(token) NOT IN ('small', 'blu', 'ptr', 'const') GROUP BY ALL""")
def tokenize_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "part").select(F.concat(F.replace(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("e"), F.lit("E")), F.col("p_size").cast("string"), "p_type").alias("name"))
    rules_ = {"name": names.name_tokens(F.col("name")), "identifier": names.identifier_tokens(F.col("name")), "anchor": names.anchor_tokens(F.col("name"), ("small", "blu", *names.ANCHOR_STOP_TOKENS))}
    listed = F.array(*(F.struct(F.lit(r).alias("rule"), t.alias("tokens")) for r, t in rules_.items()))
    cut = raw.select(F.explode(listed).alias("c")).select("c.rule", F.explode("c.tokens").alias("token"))
    return cut.groupBy("rule", "token").agg(F.count("*").alias("n"))


@query("""WITH raw AS (SELECT event_id, event_type || '(a, b[' || (event_id % 9) || ', 2]), ' || props || ' , x, (y, {z, ' || user_id || '})' AS text FROM events),
parts AS (SELECT event_id, [event_type_part, props_part, 'x', last_part] AS p FROM (SELECT event_id, split_part(text, ', {', 1) AS event_type_part, '{' || split_part(split_part(text, ', {', 2), ' , ', 1) AS props_part,
  '(y, {z, ' || split_part(text, '(y, {z, ', 2) AS last_part FROM raw))
SELECT event_id, CAST(i AS BIGINT) AS place, p[i + 1] AS part FROM parts, (VALUES (0), (1), (2), (3)) v(i)""")
def balanced_split(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("event_type", F.lit("(a, b["), F.col("event_id") % 9, F.lit(", 2]), "), "props", F.lit(" , x, (y, {z, "), "user_id", F.lit("})"))
    rows = table(spark, sf, "events").select("event_id", F.posexplode(names.split_top_level(text)).alias("place", "part"))
    return rows.withColumn("place", F.col("place").cast("long"))


ROLE_NAMES = ("layout", "outLen", "content_type", "numItems", "ctx", "window_ptr", "src_buf", "row_table", "value", "handle", "return")
ROLE_TYPES = ("char **", "const char *", "int", "size_t", "struct foo", "voidp", "palette_t", "foo_ptr", "pointer_t", "uint8_t")


@query("""WITH raw AS (SELECT p_partkey, ['layout','outLen','content_type','numItems','ctx','window_ptr','src_buf','row_table','value','handle','return'][p_size % 11 + 1] AS name,
  ['char **','const char *','int','size_t','struct foo','voidp','palette_t','foo_ptr','pointer_t','uint8_t'][p_partkey % 10 + 1] AS type FROM part),
t AS (SELECT *, lower(name) AS l, lower(type) AS y, list_filter(list_transform(regexp_split_to_array(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[_0-9]+'), lambda x: lower(x)), lambda x: x <> '') AS w FROM raw),
r AS (SELECT p_partkey, name, type,
 CASE WHEN starts_with(l, 'num') OR list_has_any(w, ['len','length','size','count','capacity','avail']) THEN 'size'
  WHEN list_has_any(w, ['mode','type','flag','flags','option','options','kind','op','cmd','flush']) THEN 'control'
  WHEN list_has_any(w, ['out','dst','dest','result','output']) OR l = 'return' OR contains(y, '**') THEN 'output-buffer'
  WHEN list_has_any(w, ['state','ctx','context','stream','parser','handle','object','info','strm']) OR (ends_with(l, '_ptr') AND NOT regexp_matches(l, 'buf|data|text|str')) OR contains(y, '%struct') OR (ends_with(y, 'ptr') AND NOT contains(y, '*')) THEN 'state'
  WHEN list_has_any(w, ['table','array','list','entry','entries','palette','hist','map']) OR regexp_matches(y, 'table|array|list|palette|hist') THEN 'support-buffer'
  WHEN regexp_matches(y, '\\*|char|uint8|int8|void|byte') THEN 'input-buffer'
  WHEN regexp_matches(y, '(^|[^a-z0-9_])(int|long|short|size_t|ssize_t|uint|float|double)($|[^a-z0-9_])') THEN 'numeric' ELSE 'value' END AS by_word,
 CASE WHEN starts_with(l, 'num') OR regexp_matches(l, 'len|size|count|capacity|avail') THEN 'size'
  WHEN regexp_matches(l, 'mode|type|flag|option|kind|op|cmd|flush') THEN 'control'
  WHEN regexp_matches(l, 'out|dst|dest|result|return') OR contains(y, '**') THEN 'output-buffer'
  WHEN regexp_matches(l, 'state|ctx|context|stream|parser|handle|object|strm|info') OR (ends_with(l, '_ptr') AND NOT regexp_matches(l, 'buf|data|text|str')) OR contains(y, '%struct') OR (ends_with(y, 'ptr') AND NOT contains(y, '*')) THEN 'state'
  WHEN regexp_matches(l, 'table|array|list|entry|entries|palette|hist|map') OR regexp_matches(y, 'table|array|list|palette|hist') THEN 'support-buffer'
  WHEN regexp_matches(y, '\\*|char|void|byte') THEN 'input-buffer'
  WHEN regexp_matches(y, 'int|long|short|size_t|float|double') THEN 'numeric' ELSE 'value' END AS by_part FROM t)
SELECT * FROM r""")
def role_classifier(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda values, key: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))
    raw = table(spark, sf, "part").select("p_partkey", pick(ROLE_NAMES, "p_size").alias("name"), pick(ROLE_TYPES, "p_partkey").alias("type"))
    return raw.withColumns({"by_word": classify.parameter_role(F.col("name"), F.col("type")), "by_part": classify.signature_role(F.col("name"), F.col("type"))})


CALLS = ("free_context", "deallocate", "create", "parse_header", "push_back", "lookup", "endElement", "newBuffer", "readAll", "feed")


@query("""WITH raw AS (SELECT event_id, ['free_context','deallocate','create','parse_header','push_back','lookup','endElement','newBuffer','readAll','feed'][event_id % 10 + 1] || event_type AS name FROM events), l AS (SELECT *, lower(name) AS s FROM raw)
SELECT event_id, name, CASE WHEN regexp_matches(s, 'finish|final|flush|close|destroy|free|cleanup|end|dealloc|release|teardown') THEN 'cleanup' WHEN regexp_matches(s, 'init|open|create|alloc|new|setup|begin|start') THEN 'setup'
 WHEN regexp_matches(s, 'parse|read|decode|load|consume|process') THEN 'consume' WHEN regexp_matches(s, 'update|write|append|push|feed') THEN 'update' ELSE 'other' END AS phase,
 CASE WHEN regexp_matches(s, 'free|cleanup|destroy|release|close|end|final|deinit') THEN 'cleanup' WHEN regexp_matches(s, 'init|open|create|setup|begin|start') THEN 'setup'
 WHEN regexp_matches(s, 'update|write|append|push|feed') THEN 'update' WHEN regexp_matches(s, 'read|parse|decode|load|process|finish') THEN 'consume' ELSE 'invoke' END AS sink FROM l""")
def phase_classifier(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.element_at(F.array(*(F.lit(c) for c in CALLS)), (F.col("event_id") % len(CALLS) + 1).cast("int")), "event_type")
    return table(spark, sf, "events").select("event_id", name.alias("name")).withColumns({"phase": classify.call_phase(F.col("name")), "sink": classify.sink_role(F.col("name"))})


@query("""WITH pairs AS (SELECT unnest(regexp_extract_all(text, '([A-Za-z]+)(->|\\.)[ \\n]?([A-Za-z]+)', 1)) AS owner, unnest(regexp_extract_all(text, '([A-Za-z]+)(->|\\.)[ \\n]?([A-Za-z]+)', 3)) AS field FROM documents)
SELECT owner, field, count(*) AS reads, CASE WHEN regexp_matches(lower(field), 'mode|type|flag|state|phase|status') THEN 'control-state' WHEN regexp_matches(lower(field), 'len|size|count|avail|capacity') THEN 'size-state'
 WHEN regexp_matches(lower(field), 'buf|data|next|ptr|input|output') THEN 'buffer-state' ELSE 'state' END AS kind
FROM pairs WHERE lower(owner) NOT IN ('the', 'of') GROUP BY owner, field ORDER BY reads DESC, owner, field LIMIT 12""")
def field_frequency(spark: SparkSession, sf: str) -> DataFrame:
    pattern = F.lit(r"([A-Za-z]+)(->|\.)[ \n]?([A-Za-z]+)")
    # one pass over the text; the parts are taken from the short matches
    found = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("m"))
    rows = found.select(F.regexp_extract("m", r"^[A-Za-z]+", 0).alias("owner"), F.regexp_extract("m", r"[A-Za-z]+$", 0).alias("field")).where("lower(owner) not in ('the', 'of')")
    counts = rows.groupBy("owner", "field").agg(F.count("*").alias("reads")).withColumn("kind", classify.field_kind(F.col("field")))
    return ordered.top_k(counts, [], [F.desc("reads"), "owner", "field"], 12)


@query("""WITH lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
kept AS (SELECT doc_id, line_no, last_value(CASE WHEN length(line) < 24 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading, line FROM lines)
SELECT doc_id, heading, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM kept GROUP BY doc_id, heading""")
def state_line_window(spark: SparkSession, sf: str) -> DataFrame:
    # only what a line gives is moved: its length, and its words if it is short
    given = F.transform(F.split("text", "\n"), lambda line: F.struct(F.length(line).alias("size"), F.when(F.length(line) < 24, line).alias("short")))
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(given).alias("line_no", "line")).select("doc_id", "line_no", "line.*")
    heading = ordered.carry_forward(lines, ["doc_id"], ["line_no"], F.col("short"))
    return lines.withColumn("heading", heading).groupBy("doc_id", "heading").agg(F.count("*").alias("n_lines"), F.sum("size").alias("n_chars"))


@query("""WITH blocks AS (SELECT user_id, event_id AS block, epoch_ms(ts) // 1000 AS start, epoch_ms(ts) // 1000 + 3600 * (1 + event_id % 5) AS stop FROM events WHERE event_type = 'signup'),
points AS (SELECT user_id, event_id, epoch_ms(ts) // 1000 AS at FROM events WHERE event_type <> 'signup')
SELECT p.user_id, p.event_id, b.block FROM points p JOIN blocks b ON p.user_id = b.user_id AND b.start <= p.at AND p.at < b.stop QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY b.start, b.block) = 1""")
def block_range_join(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    blocks = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("block"), F.col("at").alias("start"), (F.col("at") + 3600 * (1 + F.col("event_id") % 5)).alias("stop"))
    points = events.where("event_type != 'signup'").select("user_id", "event_id", "at")
    return ordered.block_join(points, blocks, ["user_id"], "at", "start", "stop", ["start", "block"]).select("user_id", "event_id", "block")


@query("""SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN trim(b.text) <> '' THEN 'bench:' || length(b.text) END, nullif(trim(d.lang), ''), 'none') AS value,
 CAST(coalesce(l.quality, 0) AS BIGINT) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def coalesce_merge(spark: SparkSession, sf: str) -> DataFrame:
    d, l, b = (table(spark, sf, t) for t in ("documents", "labels", "benchmark"))
    joined = d.select("doc_id", "lang").join(l, "doc_id", "left").join(b, F.col("item_id") == F.col("doc_id"), "left")
    value = ordered.coalesce_chain(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.trim("text") != "", F.concat(F.lit("bench:"), F.length("text").cast("string"))), F.trim("lang"), F.lit("none"))
    return joined.select("doc_id", value.alias("value"), F.coalesce("quality", F.lit(0)).cast("long").alias("quality"))


@query("""WITH steps AS (SELECT o_custkey, 0 AS step, o_orderkey FROM orders WHERE o_totalprice > 490000 UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, 2, o_orderkey FROM orders)
SELECT o_custkey, CAST(step AS BIGINT) AS step, o_orderkey FROM steps QUALIFY step = min(step) OVER (PARTITION BY o_custkey)""")
def cascade_first_hit(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    steps = [orders.where(w).select("o_custkey", F.lit(i).cast("long").alias("step"), "o_orderkey") for i, w in enumerate(("o_totalprice > 490000", "o_orderpriority = '1-URGENT'", "true"))]
    return ordered.precedence(steps, ["o_custkey"]).select("o_custkey", "step", "o_orderkey")


@query("""WITH dropped AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS name FROM part WHERE p_size = 7 AND p_name LIKE 'r%')
SELECT p_partkey, p_name, p_type FROM part WHERE NOT EXISTS (SELECT 1 FROM dropped WHERE contains(lower(p_name), name) OR contains(lower(p_type), name))""")
def prune_anti(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    dropped = part.where("p_size = 7 and p_name like 'r%'").select(F.lower(F.element_at(F.split("p_name", " "), 2)).alias("name")).distinct()
    return ordered.prune_containing(part.drop("p_size"), ["p_name", "p_type"], dropped)


@query("""WITH anchors AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS token FROM part WHERE p_size = 3 AND p_partkey % 10 = 0)
SELECT p_partkey, p_name FROM part WHERE list_has_any(string_split(lower(p_name), ' '), (SELECT list(token) FROM anchors))""")
def anchor_semi(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    anchors = part.where("p_size = 3 and p_partkey % 10 = 0").select(F.explode(names.identifier_tokens(F.col("p_name"))).alias("token")).distinct()
    return ordered.keep_anchored(part.drop("p_size"), names.identifier_tokens(F.col("p_name")), anchors)


@query("""WITH names AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS name FROM conversations)
SELECT name, count(*) AS n_docs, min(doc_id) AS first_doc FROM names JOIN documents ON contains(lower(text), name) GROUP BY name""")
def names_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents contain which of all longer words of the conversations, anywhere in the text."""
    words = table(spark, sf, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("name")).distinct()
    found = ordered.containing_rows(table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text")), "doc_id", "text", words, "name")
    return found.groupBy("name").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("""WITH uses AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'click'), definitions AS (SELECT user_id, ts AS defined, event_id AS definition, value FROM events WHERE event_type = 'click')
SELECT u.event_id, d.definition, d.value, epoch_us(u.ts) - epoch_us(d.defined) AS age FROM uses u ASOF LEFT JOIN definitions d ON u.user_id = d.user_id AND u.ts >= d.defined""")
def known_when_read(spark: SparkSession, sf: str) -> DataFrame:
    """The last definition at or before each use."""
    events = table(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    uses = events.where("event_type != 'click'").select("event_id", "user_id", "at")
    definitions = events.where("event_type = 'click'").select("user_id", F.col("at").alias("defined"), F.col("event_id").alias("definition"), "value")
    found = ordered.asof_join(uses, definitions, ["user_id"], "at", "defined", bucket=6 * 3600 * 1_000_000)
    return found.select("event_id", "definition", "value", (F.col("at") - F.col("defined")).alias("age"))


@query("""WITH said AS (SELECT event_id, event_type, user_id % 7 AS y, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 5 AS k FROM events)
SELECT CASE WHEN event_id % 11 = 0 THEN 'nothing' WHEN event_id % 11 = 1 THEN '{"cut": {"off": ' || y ELSE '{"a":"' || event_type || '","b":{"k":' || k || ',"list":[{"p":1,"q":null}],"y":' || y || '}}' END AS item, count(*) AS n, min(event_id) AS first_id FROM said GROUP BY ALL""")
def canonical_items(spark: SparkSession, sf: str) -> DataFrame:
    """Objects wrapped in prose, with keys in changing order at each depth: one row for each that differs."""
    k = F.get_json_object("props", "$.k").cast("long") % 5
    y, kind = F.col("user_id") % 7, F.col("event_type")
    one = F.concat(F.lit('Answer: {"b": {"y": '), y, F.lit(', "list": [{"q": null, "p": 1}], "k": '), k, F.lit('}, "a": "'), kind, F.lit('"}\nthat is all'))
    two = F.concat(F.lit(' {"a":"'), kind, F.lit('", "b":{"k": '), k, F.lit(',"y":'), y, F.lit(', "list":[{"p":1,"q":null}]}} '), F.lit("```"))
    bad = F.when(F.col("event_id") % 11 == 0, F.lit("nothing")).when(F.col("event_id") % 11 == 1, F.concat(F.lit('{"cut": {"off": '), y))
    text = F.coalesce(bad, F.when(F.col("event_id") % 2 == 0, one).otherwise(two))
    return table(spark, sf, "events").select(tolerant.canonical_text(text).alias("item"), "event_id").groupBy("item").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


#: Documents as IR files: of seven words the first two make a definition over two lines, the last its end, the others calls.
IR_WORDS = """words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) - 1 AS i FROM documents)"""


def document_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as IR files of a line a word, in segments cut where the document is; documents are dealt over tasks by their number."""
    words = spread(table(spark, sf, "documents"), 1000, "doc_id").select(F.col("doc_id").cast("string").alias("file"), F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("words"))

    def line(word: Column, i: Column) -> Column:
        place = i % 7
        return (
            F.when(place == 0, F.concat(F.lit("define void @"), word, F.lit("(i32 %a,"))).when(place == 1, F.lit("    i32 %b) {"))
            .when(place == 6, F.lit("}")).otherwise(F.concat(F.lit("  call void @"), word, F.lit("(i32 %a, i32 7)")))
        )

    return segments_in_rows(words.select("file", F.transform("words", line).alias("lines")))


@query(f"""WITH {IR_WORDS}, owners AS (SELECT doc_id, i // 7 AS part, word AS caller FROM words WHERE i % 7 = 0)
SELECT caller, word AS callee, 'direct' AS kind FROM words JOIN owners USING (doc_id) WHERE part = i // 7 AND i % 7 IN (2, 3, 4, 5) GROUP BY ALL""")
def document_call_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Call edges of whole documents read as IR files, in segments."""
    return graph.call_edges(ir.parse_segments(materialise(document_segments(spark, sf)), with_parameters=False))


@query(f"""WITH {IR_WORDS}, heads AS (SELECT word AS name, doc_id, i, EXISTS (SELECT 1 FROM words w WHERE w.doc_id = h.doc_id AND w.i = h.i + 1) AS whole FROM words h WHERE i % 7 = 0)
SELECT name, CAST(doc_id AS VARCHAR) AS file, CAST(i + 1 AS BIGINT) AS line, CASE WHEN whole THEN 'i32 a, i32 b' ELSE 'i32 a' END AS params FROM heads QUALIFY row_number() OVER (PARTITION BY name ORDER BY CAST(doc_id AS VARCHAR) DESC, i DESC) = 1""")
def document_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The last definition of each name in documents read as IR files; one that its document breaks off has one parameter."""
    functions = ir.read_functions(materialise(document_segments(spark, sf)))
    params = F.array_join(F.transform("params", lambda p: F.concat_ws(" ", p["type"], p["name"])), ", ")
    return functions.select("name", "file", F.col("line").cast("long").alias("line"), params.alias("params"))


@query("""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) - 1 AS i FROM documents),
parts AS (SELECT doc_id, i // 4 AS part, 'int f_' || max(word) FILTER (i % 4 = 0) || '(int ' || max(word) FILTER (i % 4 = 1) || ')' || chr(10) || '{' || chr(10) || '  ' || max(word) FILTER (i % 4 = 2) || '(' || max(word) FILTER (i % 4 = 3) || ');' || chr(10) || '}' || chr(10) AS text,
  'f_' || max(word) FILTER (i % 4 = 0) AS name FROM words GROUP BY ALL HAVING count(*) = 4)
SELECT CAST(doc_id AS VARCHAR) AS id, name, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length(text) - 1 AS BIGINT) AS size FROM parts""")
def document_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Functions in documents written as C text, four words each, by the session's table function."""
    spans.register(spark)
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    fours = F.filter(F.sequence(F.lit(0), F.size("w")), lambda i: (i % 4 == 0) & (i + 3 < F.size("w")))
    word = lambda i: F.get("w", i)
    one = lambda i: F.concat(F.lit("int f_"), word(i), F.lit("(int "), word(i + 1), F.lit(")\n{\n  "), word(i + 2), F.lit("("), word(i + 3), F.lit(");\n}\n"))
    texts = table(spark, sf, "documents").select("doc_id", words.alias("w")).select("doc_id", F.array_join(F.transform(fours, one), "").alias("text"))
    found = spark.sql("SELECT * FROM function_spans(TABLE(SELECT doc_id AS id, text FROM {texts}))", texts=texts)
    return found.select("id", "name", "start", (F.col("stop") - F.col("start")).alias("size"))


@query("""WITH told AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderkey % 2 AS batch, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END AS urgent FROM orders),
last AS (SELECT o_custkey, batch, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, arg_max(struct_pack(u := urgent), (o_orderdate, o_orderkey)).u AS urgent FROM told GROUP BY ALL)
SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, coalesce(b.last_order, a.last_order) AS last_order, coalesce(b.urgent, a.urgent) AS urgent FROM (SELECT * FROM last WHERE batch = 0) a FULL JOIN (SELECT * FROM last WHERE batch = 1) b ON a.o_custkey = b.o_custkey""")
def upserted_records(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' last orders, upserted in two batches; a null of the second leaves what the first has told."""
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")).alias("urgent")
    told = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("last_order"), "o_orderdate", urgent)
    folder = f"{shared_dir(spark)}/store-{spark.sql('select uuid()').first()[0]}"
    for batch in (0, 1):
        store.upsert(spark, folder, told.where(F.col("last_order") % 2 == batch), ["o_custkey"], ["o_orderdate", "last_order"], fill=True, buckets=16)
    return store.read(spark, folder).select("o_custkey", "last_order", "urgent")


@query("""WITH fn AS (SELECT 'f' || p_partkey AS name, CASE WHEN p_partkey % 10 > 0 THEN '/src/' || lower(p_type) || CASE WHEN p_size % 7 = 0 THEN '/tests' ELSE '' END || '/' || p_size || '.c' END AS file, p_partkey AS k FROM part),
pub AS (SELECT name, file, regexp_replace(file, '/[^/]*$', '') AS folder, coalesce(NOT contains(file, '/tests/'), true) AS lib FROM fn WHERE k % 4 = 1), lib AS (SELECT * FROM pub WHERE lib OR NOT (SELECT bool_or(lib) FROM pub)),
edges AS (SELECT DISTINCT 'f' || l_suppkey AS caller, 'f' || l_partkey AS callee FROM lineitem WHERE l_quantity > 48 AND l_partkey % 3 > 0),
most AS (SELECT caller AS name FROM edges WHERE caller IN (SELECT name FROM lib) GROUP BY caller ORDER BY count(*) DESC, caller LIMIT 1),
asked AS (SELECT name, file, regexp_replace(file, '/[^/]*$', '') AS folder FROM fn),
steps AS (SELECT a.name AS sink, CASE WHEN a.name IN (SELECT name FROM pub) THEN a.name END AS e0,
  CASE WHEN a.name NOT IN (SELECT callee FROM edges) THEN (SELECT arg_min(p.name, (length(p.name), p.name)) FROM pub p WHERE p.file = a.file) END AS e1,
  (SELECT min(l.name) FROM lib l WHERE l.folder = a.folder) AS e2, (SELECT name FROM most) AS e3, (SELECT min(name) FROM lib) AS e4 FROM asked a)
SELECT sink, coalesce(e0, e1, e2, e3, e4) AS entry, CASE WHEN e0 IS NOT NULL THEN 'itself' WHEN e1 IS NOT NULL THEN 'same_unit' WHEN e2 IS NOT NULL THEN 'same_folder' WHEN e3 IS NOT NULL THEN 'most_callees' ELSE 'first' END AS rule FROM steps WHERE coalesce(e0, e1, e2, e3, e4) IS NOT NULL""")
def fallback_entries(spark: SparkSession, sf: str) -> DataFrame:
    """An entry for each function as if no call path led to it."""
    named = F.concat(F.lit("f"), "p_partkey")
    tests = F.when(F.col("p_size") % 7 == 0, "/tests").otherwise("")
    file = F.when(F.col("p_partkey") % 10 > 0, F.concat(F.lit("/src/"), F.lower("p_type"), tests, F.lit("/"), "p_size", F.lit(".c")))
    functions = table(spark, sf, "part").select(named.alias("name"), file.alias("file"), "p_partkey")
    edges = table(spark, sf, "lineitem").where("l_quantity > 48 and l_partkey % 3 > 0").select(F.concat(F.lit("f"), "l_suppkey").alias("caller"), F.concat(F.lit("f"), "l_partkey").alias("callee"))
    return assemble.fallback_entries(functions, functions.select("name", "file"), functions.where("p_partkey % 4 = 1"), edges)


#: Files of a project: one for each part, many of which have one name.
LISTED = """fn AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') || '_' || p_size % 10 AS stem, lower(p_type) AS folder, ['.c', '.cc', '.cpp', '.cxx'][p_partkey % 4 + 1] AS ending FROM part), files AS (SELECT DISTINCT '/r/' || folder || '/' || stem || ending AS path, stem, ending FROM fn WHERE k % 3 > 0)"""


def _listed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    stem = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size") % 10)
    ending = F.element_at(F.array(*map(F.lit, listing.ENDINGS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    fn = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), stem.alias("stem"), F.lower("p_type").alias("folder"), ending.alias("ending"))
    return fn, fn.where("k % 3 > 0").select(F.concat(F.lit("/r/"), "folder", F.lit("/"), "stem", "ending").alias("path")).distinct()


@query(f"""WITH {LISTED}, asked AS (SELECT k AS id, CASE WHEN k % 7 = 0 THEN '' WHEN k % 2 = 0 THEN folder || '/' || stem || ending ELSE 'gone/' || stem || ending END AS path, stem || ending AS base FROM fn)
SELECT id, path, CASE WHEN path <> '' THEN coalesce((SELECT min(f.path) FROM files f WHERE f.path = '/r/' || a.path), (SELECT min(f.path) FROM files f WHERE f.stem || f.ending = a.base)) END AS found FROM asked a""")
def source_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The files that advisories name, by path or else by base name."""
    fn, files = _listed(spark, sf)
    path = F.when(F.col("k") % 7 == 0, "").otherwise(F.concat(F.when(F.col("k") % 2 == 0, F.col("folder")).otherwise("gone"), F.lit("/"), "stem", "ending"))
    return listing.find_sources(fn.select(F.col("k").alias("id"), path.alias("path")), files, "/r/")


@query(f"""WITH {LISTED}, asked AS (SELECT DISTINCT '/b/' || k || '/' || stem || CASE WHEN k % 9 = 0 THEN '.o' ELSE '.ll:' || k END AS path, stem, k FROM fn),
best AS (SELECT stem, arg_min(path, (list_position(['.c', '.cc', '.cpp', '.cxx'], ending), path)) AS best FROM files GROUP BY stem)
SELECT path, CASE WHEN k % 9 = 0 THEN path ELSE coalesce(best, '/r/' || stem || '.c') END AS source FROM asked LEFT JOIN best USING (stem)""")
def ir_source_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The sources that IR files were compiled from."""
    fn, files = _listed(spark, sf)
    path = F.concat(F.lit("/b/"), "k", F.lit("/"), "stem", F.when(F.col("k") % 9 == 0, ".o").otherwise(F.concat(F.lit(".ll:"), "k")))
    return listing.ir_sources(fn.select(path.alias("path")), files, "/r", guess=True)


@query("""WITH items AS (SELECT o_custkey, o_orderkey, o_orderstatus AS stage, list_position(['P', 'O', 'F'], o_orderstatus) AS rank, '{"p":"' || o_orderpriority || '","q":{"m":' || o_orderkey % 3 || ',"s":1}}' AS item FROM orders),
once AS (SELECT * FROM items WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey, item ORDER BY rank, o_orderkey) = 1)
SELECT o_custkey, row_number() OVER w - 1 AS place, item FROM once WINDOW w AS (PARTITION BY o_custkey ORDER BY rank, o_orderkey) QUALIFY row_number() OVER w <= 4""")
def merged_stage_items(spark: SparkSession, sf: str) -> DataFrame:
    """The first items of each customer over three stages; objects are one whatever the order of their keys."""
    priority, m = F.col("o_orderpriority"), F.col("o_orderkey") % 3
    one = F.concat(F.lit('{"q": {"s": 1, "m": '), m, F.lit('}, "p": "'), priority, F.lit('"}'))
    two = F.concat(F.lit('{"p": "'), priority, F.lit('", "q": {"m": '), m, F.lit(', "s": 1}}'))
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("stage"), F.when(F.col("o_orderkey") % 2 == 0, one).otherwise(two).alias("item"))
    found = items.merged_stages(rows, ["o_custkey"], ["P", "O", "F"], "item", ["o_orderkey"], 4)
    return found.select("o_custkey", F.col("place").cast("long").alias("place"), tolerant.canonical_text(F.col("item")).alias("item"))


@query("""WITH items AS (SELECT p_brand, p_partkey, split_part(p_name, ' ', 1) AS target, p_name || ' of ' || p_type AS rationale FROM part), dropped AS (SELECT DISTINCT p_brand AS b, CASE WHEN p_size <= 3 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) || ' of ' || p_type END AS name FROM part WHERE p_size <= 5)
SELECT * FROM items WHERE NOT EXISTS (SELECT 1 FROM dropped WHERE b = p_brand AND (name = target OR contains(rationale, name)))""")
def pruned_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Items without a dropped name of their brand, as a whole field or within a text."""
    part = table(spark, sf, "part")
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    rows = part.select("p_brand", "p_partkey", first.alias("target"), F.concat("p_name", F.lit(" of "), "p_type").alias("rationale"))
    dropped = part.where("p_size <= 5").select("p_brand", F.when(F.col("p_size") <= 3, first).otherwise(F.concat(second, F.lit(" of "), "p_type")).alias("name"))
    return items.prune_fields(rows, dropped, ["p_brand"], equal=["target"], containing=["rationale"])


@query("""WITH items AS (SELECT p_brand, p_partkey, split_part(p_name, ' ', 1) AS name, [lower(p_type), split_part(p_name, ' ', 2)] AS uses FROM part), anchors AS (SELECT DISTINCT p_brand AS b, CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE lower(p_type) END AS token FROM part WHERE p_size <= 8)
SELECT p_brand, p_partkey, name FROM items WHERE EXISTS (SELECT 1 FROM anchors WHERE b = p_brand AND (token = name OR list_contains(uses, token)))""")
def anchored_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Items some field of which names an anchor of their brand."""
    part = table(spark, sf, "part")
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    rows = part.select("p_brand", "p_partkey", first.alias("name"), F.array(F.lower("p_type"), second).alias("uses"))
    anchors = part.where("p_size <= 8").select("p_brand", F.when(F.col("p_size") % 2 == 0, second).otherwise(F.lower("p_type")).alias("token"))
    return items.anchored(rows, anchors, ["p_brand"], ["name", "uses"]).drop("uses")


@query("""WITH turns AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS opens FROM conversations),
seg AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS sub FROM turns),
scored AS (SELECT conv_id, CAST(sub AS BIGINT) AS sub, CAST(sum(CASE WHEN role = 'user' AND contains(lower(text), 'the') THEN 4 ELSE 0 END) + sum(CASE WHEN length(text) BETWEEN 1 AND 600 THEN 3 WHEN length(text) > 2000 THEN -3 ELSE 0 END) AS BIGINT) AS score FROM seg GROUP BY conv_id, sub)
SELECT conv_id, sub, score FROM scored QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, sub) = 1 OR (score > 0 AND score >= max(score) OVER (PARTITION BY conv_id) - 2)""")
def subpatch_rank(spark: SparkSession, sf: str) -> DataFrame:
    turns = ordered.segments(table(spark, sf, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user", "sub")
    size = F.length("text")
    points = F.when((F.col("role") == "user") & F.lower("text").contains("the"), 4).otherwise(0) + F.when(size.between(1, 600), 3).when(size > 2000, -3).otherwise(0)
    scored = turns.groupBy("conv_id", "sub").agg(F.sum(points).cast("long").alias("score"))
    return advisory.near_top(scored, ["conv_id"], "score", ["sub"], 2)


RULES = (
    rules.Rule("MISSING_LICENSE", "violation", 20, True, "NOT regexp_like(text, 'License')", 1),
    rules.Rule("SHOUTING", "warning", 5, False, None, 3, "[A-Z][A-Z][A-Z]+"),
    rules.Rule("MARKUP", "violation", 18, False, None, 6, "<[a-z]+"),
    rules.Rule("TINY", "violation", 40, False, "length(text) < 60", 1),
    rules.Rule("NUMBERS", "warning", 4, False, None, 10, "[0-9][0-9][0-9][0-9]+"),
)


@query("""WITH hits AS (SELECT doc_id, 20 AS penalty, true AS critical, 1 AS n FROM documents WHERE NOT regexp_matches(text, 'License')
 UNION ALL SELECT doc_id, 5, false, least(3, len(regexp_extract_all(text, '[A-Z][A-Z][A-Z]+'))) FROM documents UNION ALL SELECT doc_id, 18, false, least(6, len(regexp_extract_all(text, '<[a-z]+'))) FROM documents
 UNION ALL SELECT doc_id, 40, false, 1 FROM documents WHERE length(text) < 60 UNION ALL SELECT doc_id, 4, false, least(10, len(regexp_extract_all(text, '[0-9][0-9][0-9][0-9]+'))) FROM documents)
SELECT doc_id, CAST(greatest(0, 100 - coalesce(sum(penalty * n), 0)) AS BIGINT) AS score, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings, NOT coalesce(bool_or(critical AND n > 0), false) AND 100 - coalesce(sum(penalty * n), 0) >= 60 AS ok
FROM documents LEFT JOIN hits USING (doc_id) GROUP BY doc_id""")
def rule_validation(spark: SparkSession, sf: str) -> DataFrame:
    return rules.evaluate(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text", RULES)


@query("""WITH r AS (SELECT p_brand AS name, p_partkey AS ord, p_size > 25 AS ok, p_size % 20 AS score, p_partkey % 3 AS relations_ok, p_partkey % 4 AS violations, p_partkey % 5 AS warnings FROM part)
SELECT name, ord, ok, CAST(score AS BIGINT) AS score FROM r QUALIFY row_number() OVER (PARTITION BY name ORDER BY ok DESC, score DESC, relations_ok DESC, violations, warnings, ord) = 1""")
def candidate_rank(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    reports = table(spark, sf, "part").select(F.col("p_brand").alias("name"), k.alias("ord"), (size > 25).alias("ok"), (size % 20).cast("long").alias("score"), (k % 3).alias("relations_ok"), (k % 4).alias("violations"), (k % 5).alias("warnings"))
    return rules.best_candidate(reports, ["name"]).select("name", "ord", "ok", "score")


@query("""WITH logs AS (SELECT event_id, CAST(event_id % 3 > 0 AS INT) AS returncode, '#0 0x1 in ' || event_type || '_fn' || chr(10) || '#1 0x2 in fn' || (event_id % 6) || chr(10)
  || CASE WHEN event_id % 4 = 0 THEN '/fuzzer.cc:12' ELSE '' END || chr(10) || 'SUMMARY: x' || chr(10) || '#2 0x3 in fn0' AS output FROM events),
cut AS (SELECT event_id, returncode, output, regexp_extract_all(split_part(output, chr(10) || 'SUMMARY:', 1), '#[0-9]+ +[^\\n]*?in +([A-Za-z_][A-Za-z0-9_:]*)', 1) AS stack FROM logs),
first AS (SELECT *, CASE WHEN list_contains(stack, 'fn0') THEN 'sink-hit' WHEN list_has_any(stack, ['fn2', 'fn1', 'fn0']) THEN 'sink-adjacent' WHEN list_contains(stack, 'click_fn') THEN 'entry-reached'
  WHEN list_has_any(stack, ['click_fn', 'fn3', 'fn2', 'fn1', 'fn0']) THEN 'path-reached' WHEN returncode <> 0 THEN 'harness-or-setup-fault' ELSE 'smoke-only' END AS c FROM cut)
SELECT event_id, CASE WHEN contains(output, '/fuzzer.cc:') AND c NOT IN ('sink-hit', 'sink-adjacent') THEN 'harness-or-setup-fault' ELSE c END AS classification,
 CAST(CASE WHEN contains(output, '/fuzzer.cc:') AND c NOT IN ('sink-hit', 'sink-adjacent') THEN least(10, CASE c WHEN 'entry-reached' THEN 50 WHEN 'path-reached' THEN 40 WHEN 'smoke-only' THEN 15 ELSE 5 END)
  ELSE CASE c WHEN 'sink-hit' THEN 100 WHEN 'sink-adjacent' THEN 80 WHEN 'entry-reached' THEN 50 WHEN 'path-reached' THEN 40 WHEN 'smoke-only' THEN 15 ELSE 5 END END AS BIGINT) AS score, array_to_string(stack, ',') AS stack_symbols FROM first""")
def run_evidence(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    output = F.concat(F.lit("#0 0x1 in "), "event_type", F.lit("_fn\n#1 0x2 in fn"), k % 6, F.lit("\n"), F.when(k % 4 == 0, "/fuzzer.cc:12").otherwise(""), F.lit("\nSUMMARY: x\n#2 0x3 in fn0"))
    logs = table(spark, sf, "events").select("event_id", output.alias("output"), (k % 3 > 0).cast("int").alias("returncode"))
    path = F.array(*(F.lit(f) for f in ("click_fn", "fn3", "fn2", "fn1", "fn0")))
    found = evidence.classify_runs(logs, F.lit("fn0"), F.lit("click_fn"), path)
    return found.select("event_id", "classification", F.col("score").cast("long").alias("score"), F.array_join("stack_symbols", ",").alias("stack_symbols"))


@query("""WITH raw AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: TRY_CAST(x AS HUGEINT)) AS xs FROM documents),
good AS (SELECT doc_id, list_filter(xs, lambda x: x >= 16 AND x <= 281474976710656) AS xs FROM raw),
uniq AS (SELECT doc_id, list_filter(xs, lambda x, i: list_position(xs, x) = i)[1:20] AS xs FROM good)
SELECT doc_id, CAST(i AS BIGINT) AS place, CAST(xs[i] AS BIGINT) AS value, CASE WHEN xs[i] >= 256 THEN printf('0x%x', CAST(xs[i] AS BIGINT)) ELSE CAST(xs[i] AS VARCHAR) END AS token FROM (SELECT doc_id, xs, unnest(generate_series(1, len(xs))) AS i FROM uniq)""")
def constant_mining(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(seeds.numeric_constants(F.col("text"), r"([0-9]+)")).alias("place", "c"))
    return rows.select("doc_id", (F.col("place") + 1).cast("long").alias("place"), "c.value", "c.token")


@query("""WITH raw AS (SELECT event_id, ['base64', 'hex', 'utf8'][event_id % 3 + 1] AS encoding, CASE event_id % 3 WHEN 0 THEN base64(encode(event_type || event_id)) WHEN 1 THEN hex(encode(event_type)) || CASE WHEN event_id % 5 = 0 THEN 'zz' ELSE '' END ELSE event_type END AS content FROM events)
SELECT event_id, encoding, NOT (encoding = 'hex' AND event_id % 5 = 0) AS ok, CASE encoding WHEN 'base64' THEN hex(from_base64(content)) WHEN 'utf8' THEN hex(encode(content)) ELSE CASE WHEN event_id % 5 = 0 THEN NULL ELSE upper(content) END END AS bytes FROM raw""")
def seed_codec(spark: SparkSession, sf: str) -> DataFrame:
    k, word = F.col("event_id"), F.col("event_type")
    content = F.when(k % 3 == 0, F.base64(F.encode(F.concat(word, k), "UTF-8"))).when(k % 3 == 1, F.concat(F.hex(F.encode(word, "UTF-8")), F.when(k % 5 == 0, "zz").otherwise(""))).otherwise(word)
    encoding = F.element_at(F.array(F.lit("base64"), F.lit("hex"), F.lit("utf8")), (k % 3 + 1).cast("int"))
    decoded = seeds.validate_seeds(table(spark, sf, "events").select("event_id", encoding.alias("encoding"), content.alias("content")))
    return decoded.select("event_id", "encoding", "ok", F.hex("bytes").alias("bytes"))


@query("""WITH bare AS (SELECT page_id, regexp_replace(lower(trim(url)), '^(https?://|git://|ssh://|git@){1,3}', '') AS u FROM pages)
SELECT page_id, regexp_replace(regexp_replace(CASE WHEN contains(u, '/') THEN regexp_replace(u, '^([^/:]*):', '\\1/') ELSE u END, '/$', ''), '\\.git$', '') AS canonical FROM bare""")
def repo_url_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", names.repository_url(F.col("url")).alias("canonical"))


@query("""WITH RECURSIVE lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(regexp_extract_all(line, '[.,;]')) DESC, line_no) AS rn FROM lines),
walk AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS rn, CAST(400 AS BIGINT) AS budget, CAST(NULL AS BIGINT) AS line_no, '' AS line FROM documents
  UNION ALL SELECT r.doc_id, r.rn, CASE WHEN length(r.line) + 1 <= w.budget THEN w.budget - length(r.line) - 1 ELSE w.budget END, CASE WHEN length(r.line) + 1 <= w.budget THEN r.line_no END, r.line FROM walk w JOIN ranked r ON r.doc_id = w.doc_id AND r.rn = w.rn + 1),
kept AS (SELECT doc_id, line_no, CASE WHEN line_no > lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) + 1 THEN '    // ...' || chr(10) || line ELSE line END AS line FROM walk WHERE line_no IS NOT NULL)
SELECT d.doc_id, count(k.line_no) AS n_lines, coalesce(string_agg(k.line, chr(10) ORDER BY k.line_no), '') AS excerpt FROM documents d LEFT JOIN kept k USING (doc_id) GROUP BY d.doc_id""")
def smart_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return excerpt.text_excerpt(table(spark, sf, "documents"), ["doc_id"], "text", lambda line: F.regexp_count(line, F.lit("[.,;]")).cast("long"), 400)


@query(r"""SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS head,
 regexp_matches(coalesce(text, ''), '(?i)(^|[^A-Za-z0-9_])(license|the|mit)($|[^A-Za-z0-9_])') AS said, coalesce(lang, '?') || ' ' || coalesce(source, '?') AS parameter FROM documents""")
def text_helpers(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(F.lit("license"), F.lit("the"), F.lit("mit"))
    parameter = names.parameter_text(F.struct(F.col("lang").alias("type"), F.col("source").alias("name")))
    return table(spark, sf, "documents").select("doc_id", names.cap_text(F.col("text"), 80, "...").alias("head"), names.mentions_word(F.col("text"), words).alias("said"), parameter.alias("parameter"))


CLASSES = "CASE o_orderkey % 5 WHEN 0 THEN '190' WHEN 1 THEN 'cwe-125, CWE-190' WHEN 2 THEN 'CWE-787' WHEN 3 THEN 'CWE-125 125' END"


@query(rf"""WITH entries AS (SELECT o_orderkey AS id, {CLASSES} AS cwe FROM orders),
 classes AS (SELECT DISTINCT id, CASE WHEN regexp_full_match(c, '\d+') THEN 'CWE-' || c ELSE c END AS cwe FROM (SELECT id, unnest(regexp_split_to_array(upper(coalesce(cwe, '')), '[, ]+')) AS c FROM entries))
 SELECT id, cwe, rule FROM classes JOIN (VALUES ('CWE-190', 'wide'), ('CWE-125', 'read'), ('CWE-125', 'bound')) r(cwe, rule) USING (cwe)""")
def weakness_rules(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(CLASSES).alias("cwe"))
    rules_ = spark.createDataFrame([("CWE-190", "wide"), ("CWE-125", "read"), ("CWE-125", "bound")], "cwe string, rule string")
    return derive.class_rules(entries, rules_)


MARKERS = "CASE event_id % 7 WHEN 0 THEN 'configure' WHEN 1 THEN 'CMakeLists.txt' WHEN 2 THEN 'Makefile' WHEN 3 THEN 'meson.build' WHEN 4 THEN 'configure.ac' ELSE 'README' END"


@query(f"""WITH marked AS (SELECT user_id AS root, list({MARKERS}) AS files FROM events GROUP BY user_id), n AS (SELECT root,
 list_contains(files, 'configure') AS configure, list_contains(files, 'CMakeLists.txt') AS lists, list_contains(files, 'Makefile') AS makefile, list_contains(files, 'meson.build') AS meson, list_contains(files, 'configure.ac') AS input FROM marked)
SELECT root, CASE WHEN configure AND input THEN 'autotools' WHEN lists THEN 'cmake' WHEN makefile THEN 'make' WHEN meson THEN 'meson' WHEN configure OR input THEN 'autotools' ELSE 'unknown' END AS system FROM n""")
def build_systems(spark: SparkSession, sf: str) -> DataFrame:
    listing = table(spark, sf, "events").select(F.col("user_id").alias("root"), F.expr(MARKERS).alias("file"))
    return build_log.build_system(listing, spark.createDataFrame([("cmake",)], "name string"))


LISTING = """'/s/' || CASE WHEN p_partkey % 11 = 0 THEN 'build' WHEN p_partkey % 13 = 0 THEN 'tests' ELSE 'd' || CAST(p_size AS STRING) END || '/' ||
 CASE p_partkey % 5 WHEN 0 THEN 'x.h' WHEN 1 THEN 'lib' || lower(substr(p_name, 1, 3)) || CAST(p_size AS STRING) || '.so.1' WHEN 2 THEN 'libq' || CAST(p_size AS STRING) || '.a' WHEN 3 THEN 'f' || CAST(p_partkey AS STRING) || '.c' ELSE 'notes.txt' END"""
DUCK_LISTING = LISTING.replace("AS STRING", "AS VARCHAR")


def file_listing(spark: SparkSession, sf: str) -> DataFrame:
    """A listing of files made of part names and sizes."""
    return table(spark, sf, "part").select(F.expr(LISTING).alias("path"))


@query(rf"""WITH files AS (SELECT {DUCK_LISTING} AS path FROM part), parts AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '([^/]+)$', 1) AS base FROM files WHERE NOT contains(path, '/tests/')),
 found AS (SELECT 'include' AS kind, folder AS value FROM parts WHERE ends_with(base, '.h')
  UNION SELECT 'library_dir', folder FROM parts WHERE regexp_full_match(base, 'lib.+\.(a|so(\..*)?)') UNION SELECT 'library', split_part(regexp_replace(base, '^lib', ''), '.', 1) FROM parts WHERE regexp_full_match(base, 'lib.+\.(a|so(\..*)?)'))
SELECT kind, value FROM found QUALIFY row_number() OVER (PARTITION BY kind ORDER BY value) <= 20""")
def listed_search_paths(spark: SparkSession, sf: str) -> DataFrame:
    return build_log.search_paths(file_listing(spark, sf), 20)


@query(rf"""WITH files AS (SELECT {DUCK_LISTING} AS path FROM part), wanted AS (SELECT DISTINCT path FROM files WHERE ends_with(path, '7.c'))
SELECT path FROM wanted UNION ALL SELECT path FROM (SELECT path FROM files WHERE regexp_matches(path, '\.(c|h)$') AND NOT contains(path, '/build/') AND path NOT IN (SELECT path FROM wanted) ORDER BY path LIMIT 50)""")
def listed_sources(spark: SparkSession, sf: str) -> DataFrame:
    files = file_listing(spark, sf)
    return retrieval.source_files(files, files.where("path like '%7.c'"), 50)


@query(r"""WITH symbols AS (SELECT 'lib' || l_suppkey AS library, CASE l_partkey % 3 WHEN 0 THEN '__p' WHEN 1 THEN 'part_' ELSE 'p.' END || l_partkey AS name FROM lineitem),
 large AS (SELECT 'lib' || s_suppkey AS library FROM supplier ORDER BY CAST(s_acctbal * 100 AS BIGINT) DESC, 'lib' || s_suppkey LIMIT 5)
SELECT DISTINCT name FROM symbols WHERE library IN (SELECT library FROM large) AND NOT regexp_matches(name, '^__|^_Z|\.') ORDER BY name LIMIT 200""")
def largest_libraries_symbols(spark: SparkSession, sf: str) -> DataFrame:
    libraries = table(spark, sf, "supplier").select(F.concat(F.lit("lib"), "s_suppkey").alias("library"), F.expr("cast(s_acctbal * 100 as bigint)").alias("size"))
    name = F.concat(F.expr("CASE l_partkey % 3 WHEN 0 THEN '__p' WHEN 1 THEN 'part_' ELSE 'p.' END"), F.col("l_partkey").cast("string"))
    symbols = table(spark, sf, "lineitem").select(F.concat(F.lit("lib"), "l_suppkey").alias("library"), name.alias("name"))
    return headers.symbol_listing(libraries, symbols)


@query("""WITH ranked AS (SELECT o_orderkey AS path_id, 'c' || o_custkey AS entry, o_orderkey % 97 AS score FROM orders), exported AS (SELECT 'c' || c_custkey AS name FROM customer WHERE c_nationkey < 5),
 kept AS (SELECT r.* FROM ranked r JOIN exported ON entry = name) SELECT path_id, entry, score FROM kept QUALIFY score = max(score) OVER () ORDER BY path_id LIMIT 1""")
def best_exported_path(spark: SparkSession, sf: str) -> DataFrame:
    ranked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path_id"), F.concat(F.lit("c"), "o_custkey").alias("entry"), (F.col("o_orderkey") % 97).alias("score"))
    exported = table(spark, sf, "customer").where("c_nationkey < 5").select(F.concat(F.lit("c"), "c_custkey").alias("name"))
    return assemble.choose_path(ranked, exported, spark.createDataFrame([(-1,)], "path_id long")).select("path_id", "entry", "score")
