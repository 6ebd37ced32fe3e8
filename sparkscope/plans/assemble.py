"""Plan assembly: paths, roles and staged facts of one vulnerability merged into a record by precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.operators.ordered import top_k
from sparkscope.plans import models


def choose_path(ranked: DataFrame, exported: DataFrame, override: DataFrame) -> DataFrame:
    """One path of (path_id, entry, score): the recorded choice (path_id) unless guards reject it, else the best.

    The entry must be exported if any entry is; a choice below 0.6 of the top
    score or 30 and more below it is overruled.
    """
    marked = ranked.join(exported.select(F.col("name").alias("entry")).distinct().withColumn("out", F.lit(True)), "entry", "left").join(override.select("path_id").distinct().withColumn("asked", F.lit(True)), "path_id", "left")
    top = marked.agg(F.max("score").alias("top"))
    judged = marked.crossJoin(F.broadcast(top)).withColumn("weak", (F.col("score") < 0.6 * F.col("top")) | (F.col("top") - F.col("score") >= 30))
    order = [F.coalesce("out", F.lit(False)).desc(), (F.coalesce("asked", F.lit(False)) & ~F.col("weak")).desc(), F.desc("score"), F.col("path_id")]
    return top_k(judged, [], order, 1).select("path_id", "entry", "score")


# Parts of paths of code that is built beside a library and is no entry to it.
BESIDE_LIBRARY = (
    "/tests/", "/test/", "/testing/", "/unittest/", "/unittests/", "/examples/", "/example/", "/sample/", "/samples/", "/demo/", "/demos/", "/benchmark/", "/benchmarks/",
    "/bench/", "/fuzz/", "/fuzzing/", "/fuzzers/", "/perf/", "/perftest/", "/tools/", "/util/", "/utils/", "/utility/", "/contrib/", "/extras/", "/scripts/", "/doc/", "/docs/",
    "/xmlwf/", "/apps/", "/app/", "/cli/", "/bin/", "/python/", "/perl/", "/ruby/", "/go/", "/rust/",
)


def fallback_entries(sinks: DataFrame, functions: DataFrame, public: DataFrame, edges: DataFrame) -> DataFrame:
    """(sink, entry, rule): an entry for each sink (name) that no call path leads to, over functions (name, file) and edges (caller, callee).

    Rules, first that holds: ``itself`` the sink is public; ``same_unit`` it has
    no caller, and its file has public functions: the one of the shortest name;
    ``same_folder`` a public function of its folder, the first by name;
    ``most_callees`` the public function that calls the most others;
    ``first`` the first public one. The last three leave out functions from
    beside the library, unless there are no others. A function without a known
    file shares none with another; without public functions there are no rows.
    Per file and folder one public function is kept before sinks are joined, so
    no sink is compared with all functions.
    """
    file = F.when(F.col("file") != "", F.split_part("file", F.lit(":"), F.lit(1)))
    placed = functions.groupBy("name").agg(F.min(file).alias("file"))
    folder = F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "")).when(F.col("file").isNotNull(), "")
    listed = public.select("name").where("name is not null").distinct().join(placed, "name", "left").withColumn("folder", folder)
    low = F.lower(F.translate(F.coalesce("file", F.lit("")), "\\", "/"))
    beside = F.array_contains(F.transform(F.array(*map(F.lit, BESIDE_LIBRARY)), lambda t: F.contains(low, t)), True)
    judged = listed.withColumn("library", ~beside)
    some = judged.agg(F.coalesce(F.bool_or("library"), F.lit(False)).alias("some"))
    general = judged.crossJoin(F.broadcast(some)).where("library or not some")
    callees = edges.select("caller", "callee").distinct().groupBy(F.col("caller").alias("name")).agg(F.count("*").alias("n"))
    ranked = general.join(callees, "name", "left")
    best = ranked.agg(F.min_by("name", F.when(F.col("n").isNotNull(), F.struct((-F.col("n")).alias("n"), "name"))).alias("most"), F.min("name").alias("first"))
    unit = listed.where("file is not null").groupBy(F.col("file").alias("u_file")).agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("unit"))
    near = general.where("folder is not null").groupBy(F.col("folder").alias("n_folder")).agg(F.min("name").alias("near"))
    called = edges.where("caller is not null").select(F.col("callee").alias("name")).distinct().withColumn("called", F.lit(True))
    asked = sinks.select("name").where("name is not null").distinct().join(placed, "name", "left").withColumn("folder", folder)
    asked = asked.join(listed.select("name").withColumn("own", F.lit(True)), "name", "left").join(called, "name", "left")
    asked = asked.join(unit, F.col("file") == F.col("u_file"), "left").join(near, F.col("folder") == F.col("n_folder"), "left").crossJoin(F.broadcast(best))
    steps = [
        ("itself", F.when(F.col("own"), F.col("name"))), ("same_unit", F.when(F.col("called").isNull(), F.col("unit"))),
        ("same_folder", F.col("near")), ("most_callees", F.col("most")), ("first", F.col("first")),
    ]
    entry = F.coalesce(*(e for _, e in steps))
    rule = F.coalesce(*(F.when(e.isNotNull(), F.lit(n)) for n, e in steps))
    return asked.select(F.col("name").alias("sink"), entry.alias("entry"), rule.alias("rule")).where("entry is not null")


def merge_roles(own: DataFrame, given: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Roles (keys, ord, name, role) with those given (keys, name, role) in their place by name; unmatched given ones follow."""
    extra = given.select(*keys, F.lower("name").alias("_n"), F.col("name").alias("g_name"), F.col("role").alias("g_role"))
    both = own.withColumn("_n", F.lower("name")).join(extra, [*keys, "_n"], "full")
    return both.select(*keys, F.coalesce("ord", F.lit(1 << 20)).alias("ord"), F.coalesce("name", "g_name").alias("name"), F.coalesce("g_role", "role").alias("role"))


def anchored_items(items: DataFrame, anchors: DataFrame, keys: Sequence[str], text: Column, stop: tuple[str, ...]) -> DataFrame:
    """Items that share a meaningful word with their key's anchors (keys, token): a semi join on exploded words."""
    from sparkscope.functions.names import anchor_tokens

    words = items.withColumn("_w", F.explode(anchor_tokens(text, stop))).withColumnRenamed("_w", "token")
    hit = words.join(anchors.select(*keys, "token").distinct(), [*keys, "token"], "left_semi")
    return hit.drop("token").distinct()


def prune_dropped(items: DataFrame, dropped: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    """Items whose text holds none of their key's dropped names (keys, name), ignoring case."""
    listed = dropped.where(F.trim("name") != "").groupBy(*keys).agg(F.collect_set(F.lower("name")).alias("_d"))
    low = F.lower(text)
    return items.join(listed, list(keys), "left").where(~F.exists(F.coalesce("_d", F.array().cast("array<string>")), lambda d: low.contains(d))).drop("_d")


def signature_relations(roles: DataFrame, keys: Sequence[str], limit: int = 6, each: int = 4) -> DataFrame:
    """(keys, ord, controller, dependent): the first sizes against the first support buffers of a signature."""
    from pyspark.sql import Window

    numbered = lambda role, name: roles.where(F.col("role") == role).withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where(F.col("n") <= each).select(*keys, F.col("n").alias(f"{name}_n"), F.col("name").alias(name))
    pairs = numbered("size", "controller").join(numbered("support-buffer", "dependent"), list(keys))
    best = top_k(pairs, keys, ["controller_n", "dependent_n"], limit)
    return best.select(*keys, ((F.col("controller_n") - 1) * each + F.col("dependent_n") - 1).alias("ord"), "controller", "dependent")


def setup_state_relations(roles: DataFrame, keys: Sequence[str], limit: int = 4) -> DataFrame:
    """(keys, ord, controller, dependent): sizes that calls on a state object may bound, where support buffers exist too."""
    flags = roles.groupBy(*keys).agg(F.min_by("name", F.when(F.col("role") == "state", F.col("ord"))).alias("controller"), F.bool_or(F.col("role") == "support-buffer").alias("s"), F.bool_or(F.col("role") == "state").alias("t")).where("s and t")
    sizes = roles.where("role = 'size'").join(flags, list(keys))
    return top_k(sizes, keys, ["ord"], limit).select(*keys, "ord", "controller", F.col("name").alias("dependent"))


def stage_contracts(items: DataFrame, keys: Sequence[str], traits: Column, limit: int = 6) -> DataFrame:
    """(keys, stage, field, items): facts (keys, field, ord, text, kind) dealt to stages, each text once, in order."""
    staged = models.stage_items(items, keys, traits)
    once = staged.groupBy(*keys, "stage", "field", "text").agg(F.min("ord").alias("ord"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return once.groupBy(*keys, "stage", "field").agg(F.slice(F.transform(ordered, lambda x: x["text"]), 1, limit).alias("items"))


def direct_items(contracts: DataFrame, traits: Column) -> DataFrame:
    """The contracts of the stages that the entry reaches itself."""
    return contracts.where(F.array_contains(models.direct_stages(traits), F.col("stage")))


def selected_signatures(signatures: DataFrame, path: DataFrame, candidates: DataFrame, siblings: int = 60) -> DataFrame:
    """Signatures of the path and candidates, and up to ``siblings`` others that share three leading letters with one of them."""
    wanted = path.select("name").union(candidates.select("name")).distinct()
    own = signatures.join(wanted, "name", "left_semi")
    prefix = wanted.select(F.lower(F.substring("name", 1, 3)).alias("p")).distinct()
    rest = signatures.join(wanted, "name", "left_anti").withColumn("p", F.lower(F.substring("name", 1, 3))).join(prefix, "p", "left_semi").drop("p")
    return own.unionByName(top_k(rest, [], ["name"], siblings).select(*own.columns))


def plan_record(analysis: DataFrame, path: DataFrame) -> DataFrame:
    """(path, fn, plan): the models of a function and its chosen call path (fn, entry, hops, score) as one JSON record."""
    parts = ["primary", "secondary", "operators", "policy", "support", "milestones", "mutable", "stabilized", "derived", "constraints", "relations", "trigger_controls", "hints", "preconditions", "activation", "cleanup", "ownership", "api_roles", "segments", "sink_role"]
    joined = analysis.join(path.select("fn", "entry", "hops", F.col("score").alias("path_score")), "fn", "left")
    return joined.select("path", "fn", F.to_json(F.struct(F.col("entry").alias("entry_function"), F.col("fn").alias("sink_function"), F.col("hops").alias("call_path"), "path_score", *parts)).alias("plan"))
