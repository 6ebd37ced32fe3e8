import json

from pyspark.sql import functions as F

from sparkscope.operators import derive
from sparkscope.plans import assemble, models
from sparkscope.sources import advisories
from sparkscope.streaming import logs

NVD = {"vulnerabilities": [{"cve": {
    "descriptions": [{"lang": "es", "value": "x"}, {"lang": "en", "value": "An overflow in the doContent function in xmlparse.c"}],
    "metrics": {"cvssMetricV2": [{"cvssData": {"baseScore": 5.0, "vectorString": "v2"}}], "cvssMetricV30": [{"cvssData": {"baseScore": 7.5, "vectorString": "v3"}}]},
    "references": [{"url": "https://github.com/o/r/commit/abcdef1234", "tags": ["Patch"]}, {"url": "https://github.com/o/r/commit/abcdef1234", "tags": []}, {"url": "https://bugzilla.org/1", "tags": []}, {"url": "https://github.com/o/r/pull/7", "tags": ["Patch"]}],
    "weaknesses": [{"description": [{"value": "CWE-787"}, {"value": "NVD-x"}]}, {"description": [{"value": "CWE-787"}]}],
}}]}
OSV = {"summary": "s", "details": "d", "affected": [{"ranges": [{"repo": "https://github.com/o/r.git", "events": [{"introduced": "0"}, {"fixed": "abcdef1234"}]}]}], "references": [{"type": "FIX", "url": "https://github.com/mirror/r/commit/abcdef1234/"}, {"type": "WEB", "url": "https://github.com/o/r/commit/1234567"}]}
PATCH = """Subject: [PATCH] xmlparse: fix heap overflow
diff --git a/lib/xmlparse.c b/lib/xmlparse.c
--- a/lib/xmlparse.c
+++ b/lib/xmlparse.h
+++ b/lib/xmlparse.c
@@ -1,2 +1,2 @@ static enum XML_Error doContent(XML_Parser p,
-  int n = len << 2;
+  if (n > MAX) return;
+//
"""


def answers(spark, *rows):
    return spark.createDataFrame([(c, json.dumps(j) if not isinstance(j, str) else j) for c, j in rows], "cve_id string, json string")


def test_advisories(spark):
    n = advisories.nvd(answers(spark, ("a", NVD), ("b", "broken"), ("c", {"vulnerabilities": []})))
    row = n.collect()
    assert len(row) == 1 and row[0].description.startswith("An overflow") and (row[0].cvss_score, row[0].cvss_vector, row[0].cwe_ids) == (7.5, "v3", ["CWE-787"]) and len(row[0].refs) == 3
    o = advisories.osv(answers(spark, ("a", OSV)))
    assert o.first().fixes == [("https://github.com/o/r.git", "abcdef1234")]
    g = advisories.github(answers(spark, ("a", [{"summary": "gs", "severity": "high"}]), ("b", [])))
    assert [(r.cve_id, r.severity) for r in g.collect()] == [("a", "high")]
    urls = advisories.patch_urls(advisories.united(n, o, g))
    got = [(r.url, r.kind) for r in urls.orderBy("place").collect()]
    assert got == [("https://github.com/o/r/commit/abcdef1234", "commit"), ("https://github.com/o/r/commit/1234567", "commit"), ("https://github.com/o/r/pull/7", "pull")]
    recorded = spark.createDataFrame([("https://github.com/o/r/pull/7", "pr"), ("https://github.com/o/r/commit/1234567", PATCH), ("https://github.com/o/r/commit/abcdef1234", "")], "url string, text string")
    patches = advisories.fix_patches(urls, recorded)
    assert [(r.patch_no, r.text == PATCH) for r in patches.orderBy("patch_no").collect()] == [(0, True), (1, False)]
    pages = advisories.tracker_pages(n, spark.createDataFrame([("https://bugzilla.org/1", "<b>crash in</b> `foo_bar()`")], "url string, html string"))
    assert "foo_bar" in pages.first().text and "<" not in pages.first().text


def test_derivation(spark):
    patches = spark.createDataFrame([("a", 0, PATCH), ("b", 0, "Subject: Fix crash in parse_it\n@@ -1 +1 @@ int helper_fn(int x)\n-a = b;\n")], "cve_id string, patch_no int, text string")
    texts = spark.createDataFrame([("a", 0, "Overflow in xmlparse.c reached by doContent"), ("b", 0, "nothing"), ("c", 0, "the crash in the c_func function"), ("c", 1, "see `real_func`")], "cve_id string, rank int, text string")
    main = texts.where("rank = 0")
    change = {r.cve_id: r for r in derive.changes(patches).collect()}
    assert change["a"].removed == ["int n = len << 2;"] and change["a"].added == ["if (n > MAX) return;"] and change["a"].functions == ["doContent"]
    assert change["a"].summary.shift and change["a"].summary.bound and change["a"].summary.guard and not change["a"].summary.allocation
    files = derive.affected_file(patches, main)
    assert {(r.cve_id, r.file) for r in files.collect()} == {("a", "xmlparse.c")}
    empty = lambda s: spark.createDataFrame([], s)
    pages, blocked = empty("cve_id string, place int, text string"), spark.createDataFrame([("nothing",)], "name string")
    override = spark.createDataFrame([("d", "from_outside")], "cve_id string, value string")
    run = lambda known: {r.cve_id: (r.value, r.step) for r in derive.affected_function(texts, patches, files, pages, blocked, known, override).collect()}
    assert run(empty("name string")) == {"a": ("doContent", 0), "b": ("parse_it", 2), "c": ("c_func", 1), "d": ("from_outside", 5)}
    assert run(spark.createDataFrame([("real_func",), ("helper_fn",)], "name string")) == {"a": ("doContent", 0), "b": ("helper_fn", 0), "c": ("real_func", 1), "d": ("from_outside", 5)}
    assert {r.message for r in derive.commit_messages(patches.where("cve_id = 'a'").withColumn("text", F.concat(F.lit("From 0123456789012345678901234567890123456789 x\nSubject: [PATCH] one\nbody\n---\n file | 2\n")))).collect()} == {"one\nbody"}
    rules = spark.createDataFrame([("CWE-190", "wide"), ("CWE-125", "read")], "cwe string, rule string")
    got = derive.class_rules(spark.createDataFrame([(1, "190"), (2, "cwe-125, CWE-190"), (3, None)], "id int, cwe string"), rules)
    assert {(r.id, r.rule) for r in got.collect()} == {(1, "wide"), (2, "wide"), (2, "read")}
    commits = spark.createDataFrame([("abcdef1234567", 5), ("1234567aaaaaa", 3), ("fffffffffffff", 1)], "hash string, time int")
    fixes = spark.createDataFrame([("git@github.com:o/r.git", "abcdef1"), ("https://github.com/o/r", "1234567"), ("https://github.com/x/y", "fffffff")], "repo string, commit string")
    assert derive.earliest_fix(commits, fixes, F.lit("https://github.com/O/r/")).first().hash == "1234567aaaaaa"
    repair = derive.repair_rules(spark.createDataFrame([(1, "keeps palette constant"), (1, "null placeholders"), (2, "odd")], "id int, text string"), ["id"])
    assert {r.id: r.rules for r in repair.collect()} == {1: ["use_real_objects", "vary_constants"], 2: ["rewrite"]}


def test_assembly(spark):
    ranked = spark.createDataFrame([(1, "a", 50), (2, "b", 40), (3, "c", 10), (4, "d", 60)], "path_id int, entry string, score int")
    exported = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    choose = lambda *i: assemble.choose_path(ranked, exported, spark.createDataFrame([(x,) for x in i], "path_id int")).first().path_id
    assert choose(2) == 2 and choose(3) == 1 and choose(4) == 1
    roles = spark.createDataFrame([("k", i, n, r) for i, (n, r) in enumerate([("n", "size"), ("m", "size"), ("t", "support-buffer"), ("u", "support-buffer"), ("s", "state")])], "k string, ord int, name string, role string")
    given = spark.createDataFrame([("k", "N", "control"), ("k", "z", "value")], "k string, name string, role string")
    merged = [(r.name, r.role) for r in assemble.merge_roles(roles, given, ["k"]).orderBy("ord").collect()]
    assert merged[0] == ("n", "control") and merged[-1] == ("z", "value") and len(merged) == 6
    pairs = [(r.controller, r.dependent) for r in assemble.signature_relations(roles, ["k"], 3).orderBy("ord").collect()]
    assert pairs == [("n", "t"), ("n", "u"), ("m", "t")]
    assert [(r.controller, r.dependent) for r in assemble.setup_state_relations(roles, ["k"]).orderBy("ord").collect()] == [("s", "n"), ("s", "m")]
    items = spark.createDataFrame([("k", "setup_call", 0, "pngInit", None), ("k", "setup_call", 1, "set_palette", None), ("k", "setup_call", 2, "pngInit", None), ("k", "milestone", 0, "m", "container-parse"), ("k", "predicate", 0, "head->x", None)], "k string, field string, ord int, text string, kind string")
    traits = models.path_traits(F.array(F.lit("png_read_row"), F.lit("png_push")))
    contracts = assemble.stage_contracts(items, ["k"], traits)
    got = {(r.stage, r.field): r["items"] for r in contracts.collect()}
    assert got == {("entry", "setup_call"): ["pngInit"], ("transform", "setup_call"): ["set_palette"], ("parse", "milestone"): ["m"], ("parse", "predicate"): ["head->x"]}
    assert {r.stage for r in assemble.direct_items(contracts, traits).collect()} == {"entry", "parse"}
    dropped = spark.createDataFrame([("k", "Palette")], "k string, name string")
    assert {r.text for r in assemble.prune_dropped(items, dropped, ["k"], F.col("text")).collect()} == {"pngInit", "m", "head->x"}
    anchors = spark.createDataFrame([("k", "palette"), ("k", "init")], "k string, token string")
    assert {r.text for r in assemble.anchored_items(items, anchors, ["k"], F.col("text"), ("init",)).collect()} == {"set_palette"}
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert {r.name for r in assemble.selected_signatures(names("png_a", "png_b", "pnx_c", "zip"), names("png_a"), names("q"), 1).collect()} == {"png_a", "png_b"}


def test_plan_record(spark):
    from test_facts import scan

    s, _ = scan(spark, "ansi")
    path = spark.createDataFrame([("ansi", "api", ["api", "ansi"], 12)], "fn string, entry string, hops array<string>, score int")
    plan = json.loads(assemble.plan_record(models.analyse(s), path).first().plan)
    assert plan["entry_function"] == "api" and plan["sink_function"] == "ansi" and plan["call_path"] == ["api", "ansi"] and plan["path_score"] == 12 and plan["trigger_controls"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"argv": ["cc", "a.c"]}\nbroken\n')
    q = logs.build_commands(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("cmds").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.argv, r.cwd) for r in spark.table("cmds").collect()] == [(["cc", "a.c"], ".")]
    runs = spark.createDataFrame([(1, "2024-01-01 00:00:10", "#0 0x1 in sink", 1), (2, "2024-01-01 00:01:00", "", 0), (2, "2024-01-01 00:02:00", "", 0), (3, "2024-01-01 02:00:00", "", 0)], "run_id int, ts string, output string, returncode int").withColumn("ts", F.col("ts").cast("timestamp"))
    runs.write.parquet(str(tmp_path / "runs"))
    stream = spark.readStream.schema(runs.schema).parquet(str(tmp_path / "runs"))
    q = logs.run_evidence(logs.first_runs(stream, "run_id"), F.lit("sink"), F.lit("e"), F.array(F.lit("sink")), delay=None).writeStream.format("memory").queryName("ev").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.classification, r.n) for r in spark.table("ev").collect()} == {("sink-hit", 1), ("smoke-only", 1)}


def test_earliest_fix_by_beginnings_of_many_lengths(spark):
    commits = spark.createDataFrame([("abcdef123", 5), ("abcdef999", 3), ("ffff", 1), ("1234567", 2), (None, 0)], "hash string, time int")
    fix = lambda *c: spark.createDataFrame([("https://github.com/o/r", x) for x in c], "repo string, commit string")
    first = lambda *c: [r.hash for r in derive.earliest_fix(commits, fix(*c), F.lit("https://github.com/O/r/")).collect()]
    assert first("abcdef", "1234", "1234", None, "ffffff", "f" * 99) == ["1234567"] and first("abcdef") == ["abcdef999"] and first("") == ["ffff"]
    assert first("fffff", "bcdef") == [] == first(None)
    found = derive.earliest_fix(commits, fix("abcdef", "12"), F.lit("https://github.com/O/r/"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
