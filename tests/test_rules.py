import pytest
from pyspark.sql import functions as F

from sparkscope import session
from sparkscope.functions import names
from sparkscope.operators import advisory, evidence, excerpt, ordered, rules, seeds, validate

SHAPED = """int f(const uint8_t *data, size_t size) {
  std::vector<uint8_t> container;
  int depth = data[0] % 8;
  set_header(state, depth);
  int limit = 1 << depth;
  for (size_t i = 0; i < size; i++) container.push_back(data[i]);
  num_rows = limit;
  parse_it(container.data(), container.size());
}"""
RAW = "int f(const uint8_t *data, size_t size) {\n  setup_state(NULL, NULL, 0);\n  feed_it(data, size);\n  if (setjmp(b)) abort();\n}"


def candidates(spark, *rows):
    fields = [x.split()[0] for x in validate.PLAN.split(", ")]
    empty = dict.fromkeys(fields)
    return spark.createDataFrame([(i, code, *({**empty, **plan}[f] for f in fields)) for i, (code, plan) in enumerate(rows)], f"id int, code string, {validate.PLAN}")


def test_validation(spark):
    relation = {"kind": "setup-state-bound-hypothesis", "controller": "state", "dependent": "num_rows", "evidence": "", "priority": "high"}
    plan = {"entry": "feed_it", "roles": [("state", "state")], "operators": ["chunked-stream"], "primary": "structured-format", "container_synthesis": True, "setup_candidates": ["feedInit_"], "setup_calls": ["feedInit_"], "controls": 1, "relations": [tuple(relation.values())]}
    good = {**plan, "entry": "parse_it", "setup_candidates": ["set_header"], "setup_calls": ["set_header2"]}
    rows = candidates(spark, (RAW, plan), (SHAPED, good), (None, {"entry": "x"}), (RAW, {**plan, "cwe": "CWE-401"}))
    found = {}
    for r in validate.validate(rows, ["id"]).collect():
        found.setdefault(r.id, []).append(r.rule)
    assert set(found[0]) >= {"MISSING_STATE_SETUP", "MISSING_SETUP_CALLS", "MISSING_CHUNKED_STREAM_LOOP", "RAW_BUFFER_STRUCTURED_INPUT", "MISSING_CONTAINER_SYNTHESIS", "RAW_PASSTHROUGH_STAGED_INPUT", "MISSING_SELECTOR_LOGIC", "SETJMP_ABORT_CONFLICT", "TRIGGER_RELATION_MISS"}
    assert 1 not in found and found[2] == ["MISSING_ENTRY_CALL"]
    assert "MISSING_SETUP_CALLS_SOFT" in found[3] and "TRIGGER_RELATION_MISS_SOFT" in found[3]
    reports = {r.id: r for r in validate.reports(rows, ["id"]).collect()}
    assert reports[1].ok and reports[1].score == 100 and reports[1].relations_ok == 1
    assert not reports[0].ok and reports[0].score == 0 and not reports[2].ok and reports[2].score == 60


def test_callbacks(spark):
    code = "void cb_a(int x) { png_quantize(x); }\nvoid cb_b(int x) { }\nint f() {\n  png_early(1);\n  register_cb(p, cb_b);\n  entry(1);\n  png_quantize(2);\n}"
    got = spark.createDataFrame([(code,)], "c string").select(validate.placements(F.col("c"), F.lit("entry"), F.array(F.lit("png_quantize"), F.lit("png_early")), F.array(F.lit("cb_a"), F.lit("register_cb"))).alias("p")).first().p
    assert got.registered == ["cb_a", "cb_b"] and got.empty == ["cb_b"] and got.early == ["png_early"]


def test_candidates_break_ties(spark):
    reports = spark.createDataFrame([("k", 0, True, 80, 0, 0, 0), ("k", 1, True, 80, 1, 5, 5), ("k", 2, False, 100, 9, 0, 0), ("k", 3, True, 80, 1, 5, 5)], "k string, ord int, ok boolean, score int, relations_ok int, violations int, warnings int")
    assert rules.best_candidate(reports, ["k"]).first().ord == 1


def test_run_logs(spark):
    stack = lambda *f: "\n".join(f"#{i} 0x1 in {x} /a.c:1" for i, x in enumerate(f))
    logs = [(stack("sink"), 1), (stack("near", "x"), 1), (stack("x", "entry"), 1), ("free\nallocated by thread\n" + stack("sink"), 1), ("", 0), ("/fuzzer.cc:3\n", 1), (None, 0)]
    got = evidence.classify_runs(spark.createDataFrame([(i, *x) for i, x in enumerate(logs)], "id int, output string, returncode int"), F.lit("sink"), F.lit("entry"), F.array(*map(F.lit, ("entry", "mid", "near", "sink"))))
    assert [(r.classification, r.score) for r in got.orderBy("id").collect()] == [("sink-hit", 100), ("sink-adjacent", 80), ("entry-reached", 50), ("harness-or-setup-fault", 5), ("smoke-only", 15), ("harness-or-setup-fault", 5), ("smoke-only", 15)]
    error = "x.c: error: use of undeclared identifier 'foo'; did you mean 'bar'?\nundefined reference to `baz'\nuse of undeclared identifier 'foo'; did you mean 'qux'?"
    texts = spark.createDataFrame([(1, error)], "id int, t string")
    assert texts.select(evidence.error_identifiers(F.col("t")).alias("e")).first().e == ["foo", "baz"]
    assert [tuple(r) for r in evidence.suggestions(texts, "id", "t").collect()] == [(1, "foo", "bar")]


PATCH = """From 0123456789012345678901234567890123456789 Mon Sep 17
Subject: [PATCH 1/2] Fix heap overflow CVE-2020-12345
---
 lib/a.c | 2 +-
diff --git a/lib/a.c b/lib/a.c
--- a/lib/a.c
+++ b/lib/a.c
@@ -1,2 +1,2 @@ int foo
-old = 1;
+new = 0x100;
 context
From abcdefabcdefabcdefabcdefabcdefabcdefabcd Mon Sep 17
Subject: [PATCH 2/2] release version bump
---
diff --git a/lib/b.h b/lib/b.h
--- a/lib/b.h
+++ b/lib/b.h
@@ -1 +1 @@
-#define B_VERSION 1
+#define B_VERSION 2
From abcdefabcdefabcdefabcdefabcdefabcdefabce Mon Sep 17
Subject: docs
diff --git a/README.md b/README.md
--- a/README.md
+++ b/README.md
@@ -1 +1 @@
+security
"""


def test_patches(spark):
    patches = spark.createDataFrame([(1, PATCH)], "id int, text string")
    lines = advisory.patch_lines(patches, ["id"], "text")
    scores = {r.sub_no: r.score for r in advisory.score_sub_patches(lines, ["id"]).collect()}
    # subject 4 + 5, keyword 2, one source file 3, few changes 3; the bump has noise, only bumped lines
    assert scores[1] == 17 and scores[2] == -5 + 3 - 6
    kept = advisory.security_patches(patches, ["id"], "text").collect()
    assert [r.sub_no for r in kept] == [1] and "heap overflow" in kept[0].text
    assert {r.sub_no: r.bump for r in advisory.version_bumps(lines, ["id"]).collect()} == {1: False, 2: True}
    assert patches.select(seeds.numeric_constants(seeds.changed_text(F.col("text"))).alias("c")).first().c == [(256, "0x100")]


def test_function_names_from_text(spark):
    texts = ["An issue in the doContent function in xmlparse.c allows", "crash via png_read at pngread.c", "overflow in tiff_jpeg.c in foo_bar, remote", "`tick_me()` and other()", "nothing here", None]
    blocked = spark.createDataFrame([("other",)], "name string")
    got = {r.id: r.value for r in advisory.function_from_text(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", blocked).collect()}
    assert got == {0: "doContent", 1: "png_read", 2: "foo_bar", 3: "tick_me"}


def test_advisories_merge_by_precedence(spark):
    user = spark.createDataFrame([("a", "mine", None), ("b", "", "CWE-1"), ("c", None, None)], "cve_id string, description string, cwe_id string")
    schema = "cve_id string, source string, description string, summary string, cvss_score double, cwe_ids array<string>, refs array<string>"
    sources = spark.createDataFrame([("a", "nvd", "n", None, 9.8, ["CWE-2"], ["u1"]), ("b", "gh", None, "gs", None, None, ["u3"]), ("b", "osv", "o", None, None, None, ["u2", "u3"])], schema)
    got = {r.cve_id: r for r in advisory.merge_advisories(user, sources).collect()}
    assert (got["a"].description, got["a"].cwe_id, got["a"].cvss_score) == ("mine", "CWE-2", 9.8)
    assert (got["b"].description, got["b"].cwe_id, got["b"].refs) == ("o", "CWE-1", ["u2", "u3"]) and got["c"].description is None


def test_seeds(spark):
    rows = [("a/b", "6869", "hex", 0), ("c", "!!", "base64", 1), ("d", "", "utf8", 2), ("e", "x", "rot13", 3), (None, "aGk=", "base64", 4)]
    frame = spark.createDataFrame(rows, "name string, content string, encoding string, ord int")
    assert [r.error is None for r in seeds.validate_seeds(frame).orderBy("ord").collect()] == [True, False, False, False, True]
    assert {(r.file, bytes(r.bytes)) for r in seeds.corpus(frame).collect()} == {("a_b_0", b"hi"), ("seed_4_4", b"hi")}
    assert seeds.corpus(frame.where("ord = 1")).count() == 10
    got = spark.createDataFrame([('x = 300; s = "GIF"; t = "GIF";', "+y = 20\n-z = 3\n+++ 99")], "s string, d string").select(seeds.dictionary_tokens(F.col("s"), F.col("d")).alias("t")).first().t
    assert got == ['"20"', '"\\x14"', '"\\x14\\x00"', '"\\x14\\x00\\x00\\x00"', '"\\x14\\x00\\x00\\x00\\x00\\x00\\x00\\x00"', '"0x12c"', '"\\x2c\\x01"', '"\\x2c\\x01\\x00\\x00"', '"\\x2c\\x01\\x00\\x00\\x00\\x00\\x00\\x00"', '"GIF"']


def test_excerpts(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["plain words", "if (x) foo();", "", "return y;", "zzz"])], "k int, n int, t string").withColumn("s", excerpt.line_score(F.col("t")))
    got = excerpt.greedy_excerpt(lines, ["k"], "n", "t", "s", 26).first()
    assert got.excerpt == "if (x) foo();\n    // ...\nreturn y;"


def test_ordered(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("b", 1, "y")], "k string, o int, v string")
    assert {tuple(r) for r in ordered.first_wins(df, ["k"], ["o"]).collect()} == {("a", 1, "x"), ("b", 1, "y")}
    assert {tuple(r) for r in ordered.last_wins(df, ["k"], ["o"]).collect()} == {("a", 2, None), ("b", 1, "y")}
    assert ordered.fallback_if_empty(df.where("false"), df).count() == 3 and ordered.fallback_if_empty(df.limit(1), df).count() == 1
    blocks = spark.createDataFrame([("a", 0, 10, "one"), ("a", 5, 20, "two")], "k string, s int, e int, name string")
    points = spark.createDataFrame([("a", 7), ("a", 12), ("a", 20)], "k string, p int")
    assert {(r.p, r.name) for r in ordered.block_join(points, blocks, ["k"], "p", "s", "e", ["s"]).collect()} == {(7, "one"), (12, "two")}


def test_names_and_anchors_by_join(spark):
    texts = [("Alpha beta", 1), ("gamma", 2), ("gamma", 2), ("", 3), (None, 4), ("xab", 5), ("delta Éa", 6)]
    df = spark.createDataFrame(texts, "t string, n int")
    names_ = spark.createDataFrame([("PHA B",), ("ab",), ("m",), (None,), (" ",), ("éa",)], "name string")
    truth = sorted([t for t in texts if not any(n in (t[0] or "").lower() for n in ("pha b", "ab", "m", "éa"))], key=str)
    for limit in (ordered.RULE_CHARS, 0):  # sent to all tasks, or joined
        assert sorted(map(tuple, ordered.prune_containing(df, ["t"], names_, rule_chars=limit).collect()), key=str) == truth
    anchors = spark.createDataFrame([("beta",), ("gamma",), (None,)], "token string")
    assert sorted(map(tuple, ordered.keep_anchored(df, F.split("t", " "), anchors).collect())) == [("Alpha beta", 1), ("gamma", 2), ("gamma", 2)]
    scores = spark.createDataFrame([("a", 1, "x", 0), ("a", 2, "y", 1), ("b", 5, "z", 0), ("c", 3, "w", 0)], "k string, s int, r string, o int")
    assert {(r.k, r.score, *r.reasons) for r in ordered.group_scores(scores, ["k"], "s", "r", ["o"], k=2).collect()} == {("b", 5, "z"), ("a", 3, "x", "y")}
    assert ordered.group_scores(scores, ["k"], "s", "r", ["o"]).count() == 3


def test_excerpts_inside_a_row(spark):
    texts = spark.createDataFrame([(1, "plain words\nif (x) foo();\n\nreturn y;\nzzz"), (2, ""), (3, None)], "k int, t string")
    got = excerpt.text_excerpt(texts, ["k"], "t", excerpt.line_score, 26).collect()
    assert [(r.k, r.n_lines, r.excerpt) for r in got] == [(1, 2, "if (x) foo();\n    // ...\nreturn y;")]


def test_a_replaced_table_is_removed_and_a_shared_folder_is_needed(spark):
    first = session.materialise(spark.range(3))
    second = session.materialise(first.withColumn("x", F.lit(1)), replaces=first)
    assert second.count() == 3 and first._sparkscope_path not in session._written and second._sparkscope_path in session._written

    class Context:
        master = "spark://somewhere"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()
        getConf = lambda self: type("C", (), {"get": lambda self, key: None})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(type("Spark", (), {"sparkContext": Context()}))


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    text = F.lit
    assert one(names.split_top_level(text("a, f(b, c), {d, [e,f]}, ,g"))) == ["a", "f(b, c)", "{d, [e,f]}", "g"]
    assert one(names.matching_close(text("a(b(c))d"), F.lit(1), "(", ")")) == 6 and one(names.matching_close(text("a(b"), F.lit(1), "(", ")")) == -1
    assert one(names.condition_value(text("Z_FINISH) && x"))) == "Z_FINISH" and one(names.condition_value(text("f(x) ;"))) in ("f(x) ", "f(x)")
    assert one(names.shared_prefix(text("extraMax"), text("extra"))) == 5 and one(names.relation_token(text("s->Foo[3]"))) == "3"
    assert one(names.semantic_match(F.array(text("extra"), text("max")), F.array(text("extras")))) == 2
    assert one(names.repository_url(text("ssh://git@GitHub.com:org/repo.git"))) == "github.com/org/repo" and one(names.repository_url(text("https://github.com/org/repo/"))) == "github.com/org/repo"
    assert one(names.decode_seed(text("zz"), text("hex"))) is None and bytes(one(names.decode_seed(text("é"), text("utf8")))) == "é".encode()
    assert one(names.to_integer(text("0x1F"))) == 31 and one(names.to_integer(text("x"))) is None
    assert one(names.is_constant_like(text("-12UL"))) and one(names.is_constant_like(text("ABC_1"))) and not one(names.is_constant_like(text("abc")))
    assert one(names.without_fence(text("```python\nx = 1\n```"))) == "x = 1" and one(names.unwrapped_code(text('{"code": "int x;"}'))) == "int x;" and one(names.unwrapped_code(text("int y;"))) == "int y;"
    assert one(names.mentions_word(text("uses BUF now"), F.array(text("buf")))) and not one(names.mentions_word(text("uses buffer"), F.array(text("buf"))))
    assert one(names.parameter_text(F.struct(text("int").alias("type"), text("x").alias("name")))) == "int x"


def test_function_names_are_found_without_moving_texts(spark):
    texts = spark.createDataFrame([(1, "crash via png_read at png.c"), (2, "overflow in tiff_jpeg.c in foo_bar, remote"), (3, "see xml_c in xml_c.c, or bar_baz()"), (4, None), (None, "bar_baz()")], "id int, t string")
    found = advisory.function_from_text(texts, "id", "t", spark.createDataFrame([("nothing",)], "name string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == plan.count("Join LeftAnti") == 1
    assert {r.id: r.value for r in found.collect()} == {1: "png_read", 2: "foo_bar", 3: "bar_baz"}
