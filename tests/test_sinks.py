"""The versioned store, the corpus sink, table functions in SQL, entries without a path, and loads in order."""

import random

import pytest
from pyspark.sql import functions as F

from sparkscope import templates
from sparkscope.functions import spans
from sparkscope.operators import facts, graph, seeds
from sparkscope.plans import assemble
from sparkscope.sources import corpus_sink, ir, store

ROW = "k string, n int, v string, w string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_store_against_a_dict(spark, tmp_path):
    rng, folder, truth = random.Random(3), f"file://{tmp_path}/s", {}
    with pytest.raises(FileNotFoundError):
        store.read(spark, folder)
    for i, fill in enumerate([False, True, True, False, True]):
        batch = [(rng.choice([None, *"abcdefgh"]), rng.randrange(4), rng.choice([None, f"v{i}"]), rng.choice([None, f"w{i}"])) for _ in range(12)]
        version = store.upsert(spark, folder, spark.createDataFrame(batch, ROW), ["k"], ["n"], fill=fill, buckets=4)
        last = {}
        for r in sorted((r for r in batch if r[0]), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
            last[r[0]] = r
        for k, r in last.items():
            truth[k] = tuple(a if a is not None else b for a, b in zip(r, truth.get(k, r), strict=True)) if fill else r
        assert version == i + 1 and rows(store.read(spark, folder)) == sorted(truth.values(), key=repr)
    before = rows(store.read(spark, folder))
    again = spark.createDataFrame([("z", 1, "x", None)], ROW)
    assert [store.upsert(spark, folder, again, ["k"]) for _ in range(2)] == [6, 7]
    assert rows(store.read(spark, folder)) == rows(store.read(spark, folder, 6)) == sorted([*before, ("z", 1, "x", None)], key=repr)
    assert store.upsert(spark, folder, again.where("false"), ["k"]) == 8 and rows(store.read(spark, folder)) == rows(store.read(spark, folder, 7))


def test_store_survives_writers(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/s"
    one, two = (spark.createDataFrame([(k, 1, k, None) for k in ks], ROW) for ks in ("ab", "bc"))
    store.upsert(spark, folder, one, ["k"], buckets=2)
    with monkeypatch.context() as m:
        m.setattr(store._Files, "publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):  # killed when all its data were written
            store.upsert(spark, folder, two, ["k"])
    assert rows(store.read(spark, folder)) == rows(one) and store.versions(spark, folder) == [1]
    store.upsert(spark, folder, two, ["k"], base=1)
    with pytest.raises(store.Conflict):  # began from the same version
        store.upsert(spark, folder, spark.createDataFrame([("q", 1, "q", None)], ROW), ["k"], base=1)
    assert [r[0] for r in rows(store.read(spark, folder))] == ["a", "b", "c"]
    store.vacuum(spark, folder)
    assert store.versions(spark, folder) == [2] and [r[0] for r in rows(store.read(spark, folder))] == ["a", "b", "c"]
    assert [p.name for p in (tmp_path / "s" / "manifests").iterdir() if not p.name.endswith(".crc")] == ["000000000002.json"]
    wider = store.upsert(spark, folder, spark.createDataFrame([("c", 5.5)], "k string, extra double"), ["k"], fill=True)
    assert {r.k: (r.v, r.extra) for r in store.read(spark, folder, wider).collect()}["c"] == ("c", 5.5)


def files(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir()} if folder.exists() else {}


def test_corpus_sink(spark, tmp_path):
    given = spark.createDataFrame([(f"s {i}", "00ff" * i, "hex", i) for i in range(1, 40)] + [("bad", "zz", "hex", 99)], "name string, content string, encoding string, ord int").repartition(5)
    corpus_sink.write_corpus(seeds.corpus(given), f"file://{tmp_path}/a")
    assert files(tmp_path / "a") == {f"s_{i}_{i}": bytes.fromhex("00ff" * i) for i in range(1, 40)}
    corpus_sink.write_corpus(seeds.corpus(given.where("ord = 1")), f"{tmp_path}/a", overwrite=True)
    assert files(tmp_path / "a") == {"s_1_1": b"\x00\xff"}
    corpus_sink.write_corpus(seeds.corpus(given.where("false")), f"file://{tmp_path}/b")
    assert b"{}" in files(tmp_path / "b").values()
    frame = lambda *r: spark.createDataFrame(list(r), "file string, bytes binary")
    corpus_sink.write_corpus(frame(("n", None)), f"file://{tmp_path}/c")
    assert files(tmp_path / "c") == {"n": b""}


def test_corpus_sink_shows_nothing_of_what_failed(spark, tmp_path):
    frame = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("file"), F.lit(b"x").alias("bytes"))
    late = frame.withColumn("bytes", F.when(F.col("file") == "39", F.raise_error(F.lit("late")).cast("binary")).otherwise(F.col("bytes")))
    for broken in (late, frame.union(frame.where("file = '7'")), frame.union(frame.limit(1).withColumn("file", F.lit("../up")))):
        with pytest.raises(Exception):  # noqa: B017
            corpus_sink.write_corpus(broken, f"file://{tmp_path}/a")
        assert not [n for n in files_below(tmp_path) if corpus_sink.STAGED not in n.parts]
    corpus_sink.write_corpus(frame, f"file://{tmp_path}/a")
    assert len([p for p in (tmp_path / "a").iterdir() if p.is_file()]) == 40


def files_below(folder):
    return [p for p in folder.rglob("*") if p.is_file()]


def test_table_functions(spark):
    spans.register(spark)
    text = templates.CALLBACKS + templates.SOURCE
    df = spark.createDataFrame([(f"p{i}", text.replace("<<k>>", str(i)).replace("é", "x") if i % 5 else None) for i in range(20)] + [("u", "// é\n" + text)], "path string, text string").repartition(3)
    found = spark.sql("SELECT id, name, start, stop, body FROM function_spans(TABLE(SELECT path AS id, text FROM {df}))", df=df)
    assert rows(found) == rows(facts.function_blocks(df).select("path", "name", "start", "end", "body")) and found.count() > 30
    asked = spark.sql("SELECT * FROM function_facts(TABLE(SELECT path AS id, text, 'inflate' AS fn FROM {df}))", df=df)
    wanted = df.where("text is not null").select("path", F.lit("inflate").alias("fn"))
    assert rows(asked) == rows(facts.scan_functions(df, wanted))


def test_entries_without_a_path(spark):
    functions = [("s1", "/l/a.c:3"), ("s2", "/l/b.c"), ("s3", "/m/c.c"), ("s4", None), ("s5", "/l/a.c"), ("pubLong", "/l/a.c"), ("pub", "/l/a.c"), ("zed", "/l/z.c"), ("aaa", "/l/tests/t.c"), ("mid", "/n/x.c"), ("p", None)]
    edges = [("x", "s5"), ("mid", "q"), ("mid", "r"), ("mid", "r"), ("pub", "q"), ("aaa", "1"), ("aaa", "2"), ("aaa", "3"), (None, "s1")]
    frame = lambda r, s: spark.createDataFrame(r, s)
    args = frame([(f"s{i}",) for i in range(1, 6)] + [("pub",), (None,), ("s1",)], "name string"), frame(functions, "name string, file string")
    public = frame([(n,) for n in ("pubLong", "pub", "zed", "aaa", "mid", "p")], "name string")
    run = lambda public, edges: {r.sink: (r.entry, r.rule) for r in assemble.fallback_entries(*args, public, frame(edges, "caller string, callee string")).collect()}
    assert run(public, edges) == {
        "s1": ("pub", "same_unit"), "s2": ("pub", "same_folder"), "s3": ("mid", "most_callees"), "s4": ("mid", "most_callees"), "s5": ("pub", "same_folder"), "pub": ("pub", "itself"),
    }
    assert run(public.where("name = 'aaa'"), edges[:1])["s3"] == ("aaa", "first")  # nothing else is left, and none calls others
    assert run(public.where("false"), edges) == {}


def test_loads_in_order(spark):
    text = ["define void @a(ptr %o) {", "  %f = load ptr, ptr @late, !invariant @other", "  call void %f(ptr %o)", "}", "define void @late(ptr %o) {", "}", "define void @b(ptr %o) {", "  %f = load ptr, ptr @late, !invariant @other", "  call void %f(ptr %o)", "}"]
    read = ir.parse_ir(spark.createDataFrame([("x.ll", i + 1, t) for i, t in enumerate(text)], "file string, line_no int, text string"))
    edges = lambda **more: {(r.caller, r.callee) for r in graph.call_edges(read, **more).where("kind = 'indirect'").collect()}
    assert edges() == {("a", "late"), ("b", "late")} and edges(in_order=True) == {("b", "late")}
