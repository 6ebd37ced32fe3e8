"""Joins by position and by part of a name, against plain loops; long chains of pointers and paths; JSON of unknown form."""

import json
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkscope.functions import parts, tolerant
from sparkscope.operators import graph, ordered


def test_dyadic_cover(spark):
    rng = random.Random(4)
    spans = [(a, a + rng.randrange(-2, 200)) for a in (rng.randrange(-300, 300) for _ in range(200))]
    wide = [(7, 7 + 10**12), (-(10**12) + 3, 10**12), (0, 1 << 60), (5, 6), (-1, 1)]
    rows = spark.createDataFrame(spans + wide, "s long, e long").select("s", "e", ordered.dyadic_cover(F.col("s"), F.col("e")).alias("c")).collect()
    for r in rows:
        blocks = sorted((b.place << b.level, (b.place + 1) << b.level) for b in r.c)
        assert len(blocks) <= 2 * max(1, (r.e - r.s)).bit_length() and (r.e - r.s != 10**12 or len(blocks) < 100)
        assert all(x[1] == y[0] for x, y in zip(blocks, blocks[1:], strict=False))
        assert (blocks[0][0], blocks[-1][1]) == (r.s, r.e) if r.e > r.s else not blocks


def test_block_join(spark):
    rng = random.Random(6)
    blocks = [(rng.choice("ab"), s, s + rng.choice([1, 3, 40, 10**12]), i) for i, s in enumerate(rng.sample(range(-50, 150), 40))] + [("a", 5, 5, 99), ("a", 9, 2, 98)]
    points = [(rng.choice("abc"), rng.randrange(-60, 200)) for _ in range(150)] * 2 + [("a", 10**11), ("a", None), (None, 3)]
    got = ordered.block_join(spark.createDataFrame(points, "k string, p long"), spark.createDataFrame(blocks, "k string, s long, e long, name int"), ["k"], "p", "s", "e", ["s", "name"])
    truth = []
    for k, p in points:
        first = min(((s, n) for b, s, e, n in blocks if p is not None and b == k and s <= p < e), default=None)
        truth += [(k, p, first[1])] if first else []
    assert sorted((r.k, r.p, r.name) for r in got.collect()) == sorted(truth) and len(truth) > 150


def test_asof_join(spark):
    rng = random.Random(7)
    left = [(rng.choice("abc"), rng.randrange(-40, 120), i) for i in range(200)] * 2 + [("a", None, 7), (None, 5, 8)]
    right = [(rng.choice("ab"), rng.randrange(-20, 100), rng.randrange(5), rng.choice([None, 1.5])) for _ in range(60)] + [("a", None, 1, 1.0), (None, 1, 1, 1.0)]
    frames = spark.createDataFrame(left, "k string, t long, id int"), spark.createDataFrame(right, "k string, t long, o int, v double")
    key = lambda r: (r[1], r[2], r[3] is not None, r[3] or 0)
    truth = []
    for k, t, i in left:
        last = max((r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t), key=key, default=None)
        truth.append((k, t, i, *(last[1:] if last else (None, None, None))))
    for bucket in (1, 7, 1 << 16):
        got = ordered.asof_join(*frames, ["k"], "t", "t", ["o"], bucket)
        assert got.columns == ["k", "t", "id", "t_right", "o", "v"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(truth, key=repr)


def test_containing(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab_") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 60))) for i in range(120)] + [(500, None), (501, ""), (3, None)]
    listed = {word(rng.randrange(1, 12)) for _ in range(150)} | {"aaaaaa" + word(4) for _ in range(20)}
    names = [(n,) for n in listed] + [(None,), ("",), ("a",), ("zzz",), ("éa",)]
    got = ordered.containing(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame(names, "n string"), "n")
    assert sorted(map(tuple, got.collect())) == sorted({(i, n) for i, t in texts for (n,) in names if n and t and n in t})
    assert ordered.containing(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame([], "n string"), "n").count() == 0


def test_names_in_rows(spark, monkeypatch):
    """Rows count by themselves, and no pair is shuffled; names in several blocks, by their parts, and in texts longer than a piece give the same."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ab_é") for _ in range(n))
    texts = [(i % 90, word(rng.randrange(0, 60))) for i in range(120)] + [(7, None), (None, "aéaéaé_b"), (8, word(200) * 20), (8, "xb" * 40)]
    names = sorted({word(rng.randrange(1, 14)) for _ in range(200)} | {"aéaéaé" + word(4) for _ in range(20)} | {"a", "zzz", "aéaéaé_b"})
    truth = sorted(((i, n) for i, t in texts for n in names if t and n in t), key=repr)
    rows, listed = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(n,) for n in names], "n string")
    got = ordered.containing_rows(rows, "id", "t", listed, "n")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=repr) == truth
    for limits in ({"BLOCK_CHARS": 400}, {"BLOCK_CHARS": 400, "NAME_BLOCKS": 1}, {"NAME_CHARS": 8}):
        with monkeypatch.context() as m:
            for k, v in limits.items():
                m.setattr(ordered, k, v)
            assert sorted(map(tuple, ordered.containing_rows(rows, "id", "t", listed, "n").collect()), key=repr) == truth


def test_names_whose_hashes_agree(monkeypatch):
    """Texts are compared byte by byte, in pieces that names go beyond: the result does not depend on the hashes."""
    rng = random.Random(10)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts, names = [word(rng.randrange(0, 300)) for _ in range(30)] + [None, "", word(5000)], sorted({word(rng.randrange(1, 12)) for _ in range(200)})
    truth = [(i, k) for i, t in enumerate(texts) for k, n in enumerate(names) if t and n in t]
    for piece, hashes in ((1 << 16, parts._BYTES), (16, parts._BYTES), (16, np.full(256, 7, np.uint64)), (64, np.arange(256, dtype=np.uint64) % 2 << 62)):
        monkeypatch.setattr(parts, "PIECE", piece)
        monkeypatch.setattr(parts, "_BYTES", hashes)
        found = parts.Names(pa.array(names)).found(pa.array(["left out", *texts])[1:])
        assert list(zip(*(x.tolist() for x in found), strict=True)) == truth


def test_names_with_one_prefix_do_not_share_a_key(spark):
    """20,000 names that begin alike: no key of the index has more than a few of them."""
    names = spark.range(20_000).select(F.concat(F.lit("png_set_common_prefix_"), F.hex(F.xxhash64("id"))).alias("name"))
    texts = names.where("name like '%7'").select(F.monotonically_increasing_id().alias("id"), F.concat(F.lit("calls "), "name", F.lit("();")).alias("t"))
    got = ordered.containing(texts, "id", "t", names, "name")
    assert got.count() == texts.count() == got.select("name").distinct().count() > 1000


def test_anchors_by_join_and_by_array(spark):
    rows = spark.createDataFrame([(i % 7, i, ["x", None, f"t{i % 5}"] if i % 6 else None) for i in range(60)], "k int, id int, tokens array<string>")
    anchors = spark.createDataFrame([("t1",), ("t3",), (None,), ("t1",)], "token string")
    truth = sorted(i for i in range(60) if i % 6 and i % 5 in (1, 3))
    for more in ({}, {"rule_chars": 0}, {"rule_chars": 0, "key": ["id"]}):
        assert sorted(r.id for r in ordered.keep_anchored(rows, F.col("tokens"), anchors, **more).collect()) == truth


def closure(seeds, flows):
    known = set(seeds)
    while more := {(o, d, t) for o, p, t in known for f, d, s in flows if f == o and s == p} - known:
        known |= more
    return known


def test_pointers_on_cycles_and_branches(spark):
    rng = random.Random(9)
    for n in (3, 8, 14):
        flows = [(rng.choice("ab"), f"p{rng.randrange(n)}", f"p{rng.randrange(n)}") for _ in range(n)] + [("a", f"p{(i + 1) % n}", f"p{i}") for i in range(n)] + [("b", f"q{i + 1}", f"q{i}") for i in range(3 * n)]
        seeds = [(rng.choice("ab"), f"p{rng.randrange(n)}", f"f{i % 3}") for i in range(3)] + [("b", "q0", "g"), ("b", f"q{n}", "h")]
        got = graph.pointer_fixpoint(spark.createDataFrame(seeds, "owner string, ptr string, target string"), spark.createDataFrame(flows, "owner string, dst string, src string"))
        assert sorted(map(tuple, got.collect())) == sorted(closure(seeds, flows))


def test_a_long_chain_takes_few_rounds(spark):
    n = 5000
    flows = spark.range(n).select(F.lit("o").alias("owner"), (F.col("id") + 1).cast("string").alias("dst"), F.col("id").cast("string").alias("src"))
    seeds = spark.createDataFrame([("o", "0", "f")], "owner string, ptr string, target string")
    assert graph.pointer_fixpoint(seeds, flows, max_rounds=20).count() == n + 1


def test_least_paths(spark):
    rng = random.Random(10)
    names = [f"n{i:02d}" for i in range(30)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(70)] + [(f"c{i + 1}", f"c{i}") for i in range(20)] + [("c0", "n00"), (None, "n00"), ("n01", None)]
    public = set(rng.sample(names, 6)) | {"c20", "n00"}
    truth = {}
    for sink in ("n00", "n05"):
        level = {sink: [sink]}
        seen = dict(level)
        while level:
            step = {}
            for node, path in level.items():
                for a, b in edges:
                    if a and b == node and (node not in public or node == sink and len(path) == 1) and a not in seen:
                        step[a] = min(step.get(a, [*path, a]), [*path, a])
            seen |= step
            level = step
        truth |= {(sink, v): p for v, p in seen.items() if v in public}
    got = graph.reverse_paths(spark.createDataFrame(edges, "caller string, callee string"), spark.createDataFrame([("n00",), ("n05",)], "name string"), spark.createDataFrame([(p,) for p in public], "name string"))
    assert {(r.sink, r.node): r.path for r in got.collect()} == truth and all(r.depth == len(r.path) - 1 for r in got.collect())
    assert max(map(len, truth.values())) > 20


def test_tolerant_json(spark):
    texts = ['{"b": 1, "a": {"d": [1, {"z": 1, "y": 2}], "c": null}}', ' {"a":{"c":null,"d":[1,{"y":2,"z":1}]},"b":1} ', 'Here: {"a": 1}\n``` end', '{"a": 1} trailing', "[1, 2]", "nothing", '{"a": {"b": 1', "", None, "x { y } z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tolerant.canonical_text(F.col("t")).alias("c"), tolerant.canonical(tolerant.tolerant(F.col("t"))).alias("v")).orderBy("i").collect()
    c, v = [r.c for r in rows], [r.v for r in rows]
    assert c[0] == c[1] == json.dumps(json.loads(texts[0]), sort_keys=True, separators=(",", ":")) and c[2] == c[3] == '{"a":1}' and c[4] == "[1,2]"
    assert c[5:] == texts[5:] and v[5:] == [None] * 5
