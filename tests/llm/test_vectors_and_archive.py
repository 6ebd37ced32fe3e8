"""Hard negatives, the content-addressed archive and whitening against brute force and round trips."""

import base64
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscope.llm import hardnegatives, registry, warc, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, rank string, x double"


def mined(rows, positives=5, negatives=3):
    """Hard negatives of all rows by plain loops; rows are (id, integer vector, label), distinct."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, v, label in rows:
        if i % 50:
            continue
        scored = [(-dot(v, w), j, m) for j, w, m in rows if j != i]
        for p, pid, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            hard = sorted(r for r in scored if r[2] != label and 50 * -p <= 100 * -r[0] <= 95 * -p)[:negatives]
            out += [(i, pid, k + 1, nid, -p, -n) for k, (n, nid, _) in enumerate(hard)]
    return sorted(out)


def mine(df, **more):
    found = hardnegatives.mine_hard_negatives(df, anchor=F.col("vec_id") % 50 == 0, **more)
    return sorted(tuple(r)[:6] for r in found.collect())


def whole(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


def test_hard_negatives_match_the_oracle(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    truth = db.execute(registry.ORACLES["op11_hard_negatives"]).fetchall()
    assert sorted(tuple(r) for r in registry.QUERIES["op11_hard_negatives"](spark, SF).collect()) == sorted(truth) and truth


def test_hard_negatives_in_many_blocks_chunks_and_waves(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.5, 1.0]) for _ in range(rng.choice([7, 9]))], 1 if i % 3 else rng.randrange(4)) for i in range(600)]
    monkeypatch.setattr(hardnegatives, "BLOCK", 64)
    monkeypatch.setattr(hardnegatives, "ANCHORS", 3)
    monkeypatch.setattr(hardnegatives, "CHUNK", 2)
    monkeypatch.setattr(hardnegatives, "CHUNKS", 4)
    truth = mined([(i, whole(v), m) for i, v, m in rows])
    df = spark.createDataFrame([(i, v, m, "r", 0.0) for i, v, m in rows], VECTORS)
    assert mine(df) == mine(df, wave_bytes=8 * 3 * 3 * 300) == truth and len(truth) > 50  # ties abound: entries have five values


def test_hard_negatives_of_odd_rows(spark):
    sound = [(0, [1.0, 0.5], 1), (50, [1.0, 0.5], 1), (3, [0.9, 0.5], 2), (4, [], 2), (5, [0.8], 3), (6, [0.7, 0.7], 1)]
    odd = [(7, None, 1), (8, [1.0, None], 1), (9, [float("nan"), 1.0], 2), (10, [float("inf"), 1.0], 2), (11, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1)]
    df = spark.createDataFrame([(*r, "r", 0.0) for r in sound + odd], VECTORS)
    truth = mined([(i, whole(v), m) for i, v, m in sound])
    assert mine(df) == truth and truth
    assert mine(df.where("false")) == [] == mine(df.where("vec_id = 0"))
    huge = spark.createDataFrame([(0, [1e30], 1), (50, [1e30], 1), (1, [1e30], 2)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits|OVERFLOW|overflow"):
        mine(huge)
    big = 1 << 24
    a = np.array([[big, -3], [5, big]], np.int64)
    assert hardnegatives.product(a, a).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in a] for r in a]


PAGES = [(1, "http://a b", "x\r\n\r\nWARC/1.1\r\nWARC-Type: no"), (2, None, "x\r\n\r\nWARC/1.1\r\nWARC-Type: no"), (3, "u\r\nX-Page-Id: 77", None), (0, "u", ""), (0, "u", ""), (None, "n", "zz"), (None, "n", "zz"), (None, "n", "é" * 5), (9, "c", "é" * 5), (10, "", "<p>" * 200_000)]
PAGE_ROW = "page_id long, url string, html string"


def test_archive_matches_the_oracle(spark):
    db = duckdb.connect()
    db.register("pages", spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.read.parquet(f"{SF}/pages.parquet").withColumn("page_id", F.col("page_id") + 1000)).toPandas())
    both = spark.read.parquet(f"{SF}/pages.parquet")
    both = both.unionByName(both.withColumn("page_id", F.col("page_id") + 1000)).withColumns({"key": F.lit(1), "header": F.lit("h")})
    names = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    truth = db.execute(f"SELECT {names} FROM ({registry.ORACLES['op12_warc_archive']})").fetchall()
    got = [tuple(r[n] for n in names.split(", ")) for r in warc.read_index(warc.write_archive(both)).collect()]
    assert sorted(got) == sorted(truth) and sum(r[3] == "revisit" for r in got) == 50


def test_records_of_odd_pages(spark):
    archive = warc.write_archive(spark.createDataFrame(PAGES, PAGE_ROW))
    rows = warc.read_index(archive).collect()
    assert len(rows) == len(PAGES) and archive.payloads.count() == 5
    of = {(r.page_id, r.payload_bytes): r for r in rows}
    digest = lambda text: base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
    assert {r.payload_digest for r in rows} == {digest(p[2] or "") for p in PAGES}
    assert [(of[k].record_type, of[k].refers_to) for k in ((1, 28), (2, 28), (3, 0), (0, 0), (None, 2), (9, 10), (None, 10), (10, 600_000))] == [
        ("response", None), ("revisit", 1), ("revisit", 0), ("response", None), ("response", None), ("response", None), ("revisit", 9), ("response", None)
    ]
    assert warc.read_index(warc.write_archive(spark.createDataFrame([], PAGE_ROW))).count() == 0
    large = {(r.page_id, r.record_type) for r in warc.read_index(warc.write_archive(spark.createDataFrame(PAGES, PAGE_ROW), min_bytes=11)).collect()}
    assert not any(t == "revisit" and i != 2 for i, t in large) and (2, "revisit") in large


def test_files_give_the_records_back(spark, tmp_path):
    archive = warc.write_archive(spark.createDataFrame(PAGES, PAGE_ROW))
    records = warc.read_records(archive).collect()
    assert sorted(((r.page_id or -1), bytes(r.payload)) for r in records) == sorted((i or -1, (h or "").encode()) for i, _, h in PAGES)
    truth = sorted((r.header, bytes(r.payload) if r.record_type == "response" else b"", True) for r in records)
    for codec in ("gzip", "none"):
        warc.write_warc(archive, f"file://{tmp_path}/{codec}", codec, records_per_file=3)
        assert sorted((r.header, bytes(r.block), r.complete) for r in warc.read_warc(spark, f"file://{tmp_path}/{codec}").collect()) == truth
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(bytes(records[0].record) + b"\r\n\r\n" + bytes(records[1].record)[:40])
    (tmp_path / "cut" / "b.warc").write_bytes(b"")
    assert [(r.start > 0, r.complete) for r in warc.read_warc(spark, f"file://{tmp_path}/cut").orderBy("start").collect()] == [(False, True), (True, False)]


def test_a_changed_payload_is_refused(spark):
    archive = warc.write_archive(spark.createDataFrame(PAGES[:5], PAGE_ROW))
    other = archive.payloads.withColumn("payload", F.concat("payload", F.lit("!").cast("binary")))
    for broken in (other, archive.payloads.where(F.octet_length("payload") == 0)):
        with pytest.raises(Exception, match="not what it says"):
            warc.read_index(warc.Archive(archive.headers, broken)).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40])
def test_symmetric_eigen(n):
    rng = np.random.default_rng(n)
    low = rng.standard_normal((n, max(1, n // 3)))
    for a in (np.zeros((n, n)), np.diag(np.arange(n) * 1.0), low @ low.T * 1e6, (s := rng.standard_normal((n, n))) + s.T, np.ones((n, n))):
        e, v = whitening.symmetric_eigen(a)
        scale = max(1.0, np.abs(a).max()) * n
        assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * scale
        assert np.abs(a @ v - v * e).max() < 1e-13 * scale and np.abs(v.T @ v - np.eye(n)).max() < 1e-13 * n


def brute(vectors, k=16):
    """(n, deviations, |whitened|, explained) by whole matrices."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    apart = [[n * int(c) - int(s) for c, s in zip(row, sums)] for row in x]
    centred = (fit * n - sums) / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, [sum(c * c for c in row) for row in apart], np.abs(np.array(apart, float) / n @ v / np.sqrt(e)), e / np.trace(cov)


@pytest.mark.parametrize("merged", [16, 2])
def test_whitening_matches_whole_matrices(spark, monkeypatch, merged):
    monkeypatch.setattr(whitening, "MERGED", merged)
    given = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").repartition(7)
    given = given.unionByName(given.where("vec_id < 90").withColumn("vec_id", F.col("vec_id") + 1000)).withColumn("x", F.lit("clash"))
    rows = given.orderBy("vec_id").collect()
    n, deviations, whitened, explained = brute([r.embedding for r in rows])
    got = whitening.whiten(given).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 16 * len(rows) and set(got.n) == {n} == {500}
    assert got.deviation.tolist() == [d for d in deviations for _ in range(16)]
    assert np.abs(np.abs(got.whitened.to_numpy()) - whitened.ravel()).max() < 1e-7
    assert np.abs(got.explained.to_numpy() / np.tile(explained, len(rows)) - 1).max() < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_whitening_of_odd_vectors(spark):
    sound = [(1, [1.0, 0.0, 0.5]), (2, [0.0, 1.0]), (3, []), (4, [0.5, 0.5, 0.0]), (4, [0.5, 0.5, 0.0]), (None, [1.0, 0.0, 0.5])]
    odd = [(5, None), (6, [None, 1.0]), (7, [float("nan")]), (8, [float("-inf"), 0.0])]
    row = "vec_id long, embedding array<float>"
    got = whitening.whiten(spark.createDataFrame(sound + odd, row)).toPandas()
    n, deviations, _, _ = brute([v + [0.0] * (3 - len(v)) for _, v in sound])
    assert n == 4 == got.n[0] and len(got) == 3 * len(sound) and sorted(got.deviation) == sorted(d for d in deviations for _ in range(3))
    assert got.identity_error[0] < 1e-9 and abs(got.groupby("component").explained.first().sum() - 1) < 1e-9
    assert whitening.whiten(spark.createDataFrame([], row)).count() == 0 == whitening.whiten(spark.createDataFrame(sound[3:5], row)).count()
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0, float(-i)]) for i in range(9)], row)).toPandas()
    assert set(flat.component) == {1} and len(flat) == 9  # two of three directions do not vary


def test_hard_negatives_shuffle_shards_and_no_tiles(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.5, 1.0]) for _ in range(8)], 1 if i % 3 else rng.randrange(4)) for i in range(500)]
    monkeypatch.setattr(hardnegatives, "BLOCK", 32)
    monkeypatch.setattr(hardnegatives, "ANCHORS", 2)
    monkeypatch.setattr(hardnegatives, "CHUNK", 2)
    monkeypatch.setattr(hardnegatives, "ACROSS", 2)
    monkeypatch.setattr(hardnegatives, "DOWN", 3)
    df = spark.createDataFrame([(i, v, m, "r", 0.0) for i, v, m in rows], VECTORS)
    found = hardnegatives.mine_hard_negatives(df, anchor=F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r)[:6] for r in found.collect()) == mine(df, wave_bytes=1) == mined([(i, whole(v), m) for i, v, m in rows])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapCoGroupsInArrow", "")
