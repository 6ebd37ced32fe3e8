"""The recorded-advisory format: rows, filters that are taken over, and which files are opened."""

import random
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscope.sources import recorded

WHERE = (
    "cve_id = 'CVE-2020-00500'", "cve_id = 'CVE-2020-00500' and source = 'nvd'", "cve_id in ('CVE-2020-00001', 'CVE-2020-00777', 'x')", "cve_id >= 'CVE-2020-00120' and cve_id < 'CVE-2020-00131'",
    "cve_id > 'CVE-2020-00998'", "cve_id <= 'CVE-2020-00000'", "cve_id like 'CVE-2020-0099%' and source in ('osv', 'gh')", "source = 'none'", "cve_id = 'CVE-2020-00005' and cve_id = 'CVE-2020-00006'",
    "json like '%77%'", "cve_id like '%77' and source <> 'gh'", "cve_id is null", "cve_id = 'CVE-2020-00003' or source = 'gh'",
)


def answers(spark):
    ids = spark.range(1000).select(F.format_string("CVE-2020-%05d", "id").alias("cve_id"))
    sources = spark.createDataFrame([("nvd",), ("osv",), ("gh",)], "source string")
    return ids.crossJoin(sources).withColumn("json", F.to_json(F.struct("cve_id", "source")))


def test_rows_and_filters(spark, tmp_path):
    given = answers(spark)
    odd = spark.createDataFrame([("CVE-2020-00500", "nvd", None), (None, "nvd", "{}"), ("x", None, "{}"), ('é"\n', "nvd", 'a\nb" ')], recorded.SCHEMA)
    recorded.record_answers(given.unionByName(odd), f"file://{tmp_path}/a", 100)
    read = recorded.read_answers(spark, f"file://{tmp_path}/a", pushdown=True)
    kept = given.unionByName(odd.where("cve_id is not null and source is not null").fillna("", ["json"]))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(read) == rows(kept)
    for where in WHERE:
        assert rows(read.where(where)) == rows(kept.where(where)), where
    everything = read.rdd.getNumPartitions()
    assert everything >= 30 and recorded.read_answers(spark, f"{tmp_path}/a", pushdown=True).where(WHERE[1]).rdd.getNumPartitions() == 1
    assert read.where(WHERE[0]).rdd.getNumPartitions() <= 6 and read.where(WHERE[7]).rdd.getNumPartitions() <= 1
    plain = recorded.read_answers(spark, f"file://{tmp_path}/a")
    parts = [plain.where(w) for w in WHERE]
    assert rows(reduce(DataFrame.unionAll, parts)) == sorted(r for w in WHERE for r in rows(kept.where(w)))  # one DataFrame, filtered in many ways
    narrow = recorded.read_answers(spark, f"file://{tmp_path}/a", source="osv", **{"from": "CVE-2020-00120", "to": "CVE-2020-00131"})
    assert rows(narrow) == rows(kept.where("source = 'osv' and cve_id between 'CVE-2020-00120' and 'CVE-2020-00131'")) and narrow.rdd.getNumPartitions() <= 2
    assert rows(recorded.read_answers(spark, f"file://{tmp_path}/a", starts="CVE-2020-0012")) == rows(kept.where("cve_id like 'CVE-2020-0012%'"))
    recorded.record_answers(given.where("false"), f"file://{tmp_path}/none")
    assert recorded.read_answers(spark, f"file://{tmp_path}/none").count() == 0


def test_other_files_are_not_opened(spark, tmp_path):
    recorded.record_answers(answers(spark), f"file://{tmp_path}/a", 100)
    one = recorded.read_answers(spark, f"file://{tmp_path}/a", pushdown=True).where("cve_id = 'CVE-2020-00500' and source = 'osv'")
    holding = {Path(p).name for p in (tmp_path / "a/answers").glob("part-*") if '"CVE-2020-00500","source":"osv"' in p.read_text()}
    assert len(holding) == 1
    for p in (tmp_path / "a/answers").glob("part-*"):
        if p.name not in holding:
            p.unlink()  # an attempt to open it fails now
    assert [r.source for r in one.collect()] == ["osv"]


def test_ranges_against_plain_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual, StringStartsWith

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(4)))
    kinds = {EqualTo: str.__eq__, GreaterThan: str.__gt__, GreaterThanOrEqual: str.__ge__, LessThan: str.__lt__, LessThanOrEqual: str.__le__, StringStartsWith: str.startswith, In: lambda v, w: v in w}
    for _ in range(3000):
        filters = [(k, tuple(word() for _ in range(3)) if k is In else word()) for k in rng.choices(list(kinds), k=rng.randrange(4))]
        left = recorded.Range()
        assert all(left.take(k(("cve_id",), v)) for k, v in filters)
        values = sorted(word() for _ in range(8))
        good = [all(kinds[k](v, w) for k, w in filters) for v in values]
        assert [left.holds(v) for v in values] == good
        assert left.meets(values[0], values[-1]) or not any(good)
        assert all(not any(good[i:]) for i, v in enumerate(values) if left.over(v))
