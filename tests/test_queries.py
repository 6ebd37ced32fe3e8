"""Every query with an oracle gives the oracle's rows; the entry and the guard around the corpus operators work."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def as_rows(frame):
    """Rows in order; numbers stay numbers, so 1 and '1' differ."""
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda v: v.tolist() if hasattr(v, "tolist") else v
    return sorted((tuple(map(plain, r)) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_matches_its_oracle(spark, db, name):
    got, truth = entry.queries()[name](spark, SF).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(truth.columns)
    assert as_rows(got) == as_rows(truth)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_excerpts_fit_their_budget(spark):
    rows = entry.queries()["smart_excerpt"](spark, SF).collect()
    assert rows and all(len(r.excerpt.replace("    // ...\n", "")) <= 400 for r in rows)


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    """Without both llm folders and corpus_pipeline.py the entry imports, all other tests are collected, and one of them runs."""
    for p in ("__spark_entry__.py", "sparkscope", "tests"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    for p in ("sparkscope/llm", "tests/llm"):
        subprocess.run(["rm", "-rf", str(tmp_path / p)], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
    listed = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, check=True, capture_output=True, text=True).stdout
    assert "tests/test_graph.py" in listed and "llm" not in listed
    subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_queries.py", "-k", "test_entry"], cwd=tmp_path, check=True, capture_output=True)


def test_rendered_rows_are_dealt_over_tasks_by_their_number(spark, tmp_path):
    from sparkscope.rendered import PART, SUPPLIER

    spark.range(12_001).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(0).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = PART.rows(spark, str(tmp_path), "k long, t string", ("<<k>>", "a<<k>>"), ("<<k>>", "b"))
    assert rows.rdd.getNumPartitions() == 3 and rows.count() == rows.distinct().count() == 24_002
    assert SUPPLIER.rows(spark, str(tmp_path), "k long", ("<<k>>",)).count() == 0


def test_rendered_tables_are_dealt_by_key(spark):
    """Dealing in turn sorts each file in the memory of the task that reads it."""
    from dataclasses import replace

    from sparkscope.rendered import PART, SUPPLIER

    for base in (PART, SUPPLIER):
        plan = replace(base, task_rows=5).table(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" in plan and "RoundRobin" not in plan
