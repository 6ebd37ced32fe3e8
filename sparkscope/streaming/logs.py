"""Structured Streaming over growing logs: an extra beside the batch operators, which it reuses.

Build logs and run logs are appended to while a job runs; these read them as
they grow. State is bounded by watermarks, and file sinks give each row once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope.operators.evidence import classify_runs
from sparkscope.sources.build_log import SCHEMA


def build_commands(spark: SparkSession, folder: str) -> DataFrame:
    """Compiler calls from JSON-lines files that appear in a folder; broken lines are dropped."""
    lines = spark.readStream.text(folder)
    return lines.select(F.from_json("value", SCHEMA).alias("r")).where("r.argv is not null").select("r.*").withColumn("cwd", F.coalesce("cwd", F.lit(".")))


def run_evidence(runs: DataFrame, sink: Column, entry: Column, path: Column, time: str = "ts", delay: str | None = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, classification, n, best): classes of runs per window of event time; runs later than ``delay`` are dropped.

    Give no delay for runs that have a watermark already.
    """
    judged = classify_runs(runs.withWatermark(time, delay) if delay else runs, sink, entry, path)
    return judged.groupBy(F.window(time, window), "classification").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def first_runs(runs: DataFrame, key: str, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each key's run once, as long as the watermark remembers it."""
    return runs.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
