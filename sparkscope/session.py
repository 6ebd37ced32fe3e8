"""Session helpers: settings, importable workers, and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the engine's plans assume; AQE stays on."""
    builder = (
        SparkSession.builder.master(master)
        .appName("sparkscope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Bytes of an Arrow batch that goes to a Python worker; both sides hold a few of them.
BATCH_BYTES = 8 << 20


def workers_see_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started, and send them small batches.

    On a cluster the package is shipped with the job; this only adds the
    driver's own folder to the workers' search path if it is not there yet.
    A smaller batch size that the session has already stays.
    """
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(batch)) > BATCH_BYTES:
        spark.conf.set(batch, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only if it is unset and all runs on one machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="sparkscope-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


_written: dict[str, SparkSession] = {}


def materialise(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage like checkpoint(), survives lost executors, and keeps the
    table columnar. The files are removed when the driver ends, or once a table
    that ``replaces`` this one is written: a loop's state needs one table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_written)
    _written[path] = spark
    if replaces is not None and (old := getattr(replaces, "_sparkscope_path", None)):
        _remove(old)
    # nothing needs the shuffle files behind the table any more; Spark drops them once the driver has collected their handles
    spark.sparkContext._jvm.System.gc()
    table_ = spark.read.schema(df.schema).parquet(path)
    table_._sparkscope_path = path
    return table_


def _remove(path: str) -> None:
    spark = _written.pop(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_written() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001 - the session may be gone; the shared folder's owner cleans up then
            return


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` in parts of about ``rows`` rows, dealt by ``keys`` if given; rows are counted first. Adaptive execution leaves this number as it is."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables, lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
