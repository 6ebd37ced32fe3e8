"""A store of rows by key that is upserted in versions: files by bucket of key, and a manifest that is published last.

A version is a manifest: which folder holds each bucket, and the schema. An
upsert writes the buckets it changes into a folder of its own and then renames
its manifest into place, which fails if that version exists. So readers see a
whole version or the one before, a writer that dies leaves files that no
manifest names, and of two writers that began from one version the second is
told. Files of earlier versions stay until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkscope.operators.ordered import last_wins

#: Buckets of a new store; a version's manifest has a line for each.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to be."""


@dataclass
class Manifest:
    version: int = 0
    buckets: int = BUCKETS
    schema: dict | None = None
    folders: dict[str, str] = field(default_factory=dict)


class _Files:
    """The store's folder through Hadoop's file systems, so that it may be anywhere Spark writes."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self.hadoop, self.folder = jvm.org.apache.hadoop, folder.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)
        self.context = self.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        self.plain = spark.sparkContext._gateway.new_array(getattr(self.hadoop.fs, "Options$Rename"), 0)
        self.read_all = jvm.org.apache.commons.io.IOUtils.toString

    def path(self, name: str):
        return self.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str) -> list[str]:
        path = self.path(name)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.read_all(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write beside and rename; raises Conflict if the name is taken."""
        beside = self.path(f"manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(beside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self.context.rename(self.context.makeQualified(beside), self.context.makeQualified(self.path(name)), self.plain)
        except Exception as e:
            self.fs.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Published versions, in order."""
    return sorted(int(n[:-5]) for n in _Files(spark, folder).names("manifests") if n.endswith(".json") and n[:-5].isdigit())


def _manifest(files: _Files, version: int) -> Manifest:
    return Manifest(**json.loads(files.read(f"manifests/{version:012d}.json"))) if version else Manifest()


def _rows(spark: SparkSession, files: _Files, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(manifest.schema)
    asked = [f for b, f in manifest.folders.items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*(f"{files.folder}/{f}" for f in asked)) if asked else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows of a version (default: the last); a store without any raises."""
    files = _Files(spark, folder)
    known = versions(spark, folder)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no version {version if version is not None else ''} below {folder}")
    return _rows(spark, files, _manifest(files, known[-1] if version is None else version))


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def upsert(spark: SparkSession, folder: str, rows: DataFrame, keys: list[str], order: list[str] = (), fill: bool = False, buckets: int = BUCKETS, base: int | None = None) -> int:
    """Publish a version in which ``rows`` stand for the stored rows of their keys; returns its number.

    Of rows with one key the last by ``order`` counts (then by all columns);
    rows with a null key are left out. With ``fill`` a null of the new row
    leaves what is stored, so that later answers add to earlier ones. Columns
    that either side lacks are null there. Only buckets that hold one of the
    keys are read and written. The same rows again give the same content.
    ``base`` is the version to build on (default: the last); if another writer
    has built on it, ``Conflict`` is raised and nothing is changed.
    """
    files = _Files(spark, folder)
    known = versions(spark, folder)
    old = _manifest(files, (known[-1] if known else 0) if base is None else base)
    if old.version == 0:
        old.buckets = buckets
    sound = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    rest = [c for c in rows.columns if c not in keys]
    new = last_wins(sound, keys, [*order, *(c for c in rest if c not in order)]) if rest else sound.distinct()
    marked = new.withColumn("_bucket", _bucket(keys, old.buckets))
    at = f"data/{uuid.uuid4().hex}"
    touched = sorted(r[0] for r in marked.select("_bucket").distinct().collect())  # BUCKETS numbers at most
    merged = marked
    if old.schema is not None and touched:
        stored = _rows(spark, files, old, touched)
        if fill:
            both = stored.select(*keys, F.struct(*stored.columns).alias("_old")).join(new.select(*keys, F.struct(*new.columns).alias("_new")), keys, "full")
            side = lambda s, c, cs: F.col(s)[c] if c in cs else None
            columns = [*new.columns, *(c for c in stored.columns if c not in new.columns)]
            united = both.select(*keys, *(F.coalesce(*(v for v in (side("_new", c, new.columns), side("_old", c, stored.columns)) if v is not None)).alias(c) for c in columns if c not in keys))
        else:
            united = new.unionByName(stored.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)
        merged = united.withColumn("_bucket", _bucket(keys, old.buckets))
    merged.repartition(max(1, len(touched)), "_bucket").sortWithinPartitions("_bucket", *keys).write.partitionBy("_bucket").parquet(f"{files.folder}/{at}")
    schema = merged.drop("_bucket").schema
    version = old.version + 1
    folders = old.folders | {str(b): f"{at}/_bucket={b}" for b in touched}
    files.publish(f"manifests/{version:012d}.json", json.dumps({"version": version, "buckets": old.buckets, "schema": json.loads(schema.json()), "folders": folders}))
    return version


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> None:
    """Remove all versions but the last ``keep``, and data that none of these names, also what dead writers left; no writer may be at work."""
    files = _Files(spark, folder)
    known = versions(spark, folder)
    used = {f.split("/")[1] for v in known[-keep:] for f in _manifest(files, v).folders.values()}
    for v in known[:-keep]:
        files.fs.delete(files.path(f"manifests/{v:012d}.json"), False)
    for name in files.names("data"):
        if name not in used:
            files.fs.delete(files.path(f"data/{name}"), True)
