"""Recorded advisory answers as a Spark data source: files by range of id, opened only where a filter can be met.

``record_answers`` writes answers in order of (source, id) as lines of JSON,
with an index that says which ids each file holds. After ``register``,

    spark.read.format("recorded_advisories").option("path", folder).load()

gives (cve_id, source, json), one partition for each file and source. The
options ``source``, ``from``, ``to`` (inclusive) and ``starts`` narrow what is
read: files whose range cannot meet them are no partitions at all, the others
are read up to the last id that can match. With the option ``pushdown`` filters
on ``cve_id`` and ``source`` do the same. It is an option because Spark 4.1
keeps one reader for each loaded DataFrame: if one is filtered in two ways
within one plan, the last filters hold for both. A DataFrame with ``pushdown``
is for one use; load it again for another. Folders are reached by pyarrow, so
the address may be a path or any store that it knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from sparkscope.session import workers_see_package

#: Answers of a file, and rows of a batch that the reader hands over.
ROWS_PER_FILE, BATCH_ROWS = 10_000, 500
SCHEMA = "cve_id string, source string, json string"
_ARROW = pa.schema([(c, pa.string()) for c in ("cve_id", "source", "json")])


def record_answers(answers: DataFrame, folder: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write (cve_id, source, json) rows below ``folder``; rows without an id or source are left out, repeated ones stay.

    Rows are dealt by range, so a file has about ``rows_per_file`` of them; an
    id with more is in one file. The index has a row for each file and source.
    """
    spark = answers.sparkSession
    rows = answers.select("cve_id", "source", "json").where("cve_id is not null and source is not null")
    files = max(1, -(-rows.count() // rows_per_file))
    line = F.to_json(F.struct("cve_id", "source", F.coalesce("json", F.lit("")).alias("json")))
    rows.repartitionByRange(files, "source", "cve_id").sortWithinPartitions("source", "cve_id").select(line.alias("value")).write.text(f"{folder}/answers")
    written = spark.read.schema(SCHEMA).json(f"{folder}/answers").select("cve_id", "source", F.col("_metadata.file_path").alias("file"))
    index = written.groupBy(F.regexp_extract("file", "[^/]+$", 0).alias("file"), "source").agg(F.min("cve_id").alias("first"), F.max("cve_id").alias("last"), F.count("*").alias("n"))
    index.coalesce(1).write.json(f"{folder}/index")


def store_of(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (pyarrow.fs.LocalFileSystem(), folder)


@dataclass
class Range:
    """What filters leave of a column's values: bounds, and a set if values are listed."""

    low: str | None = None
    high: str | None = None
    listed: set[str] | None = None
    tests: list[tuple[str, str]] = field(default_factory=list)

    def take(self, f: Filter) -> bool:
        """Whether the filter is one that can be decided here; then it narrows the range."""
        if isinstance(f, (EqualTo, EqualNullSafe)) and isinstance(f.value, str):
            self._list({f.value})
        elif isinstance(f, In) and all(isinstance(v, str) for v in f.value):
            self._list(set(f.value))
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and isinstance(f.value, str):
            self.low = max(filter(None, (self.low, f.value)), default=f.value)
            self.tests.append((">" if isinstance(f, GreaterThan) else ">=", f.value))
        elif isinstance(f, (LessThan, LessThanOrEqual)) and isinstance(f.value, str):
            self.high = min(filter(None, (self.high, f.value)), default=f.value)
            self.tests.append(("<" if isinstance(f, LessThan) else "<=", f.value))
        elif isinstance(f, StringStartsWith) and isinstance(f.value, str):
            self.low = max(filter(None, (self.low, f.value)), default=f.value)
            self.tests.append(("starts", f.value))
        else:
            return isinstance(f, IsNotNull)  # ids and sources never are null
        return True

    def _list(self, values: set[str]) -> None:
        self.listed = values if self.listed is None else self.listed & values

    def holds(self, value: str) -> bool:
        decide = {">": value.__gt__, ">=": value.__ge__, "<": value.__lt__, "<=": value.__le__, "starts": value.startswith}
        return (self.listed is None or value in self.listed) and all(decide[op](v) for op, v in self.tests)

    def meets(self, first: str, last: str) -> bool:
        """Whether a value from first to last can be left."""
        starts = [v for op, v in self.tests if op == "starts"]
        return (
            (self.low is None or last >= self.low) and (self.high is None or first <= self.high)
            and all(first[: len(v)] <= v for v in starts) and (self.listed is None or any(first <= v <= last for v in self.listed))
        )

    def over(self, value: str) -> bool:
        """Whether no value from this one on can be left."""
        beyond = self.high is not None and value > self.high
        return beyond or (self.listed is not None and all(v < value for v in self.listed)) or any(value[: len(v)] > v for op, v in self.tests if op == "starts")


@dataclass
class AnswerFile(InputPartition):
    file: str
    source: str

    def __post_init__(self) -> None:
        super().__init__(self.file)


class AnswerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.ranges = {"cve_id": Range(), "source": Range()}
        for option, column, kind in (("source", "source", EqualTo), ("from", "cve_id", GreaterThanOrEqual), ("to", "cve_id", LessThanOrEqual), ("starts", "cve_id", StringStartsWith)):
            if option in options:
                self.ranges[column].take(kind((column,), options[option]))

    def partitions(self) -> list[AnswerFile]:
        store, root = store_of(self.folder)
        listed = store.get_file_info(pyarrow.fs.FileSelector(f"{root}/index"))
        found = []
        for info in sorted(listed, key=lambda i: i.path):
            if info.base_name.startswith("part-"):
                with store.open_input_stream(info.path) as stream:
                    found += [json.loads(line) for line in stream.read().splitlines() if line]
        left = [r for r in found if self.ranges["source"].holds(r["source"]) and self.ranges["cve_id"].meets(r["first"], r["last"])]
        return [AnswerFile(r["file"], r["source"]) for r in sorted(left, key=lambda r: (r["source"], r["first"], r["file"]))]

    def read(self, partition: AnswerFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks once where there are no partitions
            return
        store, root = store_of(self.folder)
        ids, rows = self.ranges["cve_id"], []
        with store.open_input_stream(f"{root}/answers/{partition.file}") as stream:
            for line in _lines(stream):
                row = json.loads(line)
                if row["source"] != partition.source:
                    continue
                if ids.over(row["cve_id"]):
                    break
                if ids.holds(row["cve_id"]):
                    rows.append(row)
                if len(rows) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class FilteringReader(AnswerReader):
    """Takes the filters over that it can decide."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            column = self.ranges.get(".".join(getattr(f, "attribute", ())))
            if column is None or not column.take(f):
                yield f


def _lines(stream: pa.NativeFile, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(size):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


class RecordedAdvisories(DataSource):
    """The format ``recorded_advisories``; its option ``path`` is a folder of ``record_answers``."""

    @classmethod
    def name(cls) -> str:
        return "recorded_advisories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AnswerReader:
        if "path" not in self.options:
            raise ValueError("option path is missing: the folder of the recorded answers")
        return (FilteringReader if self.options.get("pushdown", "false").lower() == "true" else AnswerReader)(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let its readers take filters over if they are asked to."""
    workers_see_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedAdvisories)


def read_answers(spark: SparkSession, folder: str, **options: str | bool) -> DataFrame:
    """Answers of a folder; see the module for options."""
    register(spark)
    return spark.read.format("recorded_advisories").options(**options).load(folder)
