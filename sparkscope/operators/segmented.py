"""State machines over very long ordered files without one task a file: summaries of segments, folded by composition.

A segment of a file is a function from the state before it to the state after
it. Where the machine has few discrete states, that function is a small table,
so segments can be read in any order and by any task:

1. each segment gives its summary, the outcome for every discrete state;
2. summaries compose, which is associative: ``FAN`` neighbours become one, level
   by level, until one task holds what is left of a file; then the levels are
   gone down again, and every segment learns the state before it;
3. a second pass reads each segment from its known state.

No step sees more of a file than ``FAN`` summaries or one segment.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscope.session import materialise

#: Lines of a segment, and summaries that a task composes.
SEGMENT, FAN = 4096, 256

Lines = list[tuple[int, str]]


class Machine(Protocol):
    """A summary is any picklable value; a state too. ``rows`` gives a segment's result rows, in the machine's schema."""

    schema: str
    start: Any

    def summary(self, lines: Lines) -> Any: ...
    def compose(self, first: Any, second: Any) -> Any: ...
    def after(self, state: Any, summary: Any) -> Any: ...
    def rows(self, state: Any, lines: Lines) -> Iterator[tuple]: ...


def segments_of(lines: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(file, seg, whole, lines): lines (file, line_no, text) by segments of ``size`` line numbers, each in order."""
    seg = F.floor(F.col("line_no") / size).alias("seg")
    text = F.struct(F.col("line_no").cast("long").alias("line_no"), F.coalesce("text", F.lit("")).alias("text"))
    return lines.select("file", seg, text.alias("l")).groupBy("file", "seg").agg(F.array_sort(F.collect_list("l")).alias("lines")).select("file", "seg", F.lit(False).alias("whole"), "lines")


def segments_in_rows(files: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(file, seg, whole, lines): segments of files that are one row each, (file, lines array<string>), cut where they are; lines are numbered from 1.

    No line is shuffled. ``whole`` says that a file is one segment, whose state before is known.
    """
    parts = F.sequence(F.lit(0), F.ceil(F.size("lines") / size).cast("int") - 1)
    cut = files.where(F.size("lines") > 0).select("file", "lines", (F.size("lines") <= size).alias("whole"), F.explode(parts).alias("seg")).withColumn("part", F.slice("lines", F.col("seg") * size + 1, F.lit(size)))
    first = F.col("seg").cast("long") * size + 1
    numbered = F.transform("part", lambda t, i: F.struct((first + i).alias("line_no"), F.coalesce(t, F.lit("")).alias("text")))
    return cut.select("file", F.col("seg").cast("long").alias("seg"), "whole", numbered.alias("lines"))


def _lines(value: pa.Scalar) -> Lines:
    values = value.values
    return list(zip(values.field(0).to_numpy().tolist(), values.field(1).to_numpy(zero_copy_only=False).tolist(), strict=True))


def _summaries(segments: DataFrame, machine: Machine) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [pickle.dumps(machine.summary(_lines(v))) for v in batch["lines"]]
            yield pa.RecordBatch.from_arrays([batch["file"], batch["seg"], pa.array(told, pa.binary())], ["file", "seg", "summary"])

    return segments.select("file", "seg", "lines").mapInArrow(run, "file string, seg long, summary binary")


def _groups(df: DataFrame, change: Callable[[list[tuple]], list[tuple]], columns: list[str], schema: str) -> DataFrame:
    """Rows of each (file, group) in order of seg, changed together: FAN rows at most."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("seg", *columns)), strict=True))
        out = change(rows)
        file, group = table["file"][0].as_py(), table["grp"][0].as_py()
        known = {"file": [file] * len(out), "grp": [group] * len(out)}
        values = list(zip(*out, strict=True)) if out else [[] for _ in names]
        rest = iter(values)
        types = {"file": pa.string(), "seg": pa.int64(), "grp": pa.int64(), "summary": pa.binary(), "state": pa.binary()}
        return pa.table([pa.array(known.get(n) or list(next(rest)), types[n]) for n in names], names)

    return df.withColumn("grp", F.floor(F.col("seg") / FAN)).groupBy("file", "grp").applyInArrow(run, schema)


def states_before(summaries: DataFrame, machine: Machine) -> DataFrame:
    """(file, seg, state): the pickled state before each segment."""
    most = summaries.agg(F.max("seg")).first()[0] or 0
    levels = [summaries]
    while most >= FAN:
        most //= FAN

        def folded(rows: list[tuple]) -> list[tuple]:
            total = pickle.loads(rows[0][1])
            for _, more in rows[1:]:
                total = machine.compose(total, pickle.loads(more))
            return [(pickle.dumps(total),)]

        up = _groups(levels[-1], folded, ["summary"], "file string, grp long, summary binary")
        levels.append(materialise(up.select("file", F.col("grp").alias("seg"), "summary")))

    def run_from(rows: list[tuple]) -> list[tuple]:
        out, state = [], pickle.loads(rows[0][2])
        for seg, summary, _ in rows:
            out.append((seg, pickle.dumps(state)))
            state = machine.after(state, pickle.loads(summary))
        return out

    start = F.lit(pickle.dumps(machine.start))
    states = None
    for level in reversed(levels):
        told = level.withColumn("grp", F.floor(F.col("seg") / FAN))
        if states is None:
            known = told.withColumn("state", start)
        else:
            above = states.select(F.col("file").alias("f"), F.col("seg").alias("g"), "state")
            known = told.join(above, (F.col("file") == F.col("f")) & (F.col("grp") == F.col("g"))).drop("f", "g")
        states = _groups(known.drop("grp"), run_from, ["summary", "state"], "file string, seg long, state binary")
    return states


def run_segments(segments: DataFrame, machine: Machine) -> DataFrame:
    """The machine's rows, with the file first, over segments (file, seg, whole, lines) of files of any length.

    Lines of a file are in order of their number; gaps are allowed, a repeated
    number is read in order of the texts. A null text is empty, an empty table
    gives no rows. The segments are read more than once, so write them first
    if they are dear. A file of one segment needs no summary.
    """
    parts = segments.where("not whole")
    summaries = materialise(_summaries(parts, machine))
    # states are far smaller than lines: as a written table their size is known, so lines are shuffled to them only if there are very many
    states = materialise(states_before(summaries, machine)).select(F.col("file").alias("f"), F.col("seg").alias("s"), "state")
    known = parts.join(states, (F.col("file") == F.col("f")) & (F.col("seg") == F.col("s"))).select("file", "state", "lines")
    known = known.unionByName(segments.where("whole").select("file", F.lit(pickle.dumps(machine.start)).alias("state"), "lines"))
    names = ["file", *(c.split()[0] for c in machine.schema.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *(_ARROW[c.split()[1]] for c in machine.schema.split(", "))]
        # a segment's columns are turned into arrays as they are; small segments go on together
        held, n = [], 0
        for batch in batches:
            for file, state, value in zip(batch["file"].to_pylist(), batch["state"].to_pylist(), batch["lines"], strict=True):
                columns = _columns(machine, pickle.loads(state), _lines(value))
                if columns[0]:
                    held.append([[file] * len(columns[0]), *columns])
                    n += len(columns[0])
                if n >= ROWS:
                    yield _batch(held, kinds, names)
                    held, n = [], 0
        if held:
            yield _batch(held, kinds, names)

    return known.mapInArrow(run, f"file string, {machine.schema}")


#: Rows from which on a batch is handed on; a segment's rows stay together.
ROWS = 1024


def _columns(machine: Machine, state: Any, lines: Lines) -> list[list | None]:
    """A machine's rows by columns; one with ``columns`` of its own, of which None is a column of nulls, makes no rows."""
    if own := getattr(machine, "columns", None):
        return own(state, lines)
    rows = list(machine.rows(state, lines))
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in machine.schema.split(", ")]


def _batch(held: list[list[list | None]], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    arrays = []
    for k, kind in enumerate(kinds):
        if all(columns[k] is None for columns in held):
            arrays.append(pa.nulls(sum(len(columns[0]) for columns in held), kind))
        else:
            arrays.append(pa.array([v for columns in held for v in (columns[k] if columns[k] is not None else [None] * len(columns[0]))], kind))
    return pa.RecordBatch.from_arrays(arrays, names)


_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
