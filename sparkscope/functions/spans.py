"""Functions of C texts as table functions of the session, so that SQL can ask for them over any text column.

After ``register``,

    SELECT * FROM function_spans(TABLE(SELECT path AS id, text FROM files))
    SELECT * FROM function_facts(TABLE(SELECT path AS id, text, 'inflate' AS fn FROM files))

give the same rows as ``facts.function_blocks`` and ``facts.scan_functions``,
with the row's ``id``. The functions take a table instead of standing in a
lateral join, which Spark 4.1 does not allow for functions over Arrow batches;
rows are read where they are, in any number of tasks. A null text or function
name has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkscope.functions import ctext
from sparkscope.session import workers_see_package

#: Rows that go back to Spark at once.
ROWS = 1000
SPANS = "id string, name string, start long, stop long, body string"
FACTS = "id string, fn string, source string, plain string, params array<struct<name:string,type:string>>, ifs array<string>, whiles array<string>, switches array<struct<variable:string,body:string>>"


def _pairs(a: str, b: str) -> pa.DataType:
    return pa.list_(pa.struct([(a, pa.string()), (b, pa.string())]))


_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())
_SPANS = pa.schema([("id", _TEXT), ("name", _TEXT), ("start", pa.int64()), ("stop", pa.int64()), ("body", _TEXT)])
_FACTS = pa.schema([("id", _TEXT), ("fn", _TEXT), ("source", _TEXT), ("plain", _TEXT), ("params", _pairs("name", "type")), ("ifs", _TEXTS), ("whiles", _TEXTS), ("switches", _pairs("variable", "body"))])


def _tables(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.Table]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.Table.from_pylist(held, schema)
            held = []
    yield pa.Table.from_pylist(held, schema)


@F.arrow_udtf(returnType=SPANS)
class FunctionSpans:
    """The blocks of each (id, text) that look like functions; ``start`` and ``stop`` count code points from 0."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        texts = zip(batch.column("id").cast(_TEXT).to_pylist(), batch.column("text").to_pylist(), strict=True)
        spans = ((i, text, *s) for i, text in texts if text for s in ctext.Source(text).blocks())
        yield from _tables(({"id": i, "name": name, "start": start, "stop": stop, "body": text[start:stop]} for i, text, name, start, stop in spans), _SPANS)


@F.arrow_udtf(returnType=FACTS)
class FunctionFacts:
    """What a scan of each (id, text) for its function ``fn`` finds; ``source`` is empty if the text lacks it."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        asked = zip(batch.column("id").cast(_TEXT).to_pylist(), batch.column("text").to_pylist(), batch.column("fn").to_pylist(), strict=True)
        yield from _tables((self._row(i, text, fn) for i, text, fn in asked if text is not None and fn is not None), _FACTS)

    @staticmethod
    def _row(i: str, text: str, fn: str) -> dict:
        source, plain, params, ifs, whiles, switches = ctext.scan(text, fn)
        return {
            "id": i, "fn": fn, "source": source, "plain": plain, "params": [{"name": n, "type": t} for n, t in params],
            "ifs": ifs, "whiles": whiles, "switches": [{"variable": v, "body": b} for v, b in switches],
        }


def register(spark: SparkSession) -> None:
    """Make ``function_spans`` and ``function_facts`` known to SQL in this session."""
    workers_see_package(spark)
    spark.udtf.register("function_spans", FunctionSpans)
    spark.udtf.register("function_facts", FunctionFacts)
