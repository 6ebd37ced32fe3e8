"""Texts and rows rendered from a given table: one copy of a template for each of its rows, with that row's numbers in it.

The program side reads compiler IR, build logs, C source, patches, advisories
and candidate texts, which the given tables do not have. A template names
numbers of a table's row as ``<<k>>``; ``Base`` fills it in Spark, and in SQL
for the rows that must come out, so both sides depend on the table's values and
grow with it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]


class Sql(str):
    """An expression over the table's columns, the same in Spark and in SQL."""


class When(str):
    """A condition over the table's columns; as the last value of a row it says for which of the table's rows there is one."""


@dataclass(frozen=True)
class Base:
    """A given table and the numbers of its rows that templates may name."""

    name: str
    numbers: dict[str, str]
    #: Rows of the table that one task renders. The table is narrow, so one file of a few megabytes becomes gigabytes of texts.
    task_rows: int = 5000

    def table(self, spark: SparkSession, sf: str) -> DataFrame:
        """The given table in as many parts as its number of rows asks for, whatever its files are; dealt by key, as dealing in turn would sort each file in memory first."""
        return spread(table(spark, sf, self.name), self.task_rows, self.numbers["k"])

    def _used(self, text: str) -> list[tuple[str, str]]:
        return [(f"<<{n}>>", e) for n, e in self.numbers.items() if f"<<{n}>>" in text]

    def filled(self, value: object) -> Column:
        """A value of a row as a column: templates are filled, lists hold filled values."""
        if isinstance(value, Sql):
            return F.expr(value)
        if isinstance(value, (list, tuple)):
            return F.array(*map(self.filled, value))
        out = F.lit(value)
        for mark, expression in self._used(value) if isinstance(value, str) else ():
            out = F.replace(out, F.lit(mark), F.expr(expression).cast("string"))
        return out

    def sql(self, value: object) -> str:
        if isinstance(value, Sql):
            return f"({value})"
        if not isinstance(value, str):
            return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
        out = "'" + value.replace("'", "''") + "'"
        for mark, expression in self._used(value):
            out = f"replace({out}, '{mark}', CAST({expression} AS VARCHAR))"
        return out

    def rows(self, spark: SparkSession, sf: str, schema: str, *values: Sequence[object]) -> DataFrame:
        """Rows of a schema, all of ``values`` for each row of the table; a value list may end with a condition."""
        fields = [f.strip().split(" ", 1) for f in _split(schema)]
        given = []
        for row in values:
            row, when = (row[:-1], F.expr(row[-1])) if isinstance(row[-1], When) else (row, F.lit(True))
            cells = F.struct(*(self.filled(v).cast(t).alias(n) for v, (n, t) in zip(row, fields, strict=True)))
            given.append(F.when(when, cells))
        return self.table(spark, sf).select(F.explode(F.array_compact(F.array(*given))).alias("r")).select("r.*")

    def oracle(self, columns: Sequence[str], *values: Sequence[object]) -> str:
        """SQL for the same kind of rows; whole numbers and ``Sql`` expressions are 64-bit ones."""
        parts = []
        for row in values:
            row, when = (row[:-1], f" WHERE {row[-1]}") if isinstance(row[-1], When) else (row, "")
            kinds = ["BIGINT" if type(v) is int or isinstance(v, Sql) else "BOOLEAN" if isinstance(v, bool) else "VARCHAR" for v in row]
            parts.append("SELECT " + ", ".join(f'CAST({self.sql(v)} AS {k}) AS "{c}"' for v, k, c in zip(row, kinds, columns, strict=True)) + f" FROM {self.name}{when}")
        return "\nUNION ALL ".join(parts)


def _split(schema: str) -> list[str]:
    out, depth = [""], 0
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


PART = Base("part", {"k": "p_partkey", "s": "p_size", "a": "p_partkey % 4", "b": "p_size % 4", "c": "(p_size + 1) % 4", "v": "2 + p_size % 2", "id": "100000 + p_partkey"})
SUPPLIER = Base("supplier", {"k": "s_suppkey", "s": "s_nationkey", "a": "s_suppkey % 4", "b": "s_nationkey % 4"}, 1000)
