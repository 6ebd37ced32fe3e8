"""Similar pairs within groups of any size: a join that never compares all pairs of a large group.

Rows are (key, doc, place, payload): those of a key are candidates of each
other. A group of few pairs is compared throughout. All rows of a larger one
are compared with its STARS first rows, which are dealt to every task that
holds a part of it. Then each row gets the keys without one of which nothing
is similar to it (a prefix filter over the elements that fewest stars have), and
the rows of each such key are a group of the next level. Groups that their keys
do not thin out, and what is still crowded after LEVELS levels, are compared in
blocks of bounded size, so nothing is left out at any size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.llm.kernels import key_runs, mix64
from sparkscope.session import materialise

#: Pairs of a group that are compared at once, first rows that a crowded group is compared with, its rows in a task, and levels before the rest is compared in blocks.
GROUP_PAIRS, STARS, DEALT, LEVELS = 64 * 64, 16, 2048, 3
#: By how much the keys of a group's rows have to lessen its pairs; else they are compared in blocks.
THINNED = 4
#: Pairs of all crowded groups up to which blocks cost less than a further level.
BLOCK_PAIRS = 1 << 22
#: Rows of a batch that a task hands on, and rows that are loaded at once.
OUT_ROWS, LOAD_ROWS = 1 << 14, 4096
FOUND = "doc long, start long, end long, source long"


class Found:
    """Similar pairs, gathered and handed on as (doc, start, end, source) rows."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, doc: np.ndarray, start: np.ndarray, end: np.ndarray, source: np.ndarray) -> None:
        if len(doc):
            self.parts.append((doc, start, end, source))

    def take(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.empty(0, np.int64),) * 4
        out = tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        return out

    def rows(self) -> Iterator[pa.RecordBatch]:
        columns = self.take()
        for at in range(0, len(columns[0]), OUT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + OUT_ROWS]) for c in columns], ["doc", "start", "end", "source"])


class Loaded:
    """Rows of groups as arrays; what a kind of comparison has to give."""

    def compare(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, found: Found, settled: np.ndarray | None = None) -> None:
        """Report which pairs of rows are similar; mark parts of ``a``, whose rows occur once then, as settled."""
        raise NotImplementedError

    def parts(self) -> np.ndarray:
        """(rows, parts): which parts a row has that can be settled on their own."""
        raise NotImplementedError

    def prefixes(self, members: np.ndarray, stars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, element): the elements of the members of which something similar must have one."""
        raise NotImplementedError


class Comparison:
    """What is compared: the payload's columns and how rows are loaded.

    One-sided comparisons ask for each document about smaller ones; others
    about all, and a row is settled once it is similar to the first star, as
    are then all of that star's rows to each other by way of it.
    """

    payload: tuple[str, ...] = ()
    one_sided = True

    def load(self, batch: pa.RecordBatch) -> Loaded:
        raise NotImplementedError

    def found(self) -> Found:
        return Found()


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of batches sorted by ``key``, cut only between keys."""
    held: list[pa.RecordBatch] = []  # rows of one key, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or (held and held[-1].column(key)[0].as_py() != keys[0]):
            yield concatenated([*held, batch.slice(0, cut)] if cut else held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield concatenated(held)


def concatenated(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


class Held:
    """Small batches gathered into one."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []
        self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        if batch.num_rows:
            self.parts.append(batch)
            self.rows += batch.num_rows

    def take(self) -> pa.RecordBatch:
        parts, self.parts, self.rows = self.parts, [], 0
        return concatenated(parts)


def _slices(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts between keys after about LOAD_ROWS rows."""
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    at = 0
    while at < len(keys):
        later = heads[heads >= at + LOAD_ROWS]
        to = int(later[0]) if len(later) else len(keys)
        yield at, to
        at = to


def _dealt(rows: DataFrame, key: str, wide: bool) -> DataFrame:
    """Rows by key, sorted; ``wide`` in all shuffle partitions, as few bytes can mean many comparisons."""
    parts = [int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if wide else []
    return rows.repartition(*parts, key).sortWithinPartitions(key)


def _throughout(groups: DataFrame, key: str, kind: Comparison, sided: bool = False, wide: bool = False) -> DataFrame:
    """Similar pairs of groups that are small enough to be compared throughout; of two sides, asking rows with answering ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = kind.found()
        for batch in whole_groups(batches, key):
            for at, to in _slices(batch.column(key).to_numpy()):
                part = batch.slice(at, to - at)
                keys, doc, asks = (part.column(c).to_numpy(zero_copy_only=False) for c in (key, "doc", "asks"))
                loaded = kind.load(part)
                sizes = np.diff(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]))
                start, many = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
                asking = np.flatnonzero(asks)
                answers = part.column("answers").to_numpy(zero_copy_only=False) if sided else None
                for some in np.array_split(asking, max(1, int(many[asking].sum()) >> 18)):
                    n = many[some]
                    a = np.repeat(some, n)
                    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[some], n)
                    chosen = doc[a] > doc[b] if kind.one_sided else (doc[a] > doc[b]) | (~asks[b] & (doc[a] != doc[b]))
                    if answers is not None:
                        chosen = (doc[a] > doc[b] if kind.one_sided else doc[a] != doc[b]) & answers[b]
                    loaded.compare(a[chosen], b[chosen], doc, found)
            yield from found.rows()

    columns = [key, "doc", "place", *kind.payload, "asks", *(["answers"] if sided else [])]
    return _dealt(groups.select(columns), key, wide).mapInArrow(run, FOUND)


_LEVEL = "sub long, key long, doc long, place long, asks boolean, start long, end long, source long"


def _next_level(crowded: DataFrame, kind: Comparison, wide: bool) -> DataFrame:
    """Pairs of crowded groups' rows with their first ones (source is given), whether the other rows still ask, and their keys (sub is given)."""
    first = Window.partitionBy("key").orderBy("doc", "place")
    stars = crowded.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= STARS)
    columns = ["key", "doc", "place", *kind.payload, "asks"]
    salts = F.ceil(F.col("n") / DEALT).cast("int")
    star_rows = stars.select(*columns, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("star"))
    rows = crowded.select(*columns, F.pmod(F.xxhash64("doc", "place"), salts).cast("int").alias("salt"), F.lit(False).alias("star"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, "task"):
            star, doc, place, asks, key = (group.column(c).to_numpy(zero_copy_only=False) for c in ("star", "doc", "place", "asks", "key"))
            center, member = np.flatnonzero(star), np.flatnonzero(~star)
            center = center[np.lexsort((place[center], doc[center]))]
            loaded, found = kind.load(group), kind.found()
            parts = loaded.parts()
            settled = np.zeros_like(parts)
            for n, s in enumerate(center.tolist()):
                later = member[(asks[member] | (asks[s] and not kind.one_sided)) & (doc[member] > doc[s])]
                loaded.compare(later, np.full(len(later), s), doc, found, settled if kind.one_sided or not n else None)
            for s in center.tolist():  # what has been compared with all is done
                member = member[(doc[member] != doc[s]) | (place[member] != place[s])]
            for batch in found.rows():
                none = [pa.nulls(batch.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.bool_())]
                yield _level_rows(none[0], none[1], batch.column("doc"), none[2], none[3], *(batch.column(c) for c in ("start", "end", "source")))
            open_ = asks & (parts & ~settled).any(axis=1)
            none = [pa.nulls(len(member), pa.int64())] * 4
            yield _level_rows(none[0], *(pa.array(x[member]) for x in (key, doc, place, open_)), *none[1:])
            for at in range(0, len(member), 512):
                row, element = loaded.prefixes(member[at : at + 512], center)
                sub = mix64(key[row].astype(np.uint64) * np.uint64(31) + element).view(np.int64)
                for to in range(0, len(row), OUT_ROWS):
                    r = row[to : to + OUT_ROWS]
                    none = [pa.nulls(len(r), pa.int64())] * 3
                    yield _level_rows(*(pa.array(x) for x in (sub[to : to + OUT_ROWS], key[r], doc[r], place[r], open_[r])), *none)

    dealt = rows.unionByName(star_rows).withColumn("task", F.xxhash64("key", "salt"))
    return _dealt(dealt.drop("salt"), "task", wide).mapInArrow(run, _LEVEL)


def _level_rows(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["sub", "key", "doc", "place", "asks", "start", "end", "source"])


def _blocks(crowded: DataFrame, kind: Comparison) -> DataFrame:
    """All pairs of what is still crowded after the last level, in blocks of bounded size."""
    parts = F.ceil(F.col("n") / DEALT).cast("int")
    own = F.pmod(F.xxhash64("doc", "place"), parts).cast("int")
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    sides = [
        crowded.where("asks").select("key", "doc", "place", *kind.payload, own.alias("x"), every.alias("y"), F.lit(True).alias("asks"), F.lit(False).alias("answers")),
        crowded.select("key", "doc", "place", *kind.payload, every.alias("x"), own.alias("y"), F.lit(False).alias("asks"), F.lit(True).alias("answers")),
    ]
    return _throughout(reduce(DataFrame.unionByName, sides).withColumn("task", F.xxhash64("key", "x", "y")), "task", kind, sided=True)


def similar(rows: DataFrame, kind: Comparison) -> DataFrame:
    """(doc, start, end, source) of similar pairs from (key, doc, place, payload)."""
    found = []
    rows = rows.withColumn("asks", F.lit(True))
    for level in range(LEVELS + 1):
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if("asks").alias("m"))
        full = materialise(sizes.where(F.col("n") * F.col("m") > GROUP_PAIRS).select(F.col("key").alias("full"), "n", "m"))
        load = full.agg(F.sum(F.col("n") * F.col("m"))).first()[0]
        if load is None:
            found.append(materialise(_throughout(rows, "key", kind, wide=not level)))
            break
        marked = rows.join(full, F.col("key") == F.col("full"), "left")
        found.append(materialise(_throughout(marked.where("full is null"), "key", kind, wide=not level)))
        crowded = materialise(marked.where("full is not null").drop("full", "m").dropDuplicates(["key", "doc", "place"]))
        if level == LEVELS or load <= BLOCK_PAIRS:
            found.append(materialise(_blocks(crowded, kind)))
            break
        below = materialise(_next_level(crowded, kind, wide=not level))
        found.append(below.where("source is not null").select("doc", "start", "end", "source"))
        subs = below.where("sub is not null").select("sub", F.col("key").alias("k"), "doc", "place", "asks")
        shared = subs.groupBy("sub").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("sn"), F.count_if("asks").alias("sm"), F.first("k").alias("k"))
        shared = materialise(shared.where("low != high and sm > 0").select(F.col("sub").alias("s"), F.col("k").alias("sk"), (F.col("sn") * F.col("sm")).alias("pairs")))
        # groups that their keys do not thin out are compared in blocks at once
        dense = shared.groupBy("sk").agg(F.sum("pairs").alias("pairs")).join(full, F.col("sk") == F.col("full")).where(F.col("pairs") * THINNED >= F.col("n") * F.col("m")).select(F.col("sk").alias("dense"))
        dense = materialise(dense)
        if not dense.isEmpty():
            # without the stars, which are done, and with what they have settled
            states = below.where("sub is null and source is null").select(F.col("key").alias("k"), F.col("doc").alias("d"), F.col("place").alias("p"), F.col("asks").alias("open"))
            open_ = states.join(dense, F.col("k") == F.col("dense"), "left_semi")
            left_ = crowded.join(open_, (F.col("key") == F.col("k")) & (F.col("doc") == F.col("d")) & (F.col("place") == F.col("p")))
            found.append(materialise(_blocks(left_.withColumn("asks", F.col("open")), kind)))
        left = subs.join(shared.join(dense, F.col("sk") == F.col("dense"), "left_anti").select("s"), F.col("sub") == F.col("s"), "left_semi")
        payload = crowded.select("key", F.col("doc").alias("d"), F.col("place").alias("p"), *kind.payload)
        joined = left.join(payload, (F.col("k") == F.col("key")) & (F.col("doc") == F.col("d")) & (F.col("place") == F.col("p")))
        rows = materialise(joined.select(F.col("sub").alias("key"), "doc", "place", *kind.payload, "asks"))
    return reduce(DataFrame.unionByName, found)
