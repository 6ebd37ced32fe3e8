"""Hard negatives by two-dimensional block matrix multiplication over integer vectors.

1. Rows are sharded twice: into blocks of about ``BLOCK`` rows of one group of
   labels, and each block into chunks of ``CHUNK`` dimensions. A block's anchor
   rows make a shard of their own.
2. A tile is the scores of an anchor block against a row block. ``ACROSS`` row
   blocks and ``DOWN`` anchor blocks at most are a cell of the grid: their
   shards are shuffled to it, every pair of shards with the same chunk gives a
   partial tile, and the partial tiles of a place are added there as int64. So
   shards are shuffled, each once for every cell of its row or column, and
   partial tiles, which are much larger, are not.
3. Each tile is reduced where it is added: to the best rows of the same label
   (the positives) in a first pass over the tiles of one label group only, and
   then, over all tiles, to the best rows of other labels in the score window
   of each anchor and positive. What the tiles leave is ranked once more.

A wave of cells is multiplied at a time, so that the shards on the disks stay
within ``WAVE_BYTES`` however large the table is. No tile, label or vector
reaches the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.operators.ordered import top_k
from sparkscope.session import materialise, workers_see_package

#: Entries are scaled by this before they are cut to integers.
SCALE = 256
#: Rows of a row block, anchors of an anchor block, dimensions of a chunk, chunks of a vector at most, groups of labels, and bytes of shards that a wave may shuffle.
BLOCK, ANCHORS, CHUNK, CHUNKS, GROUPS, WAVE_BYTES = 1024, 128, 32, 16, 64, 8 << 30
#: Row blocks and anchor blocks of a cell at most, and bytes of its shards of either kind.
ACROSS, DOWN, CELL_BYTES = 4, 32, 16 << 20
#: Positives of an anchor, negatives of a window, and the window's bounds in hundredths of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95

_SHARD = "block long, chunk int, ids binary, labels binary, x binary"
_WINDOW = ("anchor_id", "anchor_label", "positive_id", "positive_score")


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(vec_id long, label long, x array<long>): distinct rows that take part, without nulls or non-finite entries."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(v, lambda c: F.floor(F.lit(SCALE) * c.cast("double")))
    rows = vectors.where(v.isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("x"))
    # a repeated row counts once; partial aggregates keep a hot one from moving
    return rows.where("vec_id is not null and label is not null").groupBy("vec_id", "label").agg(F.min("x").alias("x"))


class Grid:
    """Numbers of blocks: a group of labels has consecutive ones, and its rows are dealt to them by a hash of their id."""

    def __init__(self, counts: dict[int, int], size: int):
        self.blocks = [math.ceil(counts.get(g, 0) / size) for g in range(GROUPS)]
        self.starts = list(itertools.accumulate(self.blocks, initial=0))[:-1]
        self.total = sum(self.blocks)

    @staticmethod
    def group(label: Column) -> Column:
        return F.pmod(F.xxhash64(label), F.lit(GROUPS)).cast("int")

    def block(self, id_: Column, label: Column) -> Column:
        of = lambda values: F.element_at(F.array(*map(F.lit, values)), self.group(label) + 1).cast("long")
        return of(self.starts) + F.pmod(F.xxhash64(id_, F.lit(7)), of(self.blocks))

    def ranges(self, other: Grid) -> tuple[Column, Column]:
        """The first and last block of ``other`` with the labels of this grid's block ``ablock``."""
        groups = [g for g in range(GROUPS) if self.blocks[g]] or [0]
        place = F.size(F.filter(F.array(*(F.lit(self.starts[g]) for g in groups)), lambda s: s <= F.col("ablock")))
        of = lambda values: F.element_at(F.array(*map(F.lit, values)), place).cast("long")
        return of(other.starts[g] for g in groups), of(other.starts[g] + other.blocks[g] - 1 for g in groups)


def _longs(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int64)


def _shards(rows: DataFrame, block: Column, width: int, chunk: int, kind: np.dtype) -> DataFrame:
    """One row for each block and chunk; all chunks of a block have their rows in the same order, shorter vectors padded by zeros. Ids and labels are with chunk 0 alone."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, labels = (group[c].to_numpy() for c in ("vec_id", "label"))
        order = np.lexsort((labels, ids))
        x = np.zeros((len(ids), width), kind)
        for i, v in enumerate(group["x"]):
            x[i, : len(v)] = v.values.to_numpy()
        x = x[order]
        starts = range(0, width, chunk)
        same = [pa.array([v.tobytes()] + [None] * (len(starts) - 1), pa.binary()) for v in (ids[order], labels[order])]
        cut = pa.array([np.ascontiguousarray(x[:, s : s + chunk]).tobytes() for s in starts], pa.binary())
        place = pa.array([group["block"][0].as_py()] * len(starts), pa.int64())
        return pa.table([place, pa.array(range(len(starts)), pa.int32()), *same, cut], ["block", "chunk", "ids", "labels", "x"])

    return rows.select(block.alias("block"), "vec_id", "label", "x").groupBy("block").applyInArrow(pack, _SHARD)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as int64, exactly. Raises where a hundred times a whole score may not fit; below that floating point is exact and faster."""
    largest = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if 100 * CHUNKS * largest(a) * largest(b) * a.shape[1] >= 1 << 63:
        raise OverflowError("scores of these vectors do not fit into 64 bits")
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)


class Tile:
    """The sum of the partial tiles of a place of the grid, with the rows it is about."""

    def __init__(self, anchors: Block, rows: Block, windows: np.ndarray):
        self.anchors, self.anchor_labels, self.ids, self.labels, self.windows = anchors.ids, anchors.labels, rows.ids, rows.labels, windows
        self.scores = np.zeros((len(self.anchors), len(self.ids)), np.int64)
        for chunk, a in anchors.x.items():
            self.scores += product(a, rows.x[chunk])

    def best(self, row: int, may: np.ndarray, k: int) -> np.ndarray:
        """Of the columns that ``may`` marks the k with the highest scores in a row, smaller ids first among equal ones."""
        at = np.flatnonzero(may & (self.ids != self.anchors[row]))
        scores = self.scores[row, at]
        if len(at) > 8 * k:
            few = scores >= np.partition(scores, len(at) - k)[len(at) - k]
            at, scores = at[few], scores[few]
        return at[np.lexsort((self.ids[at], -scores))[:k]]


Reduced = Callable[[Tile], Iterator[np.ndarray]]


def _positives(k: int) -> Reduced:
    def reduced(tile: Tile) -> Iterator[np.ndarray]:
        for row, (anchor, label) in enumerate(zip(tile.anchors, tile.anchor_labels, strict=True)):
            top = tile.best(row, tile.labels == label, k)
            yield np.column_stack([np.tile([anchor, label], (len(top), 1)), tile.ids[top], tile.scores[row, top]])

    return reduced


def _negatives(k: int, low: int, high: int) -> Reduced:
    def reduced(tile: Tile) -> Iterator[np.ndarray]:
        place = {key: row for row, key in enumerate(zip(tile.anchors.tolist(), tile.anchor_labels.tolist(), strict=True))}
        for window in tile.windows.tolist():
            anchor, label, _, positive = window
            scores = 100 * tile.scores[row := place[anchor, label]]
            top = tile.best(row, (low * positive <= scores) & (scores <= high * positive) & (tile.labels != label), k)
            yield np.column_stack([np.tile(window, (len(top), 1)), tile.ids[top], tile.scores[row, top]])

    return reduced


class Block:
    """The shards of a block, by chunk, with its ids and labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, {}


def _blocks(group: pa.Table, kind: np.dtype) -> dict[int, Block]:
    """The blocks of a cell by number."""
    group = group.combine_chunks()
    place, chunk = (group[c].to_pylist() for c in ("block", "chunk"))
    out = {b: Block(_longs(group["ids"][i]), _longs(group["labels"][i])) for i, (b, c) in enumerate(zip(place, chunk, strict=True)) if c == 0}
    for i, (b, c) in enumerate(zip(place, chunk, strict=True)):
        out[b].x[c] = np.frombuffer(group["x"][i].as_buffer(), kind).reshape(len(out[b].ids), -1)
    return out


def _joined(blocks: list[Block]) -> Block | None:
    """The blocks of a cell as one, so that its tiles are reduced together."""
    if not blocks:
        return None
    out = Block(np.concatenate([b.ids for b in blocks]), np.concatenate([b.labels for b in blocks]))
    out.x = {c: np.concatenate([b.x[c] for b in blocks]) for c in blocks[0].x}
    return out


def _reduce(anchors: DataFrame, rows: DataFrame, reduced: Reduced, names: tuple[str, ...], kind: np.dtype) -> DataFrame:
    """Multiply the shards (cell_a, cell, block, chunk, ...) of each cell and reduce its tiles to rows of longs; an anchor block meets row blocks ``first`` to ``last``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.empty((0, len(names)), np.int64)]
        if left.num_rows and right.num_rows:
            of = _blocks(right, kind)
            ranges = zip(*(left[c].to_pylist() for c in ("block", "chunk", "first", "last", "windows")), strict=True)
            heads = {b: ((first, last), w) for b, c, first, last, w in ranges if c == 0}
            met = {span: _joined([of[b] for b in sorted(of) if span[0] <= b <= span[1]]) for span in {h[0] for h in heads.values()}}
            for a, block in _blocks(left, kind).items():
                span, w = heads[a]
                windows = np.frombuffer(w, np.int64).reshape(-1, len(_WINDOW)) if w is not None else np.empty((0, len(_WINDOW)), np.int64)
                if met[span] is not None:
                    found += reduced(Tile(block, met[span], windows))
        out = np.concatenate(found).astype(np.int64)
        return pa.table([pa.array(out[:, i]) for i in range(len(names))], list(names))

    key = ["cell_a", "cell"]
    return anchors.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(run, ", ".join(f"{n} long" for n in names))


def _packed_windows(positives: DataFrame, block: Column) -> DataFrame:
    """(wblock, windows): the anchors, positives and scores of an anchor block, a few rows for each of its anchors."""

    def pack(group: pa.Table) -> pa.Table:
        rows = np.column_stack([group[c].to_numpy() for c in _WINDOW])
        return pa.table([group["wblock"].slice(0, 1), pa.array([rows.tobytes()], pa.binary())], ["wblock", "windows"])

    return positives.select(block.alias("wblock"), *_WINDOW).groupBy("wblock").applyInArrow(pack, "wblock long, windows binary")


def mine_hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, anchor: Column | None = None,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, wave_bytes: int = WAVE_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank int, negative_id, positive_score, negative_score, anchor_label): hard negatives of each anchor and positive.

    ``label`` is a column over ``vectors`` (default: ``label``), ``anchor`` one
    over ``vec_id`` that says which rows are anchors (default: all). A score is
    the inner product of floor(256 * entry). An anchor's positives are its
    first rows of the same label, higher scores and then smaller ids first;
    negatives are the first rows of other labels whose score is at least
    ``low`` and at most ``high`` hundredths of the positive's.

    Rows with a null id, label or vector, or a null or non-finite entry, take
    no part. Vectors of other lengths are compared as if padded by zeros, an
    empty one scores 0. A row that repeats id and label counts once (the least
    vector); rows with one id and different labels count each, but are never
    each other's partners. An anchor without positives, or a window without
    rows, gives no rows, an empty table none at all. Entries so large
    that scores may leave 64 bits raise. Further columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    workers_see_package(spark)
    rows = materialise(integer_vectors(vectors, id_col, vector_col, F.col("label") if label is None else label))
    is_anchor = F.lit(True) if anchor is None else F.coalesce(anchor, F.lit(False))
    told = rows.groupBy(Grid.group(F.col("label")).alias("g")).agg(
        F.count("*").alias("n"), F.count_if(is_anchor).alias("a"), F.max(F.size("x")).alias("w"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high")
    ).collect()  # GROUPS rows at most
    grid, anchor_grid = Grid({r.g: r.n for r in told}, BLOCK), Grid({r.g: r.a for r in told}, ANCHORS)
    width = max([1, *(r.w for r in told)])
    chunk = max(CHUNK, math.ceil(width / CHUNKS))
    extremes = [v for r in told for v in (r.low, r.high) if v is not None]
    kind = next(k for k in map(np.dtype, (np.int16, np.int32, np.int64)) if all(np.iinfo(k).min <= v <= np.iinfo(k).max for v in extremes))
    shards = materialise(_shards(rows, grid.block(F.col("vec_id"), F.col("label")), width, chunk, kind))
    anchors = materialise(_shards(rows.where(is_anchor), anchor_grid.block(F.col("vec_id"), F.col("label")), width, chunk, kind))
    home = anchor_grid.ranges(grid)

    # blocks of a cell, and cells of a wave: in each, shards are repeated as often as the other side has cells
    fits = lambda size, most: max(1, min(most, CELL_BYTES // (size * width * kind.itemsize)))
    across, down = fits(BLOCK, ACROSS), fits(ANCHORS, DOWN)
    cells, anchor_cells = -(-grid.total // across), -(-anchor_grid.total // down)
    row_bytes, anchor_bytes = (n * (width * kind.itemsize + 16) for n in (sum(r.n for r in told), sum(r.a for r in told)))
    room = max(1, wave_bytes // max(1, row_bytes // max(1, cells) + anchor_bytes // max(1, anchor_cells)))
    each = max(1, min(cells, room))
    wave = max(1, min(anchor_cells, room // each))

    def swept(left: DataFrame, first: Column, last: Column, reduced: Reduced, names: tuple[str, ...], keys: int, k: int) -> DataFrame:
        """The k best rows of each key (the first ``keys`` columns) over all tiles, a wave of cells at a time; the last two columns are id and score."""
        waves = list(itertools.product(range(0, anchor_cells, wave), range(0, cells, each))) or [(0, 0)]
        found = []
        cell = lambda c, n: F.floor(F.col(c) / n)
        placed = left.withColumn("ablock", F.col("block")).withColumns({"first": first, "last": last, "cell_a": cell("block", down)}).drop("ablock").where("first <= last")
        reach = F.explode(F.sequence(cell("first", across), cell("last", across))).alias("cell")
        asked = materialise(placed.select("cell_a", reach).distinct())
        for a, b in waves:
            mine = lambda df: df.where(F.col("cell_a").between(a, a + wave - 1) & F.col("cell").between(b, b + each - 1))  # noqa: B023, E731
            part = mine(placed.select("*", reach))
            met = shards.withColumn("cell", cell("block", across)).join(mine(asked), "cell")
            best = _reduce(part, met, reduced, names, kind)
            found.append(best if len(waves) == 1 else materialise(top_k(best, names[:keys], order(names), k)))
        return reduce(DataFrame.unionByName, found)

    def order(names: tuple[str, ...]) -> list[Column]:
        return [F.desc(names[-1]), F.col(names[-2])]

    everywhere = F.lit(0).cast("long"), F.lit(grid.total - 1).cast("long")
    no_windows = anchors.withColumn("windows", F.lit(None).cast("binary"))
    close = materialise(top_k(swept(no_windows, *home, _positives(positives), _WINDOW, 2, positives), _WINDOW[:2], order(_WINDOW), positives))
    windows = _packed_windows(close, anchor_grid.block(F.col("anchor_id"), F.col("anchor_label")))
    asked = anchors.join(windows, F.col("block") == F.col("wblock")).drop("wblock")
    names = (*_WINDOW, "negative_id", "negative_score")
    hard = swept(asked, *everywhere, _negatives(negatives, low, high), names, 3, negatives)
    rank = F.row_number().over(Window.partitionBy(*names[:3]).orderBy(*order(names)))
    return hard.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "anchor_label")
