"""Benchmark decontamination by greedy string tiling.

Runs of ``min_match`` words that a document shares with a benchmark item seed
matches; matches are grown word by word after a Karp-Rabin hash agrees, the
longest unmarked one is marked first, again and again, and what the tiles cover
of an item decides, so passages whose parts are in another order count too.
The benchmark goes to the tasks in blocks of bounded size; documents are never
shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscope.llm.kernels import binary_rows, word_hashes
from sparkscope.session import workers_see_package

MIN_MATCH, MIN_COVER = 5, 0.8
#: Words of benchmark text that are sent to the tasks at once, and seeds of a document that are compared at once.
BLOCK_WORDS, SEEDS = 1 << 21, 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def rolling_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, width):
        out = out * _BASE + words[i : i + n]
    return out


def tile(pattern: np.ndarray, diagonals: Iterable[tuple[int, int, int]], min_match: int) -> tuple[int, int]:
    """(covered words of the pattern, tiles) for maximal matches (pattern start, text start, length).

    The longest match whose words are all free becomes a tile; a longer one
    that is partly taken comes back as its free parts of at least ``min_match``.
    Of equally long ones the first in pattern, then in text, is taken.
    """
    taken = np.zeros(len(pattern), np.bool_)
    used: set[int] = set()
    heap = [(-n, p, t) for p, t, n in diagonals]
    heapq.heapify(heap)
    tiles = 0
    while heap:
        n, p, t = heapq.heappop(heap)
        free = [not taken[p + i] and t + i not in used for i in range(-n)]
        if all(free):
            taken[p : p - n] = True
            used.update(range(t, t - n))
            tiles += 1
            if taken.all():
                break
            continue
        at = 0
        while at < -n:
            end = at
            while end < -n and free[end]:
                end += 1
            if end - at >= min_match:
                heapq.heappush(heap, (at - end, p + at, t + at))
            at = end + 1
    return int(taken.sum()), tiles


class Benchmark:
    """A block of benchmark items (id, word hashes), indexed by the hashes of their runs."""

    def __init__(self, items: list[tuple[int, np.ndarray]], min_match: int):
        self.min_match = min_match
        self.items = [(i, w) for i, w in items if len(w)]
        by_width: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for n, (_, words) in enumerate(self.items):
            width = min(min_match, len(words))
            h = rolling_hashes(words, width)
            by_width.setdefault(width, []).append((h, np.full(len(h), n), np.arange(len(h))))
        self.flat = np.concatenate([np.empty(0, np.uint64), *(w for _, w in self.items)])
        sizes = np.array([len(w) for _, w in self.items], np.int64)
        self.offset = np.cumsum(sizes) - sizes
        self.seeds = {}
        for width, parts in by_width.items():
            h, n, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.seeds[width] = (h[order], n[order], at[order])

    def tilings(self, words: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item id, words, covered words, tiles) of the items that share a seed with a document."""
        found: dict[int, list[np.ndarray]] = {}
        for width, seeds in self.seeds.items():
            runs = self._runs(words, width, *seeds)
            if len(runs):
                for part in np.split(runs, np.flatnonzero(np.diff(runs[:, 0])) + 1):
                    found.setdefault(int(part[0, 0]), []).append(part)
        for n in sorted(found):
            item_id, pattern = self.items[n]
            width = min(self.min_match, len(pattern))
            matches = np.concatenate(found[n])
            covered, tiles = tile(pattern, zip(matches[:, 2].tolist(), (matches[:, 1] + matches[:, 2]).tolist(), (matches[:, 3] + width - 1).tolist(), strict=True), width)
            yield item_id, len(pattern), covered, tiles

    def _runs(self, words: np.ndarray, width: int, seeds: np.ndarray, items: np.ndarray, places: np.ndarray) -> np.ndarray:
        """(item, diagonal, place, seeds) of maximal runs of seeds along a diagonal; words are compared, SEEDS of them at once."""
        runs = np.empty((0, 4), np.int64)
        h = rolling_hashes(words, width)
        low = np.searchsorted(seeds, h)
        here = np.flatnonzero(seeds[np.minimum(low, len(seeds) - 1)] == h) if len(h) else low
        if not len(here):
            return runs
        low = low[here]
        many = np.searchsorted(seeds, h[here], side="right") - low
        block = (np.cumsum(many) - 1) // SEEDS
        parts = []
        for at in np.split(np.arange(len(here)), np.flatnonzero(np.diff(block)) + 1):
            text = np.repeat(here[at], many[at])
            seed = np.repeat(low[at] - np.cumsum(many[at]) + many[at], many[at]) + np.arange(len(text))
            item, place = items[seed], places[seed]
            same = np.ones(len(text), np.bool_)
            for i in range(width):
                same &= self.flat[self.offset[item] + place + i] == words[text + i]
            parts.append(_joined(np.stack([item, text - place, place, np.ones_like(place)], axis=1)[same]))
            if sum(map(len, parts)) > 4 * SEEDS:
                parts = [_joined(np.concatenate(parts))]
        return _joined(np.concatenate(parts))


def _joined(runs: np.ndarray) -> np.ndarray:
    """Runs (item, diagonal, place, seeds) that follow each other as one, in order."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    end = runs[:, 2] + runs[:, 3]
    head = np.flatnonzero(np.r_[True, (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1]) | (runs[1:, 2] != end[:-1])])
    out = runs[head]
    out[:, 3] = np.add.reduceat(runs[:, 3], head)
    return out


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_match: int = MIN_MATCH,
    min_cover: float = MIN_COVER,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, n_item_words, covered_words, n_tiles, coverage): pairs of at least ``min_cover``.

    Items shorter than ``min_match`` words need a run of all their words. Null,
    empty and wordless texts on either side match nothing; repeated documents
    and items give a row each; extra columns are ignored. Seeds of a text with
    many repeats are joined to runs as they are found, so memory follows the
    runs, not the pairs of places.
    """
    spark = docs.sparkSession
    workers_see_package(spark)
    schema = "doc_id long, item_id long, n_item_words long, covered_words long, n_tiles long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def search(items: list[tuple[int, bytes]]) -> DataFrame:
        block = spark.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(block, min_match)
            for batch in batches:
                out = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), binary_rows(batch, "text"), strict=True):
                    out += [(doc_id, *t) for t in index.tilings(word_hashes(text)) if t[2] >= min_cover * t[1] - 1e-9]
                columns = zip(*out, strict=True) if out else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_item_words", "covered_words", "n_tiles"]
                )

        return rows.mapInArrow(run, schema)

    parts = [search(items) for items in _blocks(benchmark, block_words)] or [spark.createDataFrame([], schema)]
    return reduce(DataFrame.unionByName, parts).withColumn("coverage", F.col("covered_words") / F.col("n_item_words"))


_last: list = []  # a block's items and their index


def _index(block: Broadcast, min_match: int) -> Benchmark:
    """The index of a block; a worker keeps its last one for its next task."""
    items = block.value
    if not _last or _last[0] is not items or _last[1].min_match != min_match:
        _last[:] = [items, Benchmark([(i, word_hashes(t)) for i, t in items], min_match)]
    return _last[1]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, bytes]]]:
    """The stated query set in blocks of at most ``block_words`` words (one item at least)."""
    held, size = [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = r.text.encode("utf-8", "replace")
        words = len(text) // 2 + 1
        if held and size + words > block_words:
            yield held
            held, size = [], 0
        held.append((r.item_id, text))
        size += words
    if held:
        yield held
