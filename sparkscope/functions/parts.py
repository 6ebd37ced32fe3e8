"""Parts of texts, which are all runs of n characters, as 64-bit hashes, and names within texts: numpy over Arrow batches, and bit sets of fixed size of such hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of a bit set; tasks are sent an eighth of so many bytes, whatever the number of parts.
BITS = 1 << 25
#: Characters of a text that are hashed at a time.
BLOCK = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def part_hashes(text: str, n: int, bits: np.ndarray | None = None) -> np.ndarray:
    """The distinct hashes of a text's runs of ``n`` characters, those in the bit set if one is given."""
    found = [np.empty(0, np.uint64)]
    for at in range(0, len(text) - n + 1, BLOCK):
        hashes = _runs(text[at : at + BLOCK + n - 1], n)
        found.append(np.unique(hashes if bits is None else hashes[_in(bits, hashes)]))
    return np.unique(np.concatenate(found))


def _runs(text: str, n: int) -> np.ndarray:
    """The hash of the run of ``n`` characters at each place of a text."""
    codes = _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint64(1))
    hashes = np.full(len(codes) - n + 1, n, np.uint64)
    for k in range(n):
        hashes = hashes * _STEP + codes[k : k + len(hashes)]
    return _mix(hashes)


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(BITS - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def batch_hashes(texts: Sequence[str | None], lengths: Sequence[Sequence[int]], bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes): what ``part_hashes`` gives for each text and each of its lengths. Short texts are hashed together, BLOCK characters at a time."""
    at, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]

    def together(rows: list[int], n: int) -> None:
        sizes = np.array([len(texts[r]) for r in rows], np.int64)
        hashes = _runs("".join(texts[r] for r in rows), n)
        owner = np.repeat(np.arange(len(rows)), sizes)[: len(hashes)]
        # a run may not reach beyond its text
        inside = np.cumsum(sizes)[owner] - np.arange(len(hashes)) >= n
        keep = inside if bits is None else inside & _in(bits, hashes)
        owner, hashes = owner[keep], hashes[keep]
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        first = np.ones(len(hashes), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        at.append(np.array(rows, np.int64)[owner[first]])
        found.append(hashes[first])

    for n in sorted({n for of in lengths for n in of}):
        rows, size = [], 0
        for r, (text, of) in enumerate(zip(texts, lengths, strict=True)):
            if not text or n not in of or len(text) < n:
                continue
            if len(text) > BLOCK:
                found.append(part_hashes(text, n, bits))
                at.append(np.full(len(found[-1]), r, np.int64))
                continue
            if rows and size + len(text) > BLOCK:
                together(rows, n)
                rows, size = [], 0
            rows.append(r)
            size += len(text)
        if rows:
            together(rows, n)
    return np.concatenate(at), np.concatenate(found)


def bit_set(hashes: DataFrame, column: str) -> np.ndarray:
    """The bit set of a column of hashes; words of 64 bits are put together before they are collected, BITS / 64 of them at most."""
    place = hashes.select(F.col(column).bitwiseAND(BITS - 1).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def count_parts(texts: DataFrame, column: str, lengths: Sequence[int], bits: np.ndarray) -> DataFrame:
    """(hash, n): in how many rows each part of the bit set occurs; a task adds up its batches' rows before they are shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = np.unique(batch_hashes(batch.column(0).to_pylist(), [lengths] * batch.num_rows, bits)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], ["hash", "n"])

    return texts.select(column).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def row_parts(rows: DataFrame, id_col: str, text_col: str, lengths: Callable[[str], Sequence[int]] | Sequence[int], bits: np.ndarray | None = None) -> DataFrame:
    """(id, hash): the distinct parts of each row's text, of the given lengths (or of those that a function of the text gives), those in the bit set if one is given."""
    of = lengths if callable(lengths) else lambda _: lengths
    kind = rows.schema[id_col].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at, hashes = batch_hashes(texts, [of(t) if t else () for t in texts], bits)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(hashes.view(np.int64))], ["id", "hash"])

    return rows.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind.simpleString()}, hash long")


#: Bytes of texts in which names are looked up at a time, and bytes by whose hash a place is told to be no name's start.
PIECE, START = 1 << 16, 8
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, modulo 2 to the 64."""
    base = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    for b in base:
        b[:1] = 1
    return tuple(np.multiply.accumulate(b) for b in base)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts in UTF-8; a null text is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


class Table:
    """Which hashes may be in a set: a byte for each value of their top bits, 16 for each hash of the set."""

    def __init__(self, hashes: np.ndarray):
        bits = max(10, (16 * len(hashes)).bit_length())
        self.shift, self.told = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.told[hashes >> self.shift] = True

    def may(self, hashes: np.ndarray) -> np.ndarray:
        return self.told[hashes >> self.shift]


class Names:
    """Names that are looked up in texts, in bytes of UTF-8.

    The sum of bytes times powers of an odd base up to each place gives the
    hash of any stretch at once. Places whose first START bytes (or fewer, for
    shorter names) are no name's are dropped; at the others the hash of each
    length that names have is looked up. A place costs as many steps as names
    have lengths, however many of them begin alike. What is found is compared
    byte by byte, so hashes that agree by chance do no harm.
    """

    def __init__(self, names: pa.Array):
        data, offsets = _buffer(names)
        sizes = np.diff(offsets)
        self.names, self.longest = names, int(sizes.max(initial=0))
        power = _powers(self.longest)[0]
        #: (bytes of the start, length, sorted hashes, their names, their bytes), with one name a hash
        self.lengths: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        starts: dict[int, list[np.ndarray]] = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            rows, start = np.flatnonzero(sizes == size), min(size, START)
            own = data[offsets[rows][:, None] + np.arange(size)]
            hashes = np.zeros(len(rows), np.uint64)
            for k in range(size):
                hashes += _BYTES[own[:, k]] * power[k]
                if k == start - 1:
                    starts.setdefault(start, []).append(np.unique(hashes))
            while len(rows):
                _, first = np.unique(hashes, return_index=True)
                self.lengths.append((start, size, hashes[first], rows[first], own[first]))
                rest = np.ones(len(rows), bool)
                rest[first] = False
                rows, own, hashes = rows[rest], own[rest], hashes[rest]
        self.starts = {n: Table(np.concatenate(h)) for n, h in starts.items()}
        self.whole = Table(np.concatenate([np.empty(0, np.uint64), *(x[2] for x in self.lengths)]))

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows, names): the places of texts and of the names that they contain, each pair once, in order."""
        data, offsets = _buffer(texts)
        step, n, pairs, size = max(PIECE, 4 * self.longest), len(self.names), [np.empty(0, np.int64)], 0
        for at in range(int(offsets[0]), int(offsets[-1]), step):
            pairs.append(np.unique(self._piece(data, offsets, at, min(step, int(offsets[-1]) - at), n)))
            size += len(pairs[-1])
            if size > PIECE * 16:
                pairs = [np.unique(np.concatenate(pairs))]
                size = 0
        return np.divmod(np.unique(np.concatenate(pairs)), max(n, 1))

    def _piece(self, data: np.ndarray, offsets: np.ndarray, at: int, step: int, n: int) -> np.ndarray:
        """row * n + name of all places in ``step`` bytes, which names may go beyond."""
        window = data[at : min(at + step + self.longest, int(offsets[-1]))]
        power, inverse = _powers(max(PIECE, 4 * self.longest) + self.longest)
        sums = np.zeros(len(window) + 1, np.uint64)
        np.cumsum(_BYTES[window] * power[: len(window)], out=sums[1:])
        told = [np.empty(0, np.int64)]
        for start, table in self.starts.items():
            last = min(step, len(window) - start + 1)
            if last <= 0:
                continue
            places = np.flatnonzero(table.may((sums[start : start + last] - sums[:last]) * inverse[:last]))
            rows = np.searchsorted(offsets, places + at, "right") - 1
            room = offsets[rows + 1] - at - places
            for _, size, hashes, names, own in (x for x in self.lengths if x[0] == start):
                fits = np.flatnonzero(room >= size)
                here = places[fits]
                hash_ = (sums[here + size] - sums[here]) * inverse[here]
                some = np.flatnonzero(self.whole.may(hash_))
                fits, hash_ = fits[some], hash_[some]
                k = np.minimum(np.searchsorted(hashes, hash_), len(hashes) - 1)
                same = np.flatnonzero(hashes[k] == hash_)
                fits, k = fits[same], k[same]
                for part in range(0, len(k), max(1, PIECE * 16 // size)):
                    f, name = fits[part : part + max(1, PIECE * 16 // size)], k[part : part + max(1, PIECE * 16 // size)]
                    equal = (window[places[f][:, None] + np.arange(size)] == own[name]).all(1)
                    told.append(rows[f[equal]] * n + names[name[equal]])
        return np.concatenate(told)


def row_names(rows: DataFrame, id_col: str, text_col: str, names: Names) -> DataFrame:
    """(id, name): the names that each row's text contains, each once a row."""
    kind = rows.schema[id_col].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = names.found(batch.column(1))
            for i in range(0, len(at), PIECE):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[i : i + PIECE])), names.names.take(pa.array(found[i : i + PIECE]))], ["id", "name"])

    return rows.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind.simpleString()}, name string")
