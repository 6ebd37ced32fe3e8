"""Numpy kernels on UTF-8 bytes that several corpus operators share.

A *word* here is a maximal run of characters other than ASCII
non-alphanumerics, after lower-casing A-Z only; every byte of a non-ASCII
character belongs to a word, so working on bytes is the same as working on
code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Byte -> byte: A-Z to a-z, ASCII non-alphanumerics to a space, the rest as it is.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_BASE = 0xD6E8FEB86659FD93
_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out


class _Powers:
    up = _powers(_BASE, _BLOCK)
    down = _powers(pow(_BASE, -1, 1 << 64), _BLOCK)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        return cls.up[:n], cls.down[:n]


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of a text's words, in order; empty for null or wordless text."""
    return located_words(text)[0]


def located_words(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, start byte, end byte) of the words of a UTF-8 text."""
    none = np.empty(0, np.int64)
    if not text:
        return none.astype(np.uint64), none, none
    buf = np.frombuffer(text.translate(FOLD), np.uint8)
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.not_equal(buf, 32, out=inside[1:-1].view(np.bool_))
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return none.astype(np.uint64), none, none
    up, down = _Powers.of(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[buf] * up[:-1], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts]), starts, ends


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; of the whole sequence if it is shorter, none if it is empty."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    out = words[: n - width + 1].copy()
    for i in range(1, width):
        out = out * np.uint64(_BASE) + words[i : n - width + 1 + i]
    return mix64(out + np.uint64(width))


class Rolled:
    """Hashes (as int64) of any runs of a sequence of 32-bit words, from one pass of prefix sums."""

    def __init__(self, words: np.ndarray):
        up, self.down = _Powers.of(len(words) + 1)
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix64(words.astype(np.uint64) + np.uint64(_ODD)) * up[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64)).view(np.int64)


def binary_rows(batch: pa.RecordBatch, column: str) -> Iterator[bytes | None]:
    """A string column's values as UTF-8 bytes, without building Python strings."""
    values = batch.column(column)
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    for value in values.cast(kind):
        yield value.as_py()


def fingerprint64(values: np.ndarray) -> np.ndarray:
    """uint64 view as int64, for Spark's long."""
    return values.view(np.int64)


def key_runs(batches, key: str) -> Iterator[pa.RecordBatch]:
    """The rows of each key, in turn, from batches sorted by an integer key; only one key's rows are held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        cuts = np.flatnonzero(np.diff(values)) + 1
        edges = [0, *cuts.tolist(), len(values)]
        if held and held[-1].column(key)[0].as_py() != values[0]:
            yield _joined(held)
            held = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(a, b - a)
            if b < len(values):
                yield _joined([*held, part])
                held = []
            else:
                held.append(part)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
