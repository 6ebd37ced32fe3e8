"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A task tokenises its documents and packs them shard by shard (a bounded number
of tokens), so nothing is shuffled and a lost task is simply run again. In a
shard, full chunks come first and pieces go, longest first, to the sequence of
least estimated cost that still holds them. A shard's remainder is laid out as
sequences whose lengths are distinct powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkscope.llm.kernels import binary_rows
from sparkscope.session import workers_see_package

CAPACITY = 1024
#: Tokens of a shard at which it is packed.
SHARD_TOKENS = 1 << 20
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 512
#: Longest run without white space that goes to the fast encoder, and characters encoded at once.
LONG_RUN, CHUNK_CHARS = 2000, 1 << 20

_LONG = re.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))
#: A place where every split pattern of byte-level BPE starts a new pre-token: one space between two letters.
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def _byte_letters() -> dict[str, int]:
    """The published letter of each byte in byte-level BPE files: printable bytes stand for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of a byte-level BPE tokenizer file, the same as its own library gives.

    The file's vocabulary is run by a faster encoder of the same kind (merge
    order is id order there, which is checked); texts with added-token strings
    or very long runs go to the file's own library.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = None
        vocab, merges = spec["model"]["vocab"], spec["model"].get("merges", [])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ids = [vocab["".join(p)] for p in pairs]
        split = spec.get("pre_tokenizer") or {}
        if split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and spec.get("normalizer") is None and ids == sorted(ids):
            letter = _byte_letters()
            ranks = {bytes(letter[c] for c in token): i for token, i in vocab.items() if token not in self.added}
            self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def own(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        parts = [self._encode(part) for part in _pieces(text)]
        return np.concatenate(parts) if len(parts) != 1 else parts[0]

    def _encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added) or _LONG.search(text):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


def _pieces(text: str) -> Iterator[str]:
    """Cuts of a very long text at places where no token can span, so that encoding needs bounded memory."""
    at = 0
    while len(text) - at > CHUNK_CHARS:
        cut = _SAFE.search(text, at + CHUNK_CHARS)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of the given lengths.

    Sequences: as many of ``capacity`` as the total fills, and one of each
    power of two in the rest; all end up full. Pieces go in descending order to
    the cheapest sequence with room; where none has room for all of a piece,
    it is cut and fills the cheapest ones.
    """
    total = sum(lengths)
    rest = total % capacity
    room = np.array([capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if rest >> b & 1], np.int64)
    size = room.copy()
    load = np.zeros(len(room))
    out = []

    def put(doc: int, start: int, n: int, at: int) -> None:
        out.append((doc, start, n, at, int(size[at] - room[at])))
        room[at] -= n
        load[at] += cost(n) if room[at] else np.inf

    chunks, tails = [], []
    for doc, n in enumerate(lengths):
        chunks += [(doc, s, capacity) for s in range(0, n - capacity + 1, capacity)]
        if n % capacity:
            tails.append((doc, n - n % capacity, n % capacity))
    for at, (doc, start, n) in enumerate(chunks):  # each has an empty sequence, all of them equally cheap
        put(doc, start, n, at)
    for doc, start, n in sorted(tails, key=lambda t: (-t[2], t[0])):
        while n:
            fits = np.flatnonzero(room >= n)
            if len(fits):
                at, take = int(fits[np.argmin(load[fits])]), n
            else:
                at = int(np.argmin(load))
                take = int(room[at])
            put(doc, start, take, at)
            start, n = start + take, n - take
    return out


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64()),
])


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    shard_tokens: int = SHARD_TOKENS,
    end_id: int = 0,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length.

    A document is its token ids and then ``end_id``, so null and empty texts
    are one token. Each token lies in exactly one piece, and each sequence is
    either ``capacity`` long or a power of two, so none is padded. Repeated
    rows are packed as often as they occur; extra columns are ignored.
    """
    workers_see_package(docs.sparkSession)
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        first = TaskContext.get().partitionId() << 40
        held: list[tuple[int, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, tokens
            rows = pack([len(ids) for _, ids in held], capacity)
            doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            crc = np.array([zlib.crc32(held[d][1][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in rows], np.int64)
            ends = np.bincount(sequence, weights=length).astype(np.int64)
            ids = pa.array([held[d][0] for d, *_ in rows], pa.int64())
            total = np.array([len(held[d][1]) for d, *_ in rows], np.int64)
            out = [ids, *(pa.array(c) for c in (start, length, crc, total, sequence + first, offset, ends[sequence]))]
            first += len(ends)
            held.clear()
            tokens = 0
            return pa.RecordBatch.from_arrays(out, schema=_SCHEMA)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), binary_rows(batch, "text"), strict=True):
                ids = np.append(encode((text or b"").decode("utf-8", "replace")), np.uint32(end_id)).astype(np.uint32)
                held.append((doc_id, ids))
                tokens += len(ids)
                if tokens >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
    )
