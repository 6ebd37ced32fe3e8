"""Token counts under a unigram vocabulary by dynamic programming over shared prefixes.

The distinct pre-tokens of a bounded buffer of documents are put in order,
which is the depth-first walk of their trie: walking it, forward scores of a
shared prefix are computed once and stay on the path, and a pre-token's
terminal keeps the number of pieces on its best path. Documents then add up
their pre-tokens' terminals. Each task does this for its own rows, so nothing
is shuffled, and memory holds one buffer and a bounded store of terminals.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkscope.llm.kernels import binary_rows
from sparkscope.llm.packing import _byte_letters
from sparkscope.session import workers_see_package

#: Pre-tokens of a buffer, and terminals kept from earlier buffers.
BUFFER_WORDS, STORED_WORDS = 1 << 20, 1 << 19
_SPLIT = regex.compile(public_tokenizers.PATTERN)


def zipf_scores(path: str) -> dict[bytes, float]:
    """Log-probability of each piece of a byte-level vocabulary file: Zipf's law over its ids, which follow frequency."""
    letter = _byte_letters()
    ids = {bytes(letter[c] for c in t): i for t, i in Tokenizer.from_file(path).get_vocab(with_added_tokens=False).items() if all(c in letter for c in t)}
    total = math.log(sum(1 / (i + 1) for i in ids.values()))
    return {t: -math.log(i + 1) - total for t, i in ids.items()}


@lru_cache(maxsize=2)
def _model(path: str) -> tuple[dict[bytes, float], int]:
    scores = zipf_scores(path)
    return scores, max(map(len, scores))


def terminals(words: Iterable[bytes], scores: Mapping[bytes, float], longest: int) -> dict[bytes, tuple[int, float]]:
    """(pieces, log-probability) of the best segmentation of each distinct word.

    Of equally probable segmentations the one with fewer pieces counts. A byte
    without a piece counts as one piece of the least score less ten.
    """
    unknown = min(scores.values(), default=0.0) - 10
    get = scores.get
    score, count = [0.0], [0]  # of the prefixes on the path from the root
    done: dict[bytes, tuple[int, float]] = {}
    before = b""
    for word in sorted(words):
        shared = 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            shared += 1
        del score[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            best, pieces = score[end - 1] + get(word[end - 1 : end], unknown), count[end - 1] + 1
            for start in range(max(0, end - longest), end - 1):
                piece = get(word[start:end])
                if piece is not None:
                    s, n = score[start] + piece, count[start] + 1
                    if s > best or (s == best and n < pieces):
                        best, pieces = s, n
            score.append(best)
            count.append(pieces)
        done[word] = (count[-1], score[-1])
        before = word
    return done


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, log_prob): one row per document, no shuffle.

    Pre-tokens are split by the byte-level pattern; null and empty texts have
    none and count 0; repeated rows count alike; extra columns are ignored.
    """
    workers_see_package(docs.sparkSession)
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, longest = _model(path)
        stored: dict[str, tuple[int, float]] = {}
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            fresh = {w.encode("utf-8", "replace"): w for w in set().union(*(ws for _, ws in held)).difference(stored)}
            for word, value in terminals(fresh, scores, longest).items():
                stored[fresh[word]] = value
            rows = []
            for doc_id, ws in held:
                found = [stored[w] for w in ws]
                rows.append((doc_id, len(ws), sum(n for n, _ in found), math.fsum(s for _, s in found)))
            held.clear()
            size = 0
            if len(stored) > STORED_WORDS:
                stored.clear()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_tokens", "log_prob"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), binary_rows(batch, "text"), strict=True):
                words = _SPLIT.findall((text or b"").decode("utf-8", "replace"))
                held.append((doc_id, words))
                size += len(words) + 1
                if size >= BUFFER_WORDS:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, log_prob double")
