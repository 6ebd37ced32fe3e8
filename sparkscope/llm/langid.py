"""Language identification: averaged hashed subword embeddings and a linear softmax.

The model is trained by stochastic gradient descent in numpy on a bounded,
documented sample of labelled rows (``train_rows``); everything else sees every
whole text. For prediction the embeddings and the linear layer are multiplied
out to one score per subword bucket and language, so a text costs one
histogram and one product.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscope.llm.kernels import binary_rows
from sparkscope.session import workers_see_package

#: Labelled rows that training sees at most, subword buckets (a power of two), longest subword, embedding size.
TRAIN_ROWS, BUCKETS, LONGEST, DIMENSION = 4000, 1 << 14, 4, 16
EPOCHS, RATE, SEED = 6, 0.5, 7
#: Accepted texts should be right this often on calibration rows; the share of clean rows that may be rejected for it.
PRECISION, MAX_REJECTED = 0.98, 0.002

_BMP = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(1 << 16)])


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def subwords(text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Histogram over hashed runs of 1 to ``longest`` letters, words being bounded by one space; zeros if no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.zeros(len(codes) + 2, np.bool_)
    low = codes < (1 << 16)
    letter[1:-1] = _BMP[np.where(low, codes, 0)]
    for i in np.flatnonzero(~low).tolist():
        letter[i + 1] = chr(int(codes[i])).isalpha()
    padded = np.zeros(len(codes) + 2, np.uint32)
    padded[1:-1] = codes
    padded[~letter] = 32
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    line = padded[keep]
    if not letter.any():
        return np.zeros(buckets, np.int64)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    total = np.zeros(buckets, np.int64)
    for at in range(0, len(line), 1 << 18):
        part = line[at : at + (1 << 18) + longest - 1]
        own = min(1 << 18, len(line) - at)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(n)
            hashed = (h[:own] * np.uint32(0x9E3779B1)) >> shift
            total += np.bincount(hashed, minlength=buckets)
    return total


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    scores: np.ndarray  # buckets x languages
    temperature: float
    shortness: float  # by how many subwords a text's length is discounted
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language or und, calibrated probability, rejected)."""
        counts = subwords(text) if text else None
        if counts is None or not self.langs or not (total := counts.sum()):
            return "und", 0.0, True
        p = _softmax(counts @ self.scores / total / (self.temperature * (1 + self.shortness / total)))
        best = int(np.argmax(p))
        return self.langs[best], float(p[best]), bool(p[best] < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], buckets: int = BUCKETS, epochs: int = EPOCHS, rate: float = RATE, dimension: int = DIMENSION) -> Model:
    """Fit on (language, bucket, count) rows; every fifth is kept for temperature and threshold."""
    langs = tuple(sorted({r[0] for r in rows}))
    if not langs:
        return Model((), np.zeros((buckets, 0)), 1.0, 0.0, 0.0)
    rng = np.random.default_rng(SEED)
    place = {lang: i for i, lang in enumerate(langs)}
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    fit = [r for i, r in enumerate(rows) if i % 5 != 4]
    embed = rng.uniform(-1, 1, (buckets, dimension)) / dimension
    linear = np.zeros((dimension, len(langs)))
    steps, step = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            lang, index, count = fit[i]
            weight = count / count.sum()
            hidden = weight @ embed[index]
            error = _softmax(hidden @ linear)
            error[place[lang]] -= 1
            now = rate * (1 - step / steps)
            back = linear @ error
            linear -= now * np.outer(hidden, error)
            embed[index] -= (now * len(index) ** 0.5) * weight[:, None] * back
            step += 1
    scores = embed @ linear
    return Model(langs, scores, *_calibrate(scores, held or fit, place))


def _calibrate(scores: np.ndarray, rows: list, place: dict[str, int]) -> tuple[float, float, float]:
    """(temperature, shortness, threshold): the first two of least log loss, the least threshold of the wanted precision within the allowed rejections.

    The loss is against smoothed targets, (n + 1) / (n + 2) for the true
    language of n rows, so that probabilities claim no more than n rows show.
    """
    size = np.array([c.sum() for _, _, c in rows])
    logits = np.stack([(c / c.sum()) @ scores[i] for _, i, c in rows])
    truth = np.array([place[lang] for lang, _, _ in rows])
    target = np.full(logits.shape, 1 / (len(truth) + 2) / max(1, len(place) - 1))
    target[np.arange(len(truth)), truth] = (len(truth) + 1) / (len(truth) + 2)

    def probabilities(t: float, c: float) -> np.ndarray:
        return _softmax(logits / (t * (1 + c / size))[:, None])

    grid = [(t, c) for t in np.geomspace(0.02, 5, 40) for c in (0.0, 8.0, 32.0, 128.0, 512.0)]
    temperature, shortness = min(grid, key=lambda g: -(target * np.log(probabilities(*g) + 1e-12)).sum(axis=1).mean())
    p = probabilities(temperature, shortness)
    best, right = p.max(axis=1), p.argmax(axis=1) == truth
    allowed = float(np.quantile(best, MAX_REJECTED))
    for t in np.sort(np.r_[0.0, best]):
        if t > allowed or right[best >= t].mean() >= PRECISION:
            return float(temperature), shortness, min(float(t), allowed)
    return float(temperature), shortness, 0.0


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text modulo 3; remainder 1 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def fit_language_model(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Train on at most ``train_rows`` labelled ids outside the held-out fold, chosen by a hash of the id, one row each.

    The driver sees subword histograms of at most BUCKETS entries a row, never texts.
    """
    workers_see_package(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 1))
    order = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    n = labelled.agg(F.approx_count_distinct("doc_id").alias("n")).first()["n"]  # an id's rows share their place in the hash space
    if not n:
        return train([])
    # a share of the hash space leaves little more than train_rows to sort, however many rows are labelled
    share = labelled.where(F.pmod(order, F.lit(1 << 30)) < int(min(1.0, 1.2 * train_rows / n) * (1 << 30)))
    last = share.select(order.alias("o")).distinct().orderBy("o").limit(train_rows).agg(F.max("o").alias("o")).first()["o"]
    if last is None:
        return train([])
    labelled = share

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, count = [], []
            for text in binary_rows(batch, "text"):
                h = subwords((text or b"").decode("utf-8", "replace"))
                index.append(np.flatnonzero(h).astype(np.int16))
                count.append(np.minimum(h[index[-1]], np.iinfo(np.int32).max).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("lang"), pa.array(index, pa.list_(pa.int16())), pa.array(count, pa.list_(pa.int32()))], ["o", "lang", "i", "c"])

    chosen = labelled.where(order <= last).select(order.alias("o"), "lang", F.col("text").cast("string").alias("text"))
    # however often an id repeats, one of its rows trains; each task's share is cut before it is shuffled
    chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("o").orderBy("lang", F.xxhash64("text")))).where("rank = 1").drop("rank")
    rows = chosen.mapInArrow(run, "o long, lang string, i array<short>, c array<int>").toArrow()
    langs, indexes, counts = rows["lang"].to_pylist(), rows["i"], rows["c"]
    kept = []
    for n in np.argsort(rows["o"].to_numpy(), kind="stable")[:train_rows].tolist():
        if len(indexes[n].values):  # views of the table, not copies
            kept.append((langs[n], indexes[n].values.to_numpy(), counts[n].values.to_numpy()))
    return train(kept)


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; the prediction reads nothing but the whole text.

    Null texts and texts without a letter are ``und`` with score 0 and rejected;
    an untrained model gives that for every text; repeated rows are predicted
    alike. Columns named like the three new ones are replaced.
    """
    workers_see_package(docs.sparkSession)
    new = ["lang_pred", "score", "rejected"]
    base = docs.drop(*new)
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(None if t is None else t.decode("utf-8", "replace")) for t in binary_rows(batch, "text")]
            columns = zip(*found, strict=True) if found else ((), (), ())
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *new])

    return base.mapInArrow(run, schema)
