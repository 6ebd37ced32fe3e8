"""Near-duplicate passages through compact windows.

For each hash function, the minimum of every run of ``width`` shingles is a
node of the Cartesian tree over the shingles' hashes, and the widest run with
that minimum is its compact window: an interval of run starts that share a
signature. Windows of a minimum are grouped. Equal windows (inside a task at
once, so a passage that a third of all rows share is one row a task) are linked
to the smallest document. Different windows of a minimum meet in an interval
join, aligned at the minimum's shingle, and runs of equal width whose starts
lie in both intervals are compared word by word.

Groups of any size are compared by ``crowds``: no document, passage or partner
is left out in a crowded one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.llm import crowds
from sparkscope.llm.crowds import OUT_ROWS, Held, whole_groups
from sparkscope.llm.kernels import Rolled, binary_rows, located_words, mix64, shingle_hashes, word_hashes
from sparkscope.llm.membership import fresh, possible, split
from sparkscope.session import materialise, workers_see_package

SHINGLE, SIMILARITY = 5, 0.8
#: Shortest passage in words, and hash functions (at most 8); words are compared as soon as one of them agrees.
PASSAGE_WORDS, HASHES = 51, 3
#: Windows that a task groups at once before they are shuffled, and the different ones of a minimum there from which it is dealt out.
BUFFER_WINDOWS, LOCAL_CROWD = 1 << 20, 64
_SEEDS = mix64(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def _sliding(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every run of ``width`` values, by doubling."""
    done = 1
    while done * 2 <= width:
        values = least(values[:-done], values[done:])
        done *= 2
    return least(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(center, first, last) of every compact window of at least ``width`` values.

    ``values[center]`` is the minimum of values[first..last], the leftmost one
    where equal, and the window cannot be widened. Every run of ``width``
    values lies in the window of its minimum.
    """
    n = len(values)
    if n < width:
        none = np.empty(0, np.int64)
        return none, none, none
    least = _sliding(values, width, np.minimum)
    pad = np.zeros(width - 1, values.dtype)
    nodes = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == values)
    first, last, path = [0] * len(nodes), [n - 1] * len(nodes), []
    at, height = nodes.tolist(), values[nodes].tolist()
    for i, h in enumerate(height):  # the path from the root to the newest node of the Cartesian tree
        while path and height[path[-1]] > h:
            last[path.pop()] = at[i] - 1
        first[i] = at[path[-1]] + 1 if path else 0
        path.append(i)
    first, last = np.array(first, np.int64), np.array(last, np.int64)
    wide = last - first + 1 >= width
    return nodes[wide], first[wide], last[wide]


#: Shingles of a passage beyond its first; a place has twelve binary digits for either side of a window.
REACH = (1 << 12) - 1


# A window's place: its center, and how many shingles of it lie before and behind within one run's reach.
def _place(center: np.ndarray, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
    return center << 24 | before << 12 | behind


def _parts(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 24, place >> 12 & REACH, place & REACH


def needed(width: int, similarity: float) -> int:
    """Common shingles from which two runs of ``width`` are similar."""
    return int(np.ceil(width * 2 * similarity / (1 + similarity) - 1e-9))


class Runs(crowds.Loaded):
    """Windows aligned at their centers, one row of shingles each, and the comparison of their runs."""

    def __init__(self, places: np.ndarray, words: list[bytes], also: list[bytes | None], shingle: int, width: int, similarity: float):
        self.also = {i: np.frombuffer(x, np.int64) for i, x in enumerate(also) if x}
        self.center = places >> 24
        self.shingle, self.width, self.need = shingle, width, needed(width, similarity)
        # an edit costs the shingles that span it, so the rest of a similar run can be shifted by so much
        self.band = max(0, width - self.need - (shingle - 1))
        _, self.before, self.behind = _parts(places)
        n, span = len(places), 2 * width - 1
        values = np.zeros((n, span + shingle - 1), np.uint64)
        for i, (b, w) in enumerate(zip((width - 1 - self.before).tolist(), words, strict=True)):
            row = np.frombuffer(w, np.uint32)
            values[i, b : b + len(row)] = row
        out = values[:, :span].copy()
        for k in range(1, shingle):
            out = out * np.uint64(0xD6E8FEB86659FD93) + values[:, k : k + span]
        self.shingles = (mix64(out + np.uint64(shingle)) >> np.uint64(32)).astype(np.uint32)
        column = np.arange(span)
        self.valid = (column >= (width - 1 - self.before)[:, None]) & (column <= (width - 1 + self.behind)[:, None])

    def report(self, rows: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, source: np.ndarray, found: Spans) -> None:
        """Spans from the centers of rows, and from the other places of the same window in the document."""
        found.add(doc, self.center[rows] + start, self.center[rows] + end, source)
        for n in [n for n, row in enumerate(rows.tolist()) if row in self.also] if self.also else ():
            centers = self.also[int(rows[n])]
            found.add(*(np.broadcast_to(x, len(centers)) for x in (doc[n], centers + start[n], centers + end[n], source[n])))

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The interval join: pairs of which runs may start at the same place from the center, or within the band."""
        first = np.maximum(-self.before[a], -self.before[b] - self.band)
        last = np.minimum(self.behind[a], self.behind[b] + self.band) - self.width + 1
        return first <= last

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of rows, which runs of ``a`` (by start) are similar to an equally wide run of ``b``.

        A run counts if it and the other have enough shingles with an equal one
        at most the band further in the partner, and if its first and last do.
        """
        width, band = self.width, self.band
        x, y = self.shingles[a], self.shingles[b]
        vx, vy = self.valid[a], self.valid[b]
        hit, back = np.zeros(x.shape, np.bool_), np.zeros(x.shape, np.bool_)
        span = x.shape[1]
        for d in range(-band, band + 1):
            p, q = slice(max(0, -d), span - max(0, d)), slice(max(0, d), span - max(0, -d))
            same = (x[:, p] == y[:, q]) & vx[:, p] & vy[:, q]
            hit[:, p] |= same
            back[:, q] |= same
        starts = span - width + 1
        inside = lambda v: v[:, :starts] & v[:, width - 1 :]
        enough = lambda h: self._sums(h) >= self.need
        own = enough(hit) & inside(vx) & inside(hit)
        other = enough(back) & inside(vy)
        near = other.copy()
        for d in range(1, band + 1):
            near[:, d:] |= other[:, :-d]
            near[:, :-d] |= other[:, d:]
        return own & near

    def compare(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, found: crowds.Found, settled: np.ndarray | None = None) -> None:
        joined = self.overlap(a, b)
        a, b = a[joined], b[joined]
        for at in range(0, len(a), 4096):
            i, j = a[at : at + 4096], b[at : at + 4096]
            good = self.similar(i, j)
            some = good.any(axis=1)
            if not some.any():
                continue
            i, j, good = i[some], j[some], good[some]
            if settled is not None:
                settled[i] |= good
            first = good.argmax(axis=1)
            last = good.shape[1] - 1 - good[:, ::-1].argmax(axis=1)
            self.report(i, first - (self.width - 1), last + self.shingle, doc[i], doc[j], found)

    def parts(self) -> np.ndarray:
        return self.valid[:, : self.width] & self.valid[:, self.width - 1 :]

    def prefixes(self, members: np.ndarray, stars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each run the shingles that fewest stars have, one more than a similar run may lack."""
        values = self.shingles[members].astype(np.uint64)
        known, many = np.unique(np.concatenate([np.zeros(1, np.uint32), *(np.unique(self.shingles[s][self.valid[s]]) for s in stars.tolist())]), return_counts=True)
        place = np.minimum(np.searchsorted(known, values), len(known) - 1)
        weight = np.where(known[place] == values, many[place], 0).astype(np.uint64)
        order = weight << np.uint64(32) | values
        order[~self.valid[members]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        prefix, runs = self.width - self.need + 1, self.parts()[members]
        rows, picked = [], []
        for s in range(self.width):
            whole = np.flatnonzero(runs[:, s])
            if len(whole):
                least = np.partition(order[whole, s : s + self.width], prefix - 1, axis=1)[:, :prefix]
                rows.append(np.repeat(members[whole], prefix))
                picked.append(least.ravel() & np.uint64(0xFFFFFFFF))
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        both = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(picked)]), axis=1)
        return both[0].astype(np.int64), both[1]

    def _sums(self, hit: np.ndarray) -> np.ndarray:
        total = np.zeros((len(hit), hit.shape[1] + 1), np.int16)
        np.cumsum(hit, axis=1, out=total[:, 1:], dtype=np.int16)
        return total[:, self.width :] - total[:, : -self.width]


class Spans(crowds.Found):
    """Spans of documents; overlapping ones of a document are handed on as one, with the smallest source."""

    def take(self) -> tuple[np.ndarray, ...]:
        doc, start, end, source = super().take()
        if not len(doc):
            return doc, start, end, source
        order = np.lexsort((start, doc))
        doc, start, end, source = doc[order], start[order], end[order], source[order]
        group = np.cumsum(np.r_[False, doc[1:] != doc[:-1]])
        # the greatest end so far in the document; documents are kept apart by a stride above all ends
        stride = int(end.max()) + 1
        reach = np.maximum.accumulate(end + group * stride)
        head = np.flatnonzero(np.r_[True, (start[1:] + group[1:] * stride > reach[:-1]) | (group[1:] != group[:-1])])
        return doc[head], start[head], np.maximum.reduceat(end, head), np.minimum.reduceat(source, head)


# What a row of the windows' shuffle is: a window, a finished span (key start, ctx end, place source), a window of a
# minimum that is crowded in its task, or a sign of such a minimum to the windows of other tasks.
_WINDOW, _SPAN, _CROWD, _SIGN = 0, 1, 2, 3
_WINDOWS = "key long, ctx long, doc long, place long, kind byte, also binary"


def _window_rows(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, place: np.ndarray, kind: np.ndarray | int, also: np.ndarray | None = None) -> pa.RecordBatch:
    more = pa.nulls(len(key), pa.binary()) if also is None else pa.array(also.tolist(), pa.binary())
    kinds = np.broadcast_to(np.asarray(kind, np.int8), len(key))
    columns = [pa.array(x.astype(np.int64, copy=False)) for x in (key, ctx, doc, place)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(kinds), more], ["key", "ctx", "doc", "place", "kind", "also"])


def _span_rows(found: crowds.Found) -> Iterator[pa.RecordBatch]:
    doc, start, end, source = found.take()
    for at in range(0, len(doc), OUT_ROWS):
        part = slice(at, at + OUT_ROWS)
        yield _window_rows(start[part], end[part], doc[part], source[part], _SPAN)


def _equal_windows(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, place: np.ndarray, also: np.ndarray, shingle: int, found: Spans) -> tuple[np.ndarray, ...]:
    """Link equal windows to their smallest document and keep the first of that document, with the centers of its others, in order."""
    order = np.lexsort((place, doc, ctx, key))
    key, ctx, doc, place, also = key[order], ctx[order], doc[order], place[order], also[order]
    if not len(key):
        return key, ctx, doc, place, also
    head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])])
    least = np.repeat(doc[head], np.diff(np.r_[head, len(key)]))
    more = doc > least
    center, before, behind = _parts(place)
    found.add(doc[more], (center - before)[more], (center + behind)[more] + shingle, least[more])
    for i in np.flatnonzero(more & (also != None)).tolist():  # noqa: E711 - of an array
        centers = np.frombuffer(also[i], np.int64)
        found.add(np.full(len(centers), doc[i]), centers - before[i], centers + behind[i] + shingle, np.full(len(centers), least[i]))
    own = np.add.reduceat((~more).astype(np.int64), head)
    for h, n in zip(head[own > 1].tolist(), own[own > 1].tolist(), strict=True):
        centers = np.concatenate([center[h + 1 : h + n], *(np.frombuffer(x, np.int64) for x in also[h : h + n] if x)])
        centers = np.unique(centers[centers != center[h]])
        also[h] = centers.tobytes() or None
    return key[head], ctx[head], doc[head], place[head], also[head]


def _different(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, number of rows) of each key of rows in order."""
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return head, np.diff(np.r_[head, len(key)])


def shared_windows(rows: DataFrame, passage_words: int, shingle: int, hashes: int) -> DataFrame:
    """Spans of equal windows, and the windows whose minimum has different ones, of (doc_id, text) rows."""
    width = passage_words - shingle + 1

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = Spans()
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            key, ctx, doc, place, also = _equal_windows(*columns, np.full(len(columns[0]), None, object), shingle, found)
            head, many = _different(key)
            full = many > LOCAL_CROWD
            kind = np.where(np.repeat(full, many), _CROWD, _WINDOW)
            for at in range(0, len(key), OUT_ROWS):
                yield _window_rows(*(x[at : at + OUT_ROWS] for x in (key, ctx, doc, place, kind, also)))
            signs = key[head[full]]
            yield _window_rows(signs, np.zeros_like(signs), np.zeros_like(signs), np.zeros_like(signs), _SIGN)
            yield from _span_rows(found)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), binary_rows(batch, "text"), strict=True):
                words = word_hashes(text)
                if len(words) < passage_words:
                    continue
                base = shingle_hashes(words, shingle)
                rolled = Rolled(words.astype(np.uint32))
                for f in range(hashes):
                    values = base * _SEEDS[f]  # shingle hashes are mixed already, so their products order them anew
                    center, first, last = compact_windows(values, width)
                    before, behind = np.minimum(center - first, width - 1), np.minimum(last - center, width - 1)
                    ctx = rolled.of(center - before, center + behind + shingle) ^ before
                    key = ((values[center] & ~np.uint64(7)) | np.uint64(f)).view(np.int64)
                    held.append((key, ctx, np.full(len(center), doc_id, np.int64), _place(center, before, behind)))
                    size += len(center)
                if size >= BUFFER_WINDOWS:
                    yield from flush()
                    held.clear()
                    size = 0
        if held:
            yield from flush()

    def group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "key"):
            kind = batch.column("kind").to_numpy()
            yield batch.filter(pa.array(kind == _SPAN))
            key, ctx, doc, place = (batch.column(c).to_numpy() for c in ("key", "ctx", "doc", "place"))
            window = (kind == _WINDOW) | (kind == _CROWD)
            crowded = np.unique(key[(kind == _SIGN) | (kind == _CROWD)])
            found = Spans()
            also = np.array([*batch.column("also").to_pylist(), None], object)[:-1]
            key, ctx, doc, place, also = _equal_windows(key[window], ctx[window], doc[window], place[window], also[window], shingle, found)
            head, many = _different(key)
            several = np.repeat((many > 1) | np.isin(key[head], crowded), many)
            yield _window_rows(key[several], ctx[several], doc[several], place[several], _WINDOW, also[several])
            yield from _span_rows(found)

    # windows of a crowded minimum are dealt out by all their words, spans by their document
    deal = F.when(F.col("kind") == _CROWD, F.xxhash64("key", "ctx")).when(F.col("kind") == _SPAN, F.xxhash64("doc", "key")).otherwise(F.col("key"))
    dealt = rows.mapInArrow(windows, _WINDOWS).withColumn("deal", deal).repartition("deal").drop("deal").sortWithinPartitions("key")
    return dealt.mapInArrow(group, _WINDOWS)


def _window_words(rows: DataFrame, windows: DataFrame, shingle: int) -> DataFrame:
    """(key, doc, place, words, also) of windows (key, ctx, doc, place, also); only texts that have one are moved, as hashes of words."""

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [word_hashes(t).astype(np.uint32).tobytes() for t in binary_rows(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary())], ["id", "words"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in batches:
            for doc, blob, listed in zip(batch.column("doc").to_pylist(), batch.column("words"), batch.column("listed"), strict=True):
                own = np.frombuffer(blob.as_py(), np.uint32)
                key, ctx, place = (listed.values.field(i).to_numpy() for i in range(3))
                also = listed.values.field(3)
                center, before, behind = _parts(place)
                start, end = center - before, center + behind + shingle
                # of rows that repeat an id, a window is cut from those that have it
                fits = np.flatnonzero(end <= len(own))
                fits = fits[(Rolled(own).of(start[fits], end[fits]) ^ before[fits]) == ctx[fits]]
                for part in np.array_split(fits, len(fits) // OUT_ROWS + 1):
                    out = [own[a:b].tobytes() for a, b in zip(start[part].tolist(), end[part].tolist(), strict=True)]
                    columns = [pa.array(key[part]), pa.array(np.full(len(part), doc, np.int64)), pa.array(place[part]), pa.array(out, pa.binary()), also.take(pa.array(part))]
                    held.add(pa.RecordBatch.from_arrays(columns, ["key", "doc", "place", "words", "also"]))
                    if held.rows >= OUT_ROWS:
                        yield held.take()
            if held.rows:
                yield held.take()

    listed = windows.groupBy("doc").agg(F.collect_list(F.struct("key", "ctx", "place", "also")).alias("listed"))
    blobs = possible(rows, "doc_id", windows.select("doc")).mapInArrow(words, "id long, words binary")
    joined = listed.join(blobs, F.col("doc") == F.col("id")).select("doc", "words", "listed")
    return joined.mapInArrow(cut, "key long, doc long, place long, words binary, also binary")


class Passages(crowds.Comparison):
    payload = ("words", "also")

    def __init__(self, shingle: int, width: int, similarity: float):
        self.shingle, self.width, self.similarity = shingle, width, similarity

    def load(self, batch: pa.RecordBatch) -> Runs:
        place, words, also = (batch.column(c) for c in ("place", "words", "also"))
        return Runs(place.to_numpy(), words.to_pylist(), also.to_pylist(), self.shingle, self.width, self.similarity)

    def found(self) -> Spans:
        return Spans()


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    passage_words: int = PASSAGE_WORDS,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    hashes: int = HASHES,
) -> DataFrame:
    """(doc_id, start_word, end_word, source_id): passages that a document with a smaller id has too.

    Words are numbered from 0 and spans are [start, end); overlapping spans of
    a document are merged, with the smallest source. Null, empty and short
    texts have no passages and rows without an id are left out. Rows that
    repeat an id are one document: their passages are not repeats of each
    other. Extra columns are ignored. A passage has at least a shingle's words
    and at most REACH more; other values raise.
    """
    if not 0 < shingle <= passage_words <= shingle + REACH:
        raise ValueError(f"passage_words has to be between the shingle's {shingle} words and {shingle + REACH}")
    spark = docs.sparkSession
    workers_see_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    shared = materialise(shared_windows(rows, passage_words, shingle, hashes))
    windows = materialise(_window_words(rows, shared.where(F.col("kind") == _WINDOW), shingle))
    near = crowds.similar(windows, Passages(shingle, passage_words - shingle + 1, similarity))
    equal = shared.where(F.col("kind") == _SPAN).select("doc", F.col("key").alias("start"), F.col("ctx").alias("end"), F.col("place").alias("source"))
    return _merged(equal.unionByName(near).toDF("doc_id", "start_word", "end_word", "source_id"))


def _merged(spans: DataFrame) -> DataFrame:
    """Union of each document's overlapping spans."""
    order = Window.partitionBy("doc_id").orderBy("start_word", "end_word", "source_id")
    before = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.withColumn("fresh", F.coalesce((F.col("start_word") > before).cast("int"), F.lit(1)))
        .withColumn("part", F.sum("fresh").over(order))
        .groupBy("doc_id", "part")
        .agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("source_id").alias("source_id"))
        .drop("part")
    )


def cut_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of ``spans``; a document that has no word left is dropped.

    Text outside the spans stays as it is; n_chars follows the text where it changed.
    """
    workers_see_package(docs.sparkSession)
    cut_id, cut_spans = fresh(docs, "cut_id"), fresh(docs, "cut_spans")
    lists = spans.groupBy(F.col("doc_id").alias(cut_id)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(cut_spans))
    doubtful, sure = split(docs, "doc_id", spans.select("doc_id"))
    joined = doubtful.join(lists, F.col("doc_id") == F.col(cut_id), "left").drop(cut_id)
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, cuts in zip(binary_rows(batch, "text"), batch.column(cut_spans).to_pylist(), strict=True):
                rest = text if not cuts or text is None else _without(text, [(c["start_word"], c["end_word"]) for c in cuts])
                texts.append(rest)
                keep.append(rest is text or located_words(rest)[0].size > 0)
            text = pa.array(texts, pa.binary()).cast(batch.column("text").type)
            columns = {n: batch.column(n) for n in names} | {"text": text}
            if "n_chars" in columns:
                changed = pa.compute.is_valid(batch.column(cut_spans))
                columns["n_chars"] = pa.compute.if_else(changed, pa.compute.utf8_length(text).cast(columns["n_chars"].type), columns["n_chars"])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(keep, pa.bool_()))

    return sure.unionByName(joined.mapInArrow(run, docs.schema))


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    _, start, end = located_words(text)
    parts, at = [], 0
    for a, b in spans:
        b = min(b, len(start))
        if a < b:
            parts.append(text[at : start[a]])
            at = max(at, int(end[b - 1]))
    return b"".join([*parts, text[at:]])
