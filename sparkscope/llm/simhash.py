"""SimHash near-duplicates linked through vantage-point trees.

1. ``fingerprints``: a 64-bit SimHash of each whole text (no shuffle).
2. ``hamming_links``: distinct fingerprints are routed down a top tree whose
   vantage points come from a bounded sample. A fingerprint goes to its own
   side of every split, and one on the inner side of a boundary within the
   radius also goes to the outer side, so every pair within the radius meets
   in a leaf (triangle inequality). Leaves are searched by local vantage-point
   trees and give a spanning star of each local group, never all its pairs.
3. ``components`` joins the stars of all leaves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.llm import crowds
from sparkscope.llm.components import connected_components
from sparkscope.llm.kernels import binary_rows, fingerprint64, key_runs, mix64, shingle_hashes, word_hashes
from sparkscope.llm.membership import possible
from sparkscope.session import materialise, workers_see_package

#: Size of the sample from which the top tree's vantage points come, and the fingerprints a leaf should hold.
SAMPLE_ROWS = 1 << 16
LEAF_ROWS = 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Fingerprint of one UTF-8 text: bit set if set in over half of its shingles' XXH64.

    Words are runs of non-white-space after lower-casing A-Z; repeated shingles
    count each time; fewer words than a shingle form one; none give 0.
    """
    words = text.translate(_LOWER).split() if text else []
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(shingle, n)
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(line[a:b], seed) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)],
        dtype="<u8",
    )
    m = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, m, 1 << 16):
        block = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): each whole text's fingerprint; null and empty texts get 0. Other columns are ignored."""
    workers_see_package(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((simhash(t, shingle) for t in binary_rows(batch, "text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprint64(values))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def distances(values: np.ndarray, pivot: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ pivot).astype(np.int64)


class TopTree:
    """Splits of the whole fingerprint set, learned from a sample; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int):
        self.radius = radius
        self.nodes: list[tuple[int, int, int, int]] = []  # pivot, split distance, inner child, outer child (~leaf if < 0)
        self.leaves = 0
        self.root = self._grow(np.unique(sample), max(1, leaves))

    def _grow(self, sample: np.ndarray, leaves: int) -> int:
        if leaves > 1 and len(sample) >= 4:
            pivot = sample[len(sample) // 2]
            pivot = sample[int(np.argmax(distances(sample, pivot)))]
            d = distances(sample, pivot)
            split = int(np.median(d))
            if split >= d.max():
                split = int(d[d < d.max()].max(initial=-1))
            if split >= 0:
                at = len(self.nodes)
                self.nodes.append((0, 0, 0, 0))
                inner = self._grow(sample[d <= split], leaves // 2)
                outer = self._grow(sample[d > split], leaves - leaves // 2)
                self.nodes[at] = (int(pivot), split, inner, outer)
                return at
        self.leaves += 1
        return ~(self.leaves - 1)

    def route(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, index into values), one row for every leaf a value has to visit."""
        leaf_parts, index_parts = [], []
        stack = [(self.root, np.arange(len(values)))]
        while stack:
            node, index = stack.pop()
            if node < 0:
                leaf_parts.append(np.full(len(index), ~node, np.int64))
                index_parts.append(index)
                continue
            pivot, split, inner, outer = self.nodes[node]
            d = distances(values[index], np.uint64(pivot))
            for child, part in ((inner, index[d <= split]), (outer, index[d > split - self.radius])):
                if len(part):
                    stack.append((child, part))
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *leaf_parts]), np.concatenate([empty, *index_parts])


class Forest:
    """Union-find over positions, smaller root first."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.find(i), self.find(j)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        parent = self.parent
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                return parent
            parent = up


def local_groups(values: np.ndarray, radius: int, block: int = 1024) -> np.ndarray:
    """For each of the distinct ``values`` the smallest position of its group within ``radius`` links."""
    forest = Forest(len(values))

    def match(left: np.ndarray, right: np.ndarray, own: bool) -> None:
        for at in range(0, len(left), block):
            part = left[at : at + block]
            other = right[at:] if own else right
            for to in range(0, len(other), 4 * block):
                piece = other[to : to + 4 * block]
                i, j = np.nonzero(np.bitwise_count(values[part][:, None] ^ values[piece][None, :]) <= radius)
                different = part[i] != piece[j]
                forest.union(part[i][different], piece[j][different])

    def halves(index: np.ndarray) -> tuple[np.uint64, int] | None:
        pivot = values[index[0]]
        pivot = values[index[int(np.argmax(distances(values[index], pivot)))]]
        d = distances(values[index], pivot)
        split = int(np.median(d))
        if split >= d.max():
            split = int(d[d < d.max()].max(initial=-1))
        return (pivot, split) if split >= 0 else None

    stack: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(values)), None)]
    while stack:
        left, right = stack.pop()
        if right is None:
            cut = halves(left) if len(left) > block else None
            if cut is None:
                match(left, left, True)
                continue
            d = distances(values[left], cut[0])
            stack += [(left[d <= cut[1]], None), (left[d > cut[1]], None)]
            near_in, near_out = left[(d <= cut[1]) & (d > cut[1] - radius)], left[(d > cut[1]) & (d <= cut[1] + radius)]
            if len(near_in) and len(near_out):
                stack.append((near_in, near_out))
            continue
        cut = halves(np.concatenate([left, right])) if len(left) * len(right) > block * block else None
        if cut is None:
            match(left, right, False)
            continue
        a, b = (distances(values[x], cut[0]) for x in (left, right))
        s = cut[1]
        for x, y in (
            (left[a <= s], right[b <= s]),
            (left[a > s], right[b > s]),
            (left[(a <= s) & (a > s - radius)], right[(b > s) & (b <= s + radius)]),
            (left[(a > s) & (a <= s + radius)], right[(b <= s) & (b > s - radius)]),
        ):
            if len(x) and len(y):
                stack.append((x, y))
    return forest.roots()


def hamming_links(points: DataFrame, radius: int = 2, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``points`` (fp, rep) within ``radius`` bits.

    ``points`` has distinct fingerprints. About ``sample_rows`` of them shape
    the top tree on the driver; every fingerprint is routed and searched.
    """
    workers_see_package(points.sparkSession)
    n = points.count()
    # a share of the hash space, so that every task gives its part and none sorts
    share = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(min(1.0, sample_rows / max(1, n)) * (1 << 30))
    sample = points.where(share).select("fp").collect() if n > leaf_rows else []
    tree = TopTree(np.array([r.fp for r in sample], np.int64).view(np.uint64), min(-(-n // leaf_rows), max(1, len(sample) // 16)), radius)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, index = tree.route(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf), batch.column("fp").take(pa.array(index)), batch.column("rep").take(pa.array(index))], ["leaf", "fp", "rep"]
            )

    def search(rows: pa.Table) -> pa.Table:
        rep = rows.column("rep").to_numpy()
        order = np.argsort(rep)
        rep = rep[order]
        root = local_groups(rows.column("fp").to_numpy().view(np.uint64)[order], radius)
        linked = root != np.arange(len(root))
        return pa.table({"a": rep[linked], "b": rep[root[linked]]})

    routed = points.select("fp", "rep").mapInArrow(route, "leaf long, fp long, rep long")
    if n > len(sample) * leaf_rows // 16:  # more leaves would be wanted than the sample can shape
        routed = _split_leaves(materialise(routed), radius, 4 * leaf_rows)
    return routed.groupBy("leaf").applyInArrow(search, "a long, b long")


def _split_leaves(routed: DataFrame, radius: int, most: int) -> DataFrame:
    """(leaf, fp, rep) with leaves of more than ``most`` rows split, again and again, by a vantage point of their own.

    The split is the median of the leaf's distances, from a histogram; a leaf
    whose rows all have the same distance to the point stays as it is.
    """
    done = []
    while True:
        sizes = routed.groupBy("leaf").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp")).alias("pivot"))
        full = materialise(sizes.where(F.col("n") > most).select(F.col("leaf").alias("full"), "n", "pivot"))
        if full.isEmpty():
            return reduce(DataFrame.unionByName, [*done, routed])
        marked = routed.join(full, F.col("leaf") == F.col("full"), "left")
        done.append(marked.where("full is null").select("leaf", "fp", "rep"))
        far = marked.where("full is not null").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))))
        below = Window.partitionBy("leaf").orderBy("d")
        steps = far.groupBy("leaf", "n", "d").count().withColumn("up", F.sum("count").over(below)).withColumn("band", F.sum("count").over(below.rangeBetween(-radius + 1, 0)))
        # both sides have to be smaller than the leaf: not all inside, and something below the outer side's band
        cuts = steps.where((F.col("up") < F.col("n")) & (F.col("up") > F.col("band"))).groupBy("leaf").agg(F.min_by("d", F.abs(2 * F.col("up") - F.col("n"))).alias("cut"))
        cut = far.join(materialise(cuts.withColumnRenamed("leaf", "of")), F.col("leaf") == F.col("of"), "left")
        done.append(materialise(cut.where("cut is null").select("leaf", "fp", "rep")))
        sides = F.array(F.when(F.col("d") <= F.col("cut"), F.lit(0)), F.when(F.col("d") > F.col("cut") - radius, F.lit(1)))
        parts = cut.where("cut is not null").select("leaf", "fp", "rep", F.explode(F.array_compact(sides)).alias("side"))
        routed = materialise(parts.select(F.xxhash64("leaf", "side").alias("leaf"), "fp", "rep"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp long, component_id): one row per document.

    ``component_id`` is the smallest id reachable over fingerprints that differ
    in at most ``radius`` bits. Null texts are empty and empty texts share the
    fingerprint 0; repeated ids keep one row each; an empty table gives an
    empty table; extra columns are ignored.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle))
    points = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    parts = connected_components(hamming_links(points, radius))
    groups = (
        points.join(parts, points.rep == parts.node, "left")
        .where((F.col("n") > 1) | F.col("component").isNotNull())
        .select(F.col("fp").alias("g_fp"), F.coalesce("component", "rep").alias("g_component"))
    )
    return prints.join(groups, F.col("fp") == F.col("g_fp"), "left").select("doc_id", "fp", F.coalesce("g_component", "doc_id").alias("component_id"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Min-wise samples of a text's shingles, shingles in each, and the size up to which a sample's group is paired at once; larger ones are a crowd.
SAMPLES, SAMPLE_SHINGLES, SMALL_GROUP = 10, 3, 32
_SEEDS = mix64(np.arange(101, 101 + SAMPLES, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Distinct hashes of a text's word shingles, in order."""
    return np.unique(shingle_hashes(word_hashes(text), shingle))


def _samples(shingles: np.ndarray) -> np.ndarray:
    """One hash for each min-wise sample: equal for two texts with probability about similarity ** SAMPLE_SHINGLES."""
    out = np.empty(SAMPLES, np.uint64)
    for j in range(SAMPLES):
        values = mix64(shingles * _SEEDS[j])
        k = min(SAMPLE_SHINGLES, len(values))
        least = np.sort(np.partition(values, k - 1)[:k]) if k else values
        out[j] = np.bitwise_xor.reduce(mix64(least + np.arange(1, k + 1, dtype=np.uint64) * _SEEDS[j])) if k else 0
    return out


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp, digest, keys): SimHash, hash of the shingle set, and sample hashes of each whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, digests, keys = [], [], []
            for text in binary_rows(batch, "text"):
                shingles = shingle_set(text, shingle)
                fps.append(simhash(text, shingle))
                digests.append(xxhash.xxh64_intdigest(shingles.tobytes()))
                keys.append(_samples(shingles) if len(shingles) else np.empty(0, np.uint64))
            listed = pa.array([fingerprint64(k) for k in keys], pa.list_(pa.int64()))
            longs = (pa.array(fingerprint64(np.array(x, np.uint64))) for x in (fps, digests))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *longs, listed], ["doc_id", "fp", "digest", "keys"])

    return docs.mapInArrow(run, "doc_id long, fp long, digest long, keys array<long>")


def _group_pairs(members: DataFrame) -> DataFrame:
    """All pairs (a, b) of the groups of (key, doc_id), which have SMALL_GROUP members at most."""

    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        size = 0
        for group in key_runs(batches, "key"):
            n = group.num_rows
            if n < 2:
                continue
            ids = group.column("doc_id").to_numpy()
            i, j = np.triu_indices(n, 1)
            found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]))
            size += len(i)
            if size > 1 << 18:
                yield _pair_rows(found)
                found, size = [], 0
        if found:
            yield _pair_rows(found)

    return members.repartition("key").sortWithinPartitions("key").mapInArrow(pair, "a long, b long").distinct()


def _pair_rows(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


class Sets(crowds.Loaded):
    """Sorted sets of shingles, compared by Jaccard similarity; similar ones are joined, not listed pair by pair."""

    def __init__(self, blobs: list[bytes], similarity: float):
        self.sets = [np.frombuffer(b, np.uint32) for b in blobs]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.similarity = similarity

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.sizes[a], self.sizes[b]), np.maximum(self.sizes[a], self.sizes[b])
        out = (low > 0) & (low >= self.similarity * high - 1e-9)
        order = np.flatnonzero(out)
        order = order[np.argsort(b[order], kind="stable")]
        for part in np.split(order, np.flatnonzero(np.diff(b[order])) + 1) if len(order) else ():
            other = self.sets[b[part[0]]]
            for at in range(0, len(part), 256):
                some = part[at : at + 256]
                values = np.concatenate([self.sets[i] for i in a[some].tolist()])
                place = np.minimum(np.searchsorted(other, values), len(other) - 1)
                sizes = self.sizes[a[some]]
                common = np.add.reduceat((other[place] == values).astype(np.int64), np.cumsum(sizes) - sizes)
                out[some] = common >= self.similarity * (sizes + len(other) - common) - 1e-9
        return out

    def compare(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, found: crowds.Found, settled: np.ndarray | None = None) -> None:
        good = self.similar(a, b)
        a, b = a[good], b[good]
        if settled is not None:
            settled[a] = True
        # what is similar to the same is joined anyway: a link for each document but the first of a component
        rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(rows))
        forest.union(place[: len(a)], place[len(a) :])
        root = forest.roots()
        more = np.flatnonzero(root != np.arange(len(rows)))
        none = np.zeros(len(more), np.int64)
        found.add(doc[rows[more]], none, none, doc[rows[root[more]]])

    def parts(self) -> np.ndarray:
        return np.ones((len(self.sets), 1), np.bool_)

    def prefixes(self, members: np.ndarray, stars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each set the shingles that fewest stars have, one more than a similar set may lack."""
        known, many = np.unique(np.concatenate([np.zeros(1, np.uint32), *(self.sets[s] for s in stars.tolist())]), return_counts=True)
        rows, elements = [], []
        for m in members.tolist():
            own = self.sets[m]
            if not len(own):
                continue
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            weight = np.where(known[place] == own, many[place], 0).astype(np.uint64)
            k = len(own) - int(np.ceil(self.similarity * len(own) - 1e-9)) + 1
            least = np.partition(weight << np.uint64(32) | own, k - 1)[:k]
            rows.append(np.full(k, m, np.int64))
            elements.append(least & np.uint64(0xFFFFFFFF))
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        return np.concatenate(rows), np.concatenate(elements)


class ShingleSets(crowds.Comparison):
    payload = ("words",)
    one_sided = False

    def __init__(self, similarity: float):
        self.similarity = similarity

    def load(self, batch: pa.RecordBatch) -> Sets:
        return Sets(batch.column("words").to_pylist(), self.similarity)


def _shingle_blobs(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, words): sorted 32-bit hashes of the shingles of the documents that may have one of the ids."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.unique(shingle_set(t, shingle).astype(np.uint32)).tobytes() for t in binary_rows(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary())], ["id", "words"])

    return possible(docs, "doc_id", ids).mapInArrow(sets, "id long, words binary")


def similar_pairs(pairs: DataFrame, blobs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of document ids whose shingle sets have at least the given Jaccard similarity, compared in full."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            both = Sets([*batch.column("x").to_pylist(), *batch.column("y").to_pylist()], similarity)
            yield batch.select(["a", "b"]).filter(pa.array(both.similar(np.arange(n), np.arange(n, 2 * n)), pa.bool_()))

    first = pairs.join(blobs, F.col("a") == F.col("id")).select("a", "b", F.col("words").alias("x"))
    joined = first.join(blobs, F.col("b") == F.col("id")).select("a", "b", "x", F.col("words").alias("y"))
    return joined.mapInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """(doc_id, component_id): groups of near-duplicates for a corpus filter, one row per document.

    Documents are linked if their fingerprints differ in at most ``radius``
    bits (vantage-point trees), or if they share one of SAMPLES min-wise
    samples and their shingle sets have at least ``similarity``. A change of
    one word in a short text moves more than a few bits of its fingerprint,
    which is why samples are looked up as well. Groups of a sample of any size
    are compared in full (``crowds``).
    Wordless texts are one group; null ids are dropped; extra columns are
    ignored.
    """
    workers_see_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    sketched = materialise(_sketches(rows, shingle))
    same = materialise(sketched.groupBy("digest").agg(F.min_by(F.struct("doc_id", "fp", "keys"), "doc_id").alias("r")).select("digest", "r.*"))
    points = same.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    equal = same.select("doc_id", "fp").join(points, "fp").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    keys = same.select(F.explode("keys").alias("key"), "doc_id")
    full = materialise(keys.groupBy("key").count().where(F.col("count") > SMALL_GROUP).select(F.col("key").alias("full")))
    marked = keys.join(full, F.col("key") == F.col("full"), "left")
    pairs = materialise(_group_pairs(marked.where("full is null").select("key", "doc_id")))
    crowd = materialise(marked.where("full is not null").select("key", F.col("doc_id").alias("doc")))
    blobs = materialise(_shingle_blobs(rows, pairs.select("a").union(pairs.select("b")).union(crowd.select("doc")), shingle))
    near = similar_pairs(pairs, blobs, similarity)
    if not crowd.isEmpty():
        crowded = crowd.join(blobs, F.col("doc") == F.col("id")).select("key", "doc", F.lit(0).cast("long").alias("place"), "words")
        near = near.union(crowds.similar(materialise(crowded), ShingleSets(similarity)).select("doc", "source"))
    links = materialise(hamming_links(materialise(points), radius).union(equal).union(near))
    parts = connected_components(links)
    groups = same.join(parts, same.doc_id == parts.node, "left").select(F.col("digest").alias("d"), F.coalesce("component", "doc_id").alias("component_id"))
    return sketched.join(groups, F.col("digest") == F.col("d")).select("doc_id", "component_id")
