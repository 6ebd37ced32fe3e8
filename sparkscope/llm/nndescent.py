"""Embedding near-duplicates by NN-descent on a threshold neighbour graph.

1. Equal vectors become one point with a count.
2. A first graph comes from sign-of-projection buckets.
3. Rounds of local joins compare the neighbours of each point with each other
   and keep the best ``neighbours`` of every list, until no new link appears.
   Of all compared pairs at the threshold or above, links that join the same
   points are kept for good, whether or not they are among the best.
4. Points whose lists may be saturated, which are those in a component of
   links, have their lists enlarged to the component. Its core, the points near
   its mean direction, is linked throughout and only summed; the others are
   compared with all in blocks of bounded size. Links are counted, not listed.
5. Recall is audited twice: a bounded sample of points of different components
   and of points without links is compared with all, and pairs planted at the
   threshold's angle are looked up in the wave's tables, which tells how many
   lone pairs they can miss whatever the data hold. The number of tables grows
   with that of points; more waves follow while recall is too low.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkscope.llm.components import connected_components
from sparkscope.llm.kernels import key_runs
from sparkscope.session import materialise, workers_see_package

THRESHOLD = 0.95
#: Length of neighbour lists, least cosine of a neighbour, rows a bucket should have and may have, rows of a block whose links are counted.
NEIGHBOURS, EXPLORE, BUCKET, BLOCK, COUNT_BLOCK = 12, 0.8, 64, 1024, 128
#: Points of each kind in the audit, planted pairs, recall that is wanted, share of lone pairs a wave's tables may miss, and the most descent rounds and waves.
AUDIT_ROWS, PLANTED, AUDIT_RECALL, MISSED, ROUNDS, WAVES = 256, 2000, 0.99, 0.004, 8, 6

_log = logging.getLogger(__name__)
_PAIR = "a long, b long, cosine double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit row vectors in double precision from packed float64 values."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def packed_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec binary): float64 values, shorter vectors padded by zeros; null where a vector links with nothing."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v"):
                values = None if not v.is_valid or v.values.null_count else v.values.to_numpy()
                if values is None or not np.isfinite(values).all() or not values.any():
                    out.append(None)
                    continue
                # scaling by a power of two is exact and keeps squares in range
                values = np.ldexp(values, -int(np.frexp(np.abs(values).max())[1])) + 0.0
                out.append(np.pad(values, (0, width - len(values))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "vec"])

    return rows.mapInArrow(run, "vec_id long, vec binary")


def _best(index: np.ndarray, cosines: np.ndarray, neighbours: int, explore: float, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a group that are among the best of either end, and links that join it as all its links at the threshold or above do."""
    n = len(index)
    np.fill_diagonal(cosines, -2)
    k = min(neighbours, n - 1)
    top = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    i = np.repeat(np.arange(n), k)
    j = top.ravel()
    c = cosines[i, j]
    good = c >= explore
    yield np.minimum(index[i], index[j])[good], np.maximum(index[i], index[j])[good], c[good]
    i, j = _joining(cosines >= threshold)
    yield np.minimum(index[i], index[j]), np.maximum(index[i], index[j]), cosines[i, j]


def _joining(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a spanning forest of a group's links: one link fewer than points in each component, however many there are."""
    rest, ends, starts = linked.any(axis=1), [], []
    while rest.any():
        front = np.array([int(np.argmax(rest))])
        rest[front] = False
        while len(front):
            reached = linked[front] & rest
            new = np.flatnonzero(reached.any(axis=0))
            starts.append(front[np.argmax(reached[:, new], axis=0)])
            ends.append(new)
            rest[new] = False
            front = new
    none = np.empty(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends])


def _pairs(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, c = (np.concatenate(x) if parts else np.empty(0) for x in (zip(*parts, strict=True) if parts else [(), (), ()]))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["a", "b", "cosine"])


class Tables:
    """Sign-of-projection tables of one wave: as many as it takes that few pairs at the threshold share no bucket."""

    def __init__(self, n: int, width: int, wave: int, threshold: float):
        self.bits = max(2, math.ceil(math.log2(max(4, n / BUCKET))))
        together = (1 - math.acos(threshold) / math.pi) ** self.bits
        self.count = max(4, math.ceil(math.log(MISSED) / math.log1p(-together)))
        self.planes = np.random.default_rng(1000 + wave).standard_normal((width, self.count * self.bits))
        self.weights = 1 << np.arange(self.bits, dtype=np.int64)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables): bucket numbers, different for each table."""
        signs = (unit @ self.planes > 0).reshape(len(unit), self.count, self.bits)
        return signs @ self.weights + (np.arange(self.count, dtype=np.int64) << self.bits)

    def planted_recall(self, sample: np.ndarray, threshold: float, missed: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """(share of pairs planted at the threshold that share a bucket in this wave or an earlier one, those that never do)"""
        rng = np.random.default_rng(7)
        left = sample[rng.integers(0, len(sample), PLANTED)]
        off = rng.standard_normal(left.shape)
        off -= (off * left).sum(axis=1, keepdims=True) * left
        right = threshold * left + math.sqrt(1 - threshold**2) * off / np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-300)
        apart = (self.keys(left) != self.keys(right)).all(axis=1)
        apart = apart if missed is None else apart & missed
        return 1 - float(apart.mean()), apart


def _bucket_pairs(points: DataFrame, tables: Tables, threshold: float) -> DataFrame:
    """Close pairs within the buckets of one wave of tables; crowded buckets are dealt into parts by a hash."""

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys = tables.keys(_matrix(part.column("vec")))
                index = pa.array(np.repeat(np.arange(part.num_rows), tables.count))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column("rep").take(index), part.column("vec").take(index)], ["bucket", "rep", "vec"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for group in key_runs(batches, "bucket"):
            if group.num_rows < 2:
                continue
            rep, unit = group.column("rep").to_numpy(), _matrix(group.column("vec"))
            order = np.argsort(rep)
            for at in range(0, len(order), BLOCK):
                chosen = order[at : at + BLOCK]
                if len(chosen) > 1:
                    parts += _best(rep[chosen], unit[chosen] @ unit[chosen].T, NEIGHBOURS, EXPLORE, threshold)
            if len(parts) >= 512:
                yield _pairs(parts)
                parts = []
        yield _pairs(parts)

    keys = points.select("rep", "vec").mapInArrow(assign, "bucket long, rep long, vec binary")
    crowded = keys.groupBy("bucket").count().where(F.col("count") > BLOCK).select(F.col("bucket").alias("full"), F.ceil(F.col("count") / (BLOCK // 2)).alias("parts"))
    dealt = keys.join(materialise(crowded), F.col("bucket") == F.col("full"), "left").withColumn(
        "bucket", F.xxhash64("bucket", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("rep", "bucket"), F.col("parts"))))
    )
    return dealt.select("bucket", "rep", "vec").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, _PAIR)


def _graph(pairs: DataFrame) -> DataFrame:
    """The best neighbours of every point: (center, other, cosine)."""
    both = pairs.select(F.col("a").alias("center"), F.col("b").alias("other"), "cosine").unionByName(
        pairs.select(F.col("b").alias("center"), F.col("a").alias("other"), "cosine")
    )
    # a list needs its best only, so each task's share of a crowded list is cut before it is shuffled
    best = Window.partitionBy("center").orderBy(F.desc("cosine"), "other")
    return both.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEIGHBOURS).drop("rank")


def _local_joins(graph: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """Pairs of neighbours of the same point, compared."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for group in key_runs(batches, "center"):
            if group.num_rows > 1:
                unit = _matrix(group.column("vec"))
                parts += _best(group.column("other").to_numpy(), unit @ unit.T, NEIGHBOURS, EXPLORE, threshold)
            if len(parts) >= 512:
                yield _pairs(parts)
                parts = []
        yield _pairs(parts)

    rows = graph.join(points.select(F.col("rep").alias("id"), "vec"), F.col("other") == F.col("id")).select("center", "other", "vec")
    return rows.repartition("center").sortWithinPartitions("center", "other").mapInArrow(compare, _PAIR)


def _centers(members: DataFrame) -> DataFrame:
    """(center_of, center): the direction of each component's mean vector, from one partial sum a batch."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                comp, place = np.unique(batch.column("component").to_numpy(), return_inverse=True)
                unit = _matrix(batch.column("vec"))
                total = np.zeros((len(comp), unit.shape[1]))
                np.add.at(total, place, unit)
                yield pa.RecordBatch.from_arrays([pa.array(comp), pa.array([t.tobytes() for t in total], pa.binary())], ["component", "total"])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, "component"):
            total = np.frombuffer(b"".join(group.column("total").to_pylist()), np.float64).reshape(group.num_rows, -1).sum(axis=0)
            yield pa.RecordBatch.from_arrays([group.column("component").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["center_of", "center"])

    sums = members.select("component", "vec").mapInArrow(partial, "component long, total binary")
    return sums.repartition("component").sortWithinPartitions("component").mapInArrow(join, "center_of long, center binary")


def _link_counts(points: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """(rep, linked): vectors linked directly to each point of a component of several points, exactly.

    Points within half the threshold's angle of their component's mean
    direction are the core; they are all linked to each other (triangle
    inequality of angles), so their links are summed, not compared. Only points
    outside the core are compared with all of the component, in blocks.
    """
    half = math.cos(math.acos(threshold) / 2) + 1e-9

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            center = np.frombuffer(b"".join(batch.column("center").to_pylist()), np.float64).reshape(batch.num_rows, -1)
            length = np.maximum(np.linalg.norm(center, axis=1), 1e-300)
            core = (_matrix(batch.column("vec")) * center).sum(axis=1) >= half * length if batch.num_rows else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "rep", "n", "vec")), pa.array(core)], ["component", "rep", "n", "vec", "core"])

    members = materialise(parts.join(points, F.col("node") == F.col("rep")).select("component", "rep", "n", "vec"))
    centered = members.join(_centers(members), F.col("component") == F.col("center_of")).select("component", "rep", "n", "vec", "center")
    placed = materialise(centered.mapInArrow(place, "component long, rep long, n long, vec binary, core boolean"))
    sums = placed.groupBy("component").agg(
        F.sum(F.when(F.col("core"), F.col("n"))).alias("core_n"), F.ceil(F.count_if(~F.col("core")) / COUNT_BLOCK).cast("int").alias("mx"), F.ceil(F.count("*") / COUNT_BLOCK).cast("int").alias("my")
    ).withColumnRenamed("component", "c")
    known = placed.join(sums, F.col("component") == F.col("c"))
    inside = known.where("core").select("rep", (F.col("core_n") - F.col("n")).alias("linked"))
    mixed = known.where("mx > 0")
    part = lambda m: F.pmod(F.xxhash64("rep"), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    outer = mixed.where("not core").select("component", "rep", "n", "vec", "core", part("mx").alias("x"), every("my").alias("y"), F.lit(0).alias("side"))
    whole = mixed.select("component", "rep", "n", "vec", "core", every("mx").alias("x"), part("my").alias("y"), F.lit(1).alias("side"))
    rows = outer.unionByName(whole).select(F.xxhash64("component", "x", "y").alias("task"), "component", "side", "core", "rep", "n", "vec")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, "task"):
            comp, side, core = (group.column(c).to_numpy(zero_copy_only=False) for c in ("component", "side", "core"))
            rep, n, unit = group.column("rep").to_numpy(), group.column("n").to_numpy(), _matrix(group.column("vec"))
            total = np.zeros(len(rep), np.int64)
            for c in np.unique(comp):
                left, right = np.flatnonzero((comp == c) & (side == 0)), np.flatnonzero((comp == c) & (side == 1))
                linked = (unit[left] @ unit[right].T >= threshold) & (rep[left][:, None] != rep[right][None, :])
                total[left] += linked @ n[right]
                total[right] += np.where(core[right], linked.T @ n[left], 0)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(total)], ["rep", "linked"])

    compared = rows.repartition("task").sortWithinPartitions("task").mapInArrow(count, "rep long, linked long")
    return inside.unionByName(compared).groupBy("rep").agg(F.sum("linked").alias("linked"))


def _audit(points: DataFrame, parts: DataFrame, counts: DataFrame, threshold: float) -> tuple[float, int]:
    """(share of the sampled points with true links all of whose links were found, number of such points).

    One point a component, so that large groups do not hide small ones, and as
    many points without links.
    """
    known = points.join(parts, F.col("rep") == F.col("node"), "left").join(counts.withColumnRenamed("rep", "c"), F.col("rep") == F.col("c"), "left")
    first = known.where("component is not null").groupBy("component").agg(F.min_by(F.struct("rep", "vec", "linked"), F.xxhash64("rep")).alias("p")).select("p.*")
    alone = known.where("component is null").select("rep", "vec", F.lit(None).cast("long").alias("linked"))
    chosen = [df.orderBy(F.xxhash64("rep"), "rep").limit(AUDIT_ROWS).toArrow() for df in (first, alone)]
    sample = pa.concat_tables(chosen).combine_chunks()
    if not sample.num_rows:
        return 1.0, 0
    ids, linked = sample["rep"].to_numpy(), np.nan_to_num(sample["linked"].to_numpy().astype(np.float64))
    unit = _matrix(sample["vec"].combine_chunks())

    def brute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                near = (unit @ _matrix(part.column("vec")).T >= threshold) & (ids[:, None] != part.column("rep").to_numpy()[None, :])
                total += near @ part.column("n").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "links"])

    sums = points.select("rep", "n", "vec").mapInArrow(brute, "id long, links long").groupBy("id").agg(F.sum("links").alias("links")).toArrow()
    truth = dict(zip(sums["id"].to_pylist(), sums["links"].to_pylist(), strict=True))
    links = np.array([truth.get(i, 0) for i in ids.tolist()])
    has = links > 0
    return (float((linked[has] >= links[has]).mean()) if has.any() else 1.0), int(has.sum())


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vector.

    Null, zero, empty and non-finite vectors have no links and are their own
    component; shorter vectors count as padded by zeros; equal vectors are
    linked; repeated ids keep a row each; an empty table gives an empty table;
    extra columns are ignored. Raises if the audited recall stays below
    AUDIT_RECALL.
    """
    workers_see_package(vectors.sparkSession)
    rows = materialise(packed_vectors(vectors, id_col, vector_col))
    points = materialise(rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    size = points.agg(F.count("*").alias("n"), F.max(F.length("vec")).alias("w")).first()
    n, width = size["n"], (size["w"] or 0) // 8
    links = counts = parts = apart = None
    unit = _matrix(points.select("vec").limit(AUDIT_ROWS).toArrow()["vec"].combine_chunks()) if n > 1 else None
    for wave in range(WAVES if n > 1 else 0):
        tables = Tables(n, width, wave, threshold)
        planted, apart = tables.planted_recall(unit, threshold, apart)
        pairs = _bucket_pairs(points, tables, threshold)
        found = materialise(pairs.distinct() if links is None else pairs.union(links).distinct(), replaces=links)
        links = found
        before = links.where(F.col("cosine") >= threshold).select("a", "b").distinct().count()
        for _ in range(ROUNDS):
            fresh = _local_joins(_graph(links), points, threshold)
            links = materialise(links.union(fresh).groupBy("a", "b").agg(F.max("cosine").alias("cosine")), replaces=links)
            now = links.where(F.col("cosine") >= threshold).count()
            if now <= before * 1.001:
                break
            before = now
        parts = connected_components(links.where(F.col("cosine") >= threshold).select("a", "b"))
        counts = materialise(_link_counts(points, parts, threshold))
        recall, seen = _audit(points, parts, counts, threshold)
        _log.info("wave %d: %d points, %d tables of %d bits, recall %.4f of planted pairs, %.4f of %d audited points", wave, n, tables.count, tables.bits, planted, recall, seen)
        if min(recall, planted) >= AUDIT_RECALL:
            break
    else:
        if n > 1:
            raise RuntimeError(f"recall {recall:.4f} of audited points and {planted:.4f} of planted pairs after {WAVES} waves")
    if parts is None:
        spark = vectors.sparkSession
        parts, counts = spark.createDataFrame([], "node long, component long"), spark.createDataFrame([], "rep long, linked long")
    result = points.join(parts, points.rep == parts.node, "left").join(counts.withColumnRenamed("rep", "c_rep"), F.col("rep") == F.col("c_rep"), "left")
    result = result.where("n > 1 or component is not null").select(
        F.col("vec").alias("r_vec"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("comp")
    )
    out = rows.join(result, F.col("vec") == F.col("r_vec"), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
