"""Centroid clustering of whole-number vectors with Ptolemaic pivots.

Components become floor(scale * x), so distances, sums and centroids are whole numbers and every round is exact.

1. Fixed pivots (the first starting centroids) are measured once from every vector; the vectors and their pivot
   distances are a written table that all rounds read.
2. For a pair of pivots p, s, Ptolemy's inequality gives d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s).
   A round takes the largest such bound over all pairs, for every vector and centroid, from cached numbers only.
3. Bounds are floating: each is lowered by more than rounding can have raised it. A vector's first guess (its
   centroid with the least bound) is measured exactly; only centroids whose bound doesn't exceed that are measured
   as well. Ties go to the smaller number.
4. A task adds up its vectors by centroid; the sums meet in one aggregation of a row per centroid and digit group.

Only centroids (``k`` rows) pass through the driver. Vectors are kept that have exactly ``size`` components, none of
them null, NaN or infinite; others, null vectors included, give no row. Kept rows that repeat an id, or whose id is
null, are rows of their own; null ids start a centroid only after all others, rows with one id are ordered by their components.
With fewer kept rows than ``k`` there are fewer centroids; an empty table gives an empty result. Components beyond
2**26 are handled with whole numbers of any length; a distance or sum of distances that doesn't fit a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import stored
from tilewright.llm.text import numbers_of, split_binary

PIVOTS = 8
#: Components up to this bound keep the squared distance of ``MOST`` components inside a long.
NARROW, MOST = 1 << 26, 256
DIGITS = 40
BATCH = 8192


def usable(vector: Column, size: int) -> Column:
    """Exactly ``size`` components, none null or non-finite."""
    return F.coalesce((F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(False))


def whole(x: float, scale: int) -> int:
    """floor(scale * x), also where the product is no longer a finite double."""
    numerator, denominator = float(x).as_integer_ratio()
    return scale * numerator // denominator


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of a matrix of doubles: int64 where all are narrow, Python's whole numbers otherwise."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not values.size or (np.abs(scaled) <= NARROW).all():
        return scaled.astype(np.int64)
    return np.array([[whole(x, scale) for x in row] for row in values.tolist()], dtype=object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` and ``b``."""
    gap = a - b
    return (gap * gap).sum(axis=1)


def floats(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles; those beyond a double are infinite."""
    if numbers.dtype != object:
        return numbers.astype(np.float64)
    return np.array([float(x) if x < 1 << 1000 else np.inf for x in numbers.tolist()])


def measured(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Floating distances of all ``points`` to one centre."""
    return np.sqrt(floats(squared(points, centre[None, :])))


@dataclass(frozen=True)
class Round:
    """What a round's tasks need: centroids, pivots, and the distances between both and among the pivots."""

    centroids: np.ndarray
    to_pivots: np.ndarray
    among: np.ndarray

    @classmethod
    def of(cls, centroids: list[list[int]], pivots: list[list[int]]) -> Round:
        c, p = table_of(centroids), table_of(pivots)
        return cls(c, np.stack([measured(c, x) for x in p], axis=1), np.stack([measured(p, x) for x in p], axis=1))


def table_of(rows: list[list[int]]) -> np.ndarray:
    """Whole numbers as a matrix: int64 where all are narrow."""
    wide = any(abs(x) > NARROW for row in rows for x in row)
    return np.array(rows, dtype=object if wide else np.int64)


def bounds(cached: np.ndarray, now: Round) -> np.ndarray:
    """A lower bound of every (vector, centroid) distance, safe against rounding; ``cached`` are the vectors' pivot distances.

    The errors of a distance are a few parts in 2**52 of it; the products' sum is lowered by 2**-40 of their size.
    """
    best = np.zeros((len(cached), len(now.centroids)))
    n = now.among.shape[0]
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        for p in range(n):
            for s in range(p):
                if now.among[p, s] > 0:
                    a, b = np.outer(cached[:, p], now.to_pivots[:, s]), np.outer(cached[:, s], now.to_pivots[:, p])
                    low = (np.abs(a - b) - (a + b) * 2.0 ** -40) / now.among[p, s] * (1 - 2.0 ** -40)
                    np.maximum(best, np.where(np.isfinite(low), low, 0.0), out=best)
    return best


def assign(points: np.ndarray, cached: np.ndarray, now: Round) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each point, its exact squared distance, and how many distances were measured."""
    if points.dtype == object or now.centroids.dtype == object:
        points, centroids = points.astype(object), now.centroids.astype(object)
    else:
        centroids = now.centroids
    low = bounds(cached, now)
    nearest = low.argmin(axis=1)
    distance = squared(points, centroids[nearest])
    reach = np.nextafter(np.sqrt(floats(distance)), np.inf)
    open_ = low <= reach[:, None]
    open_[np.arange(len(points)), nearest] = False
    count = len(points)
    for c in range(len(centroids)):
        at = np.flatnonzero(open_[:, c])
        if not len(at):
            continue
        count += len(at)
        found = squared(points[at], centroids[c][None, :])
        better = (found < distance[at]) | ((found == distance[at]) & (c < nearest[at]))
        nearest[at[better]], distance[at[better]] = c, found[better]
    return nearest, distance, count


def _preparer(scale: int, pivots: list[list[int]], size: int):
    """Rows as their whole numbers and pivot distances; wide rows as text."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = table_of(pivots)
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH):
                part = batch.slice(low, BATCH)
                points = integers(part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, size), scale)
                cached = np.stack([measured(points, x) for x in p], axis=1)
                rows = np.arange(part.num_rows + 1)
                none = pa.nulls(part.num_rows, pa.binary())
                if points.dtype == object:
                    narrow, wide = none, pa.array([",".join(map(str, row)).encode() for row in points.tolist()], pa.binary())
                else:
                    narrow, wide = split_binary(points.astype("<i4").ravel(), rows * size), none
                yield pa.record_batch({"vec_id": part.column("vec_id"), "narrow": narrow, "wide": wide, "cached": split_binary(cached.ravel(), rows * len(p))})

    return prepare


def _points(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of the prepared rows: the rows, their whole numbers and their pivot distances."""
    for is_wide in (False, True):
        part = batch.filter(batch.column("narrow").is_null() if is_wide else batch.column("narrow").is_valid())
        if not part.num_rows:
            continue
        if is_wide:
            points = np.array([[int(x) for x in row.split(b",")] for row in part.column("wide").to_pylist()], dtype=object)
        else:
            points = numbers_of(part.column("narrow"), "<i4")[0].reshape(part.num_rows, size).astype(np.int64)
        yield part, points, numbers_of(part.column("cached"), np.float64)[0].reshape(part.num_rows, -1)


def _digits(sums: list[int]) -> Iterator[tuple[int, list[int]]]:
    """(place, digits): the numbers in base 2**DIGITS; the last place keeps the sign."""
    place, edge = 0, 1 << DIGITS
    while True:
        if all(-edge < x < edge for x in sums):
            yield place, sums
            return
        yield place, [x & (edge - 1) for x in sums]
        sums, place = [x >> DIGITS for x in sums], place + 1


def _adder(now: Round, size: int):
    """Sums of the vectors by nearest centroid, one row per task, centroid and digit group."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(now.centroids)
        counts, sums = [0] * k, [[0] * size for _ in range(k)]
        for batch in batches:
            for _, points, cached in _points(batch, size):
                nearest, _, _ = assign(points, cached, now)
                for c in np.unique(nearest).tolist():
                    mine = points[nearest == c]
                    counts[c] += len(mine)
                    sums[c] = [x + int(y) for x, y in zip(sums[c], mine.sum(axis=0))]
        rows = [(c, place, counts[c] if place == 0 else 0, digits) for c in range(k) if counts[c] for place, digits in _digits(sums[c])]
        if rows:
            columns = list(zip(*rows))
            yield pa.record_batch({"cluster": pa.array(columns[0], pa.int32()), "place": pa.array(columns[1], pa.int32()), "n": pa.array(columns[2], pa.int64()),
                                   "sums": pa.array(columns[3], pa.list_(pa.int64()))})

    return add


def _assigner(now: Round, size: int):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, points, cached in _points(batch, size):
                nearest, distance, _ = assign(points, cached, now)
                fits = [x if x < 1 << 63 else None for x in distance.tolist()]
                yield pa.record_batch({"vec_id": part.column("vec_id"), "cluster": pa.array(nearest.astype(np.int32)), "distance": pa.array(fits, pa.int64())})

    return name


def centroids_after(prepared: DataFrame, now: Round, size: int) -> list[list[int]]:
    """Every centroid's new components: floor(sum / count) of its vectors, or the old ones where it has none."""
    added = prepared.mapInArrow(_adder(now, size), "cluster int, place int, n long, sums array<long>")
    total = added.groupBy("cluster", "place").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(size)]).alias("sums")).collect()
    new = [[int(x) for x in row] for row in now.centroids.tolist()]
    for c in {r.cluster for r in total}:
        mine = [r for r in total if r.cluster == c]
        n = sum(r.n for r in mine)
        new[c] = [sum(int(r.sums[i]) << (DIGITS * r.place) for r in mine) // n for i in range(size)]
    return new


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, pivots: int = PIVOTS,
              vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) for every kept row; ``centroid`` are the final components as text."""
    if size > MOST:
        raise ValueError(f"at most {MOST} components")
    kept = vectors.where(usable(F.col(vector), size)).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"))
    code = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    order = [F.col("code").asc_nulls_last(), F.col("vector")]
    first = kept.withColumn("code", code).orderBy(*order).limit(k).collect()
    spark, out = vectors.sparkSession, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid string"
    if not first:
        return spark.createDataFrame([], out)
    centroids = [[whole(x, scale) for x in row.vector] for row in first]
    fixed = centroids[:pivots]
    prepared = stored(kept.mapInArrow(_preparer(scale, fixed, size), "vec_id long, narrow binary, wide binary, cached binary"), "vectors")
    for _ in range(rounds):
        centroids = centroids_after(prepared, Round.of(centroids, fixed), size)
    named = stored(prepared.mapInArrow(_assigner(Round.of(centroids, fixed), size), "vec_id long, cluster int, distance long"), "clusters")
    # null, where a distance or the sum doesn't fit
    exact = lambda c: F.when(F.count("*") == F.count(c), F.sum(F.col(c).cast("decimal(38,0)")))
    by_cluster = named.groupBy("cluster").agg(exact("distance").alias("sum"), F.count("*").alias("n")).collect()
    whole_sum = None if any(r.sum is None for r in by_cluster) else sum(int(r.sum) for r in by_cluster)
    long_ = lambda x: None if x is None or x >= 1 << 63 else int(x)
    facts = spark.createDataFrame(
        [(r.cluster, long_(r.sum), long_(whole_sum), ",".join(map(str, centroids[r.cluster]))) for r in by_cluster], "cluster int, cluster_inertia long, inertia long, centroid string")
    return named.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
