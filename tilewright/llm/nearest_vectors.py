"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Every vector is projected on ``projections`` random lines, and each line keeps a block's vectors in sorted
order. A query opens a window around its own projection on every line; virtual rehashing widens all
windows by one factor per round, so the narrow windows are parts of the wide ones and only the newly
reached places are counted. A vector that has come into ``threshold`` windows is verified by its distance.
A query ends when the distance of its k-th best is so small against the windows' reach that a nearer vector
would have collided already, or when its windows hold everything.

Vectors are cut into blocks of bounded size, queries likewise; every query block meets every vector block
(a stated query set against all rows), and each meeting returns k rows per query, merged by query. All rows
are indexed, none is sampled, and copies are found in their blocks like all others.

Vectors that are null or empty, zero, or that hold null or non-finite components take no part, nor do rows
without an id, which no result could name. A distance needs equal lengths, so vectors of each length are
searched among their own, in blocks of their own. A query never finds its own row; other rows with its id or
its vector count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import stored

BLOCK_ROWS = 8192
QUERY_ROWS = 2048
MOST_TASKS = 20_000
PROJECTIONS = 32
THRESHOLD = 0.6
FIRST_REACH = 0.5
WIDEN = 1.25
SAFE = 1.1


def directions(dims: int, projections: int) -> np.ndarray:
    """Unit vectors, the same in every task."""
    lines = np.random.default_rng(20_011).normal(size=(dims, projections))
    return lines / np.linalg.norm(lines, axis=0)


class Block:
    """Vectors of one block with their sorted projections, line after line in one array.

    Line j is shifted by j times ``stride``, so the whole array is sorted and one search serves all lines.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, projections: int):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.lines = directions(vectors.shape[1], projections)
        places = (vectors @ self.lines).T
        self.order = np.argsort(places, axis=1, kind="stable")
        self.spread = max(float(places.std(axis=1).mean()), 1e-12)
        self.limit = float(np.abs(places).max()) + self.spread
        self.stride = 4 * self.limit
        self.shift = np.arange(projections) * self.stride
        self.sorted = (np.take_along_axis(places, self.order, axis=1) + self.shift[:, None]).ravel()
        self.order = self.order.ravel()

    def search(self, row: int, query: np.ndarray, k: int, threshold: float, safe: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest found."""
        n, m = len(self.ids), len(self.shift)
        least = max(1, int(np.ceil(threshold * m)))
        centre, reach = np.clip(query @ self.lines, -self.limit, self.limit) + self.shift, FIRST_REACH * self.spread
        ends = np.arange(m) * n
        low = np.searchsorted(self.sorted, centre)
        high, counts, fresh = low.copy(), np.zeros(n, np.int64), np.ones(n, bool)
        own = self.rows == row
        near, distance = np.zeros(0, np.int64), np.zeros(0)
        while True:
            # a window never leaves its own line
            a = np.maximum(np.searchsorted(self.sorted, centre - reach), ends)
            b = np.minimum(np.searchsorted(self.sorted, centre + reach, "right"), ends + n)
            a, b = np.minimum(a, low), np.maximum(b, high)
            counts += np.bincount(np.concatenate([self.order[x:y] for x, y in zip(np.concatenate([a, high]).tolist(), np.concatenate([low, b]).tolist())]), minlength=n)
            low, high = a, b
            new = np.flatnonzero((counts >= least) & fresh & ~own)
            if len(new):
                fresh[new] = False
                gaps = self.vectors[new] - query
                near = np.concatenate([near, new])
                distance = np.concatenate([distance, np.sqrt(np.einsum("ij,ij->i", gaps, gaps))])
            everything = bool((low == ends).all() and (high == ends + n).all())
            if everything or (len(near) >= k and np.partition(distance, k - 1)[k - 1] * safe <= reach * np.sqrt(self.vectors.shape[1])):
                best = np.lexsort((self.ids[near], distance))[: k]
                return near[best], distance[best]
            reach *= WIDEN


def _meet(k: int, projections: int, threshold: float, safe: float):
    def meet(table: pa.Table) -> pa.Table:
        """One block of vectors and one of queries."""
        r = table.to_pylist()[0]
        block = Block(np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(r["n"], -1), projections)
        out = ([], [], [], [])
        for row, query_id, query in zip(np.frombuffer(r["q_rows"], np.int64), np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_vectors"]).reshape(r["q_n"], -1)):
            near, distance = block.search(row, query, k, threshold, safe)
            out[0].append(np.full(len(near), row))
            out[1].append(np.full(len(near), query_id))
            out[2].append(block.ids[near])
            out[3].append(distance)
        return pa.table({name: pa.array(np.concatenate(c)) for name, c in zip(("query_row", "query_id", "vec_id", "score"), out)})

    return meet


def _gather(table: pa.Table) -> pa.Table:
    """One row that holds a block."""
    table = table.sort_by("row")
    vectors = np.stack(table.column("v").to_numpy()) if table.num_rows else np.zeros((0, 1))
    return pa.table({
        "dims": table.column("dims").slice(0, 1), "block": table.column("block").slice(0, 1), "n": pa.array([table.num_rows], pa.int32()), "rows": pa.array([table.column("row").to_numpy().tobytes()]),
        "ids": pa.array([table.column("id").to_numpy().tobytes()]), "vectors": pa.array([vectors.astype(np.float64).tobytes()])})


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", vec_id: str = "vec_id", projections: int = PROJECTIONS,
            threshold: float = THRESHOLD, safe: float = SAFE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k nearest other rows found, ties to the smaller id."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("bigint").alias("id"),
                          F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = stored(rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)), "vectors")
    count = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    sizes = stored(rows.groupBy(F.size("v").alias("dims")).agg(
        count(F.count("*"), block_rows).alias("n_blocks"), count(F.sum(F.col("asks").cast("bigint")), QUERY_ROWS).alias("n_asking")), "sizes")
    tasks = sizes.agg(F.coalesce(F.sum(F.col("n_blocks").cast("bigint") * F.col("n_asking")), F.lit(1)).alias("n")).first()["n"]
    rows = rows.withColumn("dims", F.size("v")).join(sizes, "dims")
    kinds = "dims int, block int, n int, rows binary, ids binary, vectors binary"

    def gathered(part: DataFrame, seed: int, number: str) -> DataFrame:
        dealt = part.withColumn("block", F.pmod(F.xxhash64("row", F.lit(seed)), F.col(number)).cast("int"))
        return dealt.select("dims", "block", "row", "id", "v").groupBy("dims", "block").applyInArrow(_gather, kinds)

    blocks = gathered(rows, 0, "n_blocks").join(sizes, "dims").withColumn("asking", F.explode(F.sequence(F.lit(0), F.col("n_asking") - 1)))
    asking = gathered(rows.where("asks"), 1, "n_asking").select(
        "dims", F.col("block").alias("asking"), F.col("n").alias("q_n"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    # few bytes make a long meeting, so meetings are dealt to tasks by their number
    meetings = blocks.join(asking, ["dims", "asking"]).repartition(min(tasks, MOST_TASKS), "dims", "block", "asking")
    found = meetings.groupBy("dims", "block", "asking").applyInArrow(
        _meet(k, projections, threshold, safe), "query_row long, query_id long, vec_id long, score double")
    best = found.groupBy("query_row", "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", "b.score")
