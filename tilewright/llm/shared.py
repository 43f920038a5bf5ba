"""Small helpers of the operators: reading, written intermediate tables, bounded sieves, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import scratch_path

SIEVE_BITS = 1 << 24
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where the written tables of this process lie, while someone holds them.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores behind it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of what runs here as soon as it has run."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends, a lost executor loses nothing.

    The shuffle files of the write are of no more use once the table stands, so Spark is told to remove them then.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written intermediate tables that nothing reads any more: what was made of them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sieve(df: DataFrame, column: str, bits: int = SIEVE_BITS) -> np.ndarray:
    """A bit per residue of the longs in ``column``: at most ``bits`` / 8 bytes, whatever the input's size.

    A value in ``df`` always passes. Others may pass too, so readers still join exactly afterwards.
    """
    place = F.pmod(F.col(column), F.lit(bits))
    with _shuffles_removed(df.sparkSession):
        words = df.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("b")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    return out


def passes(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which signed 64-bit ``values`` the sieve lets through."""
    place = np.mod(values.view(np.int64), len(words) * 32)
    return (words[place >> 5] >> (place & 31).astype(np.uint32)) & np.uint32(1) > 0


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` reaches.

    Alternating stars: every node hands its neighbours the smallest node it knows, once towards larger
    and once towards smaller neighbours, until nothing changes. Only edges move, and each round is written.
    """
    now = stored(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    last = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join deals out nothing but its two inputs and a node with many edges can be split
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large, "edges")
        discard(now, low)
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now = stored(small, "edges")
        discard(large, low)
    raise RuntimeError("components did not settle")
