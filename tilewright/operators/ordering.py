"""Ranks, first occurrences and dense ids that survive one key holding most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.session import checkpoint


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos", descending: bool = False) -> DataFrame:
    """1-based position within each key, for keys of any size.

    Rows are range-partitioned by (key, order), numbered inside their partition, and shifted by the
    counts of the earlier partitions of the same key; only those counts (one row per partition and
    key) meet in a window.
    """
    columns = [F.col(k).asc_nulls_first() for k in keys] + [
        F.col(o).desc_nulls_last() if descending else F.col(o).asc_nulls_first() for o in order]
    spread = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = checkpoint(spread.withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy(*keys, "_part").orderBy(*columns[len(keys):])
    local = placed.withColumn(out, F.row_number().over(inner).cast("bigint"))
    counts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    on = None
    for k in [*keys, "_part"]:
        test = local[k].eqNullSafe(before[k])
        on = test if on is None else on & test
    joined = local.hint("merge").join(before, on)
    return joined.select(*[local[c] for c in df.columns], (local[out] + F.col("_shift")).alias(out))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """The first row of every key; a map-side combined aggregate, so hot keys cost one partial row per task."""
    rest = [c for c in df.columns if c not in keys]
    at = F.col(order) if isinstance(order, str) else order
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("_r")).select(*keys, "_r.*")


def dense_ids(df: DataFrame, scope: Sequence[str], key: Sequence[str], order: str, out: str = "dense_id") -> DataFrame:
    """0-based ids of distinct keys in order of first appearance within a scope: (scope, key, first order, id)."""
    firsts = df.groupBy(*scope, *key).agg(F.min(order).alias("first_at"))
    return ranked(firsts, scope, ["first_at"], out).withColumn(out, F.col(out) - 1)
