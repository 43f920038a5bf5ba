"""New snapshots of keyed tables: upsert, expiry, removal, history append and delete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import cells


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], refreshed: Sequence[str]) -> DataFrame:
    """Rows of both sides; where a key is on both, only the ``refreshed`` columns come from the new row."""
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c not in keys], F.lit(True).alias("_in_old"))
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_in_new"))
    joined = o.join(n, list(keys), "full_outer")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in refreshed:
            out.append(F.when(F.col("_in_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c))
        else:
            out.append(F.when(F.col("_in_old"), F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}")).alias(c))
    return joined.select(*out)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def drop_expired(cells_table: DataFrame, now: DataFrame, age: str) -> DataFrame:
    """Keep cells touched within ``age`` of the single-row ``now`` table."""
    limit = now.select((F.col(now.columns[0]) - F.expr(f"INTERVAL {age}")).alias("_limit"))
    return cells_table.join(limit, cells_table["update_time"] >= limit["_limit"], "left_semi")


def drop_below(cells_table: DataFrame, closed: DataFrame) -> DataFrame:
    """Remove every descendant of a closed cell: each cell names its proper ancestors and meets them by equality."""
    ups = cells_table.select("geohash", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("geohash") - 1, F.lit(1))), lambda n: F.substring(F.col("geohash"), F.lit(1), n))).alias("up"))
    dead = ups.where(F.length("up") < F.length("geohash")).join(
        closed.select(F.col("geohash").alias("up")), "up", "left_semi").select("geohash").distinct()
    return cells_table.join(dead, "geohash", "left_anti")


def drop_childless(cells_table: DataFrame) -> DataFrame:
    """Remove cells that are neither counted nor refined and carry no child."""
    kids = cells_table.select((F.col("level") - 1).alias("level"), cells.parent_code(F.col("cell"), F.col("level")).alias("cell"))
    empty = cells_table.where("total_count = 0").join(kids, ["level", "cell"], "left_anti").select("level", "cell")
    return cells_table.join(empty, ["level", "cell"], "left_anti")


def delete_by_key(history: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return history.join(gone.select(*keys).distinct(), list(keys), "left_anti")
