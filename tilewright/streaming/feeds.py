"""Changed and deleted feeds over edit tables; the same steps serve batch and streams."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.predicates import live_feature


def deleted_feed(edit_tables: Mapping[str, DataFrame], since: str) -> DataFrame:
    """Distinct deletions since a moment over all edit tables, tagged with their kind."""
    out = None
    for kind, edits in edit_tables.items():
        part = edits.where((F.col("del_flag") == "1") & (F.col("update_time") >= F.lit(since).cast("timestamp"))).select(
            "id", F.lit(kind).alias("type"), "update_time", "del_flag")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def changed_feed(layers: Mapping[str, tuple[DataFrame, DataFrame]], since: str) -> DataFrame:
    """Edited, live features with a placeable model, one row per edit.

    Filtering on the edit time makes the overlay an inner join: features never edited are not in
    the feed.
    """
    grouped: dict[int, tuple[DataFrame, list[DataFrame]]] = {}
    for kind, (features, edits) in layers.items():
        recent = edits.where(F.col("update_time") >= F.lit(since).cast("timestamp")).select(
            F.col("id").cast("string").alias("_key"), "del_flag", F.col("update_time").alias("_edited"), F.lit(kind).alias("_type"))
        grouped.setdefault(id(features), (features, []))[1].append(recent)
    out = None
    for features, edits in grouped.values():
        # kinds that share a feature table meet it in one join; ids are compared as text, so their size is not that of the scan
        recent = reduce(lambda a, b: a.unionByName(b), edits)
        model = F.col("model")
        placeable = model.endswith(".glb") | model.endswith(".gltf")
        part = (
            features.where(placeable).hint("merge")
            .join(recent, features["id"].cast("string") == recent["_key"])
            .where(live_feature(F.col("del_flag"), F.col("lng"), features["id"]))
            .select(features["id"], F.col("_type").alias("type"), features["model"].alias("url"), features["lng"], features["lat"],
                    features["alt"], features["obj_angle"], F.col("_edited").alias("update_time"))
        )
        out = part if out is None else out.unionByName(part)
    return out
