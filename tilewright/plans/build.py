"""Build and rebuild jobs: leaf assignment, poses, hierarchy, dynamic manifests, dirty leaves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import cells, geodesy as g
from tilewright.functions.predicates import Bound, in_bound, model_ok
from tilewright.functions.text import fnv1a_hex, plain_number, to_fixed, versioned_uri
from tilewright.operators import refine, tiles
from tilewright.session import checkpoint


@dataclass(frozen=True)
class TilesetSpec:
    """A named group of layers that share one partition."""

    name: str
    bound: Bound
    threshold: int = refine.DEFAULT_THRESHOLD
    split_level: int = 5
    lod: tuple[tiles.LodLevel, ...] = (tiles.LodLevel(3, 0.0),)
    lod_enabled: bool = False


def encoded(points: DataFrame, bound: Bound) -> DataFrame:
    return points.where(in_bound(F.col("lng"), F.col("lat"), bound)).withColumn("code", cells.point_code(F.col("lng"), F.col("lat")))


def leaf_levels(leaves: DataFrame) -> list[int]:
    """Levels that hold leaves: at most nine numbers, read once so that points emit no useless ancestors."""
    return sorted(r[0] for r in leaves.select("level").distinct().collect())


def assign(points: DataFrame, bound: Bound, threshold: int = refine.DEFAULT_THRESHOLD, tree: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Leaves of the refined partition, and every placeable feature with its leaf."""
    if tree is None:
        tree = refine.refine_points(points, bound, threshold)
    leaves = refine.leaves(tree)
    placed = encoded(points.where(model_ok(F.col("model"))), bound)
    return leaves, tiles.to_leaves(placed, leaves.select("level", "cell"), levels=leaf_levels(leaves))


def pose_table(instances: DataFrame) -> DataFrame:
    """Attributes of placed instances as text, with bindings from the service JSON, and their placement matrix."""
    bound = lambda k: F.coalesce(F.get_json_object("service_data", f"$.{k}"), F.lit(""))
    stored = g.stored_matrix(F.col("metadata"))
    pose = F.array(*g.pose_matrix(F.col("lng"), F.col("lat"), F.col("alt"), F.col("obj_angle"), scale=g.trs_scale(F.col("transform"))))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = lambda c, d: plain_number(F.coalesce(c, F.lit(0.0)), d)
    return instances.select(
        F.concat("table_name", F.lit("."), F.col("id").cast("string")).alias("id"), F.col("id").cast("string").alias("fid"), F.col("type").alias("ftype"),
        bound("bindName").alias("name"), bound("bindType").alias("type"), bound("bindId").alias("bid"),
        number(F.col("width"), 3).alias("width"), number(F.col("height"), 3).alias("height"),
        number(F.col("lng"), 8).alias("lng"), number(F.col("lat"), 8).alias("lat"), number(F.col("alt"), 3).alias("alt"),
        F.format_string("%.3f", to_fixed(F.coalesce("km_value", F.lit(0.0)), 3)).alias("km_value"), text("travel_type").alias("travel_type"),
        text("road_name").alias("road_name"), text("type_code").alias("type_code"), stored.isNotNull().alias("stored"), F.coalesce(stored, pose).alias("matrix"))


def hierarchy_rows(leaves: DataFrame, instances: DataFrame, base: float) -> tuple[DataFrame, DataFrame]:
    """Leaf rows with box, extent and counts, and the grouping nodes above them; the instances are read once."""
    extent = tiles.leaf_extent(instances, counted=True)
    rows = refine.describe_cells(checkpoint(leaves.hint("merge").join(extent, ["level", "cell"])))
    region = F.array(*g.bound_region(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.col("low").cast("double"), F.col("high").cast("double")))
    rows = rows.withColumn("region", region).withColumn("box", g.region_box(F.col("region"), tiles.LEAF_GROWTH))
    rows = rows.withColumn("error", F.lit(0.0))
    return rows, tiles.roll_up(rows, base)


def dynamic_manifest(changed: DataFrame, code: str, margin: float = 20.0) -> DataFrame:
    """One node per changed instance: placement, fixed box, versioned address."""
    tag = fnv1a_hex(F.lit(code))
    fixed = lambda c: F.format_string("%.6f", F.bround(c, 6))
    uri = versioned_uri(F.col("url"), F.col("update_time"), code=tag, fid=F.col("id"), type=F.col("type"),
                        lng=fixed(F.col("lng")), lat=fixed(F.col("lat")), alt=fixed(F.col("alt")))
    return changed.select(
        "id", uri.alias("uri"), F.lit(500.0).alias("error"), F.lit("ADD").alias("refine"),
        F.array(*g.pose_matrix(F.col("lng"), F.col("lat"), F.col("alt"), F.col("obj_angle"))).alias("matrix"),
        F.array(*g.margin_box(F.col("lng"), F.col("lat"), F.col("alt"), F.lit(margin))).alias("box"))


def dirty_leaves(changed_points: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves holding a changed point, and changed points outside every leaf (these ask for a full refresh)."""
    coded = changed_points.withColumn("code", cells.point_code(F.col("lng"), F.col("lat")))
    levels = leaf_levels(leaves)
    inside = tiles.to_leaves(coded, leaves.select("level", "cell"), levels=levels)
    return inside.select("level", "cell").distinct(), tiles.unmatched_points(coded, leaves, levels=levels)


def rebuild(features: DataFrame, changed_points: DataFrame, leaves: DataFrame, bound: Bound) -> tuple[DataFrame, DataFrame]:
    """Model groups of the dirty leaves only, and the points that need a full refresh."""
    dirty, outside = dirty_leaves(changed_points, leaves)
    placed = encoded(features.where(model_ok(F.col("model"))), bound).withColumn("has_content", F.lit(True))
    return tiles.group_models(tiles.to_leaves(placed, dirty, levels=leaf_levels(dirty))), outside
