"""Lines and surfaces against cells: distance joins, ownership, clipping, plausibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import cells
from tilewright.functions.geodesy import SEMI_MAJOR, bind
from tilewright.operators.boxes import grid_cells
from tilewright.operators.nearest import segment_distance

# Tolerance of a shared cell edge in metres.
EDGE_TOLERANCE = 1e-5


def lines_near_cells(segments: DataFrame, level: int, metres: float, key: str = "line_id") -> DataFrame:
    """Distinct (line, cell) pairs with a segment closer to the cell than ``metres``, in the cell's local frame."""
    pad = metres / 111000.0 * 2 + 0.00011
    lng_bits, lat_bits = cells.grid_bits(level)
    # a degree of longitude shrinks towards the poles
    wide = pad / F.greatest(F.cos(F.radians(F.least(F.greatest(F.abs(F.col("y1")), F.abs(F.col("y2"))) + pad, F.lit(90.0)))), F.lit(1e-6))
    rows = segments.withColumn("gx", F.explode(cells.grid_span(F.least("x1", "x2") - wide, F.greatest("x1", "x2") + wide, -180.0, 360.0, lng_bits))).withColumn(
        "gy", F.explode(cells.grid_span(F.least("y1", "y2") - pad, F.greatest("y1", "y2") + pad, -90.0, 180.0, lat_bits)))
    box = cells.index_bbox(F.col("gx"), F.col("gy"), level)
    shrink = F.cos(F.radians(box["south"]))
    mx = lambda v: F.radians(v - box["west"]) * SEMI_MAJOR * shrink
    my = lambda v: F.radians(v - box["south"]) * SEMI_MAJOR
    rows = rows.withColumns({"_x1": mx(F.col("x1")), "_x2": mx(F.col("x2")), "_y1": my(F.col("y1")), "_y2": my(F.col("y2")),
                             "_w": mx(box["east"]), "_h": my(box["north"])})
    x1, y1, x2, y2, w, h, z = (*(F.col(k) for k in ("_x1", "_y1", "_x2", "_y2", "_w", "_h")), F.lit(0.0))
    corner = [segment_distance(px, py, x1, y1, x2, y2)[0] for px in (z, w) for py in (z, h)]
    end = [F.hypot(F.greatest(-x, x - w, z), F.greatest(-y, y - h, z)) for x, y in ((x1, y1), (x2, y2))]
    from tilewright.functions.predicates import segment_meets_box

    near = (F.least(*corner, *end) <= metres) | segment_meets_box(x1, y1, x2, y2, z, z, w, h)
    return rows.where(near).select(key, "gx", "gy").distinct()


def longest_line(lengths: DataFrame, key: str, length: str, order: str) -> DataFrame:
    """Longest line per key, the first on ties: one combined aggregate, whatever the size of a key."""
    rest = [c for c in lengths.columns if c != key]
    return lengths.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(-F.col(length), F.col(order))).alias("_b")).select(key, "_b.*")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)


def cell_owner(points: DataFrame, boxes: DataFrame, key: str, size: float) -> DataFrame:
    """First cell in order that holds each point, shared edges included by a small tolerance."""
    spread = boxes.withColumn("_c", F.explode(grid_cells(F.col("bw") - EDGE_TOLERANCE, F.col("bs") - EDGE_TOLERANCE,
                                                         F.col("be") + EDGE_TOLERANCE, F.col("bn") + EDGE_TOLERANCE, size)))
    probe = points.withColumns({"_gx": F.floor(F.col("px") / size), "_gy": F.floor(F.col("py") / size)})
    met = probe.hint("merge").join(spread, (F.col("_c.gx") == F.col("_gx")) & (F.col("_c.gy") == F.col("_gy")))
    t = EDGE_TOLERANCE
    inside = (F.col("px") >= F.col("bw") - t) & (F.col("px") <= F.col("be") + t) & (F.col("py") >= F.col("bs") - t) & (F.col("py") <= F.col("bn") + t)
    return met.where(inside).groupBy(key).agg(F.min("cell").alias("owner"))


def plausible_centrelines(triangles: DataFrame, vertices: DataFrame, margin: float = 5.0) -> DataFrame:
    """Surfaces with at least two vertices of their centreline inside their widened box."""
    box = triangles.groupBy("road_id").agg(
        F.min(F.least("x1", "x2", "x3")).alias("w"), F.max(F.greatest("x1", "x2", "x3")).alias("e"),
        F.min(F.least("y1", "y2", "y3")).alias("s"), F.max(F.greatest("y1", "y2", "y3")).alias("n"))
    inside = (F.col("x") >= F.col("w") - margin) & (F.col("x") <= F.col("e") + margin) & (F.col("y") >= F.col("s") - margin) & (F.col("y") <= F.col("n") + margin)
    return vertices.hint("merge").join(box, "road_id").groupBy("road_id").agg((F.sum(inside.cast("bigint")) >= 2).alias("plausible"))


def _clip_half(polygon: Column, axis: str, limit: Column, keep_above: bool) -> Column:
    """Convex polygon against one half plane; crossing points interpolate every coordinate."""
    def clip(poly: Column) -> Column:
        after = F.concat(F.slice(poly, F.lit(2), F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, F.lit(1), F.lit(1)))

        def edge(a: Column, b: Column) -> Column:
            side = (lambda p: p[axis] - limit) if keep_above else (lambda p: limit - p[axis])
            da, db = side(a), side(b)
            t = da / (da - db)
            cross = F.struct(*[(a[k] + (b[k] - a[k]) * t).alias(k) for k in "xyz"])
            none = F.filter(F.array(a), lambda p: F.lit(False))
            start = F.when(da >= 0, F.array(a)).otherwise(none)
            return F.when((da > 0) & (db < 0) | (da < 0) & (db > 0), F.concat(start, F.array(cross))).otherwise(start)

        return F.flatten(F.zip_with(poly, after, edge))

    return bind(polygon, clip)


def slice_triangles(triangles: DataFrame, size: float, keys: Sequence[str] = ("road_id", "tri_id")) -> DataFrame:
    """Triangles cut along a square grid: (keys, gx, gy, polygon, area); attributes are interpolated, area is kept."""
    corners = F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"), F.col(f"z{k}").alias("z")) for k in (1, 2, 3)])
    low, high = ({a: fn(*[f"{a}{k}" for k in (1, 2, 3)]) for a in "xy"} for fn in (F.least, F.greatest))
    rows = triangles.select(*keys, *[f"{a}{k}" for a in "xyz" for k in (1, 2, 3)], F.explode(grid_cells(low["x"], low["y"], high["x"], high["y"], size)).alias("c"))
    poly, whole = corners, F.lit(True)
    for axis, g in (("x", "gx"), ("y", "gy")):
        first, last = F.col(f"c.{g}") * size, (F.col(f"c.{g}") + 1) * size
        poly = _clip_half(_clip_half(poly, axis, first, True), axis, last, False)
        whole = whole & (low[axis] >= first) & (high[axis] <= last)
    # a triangle wholly in its cell needs no cut; the generator keeps later filters from working the cuts out again
    kept = F.filter(F.array(F.when(whole, corners).otherwise(poly)), lambda p: F.size(p) >= 3)
    from tilewright.operators.surfaces import ring_area

    return rows.select(*keys, "c", F.explode(kept).alias("poly")).withColumn("area", F.abs(ring_area(F.col("poly")))).where("area > 0").select(
        *keys, F.col("c.gx").alias("gx"), F.col("c.gy").alias("gy"), "poly", "area")


def fan(slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Clipped polygons as triangles around their first vertex."""
    return slices.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.size("poly") - 2), lambda k: F.struct(
        F.col("poly")[0].alias("a"), F.get(F.col("poly"), k).alias("b"), F.get(F.col("poly"), k + 1).alias("c")))).alias("t"))


def conservation(source: DataFrame, slices: DataFrame, key: str, tolerance: float = 1e-5) -> DataFrame:
    """Per source feature: area before and after slicing, whether it is kept, and whether it was split."""
    after = slices.groupBy(key).agg(F.sum("area").alias("sliced"), F.count_distinct(F.struct("gx", "gy")).alias("cells"))
    return source.hint("merge").join(after, key, "left").select(
        key, "area", F.coalesce("sliced", F.lit(0.0)).alias("sliced"), (F.abs(F.coalesce("sliced", F.lit(0.0)) - F.col("area")) <= F.col("area") * tolerance).alias("kept"),
        (F.coalesce("cells", F.lit(0)) > 1).alias("split"))
