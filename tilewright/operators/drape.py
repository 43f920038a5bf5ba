"""Heights of points and lines from surface triangles and surface points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators import lines
from tilewright.operators.nearest import segment_distance, within
from tilewright.operators.ordering import ranked
from tilewright.session import tasks_for

# Reach and weights of the height search.
SEARCH, MATCH_REACH, MATCH_RISE, OFFSET = 2.0, 2.0, 1.0, 0.02
#: Metres of the cells in which points meet triangles: about as large as a triangle of a road.
CELL = 16.0
#: Surface points for each task in which vertices meet them.
MET = 200_000


def _weights(px: Column, py: Column) -> tuple[Column, Column]:
    """The shares of the first two corners at a point; null for a triangle without an area."""
    x1, y1, x2, y2, x3, y3 = (F.col(k) for k in ("x1", "y1", "x2", "y2", "x3", "y3"))
    den = (y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)
    safe = F.when(F.abs(den) < 1e-12, F.lit(None)).otherwise(den)
    return ((y2 - y3) * (px - x3) + (x3 - x2) * (py - y3)) / safe, ((y3 - y1) * (px - x3) + (x1 - x3) * (py - y3)) / safe


def triangle_items(triangles: DataFrame) -> DataFrame:
    return triangles.withColumns({"bw": F.least("x1", "x2", "x3"), "be": F.greatest("x1", "x2", "x3"),
                                  "bs": F.least("y1", "y2", "y3"), "bn": F.greatest("y1", "y2", "y3")})


def candidates(points: DataFrame, triangles: DataFrame, key: str, on: tuple[str, ...] = ("road_id",)) -> DataFrame:
    """Triangles within reach of each point (px, py, pz) with plane distance and height there."""
    px, py = F.col("px"), F.col("py")
    rows = within(points, triangle_items(triangles), F.lit(0.0), SEARCH, on, size=CELL).where(
        (px >= F.col("bw") - SEARCH) & (px <= F.col("be") + SEARCH) & (py >= F.col("bs") - SEARCH) & (py <= F.col("bn") + SEARCH))
    # in steps, each worked out once: with all in one expression the generated method is too long to be compiled, and a filter would repeat it
    sides = (("1", "2"), ("2", "3"), ("3", "1"))
    rows = rows.select(key, "tri_id", "pz", "px", "py", *[v + k for v in "xyz" for k in "123"], F.explode(F.array(F.struct(*[
        segment_distance(px, py, F.col("x" + p), F.col("y" + p), F.col("x" + q), F.col("y" + q))[1].alias("t" + p) for p, q in sides]))).alias("m"))
    edges = []
    for p, q in sides:
        t = F.col("m.t" + p)
        ex, ey = px - (F.col("x" + p) + t * (F.col("x" + q) - F.col("x" + p))), py - (F.col("y" + p) + t * (F.col("y" + q) - F.col("y" + p)))
        edges.append(F.struct(F.sqrt(ex * ex + ey * ey).alias("d"), (F.col("z" + p) + (F.col("z" + q) - F.col("z" + p)) * t).alias("h")))
    rows = rows.select(key, "tri_id", "pz", "px", "py", *[v + k for v in "xyz" for k in "123"], F.explode(F.array(F.least(*edges))).alias("edge"))
    a, b = _weights(px, py)
    rows = rows.select(key, "tri_id", "pz", "edge", "z1", "z2", "z3", F.explode(F.array(F.struct(a.alias("a"), b.alias("b")))).alias("m"))
    a, b = F.col("m.a"), F.col("m.b")
    c = F.lit(1.0) - a - b
    inside = F.coalesce((a >= -1e-9) & (b >= -1e-9) & (c >= -1e-9), F.lit(False))
    met = F.when(inside, F.struct(F.lit(0.0).alias("d"), (a * F.col("z1") + b * F.col("z2") + c * F.col("z3")).alias("h"))).otherwise(F.col("edge"))
    rows = rows.select(key, "tri_id", "pz", F.explode(F.array(met)).alias("m"))
    found = rows.select(key, "tri_id", "pz", F.col("m.d").alias("dist"), F.col("m.h").alias("height")).where(F.col("dist") <= SEARCH)
    return found.select(key, "tri_id", "dist", "height", F.abs(F.col("height") - F.col("pz")).alias("rise"))


def best_candidates(found: DataFrame, key: str, count: int) -> DataFrame:
    """The best candidates per point by (distance, rise, id); the limit is applied before the shuffle too."""
    w = Window.partitionBy(key).orderBy("dist", "rise", "tri_id")
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= count)


def weighted_height(found: DataFrame, key: str) -> DataFrame:
    """Height per point: over all containing triangles, otherwise over the four best by (distance, rise)."""
    w = Window.partitionBy(key).orderBy("dist", "rise", "tri_id")
    ranked = found.withColumn("_rank", F.row_number().over(w)).where((F.col("_rank") <= 4) | (F.col("dist") == 0))
    inner = F.lit(1.0) / F.greatest(F.lit(0.02), F.col("rise") + 0.1)
    outer = F.lit(1.0) / F.greatest(F.lit(0.05), F.col("dist") * F.col("dist") + F.col("rise") * F.col("rise") * 0.25)
    in_w = F.when(F.col("dist") == 0, inner)
    out_w = F.when(F.col("_rank") <= 4, outer)
    return ranked.groupBy(key).agg(
        F.coalesce(F.sum(in_w * F.col("height")) / F.sum(in_w), F.sum(out_w * F.col("height")) / F.sum(out_w)).alias("height"),
        F.count("*").alias("used"))


def project_points(points: DataFrame, triangles: DataFrame, key: str, on_road: str = "road_id") -> DataFrame:
    """Heights from the point's own road; points whose road has no triangles at all may use any road's."""
    covered = points.hint("merge").join(triangles.select(on_road).distinct(), on_road, "left_semi")
    stray = points.hint("merge").join(triangles.select(on_road).distinct(), on_road, "left_anti")
    found = candidates(covered, triangles, key, (on_road,)).unionByName(
        candidates(stray.drop(on_road), triangles, key, ()))
    return weighted_height(found, key)


def drape_to_points(vertices: DataFrame, surface: DataFrame, key: str, on: str = "road_id") -> DataFrame:
    """Height of the best surface point of the same road (nearest, then smallest rise, then id), or the own height; plus the offset."""
    # a surface point is where it is: no box goes along, and wide cells leave few points in more than one
    spark = vertices.sparkSession
    tasks = tasks_for(spark, surface.count(), MET)
    size = MATCH_REACH * 8
    cell = {"_gx": F.floor(F.col("px") / size), "_gy": F.floor(F.col("py") / size)}
    cells = [F.explode(F.sequence(F.floor((F.col(p) - MATCH_REACH) / size), F.floor((F.col(p) + MATCH_REACH) / size))).alias(g) for p, g in (("sx", "_gx"), ("sy", "_gy"))]
    spread = surface.where("sx IS NOT NULL AND sy IS NOT NULL").select(on, "surface_id", "sx", "sy", "sz")
    for c in cells:
        spread = spread.select("*", c)
    probe = vertices.select(key, on, "px", "py", "pz").withColumns(cell)
    at, dx, dy = [on, "_gx", "_gy"], F.col("sx") - F.col("px"), F.col("sy") - F.col("py")
    near = probe.repartition(tasks, *at).hint("merge").join(spread.repartition(tasks, *at), at).select(
        key, "surface_id", "sz", F.sqrt(dx * dx + dy * dy).alias("distance"), F.abs(F.col("sz") - F.col("pz")).alias("rise")).where(
        (F.col("distance") <= MATCH_REACH) & (F.col("rise") <= MATCH_RISE))
    best = near.groupBy(key).agg(F.min_by("sz", F.struct("distance", "rise", "surface_id")).alias("face"))
    return vertices.hint("merge").join(best, key, "left").withColumn("z", F.coalesce("face", "pz", F.lit(0.0)) + OFFSET)


def drape_lines(vertices: DataFrame, triangles: DataFrame, step: float, reach: float) -> DataFrame:
    """Whole lines onto surfaces: densify, height per sample, gaps filled by station, heights smoothed along the line."""
    dense = lines.densify(lines.segments_of(vertices), step)
    samples = ranked(dense, ["line_id"], ["seg", "j"], "ord").withColumn("ord", F.col("ord") - 1).drop("seg", "j")
    stationed = lines.stations(lines.segments_of(samples, order="ord"), order="ord")
    vertex = lines.vertices_of(stationed.withColumnRenamed("ord", "i"))
    vertex = vertex.withColumn("sample", F.concat_ws(":", "line_id", "ord"))
    points = vertex.select("sample", F.col("line_id").alias("road_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    heights = project_points(points, triangles, "sample")
    joined = vertex.hint("merge").join(heights.select("sample", "height"), "sample", "left").drop("z").withColumnRenamed("height", "z")
    filled = lines.fill_unmatched(joined)
    return lines.average_by_distance(filled, reach, value="filled")
