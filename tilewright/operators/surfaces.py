"""Collections of polygons and vertices: context, padded boxes, measures, axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geodesy import ECC2, SEMI_MAJOR, bind


def collection_context(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base point (box centre) and region of exploded vertices; empty collections give no row."""
    return points.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*keys).agg(
        ((F.min("x") + F.max("x")) / 2).alias("base_lng"), ((F.min("y") + F.max("y")) / 2).alias("base_lat"),
        F.min("x").alias("w"), F.min("y").alias("s"), F.max("x").alias("e"), F.max("y").alias("n"))


def padded_box(points: DataFrame, keys: Sequence[str], constant: float, least: float, ratio: float) -> DataFrame:
    """Centre and half sizes of a content box; every half grows by the largest of a constant, a minimum and a share of the span."""
    spans = points.groupBy(*keys).agg(*[fn(a).alias(f"{p}{a}") for a in "xyz" for p, fn in (("lo_", F.min), ("hi_", F.max))])
    out = [*keys]
    for a in "xyz":
        low, high = F.col(f"lo_{a}"), F.col(f"hi_{a}")
        out += [((low + high) / 2).alias(f"c{a}"),
                ((high - low) / 2 + F.greatest(F.lit(constant), F.lit(least), F.lit(ratio) * (high - low))).alias(f"h{a}")]
    return spans.select(*out)


def ring_area(ring: Column) -> Column:
    """Signed area of an array of (x, y) with the closing edge implied."""
    def area(r: Column) -> Column:
        after = F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
        terms = F.zip_with(r, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
        return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v) / 2

    return bind(ring, area)


def ring_box_centre(ring: Column) -> dict[str, Column]:
    mid = lambda a: (F.array_min(F.transform(ring, lambda p: p[a])) + F.array_max(F.transform(ring, lambda p: p[a]))) * 0.5
    return {a: mid(a) for a in "xyz"}


def local_footprint(ring: Column, lng: Column, lat: Column) -> Column:
    """Ring in metres about an anchor, by the radii of curvature at its latitude, counter-clockwise."""
    phi = F.radians(lat)
    s2 = F.lit(1.0) - F.lit(ECC2) * F.sin(phi) * F.sin(phi)
    across = F.lit(SEMI_MAJOR) / F.sqrt(s2) * F.cos(phi)
    along = F.lit(SEMI_MAJOR * (1 - ECC2)) / F.pow(s2, 1.5)
    made = bind(F.struct(across.alias("across"), along.alias("along")), lambda m: F.transform(ring, lambda p: F.struct(
        (F.radians(p["x"] - lng) * m["across"]).alias("x"), (F.radians(p["y"] - lat) * m["along"]).alias("y"))))
    return bind(made, lambda r: F.when(ring_area(r) < 0, F.reverse(r)).otherwise(r))


def largest_part(parts: Column) -> Column:
    """Ring with the largest absolute area."""
    sized = F.transform(parts, lambda r: F.struct(F.abs(ring_area(r)).alias("a"), r.alias("r")))
    return F.array_max(sized)["r"]


def principal_axis(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Direction of the longest spread of each group's points and the centre of their extent along it."""
    m = points.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"),
                                  F.covar_pop("x", "y").alias("vxy"))
    axis = m.withColumn("angle", F.atan2(F.col("vxy") * 2, F.col("vx") - F.col("vy")) * 0.5)
    co, si = F.cos("angle"), F.sin("angle")
    rows = points.hint("merge").join(axis.select(*keys, "angle"), list(keys)).withColumns(
        {"u": F.col("x") * co + F.col("y") * si, "v": -F.col("x") * si + F.col("y") * co})
    spans = rows.groupBy(*keys).agg(F.first("angle").alias("angle"), *[fn(a).alias(f"{p}{a}") for a in "uv" for p, fn in (("lo_", F.min), ("hi_", F.max))])
    cu, cv = (F.col("lo_u") + F.col("hi_u")) / 2, (F.col("lo_v") + F.col("hi_v")) / 2
    return spans.select(*keys, "angle", (cu * F.cos("angle") - cv * F.sin("angle")).alias("cx"), (cu * F.sin("angle") + cv * F.cos("angle")).alias("cy"),
                        (F.col("hi_u") - F.col("lo_u")).alias("length"), (F.col("hi_v") - F.col("lo_v")).alias("width"))
