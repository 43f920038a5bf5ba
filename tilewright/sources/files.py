"""GeoJSON, CSV and WKT sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.text import safe_filename, storeys
from tilewright.operators.surfaces import local_footprint, ring_area, ring_box_centre

GEOJSON = (
    "type string, geometry struct<type:string,coordinates:string>, properties map<string,string>, "
    "features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>")


def read_geojson(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Features of FeatureCollections (one document per line, or per file) and of line-delimited features.

    Coordinates stay text until a kind is known. Missing ids and names become empty.
    """
    text = spark.read.option("wholetext", str(whole_files).lower()).text(path)
    doc = text.select(F.from_json("value", GEOJSON).alias("d")).where("d IS NOT NULL")
    one = F.array(F.struct(F.col("d.type"), F.col("d.geometry"), F.col("d.properties")))
    feats = doc.select(F.explode(F.coalesce("d.features", one)).alias("f")).where("f.geometry IS NOT NULL")
    prop = lambda k: F.try_element_at("f.properties", F.lit(k))
    return feats.select(
        F.coalesce(prop("id"), F.lit("")).alias("id"), F.coalesce(prop("name"), F.lit("")).alias("name"),
        F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def surface_features(features: DataFrame) -> DataFrame:
    """Polygons with their road, taken from the older field name where the newer is missing."""
    prop = lambda k: F.try_element_at("properties", F.lit(k))
    ring = F.from_json("coordinates", "array<array<array<double>>>")
    return features.where(F.col("kind") == "Polygon").select(
        "id", "name", F.coalesce(prop("road_id"), prop("hroad_id")).alias("road_id"), F.lit("surface").alias("feature_type"),
        F.transform(ring[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"), F.coalesce(F.get(p, F.lit(2)), F.lit(0.0)).alias("z"))).alias("ring"))


def centreline_features(features: DataFrame) -> DataFrame:
    """Lines with their road reference, taken from ``ldid`` when neither road field is set."""
    number = lambda k: F.coalesce(F.try_element_at("properties", F.lit(k)).try_cast("bigint"), F.lit(0))
    unset = (number("hroad_id") == 0) & (number("road_id") == 0) & (number("ldid") != 0)
    line = F.from_json("coordinates", "array<array<double>>")
    return features.where(F.col("kind") == "LineString").select(
        "id", F.when(unset, number("ldid")).otherwise(number("hroad_id")).alias("hroad_id"),
        F.transform(line, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"), F.coalesce(F.get(p, F.lit(2)), F.lit(0.0)).alias("z"))).alias("line"))


def read_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """CSV as text columns; missing required columns are an error before any job runs."""
    df = spark.read.option("header", "true").option("escape", '"').option("multiLine", "false").csv(path)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"CSV fields not found: {missing}")
    return df


def parse_polygon(text: Column) -> Column:
    """Outer ring of POLYGON / POLYGON Z text without its closing vertex; null when it has fewer than three vertices."""
    inner = F.regexp_extract(text, r"(?i)^\s*POLYGON\s*Z?\s*\(\s*\(([^()]*)\)", 1)
    points = F.transform(F.split(inner, ","), lambda t: F.split(F.trim(t), r"\s+"))
    ring = F.transform(points, lambda p: F.struct(
        F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y"),
        F.coalesce(F.get(p, F.lit(2)).try_cast("double"), F.lit(0.0)).alias("z")))
    first, last = F.get(ring, F.lit(0)), F.try_element_at(ring, F.lit(-1))
    shut = (F.abs(first["x"] - last["x"]) < 1e-12) & (F.abs(first["y"] - last["y"]) < 1e-12) & (F.size(ring) >= 2)
    opened = F.when(shut, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)
    fine = (F.size(opened) >= 3) & ~F.exists(opened, lambda p: p["x"].isNull() | p["y"].isNull())
    return F.when(fine, opened)


def parse_point(text: Column) -> Column:
    """POINT / POINT Z text as (x, y, z); null when malformed or not finite."""
    number = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"(?i)^\s*POINT\s*Z?\s*\(\s*{number}\s+{number}(?:\s+{number})?\s*\)\s*$"
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("double")
    return F.when(part(1).isNotNull() & part(2).isNotNull(), F.struct(part(1).alias("x"), part(2).alias("y"), F.coalesce(part(3), F.lit(0.0)).alias("z")))


def place_buildings(rows: DataFrame, kinds: Sequence[str], existing: DataFrame | None = None) -> DataFrame:
    """Placement rows with a status each: ok, skipped (already there or no height), ignored (other kind), failed (bad geometry)."""
    df = rows.withColumns({"ring": parse_polygon(F.col("geometry")), "tall": F.trim("height").try_cast("double"), "model": F.concat(safe_filename(F.col("id")), F.lit(".glb"))})
    if existing is not None:
        df = df.join(existing.select("model", F.lit(True).alias("_there")), "model", "left")
    else:
        df = df.withColumn("_there", F.lit(None).cast("boolean"))
    good_height = F.coalesce(~F.isnan("tall") & (F.col("tall") > 0) & (F.col("tall") < float("inf")), F.lit(False))
    status = (F.when(~F.coalesce(F.trim("kind").isin(*kinds), F.lit(False)), "ignored").when(F.col("_there"), "skipped").when(~good_height, "skipped")
              .when(F.col("ring").isNull(), "failed").otherwise("ok"))
    mid = ring_box_centre(F.col("ring"))
    df = df.withColumns({"status": status, "lng": mid["x"], "lat": mid["y"], "alt": mid["z"]})
    foot = F.abs(ring_area(local_footprint(F.col("ring"), F.col("lng"), F.col("lat"))))
    ok = F.col("status") == "ok"
    fixed = lambda c, d: F.when(ok, F.format_string(f"%.{d}f", F.col(c)))
    return df.select("id", "kind", "model", "status", fixed("lng", 9).alias("longitude"), fixed("lat", 9).alias("latitude"), fixed("alt", 6).alias("altitude"),
                     fixed("tall", 6).alias("height"), F.when(ok, storeys(F.col("storeys"))).alias("storeys"), F.when(ok, F.round(foot, 2)).alias("footprint"))


def place_signs(rows: DataFrame) -> DataFrame:
    """Text-sign placements from point text: ok, skipped (no text), failed (bad geometry)."""
    df = rows.withColumn("p", parse_point(F.col("geometry")))
    status = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0, "skipped").when(F.col("p").isNull(), "failed").otherwise("ok")
    ok = F.col("status") == "ok"
    return df.withColumn("status", status).select(
        "id", "status", F.when(ok, F.concat(safe_filename(F.col("id")), F.lit(".glb"))).alias("model"),
        *[F.when(ok, F.format_string(f"%.{d}f", F.col(f"p.{a}"))).alias(n) for a, n, d in (("x", "longitude", 9), ("y", "latitude", 9), ("z", "altitude", 3))])
