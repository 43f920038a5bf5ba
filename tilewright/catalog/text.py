"""Text, time, cast and JSON columns."""

from pyspark.sql import functions as F

from tilewright.catalog.registry import query
from tilewright.catalog.sqltext import geohash, r
from tilewright.functions import cells, text as t
from tilewright.sources.derived import ASSETS, LAYER, POINTS

P, L = POINTS.sql(), LAYER.sql()
c = F.col


def shard_sql(h: str) -> str:
    return (f"array_to_string(list_concat(list_transform(range(0, CAST(greatest(ceil((length({h}) - 2) / CAST(2 AS DOUBLE)), 0) AS BIGINT)), "
            f"lambda k: substr({h}, 1, CAST(least(2 * k + 2, length({h}) - 2) AS INTEGER))), [{h}]), '/')")


FNV = ("list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(range(1, length(name) + 1), "
       "lambda k: CAST(unicode(substr(name, CAST(k AS INTEGER), 1)) AS UHUGEINT))), "
       "lambda a, b: CAST(xor(CAST(a AS UBIGINT), CAST(b AS UBIGINT)) AS UHUGEINT) * CAST(1099511628211 AS UHUGEINT) % CAST(18446744073709551616 AS UHUGEINT))")
M5 = "CAST(concat('0x', substr(md5(name), 1, 16)) AS UBIGINT)"

def short_sql() -> str:
    parts = [f"CASE WHEN n5 >= {62 ** k} THEN substr('{t.BASE62}', CAST(1 + (CAST(n5 AS UHUGEINT) // CAST({62 ** k} AS UHUGEINT)) % 62 AS INTEGER), 1) ELSE '' END"
             for k in range(11)]
    return "concat(" + ", ".join(parts) + ")"


@query("C23_text_helpers", f"""
    SELECT id, concat('tiles/', {shard_sql('h')}, '/lod', CAST(id % 4 AS VARCHAR), '.glb') AS tile_path,
       concat('subtilesets/', {shard_sql('h')}, '/tileset.json') AS subtree, printf('%x', CAST(f AS UBIGINT)) AS fnv, {short_sql()} AS md5s,
       CASE WHEN id % 7 = 0 THEN 'unknown' ELSE concat('a_b-', replace(name, '#', '')) END AS safe, CAST(id AS VARCHAR) AS cid,
       floor(balance * 10 + 0.5 * 1) / 10 AS fixed
    FROM (SELECT id, name, abs(balance) AS balance, h, {FNV} AS f, {M5} AS n5
          FROM (SELECT id, name, balance, substr({geohash('lng', 'lat', 11)}, 1, CAST(3 + id % 8 AS INTEGER)) AS h FROM ({L})))""")
def c23(spark, sf):
    df = LAYER.frame(spark, sf)
    h = F.substring(cells.point_hash(c("lng"), c("lat"), 11), F.lit(1), (c("id") % 8 + 3).cast("int"))
    df = df.withColumn("h", h)
    raw = F.when(c("id") % 7 == 0, F.lit(" ._/ ")).otherwise(F.regexp_replace(F.concat(F.lit("._a b-"), c("name"), F.lit("/._")), "#", "#"))
    safe = t.safe_filename(F.replace(raw, F.lit("#"), F.lit("")))
    return df.select("id", t.tile_model_path(c("h"), c("id") % 4).alias("tile_path"), t.subtree_path(c("h")).alias("subtree"),
                     t.fnv1a_hex(c("name")).alias("fnv"), t.md5_short(c("name")).alias("md5s"), safe.alias("safe"),
                     t.canonical_id(c("id").cast("double")).alias("cid"), t.to_fixed(F.abs(c("balance")), 1).alias("fixed"))


TIMES = ("id", "update_time",
         "CASE id % 5 WHEN 0 THEN date_format(update_time, 'yyyy-MM-dd HH:mm:ss') WHEN 1 THEN date_format(update_time, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") "
         "WHEN 2 THEN CAST(unix_seconds(update_time) AS STRING) WHEN 3 THEN CAST(unix_millis(update_time) AS STRING) ELSE 'soon' END AS txt")


@query("C24_time_encodings", f"""
    SELECT id, CASE WHEN id % 5 = 4 THEN NULL WHEN id % 5 = 2 AND epoch_us(update_time) < 1000000000000000 THEN NULL
       WHEN id % 5 = 3 AND epoch_us(update_time) < 1000000000000000 THEN NULL ELSE epoch_us(update_time) END AS us FROM ({P})""")
def c24(spark, sf):
    df = POINTS.frame(spark, sf).selectExpr(*TIMES)
    return df.select("id", F.unix_micros(t.parse_time(c("txt"))).alias("us"))


CASTS = "CASE id % 6 WHEN 0 THEN ' 12 ' WHEN 1 THEN '3.5' WHEN 2 THEN 'TRUE' WHEN 3 THEN '-4' WHEN 4 THEN NULL ELSE 'x' END"


@query("C25_loose_casts", f"""
    SELECT id, CASE id % 6 WHEN 0 THEN CAST(12 AS DOUBLE) WHEN 1 THEN 3.5 WHEN 3 THEN -4 ELSE 7 END AS d,
       CAST(CASE id % 6 WHEN 0 THEN 12 WHEN 3 THEN -4 ELSE 9 END AS BIGINT) AS n,
       CASE WHEN id % 6 = 4 THEN true ELSE id % 6 = 2 END AS b,
       CASE id % 6 WHEN 0 THEN CAST(12 AS DOUBLE) WHEN 1 THEN 3.5 ELSE 1 END AS storeys FROM ({P})""")
def c25(spark, sf):
    df = POINTS.frame(spark, sf).selectExpr("id", f"{CASTS} AS v")
    whole = F.when(c("v").rlike(r"^\s*-?\d+\s*$"), c("v"))
    return df.select("id", t.loose_double(c("v"), 7.0).alias("d"), t.loose_long(whole, 9).alias("n"),
                     t.loose_bool(c("v"), True).alias("b"), t.storeys(c("v")).alias("storeys"))


@query("C26_feature_id_mapping", f"""
    SELECT id, segment || '.' || CAST(id AS VARCHAR) AS feature_id, CAST(nation AS VARCHAR) AS by_field, CAST(id AS VARCHAR) AS plain,
       CASE segment WHEN 'BUILDING' THEN 'houses' WHEN 'MACHINERY' THEN 'plants' END AS layer FROM ({L})""")
def c26(spark, sf):
    df = LAYER.frame(spark, sf)
    key = c("id").cast("string")
    layers = df.select(c("segment").alias("prefix")).distinct().withColumn(
        "layer", F.when(c("prefix") == "BUILDING", "houses").when(c("prefix") == "MACHINERY", "plants"))
    ids = df.select("id", F.concat("segment", F.lit("."), t.feature_id(key, None)).alias("feature_id"),
                    t.feature_id(key, "eq", field=c("nation")).alias("by_field"), t.feature_id(key, "none").alias("plain"))
    return t.route_features(ids, layers).select("id", "feature_id", "by_field", "plain", "layer")


@query("C27_lod_mode", f"""
    SELECT ord, model, CASE WHEN model LIKE 'm1%' OR model LIKE 'm20%' THEN 'copy-lod3' ELSE 'skip' END AS by_prefix,
       'local' AS by_default, 'reuse-lod3' AS fixed FROM ({ASSETS.sql()})""")
def c27(spark, sf):
    df = ASSETS.frame(spark, sf)
    raw = F.concat(F.lit("./"), c("model"))
    return df.select("ord", "model", t.lod_mode(raw, "copy-lod3-by-prefix", ["./m1", "m20", " "], "Skip").alias("by_prefix"),
                     t.lod_mode(c("model"), " ").alias("by_default"), t.lod_mode(c("model"), "Reuse-LOD3").alias("fixed"))


@query("C28_json_set_and_images", f"""
    SELECT id, concat('G', CAST(id AS VARCHAR)) AS grade, CAST(nation AS VARCHAR) AS nation, 'new' AS owner_name, segment AS old_grade,
       CAST(2 AS BIGINT) AS n_keys, concat('{{"grade":"', segment, '","status":', CASE WHEN status IS NULL THEN 'null' ELSE concat('"', status, '"') END, '}}') AS image
    FROM ({L})""")
def c28(spark, sf):
    df = LAYER.frame(spark, sf)
    new = t.json_set(t.json_set(c("props"), ["grade"], F.concat(F.lit("G"), c("id").cast("string"))), ["owner", "name"], F.lit("new"))
    df = df.withColumn("new", new)
    get = lambda col, p: F.get_json_object(col, p)
    return df.select("id", get("new", "$.grade").alias("grade"), get("new", "$.owner.nation").alias("nation"),
                     get("new", "$.owner.name").alias("owner_name"), get("props", "$.grade").alias("old_grade"),
                     F.json_array_length(F.to_json(F.json_object_keys("new"))).cast("bigint").alias("n_keys"),
                     t.json_image(grade=get("props", "$.grade"), status=c("status")).alias("image"))
