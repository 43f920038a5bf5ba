"""Leaves, groups, hierarchy, manifests and rebuilds."""

from pyspark.sql import functions as F

from tilewright.catalog.geodesy import corner_sql, ecef_sql, geodetic_sql
from tilewright.catalog.layers import PG, latest_edits
from tilewright.catalog.partition import BOUND, INB, OK, duck_bbox, tree_sql
from tilewright.catalog.registry import query
from tilewright.catalog.sqltext import geohash, r
from tilewright.functions import cells, geodesy as g
from tilewright.operators import refine, tiles as tl
from tilewright.plans import build
from tilewright.sources.derived import ASSETS, EDITS, HOT_POINTS, MODEL_VERTICES, POINTS, POLYGONS

P, H = POINTS.sql(), HOT_POINTS.sql()
c = F.col
LEAF = tree_sql(P) + """, leaf AS MATERIALIZED (SELECT level, geohash, total_count FROM tree t
    WHERE NOT EXISTS (SELECT 1 FROM tree k WHERE k.level = t.level + 1 AND substr(k.geohash, 1, t.level) = t.geohash)),
    pt AS MATERIALIZED (SELECT *, """ + geohash("lng", "lat", 11) + f""" AS h FROM ({P}) WHERE {OK} AND {INB}),
    inst AS MATERIALIZED (SELECT pt.*, leaf.geohash, leaf.level FROM leaf JOIN pt ON substr(pt.h, 1, CAST(leaf.level AS INTEGER)) = leaf.geohash)"""
COARSE = geohash("lng", "lat", 5)


def assigned(spark, sf):
    return build.assign(POINTS.frame(spark, sf), BOUND)


def named(df):
    return df.withColumn("geohash", cells.code_to_hash_at(c("cell"), c("level")))


def coarse(spark, sf):
    """Placeable points in level-5 cells, for operators that need leaves but not the refinement."""
    df = build.encoded(POINTS.frame(spark, sf).where(OK), BOUND)
    return df.select("*", F.lit(5).alias("level"), cells.ancestor_code(c("code"), 11, 5).alias("cell"), (c("id") % 3 != 0).alias("has_content"))


@query("J6_point_to_leaf", LEAF + """ SELECT pt.id, leaf.geohash, leaf.geohash IS NULL AS unmatched FROM pt
    LEFT JOIN (SELECT * FROM leaf WHERE total_count > 40) leaf ON substr(pt.h, 1, CAST(leaf.level AS INTEGER)) = leaf.geohash""")
def j6(spark, sf):
    leaves = refine.leaves(refine.refine_points(POINTS.frame(spark, sf), BOUND)).where("total_count > 40").select("level", "cell")
    pts = build.encoded(POINTS.frame(spark, sf).where(OK), BOUND).select("id", "code")
    levels = build.leaf_levels(leaves)
    hit = named(tl.to_leaves(pts, leaves, levels=levels)).select("id", "geohash", F.lit(False).alias("unmatched"))
    lost = tl.unmatched_points(pts, leaves, levels=levels).select("id", F.lit(None).cast("string").alias("geohash"), F.lit(True).alias("unmatched"))
    return hit.unionByName(lost)


@query("P4_leaf_assignment", LEAF + " SELECT geohash, table_name, model, count(*) AS instances, min(id) AS first_id FROM inst GROUP BY 1, 2, 3")
def p4(spark, sf):
    _, inst = assigned(spark, sf)
    return named(tl.group_models(inst.withColumn("has_content", F.lit(True)))).select("geohash", "table_name", "model", "instances", c("first.id").alias("first_id"))


GRP = f"SELECT {COARSE} AS geohash, table_name, model, count(*) AS instances, bool_or(id % 3 <> 0) AS has_content, CAST(sum(CASE WHEN id % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_content, min(id) AS first_id FROM ({P}) WHERE {OK} AND {INB} GROUP BY 1, 2, 3"


@query("A6_group_models", GRP)
def a6(spark, sf):
    return named(tl.group_models(coarse(spark, sf))).select("geohash", "table_name", "model", "instances", "has_content", "with_content", c("first.id").alias("first_id"))


@query("A7_leaf_extent", f"SELECT {COARSE} AS geohash, CAST(floor(min(alt)) AS BIGINT) AS low, CAST(ceil(max(alt)) AS BIGINT) AS high FROM ({P}) WHERE {OK} AND {INB} GROUP BY 1")
def a7(spark, sf):
    return named(tl.leaf_extent(coarse(spark, sf))).select("geohash", "low", "high")


LODS = (tl.LodLevel(0, 64.0, "skip"), tl.LodLevel(1, 16.0, "copy-lod3-by-prefix", ("m1",), "local"), tl.LodLevel(2, 4.0, ""), tl.LodLevel(3, 0.0))
LOD_SQL = f"""grp AS ({GRP}), want AS (SELECT *, unnest([0, 1, 2, 3]) AS lod FROM grp),
    mo AS (SELECT *, CASE lod WHEN 0 THEN 'skip' WHEN 1 THEN CASE WHEN model LIKE 'm1%' THEN 'copy-lod3' ELSE 'local' END WHEN 2 THEN 'local' ELSE 'lod3' END AS mode FROM want),
    a AS (SELECT table_name, model, lod, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({ASSETS.sql()}) GROUP BY 1, 2, 3),
    res AS (SELECT mo.*, a.bytes, CASE WHEN mode = 'skip' THEN 'skipped' WHEN a.bytes IS NOT NULL THEN 'available' ELSE 'missing' END AS status
            FROM mo LEFT JOIN a ON a.table_name = mo.table_name AND a.model = mo.model AND a.lod = CASE WHEN mode = 'local' THEN mo.lod ELSE 3 END)"""


def resolved(spark, sf):
    return tl.resolve_lods(tl.group_models(coarse(spark, sf)), ASSETS.frame(spark, sf), LODS)


@query("J14_lod_resolution", f"WITH {LOD_SQL} SELECT geohash, table_name, model, CAST(lod AS INTEGER) AS lod, mode, status, bytes, CASE WHEN status = 'missing' THEN CASE WHEN mode = 'local' THEN 'local model file not found' ELSE 'LOD3 model content unavailable' END END AS reason FROM res")
def j14(spark, sf):
    return named(resolved(spark, sf)).select("geohash", "table_name", "model", "lod", "mode", "status", "bytes", "reason")


@query("A8_generation_report", f"""
    WITH {LOD_SQL} SELECT CAST(lod AS INTEGER) AS lod, count(*) AS requested, count(*) FILTER (status = 'available') AS available, count(*) FILTER (status = 'skipped') AS skipped,
      count(*) FILTER (status = 'missing') AS missing, CAST(coalesce(sum(instances) FILTER (status = 'available'), 0) AS BIGINT) AS instances,
      CAST(coalesce(sum(bytes) FILTER (status = 'available'), 0) AS BIGINT) AS bytes, (SELECT count(DISTINCT geohash) FROM grp) AS found,
      (SELECT count(DISTINCT geohash) FROM res WHERE status = 'available') AS generated FROM res GROUP BY lod""")
def a8(spark, sf):
    res = resolved(spark, sf)
    per = tl.generation_report(res)
    lv = coarse(spark, sf).select("level", "cell").distinct()
    whole = tl.leaf_report(lv, res, res.where("status = 'available'")).select("found", "generated")
    return per.join(whole, F.lit(True))


@query("O3_report_order", f"""
    WITH {LOD_SQL}, m AS (SELECT lod, geohash, table_name, model FROM res WHERE status = 'missing')
    SELECT CAST(row_number() OVER (PARTITION BY lod ORDER BY geohash, table_name, model) AS INTEGER) AS pos, CAST(lod AS INTEGER) AS lod, geohash, table_name, model FROM m""")
def o3(spark, sf):
    m = named(resolved(spark, sf)).where("status = 'missing'").select("lod", "geohash", "table_name", "model")
    from tilewright.operators.ordering import ranked

    return ranked(m, ["lod"], ["geohash", "table_name", "model"], "pos").withColumn("pos", c("pos").cast("int"))


ROLL = f"""leaf AS (SELECT {COARSE} AS geohash, count(*) AS instances FROM ({P}) WHERE {OK} AND {INB} GROUP BY 1
        UNION ALL SELECT substr({geohash('lng', 'lat', 11)}, 1, 3) || '~', count(*) FROM ({P}) WHERE false GROUP BY 1),
    ups AS (SELECT geohash, instances, unnest(generate_series(3, 5)) AS k FROM leaf),
    nodes AS (SELECT CASE WHEN k = 5 THEN 'root' ELSE substr(geohash, 1, CAST(k AS INTEGER)) END AS node,
       CASE WHEN k = 5 THEN NULL WHEN k = 3 THEN 'root' ELSE substr(geohash, 1, 3) END AS parent, CASE WHEN k = 5 THEN 3 ELSE 5 - k END AS steps, instances,
       CASE WHEN instances > 40 THEN CAST(instances AS DOUBLE) ELSE 0 END AS e0 FROM ups)"""


def rolled(spark, sf):
    lv = named(coarse(spark, sf).groupBy("level", "cell").agg(F.count("*").alias("instances")))
    return tl.roll_up(lv.withColumn("error", F.when(c("instances") > 40, c("instances").cast("double")).otherwise(0.0)), 16.0)


@query("A23_ancestor_rollup", f"WITH {ROLL} SELECT node, any_value(parent) AS parent, count(*) AS leaves, CAST(sum(instances) AS BIGINT) AS instances FROM nodes GROUP BY 1")
def a23(spark, sf):
    return rolled(spark, sf).select("node", "parent", "leaves", "instances")


@query("A24_error_rollup", f"""
    WITH {ROLL}, l5 AS (SELECT geohash, CASE WHEN instances > 40 THEN CAST(instances AS DOUBLE) ELSE 0 END AS e FROM leaf),
    g4 AS (SELECT substr(geohash, 1, 4) AS g, greatest(16, max(e) * 2) AS e FROM l5 GROUP BY 1), g3 AS (SELECT substr(g, 1, 3) AS g, greatest(16, max(e) * 2) AS e FROM g4 GROUP BY 1),
    g0 AS (SELECT 'root' AS g, greatest(16, max(e) * 2) AS e FROM g3)
    SELECT g AS node, CAST(e AS DOUBLE) AS error FROM (SELECT * FROM g4 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g0)""")
def a24(spark, sf):
    return rolled(spark, sf).select("node", "error")


def leaf_boxes(spark, sf):
    inst = coarse(spark, sf)
    return build.hierarchy_rows(inst.select("level", "cell").distinct(), inst, 16.0)


@query("A9_merge_boxes")
def a9(spark, sf):
    rows, _ = leaf_boxes(spark, sf)
    merged = tl.merge_boxes(rows.withColumn("up", F.substring("geohash", 1, 4)), "up", "geohash")
    return merged.select("up", *[g.clean(c("box")[k], 3).alias(f"b{k}") for k in range(12)])


@query("P6_tile_hierarchy", f"""
    WITH {LOD_SQL}, ok AS (SELECT DISTINCT geohash, lod FROM res WHERE status = 'available'),
    ch AS (SELECT geohash, lod, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY geohash) AS n, lag(lod) OVER w AS pl, row_number() OVER w - 2 AS pp FROM ok WINDOW w AS (PARTITION BY geohash ORDER BY lod))
    SELECT CASE WHEN pos = 0 THEN geohash ELSE geohash || '#lod' || CAST(lod AS VARCHAR) END AS node,
      CASE WHEN pos = 0 THEN NULL WHEN pp = 0 THEN geohash ELSE geohash || '#lod' || CAST(pl AS VARCHAR) END AS above, CAST(lod AS INTEGER) AS lod,
      CASE WHEN pos = n - 1 THEN CAST(0 AS DOUBLE) ELSE CASE lod WHEN 0 THEN 64 WHEN 1 THEN 16 WHEN 2 THEN 4 ELSE 0 END END AS error,
      'tiles/' || substr(geohash, 1, 2) || '/' || substr(geohash, 1, 3) || '/' || geohash || '/lod' || CAST(lod AS VARCHAR) || '.glb?t=20240101000000' AS uri, pos = 0 AS has_transform FROM ch""")
def p6(spark, sf):
    lv = named(coarse(spark, sf).select("level", "cell").distinct())
    return tl.lod_chain(lv, resolved(spark, sf), LODS, "20240101000000").select("node", "above", "lod", "error", "uri", "has_transform")


@query("P6_hierarchy_boxes")
def p6b(spark, sf):
    rows, nodes = leaf_boxes(spark, sf)
    boxes = tl.hierarchy(rows, 16.0, [5])
    errors = nodes.select("node", "error", "parent").unionByName(rows.select(c("geohash").alias("node"), "error", F.substring("geohash", 1, 4).alias("parent")))
    return errors.join(boxes, "node").select("node", "parent", "error", *[g.clean(c("box")[k], 3).alias(f"b{k}") for k in range(12)])


def manifest_nodes(spark, sf):
    rows, nodes = leaf_boxes(spark, sf)
    boxes = tl.hierarchy(rows, 16.0, [5])
    flat = nodes.select(c("node").alias("geohash"), "parent", "error", F.lit(None).cast("string").alias("uri")).unionByName(
        rows.select("geohash", F.substring("geohash", 1, 4).alias("parent"), "error", F.concat(F.lit("tiles/"), "geohash").alias("uri")))
    return flat.join(boxes.withColumnRenamed("node", "geohash"), "geohash")


@query("SNK2_split_manifests", f"""
    WITH leaf AS (SELECT DISTINCT {COARSE} AS h FROM ({P}) WHERE {OK} AND {INB})
    SELECT 'subtilesets/' || substr(h, 1, 2) || '/' || substr(h, 1, 4) || '/tileset.json' AS path, count(*) + 1 AS n, count(*) AS rebased FROM leaf GROUP BY substr(h, 1, 2), substr(h, 1, 4)
    UNION ALL SELECT 'tileset.json', count(DISTINCT substr(h, 1, 4)) + count(DISTINCT substr(h, 1, 3)) + 1, 0 FROM leaf""")
def snk2(spark, sf):
    docs = tl.manifests(manifest_nodes(spark, sf), 4, "20240101000000")
    count = F.size(F.split("content", '"geohash":')) - 1
    rebased = F.size(F.split("content", '"uri":"../../../tiles/', -1)) - 1
    return docs.select("path", count.cast("bigint").alias("n"), rebased.cast("bigint").alias("rebased"))


@query("A10_union_volumes", f"""
    SELECT brand, min(px0) AS w, min(py0) AS s, max(px2) AS e, max(py2) AS n, min(base_z) AS lo, max(base_z + 10) AS hi FROM ({PG}) GROUP BY 1""")
def a10(spark, sf):
    df = POLYGONS.frame(spark, sf).select("brand", c("px0").alias("w"), c("py0").alias("s"), c("px2").alias("e"), c("py2").alias("n"),
                                          c("base_z").alias("lo"), (c("base_z") + 10).alias("hi"))
    return tl.union_regions(df, ["brand"])


@query("A10_union_spheres", f"""
    WITH RECURSIVE s AS (SELECT brand, row_number() OVER (PARTITION BY brand ORDER BY id) AS n, px0 AS x, py0 AS y, CAST(base_z AS DOUBLE) AS z, size / CAST(10 AS DOUBLE) AS r FROM ({PG})),
    f AS (SELECT * FROM s WHERE n = 1 UNION ALL
      SELECT brand, n, CASE WHEN r >= d + q THEN x WHEN q >= d + r THEN u ELSE x + (u - x) * ((d + r + q) / 2 - r) / d END, CASE WHEN r >= d + q THEN y WHEN q >= d + r THEN v ELSE y + (v - y) * ((d + r + q) / 2 - r) / d END,
        CASE WHEN r >= d + q THEN z WHEN q >= d + r THEN w ELSE z + (w - z) * ((d + r + q) / 2 - r) / d END, CASE WHEN r >= d + q THEN r WHEN q >= d + r THEN q ELSE (d + r + q) / 2 END
      FROM (SELECT s.brand, s.n, f.x, f.y, f.z, f.r, s.x AS u, s.y AS v, s.z AS w, s.r AS q, sqrt(power(s.x - f.x, 2) + power(s.y - f.y, 2) + power(s.z - f.z, 2)) AS d FROM f JOIN s ON s.brand = f.brand AND s.n = f.n + 1))
    SELECT f.brand, {r('x', 6)} AS x, {r('y', 6)} AS y, {r('z', 6)} AS z, {r('r', 6)} AS r FROM f JOIN (SELECT brand, max(n) AS n FROM s GROUP BY 1) USING (brand, n)""")
def a10s(spark, sf):
    df = POLYGONS.frame(spark, sf).select("brand", "id", c("px0").alias("x"), c("py0").alias("y"), c("base_z").alias("z"), (c("size") / 10).alias("r"))
    return tl.merge_spheres(df, "brand", "id").select("brand", *[F.round(k, 6).alias(k) for k in "xyzr"])


@query("A12_collection_context", f"""
    WITH v AS (SELECT brand, unnest([px0, px1, px2, px3]) AS x, unnest([py0, py1, py2, py3]) AS y FROM ({PG}))
    SELECT brand, {r('(min(x) + max(x)) / 2', 8)} AS base_lng, {r('(min(y) + max(y)) / 2', 8)} AS base_lat, min(x) AS w, min(y) AS s, max(x) AS e, max(y) AS n FROM v GROUP BY 1""")
def a12(spark, sf):
    from tilewright.operators.surfaces import collection_context

    pts = POLYGONS.frame(spark, sf).select("brand", F.explode(F.array(*[F.struct(c(f"px{k}").alias("x"), c(f"py{k}").alias("y")) for k in range(4)])).alias("p"))
    out = collection_context(pts.select("brand", "p.*"), ["brand"])
    return out.select("brand", g.clean(c("base_lng"), 8).alias("base_lng"), g.clean(c("base_lat"), 8).alias("base_lat"), "w", "s", "e", "n")


@query("A13_padded_content_box", f"""
    SELECT brand, (min(px0) + max(px2)) / 2 AS cx, {r('(max(px2) - min(px0)) / 2 + greatest(0.5, 0.01, CAST(0.05 AS DOUBLE) * (max(px2) - min(px0)))', 6)} AS hx,
      {r('(max(base_z) - min(base_z)) / 2 + greatest(0.5, 0.01, CAST(0.05 AS DOUBLE) * (max(base_z) - min(base_z)))', 6)} AS hz FROM ({PG}) GROUP BY 1""")
def a13(spark, sf):
    from tilewright.operators.surfaces import padded_box

    df = POLYGONS.frame(spark, sf).select("brand", F.explode(F.array(F.struct(c("px0").alias("x"), c("py0").alias("y"), c("base_z").alias("z")),
                                                                    F.struct(c("px2").alias("x"), c("py2").alias("y"), c("base_z").alias("z")))).alias("p")).select("brand", "p.*")
    out = padded_box(df, ["brand"], 0.5, 0.01, 0.05)
    return out.select("brand", "cx", g.clean(c("hx"), 6).alias("hx"), g.clean(c("hz"), 6).alias("hz"))


@query("A25_combined_bounds", f"""
    WITH q AS (SELECT id, lng - 0.002 AS w, lat - 0.002 AS s, lng + 0.002 AS e, lat + 0.002 AS n FROM ({P})),
    b AS (SELECT px0 AS bw, py0 AS bs, px2 AS be, py2 AS bn FROM ({PG}))
    SELECT id, coalesce(min(bw), any_value(w)) AS w, coalesce(min(bs), any_value(s)) AS s, coalesce(max(be), any_value(e)) AS e, coalesce(max(bn), any_value(n)) AS n
    FROM q LEFT JOIN b ON bw <= e AND be >= w AND bs <= n AND bn >= s GROUP BY id""")
def a25(spark, sf):
    from tilewright.operators.boxes import combined_bounds

    q = POINTS.frame(spark, sf).select("id", (c("lng") - 0.002).alias("w"), (c("lat") - 0.002).alias("s"), (c("lng") + 0.002).alias("e"), (c("lat") + 0.002).alias("n"))
    b = POLYGONS.frame(spark, sf).select(c("px0").alias("w"), c("py0").alias("s"), c("px2").alias("e"), c("py2").alias("n"))
    return combined_bounds(q, b, "id")


MV = MODEL_VERTICES.sql()


@query("A22_model_extents", f"SELECT model_id, {', '.join(r(f'max({a}) - min({a})', 6) + f' AS size_{a}' for a in 'xyz')} FROM ({MV}) GROUP BY 1")
def a22(spark, sf):
    e = tl.model_extents(MODEL_VERTICES.frame(spark, sf))
    return e.select("model_id", *[g.clean(c(f"size_{a}"), 6).alias(f"size_{a}") for a in "xyz"])


@query("A26_placed_leaf_region", f"""
    WITH m AS (SELECT model_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM ({MV}) GROUP BY 1),
    i AS (SELECT id, lng, lat, alt, obj_angle, {COARSE} AS h, m.* FROM ({P}) JOIN m ON m.model_id = id % 200 WHERE {OK} AND {INB}),
    pk AS (SELECT a, b, d FROM (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1, 2]) AS b), (SELECT unnest([0, 1, 2]) AS d)
           WHERE (CASE WHEN a = 1 THEN 1 ELSE 0 END + CASE WHEN b = 1 THEN 1 ELSE 0 END + CASE WHEN d = 1 THEN 1 ELSE 0 END) <= 1),
    l AS (SELECT i.*, x0 + (x1 - x0) * a / 2 AS px, y0 + (y1 - y0) * b / 2 AS py, z0 + (z1 - z0) * d / 2 AS pz FROM i, pk),
    ro AS (SELECT *, px * cos(radians(obj_angle)) + py * sin(radians(obj_angle)) AS le, py * cos(radians(obj_angle)) - px * sin(radians(obj_angle)) AS ln FROM l),
    w AS (SELECT id, h, {ecef_sql('lng', 'lat', 'alt')[0]} - le * sin(radians(lng)) - ln * sin(radians(lat)) * cos(radians(lng)) + pz * cos(radians(lat)) * cos(radians(lng)) AS x,
       {ecef_sql('lng', 'lat', 'alt')[1]} + le * cos(radians(lng)) - ln * sin(radians(lat)) * sin(radians(lng)) + pz * cos(radians(lat)) * sin(radians(lng)) AS y,
       {ecef_sql('lng', 'lat', 'alt')[2]} + ln * cos(radians(lat)) + pz * sin(radians(lat)) AS z FROM ro),
    gd AS ({geodetic_sql('SELECT * FROM w', 'id, h AS gh').replace('id, h AS gh, lon, lat', 'gh, lon, lat').replace('SELECT id, h AS gh, z, lon, p, atan2(z, p', 'SELECT gh, z, lon, p, atan2(z, p').replace('SELECT id, h AS gh, z, atan2', 'SELECT h AS gh, z, atan2')}),
    a AS (SELECT gh, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n, min(h) AS lo, max(h) AS hi FROM gd GROUP BY 1),
    bb AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in duck_bbox('gh', 5).items())} FROM a)
    SELECT gh AS geohash, {r('least(w, radians(west))', 9)} AS w, {r('least(s, radians(south))', 9)} AS s, {r('greatest(e, radians(east))', 9)} AS e,
      {r('greatest(n, radians(north))', 9)} AS n, {r('least(lo, 0)', 3)} AS lo, {r('greatest(hi, 100)', 3)} AS hi FROM bb""")
def a26(spark, sf):
    one = F.lit(1.0)
    inst = coarse(spark, sf).withColumns({"model_id": c("id") % 200, "sx": one, "sy": one, "sz": one})
    out = tl.placed_regions(inst, tl.model_extents(MODEL_VERTICES.frame(spark, sf)))
    return out.select("geohash", *[g.clean(c(k), 9).alias(k) for k in "wsen"], g.clean(c("lo"), 3).alias("lo"), g.clean(c("hi"), 3).alias("hi"))


@query("A27_category_statistics", f"""
    SELECT table_name AS tileset, category, model, count(*) AS n FROM ({P}) GROUP BY ROLLUP (table_name, category, model)""")
def a27(spark, sf):
    return POINTS.frame(spark, sf).rollup(c("table_name").alias("tileset"), "category", "model").agg(F.count("*").alias("n"))


ED = EDITS.sql()
SVC = "CASE WHEN id % 2 = 0 THEN concat('{\"bindName\":\"b', CAST(id AS {T}), '\",\"bindId\":', CAST(id % 9 AS {T}), '}') END"


@query("P5_pose_table", f"""
    SELECT table_name || '.' || CAST(id AS VARCHAR) AS id, CAST(id AS VARCHAR) AS fid, 'hdDevice' AS ftype, CASE WHEN id % 2 = 0 THEN 'b' || CAST(id AS VARCHAR) ELSE '' END AS name,
      CASE WHEN id % 2 = 0 THEN CAST(id % 9 AS VARCHAR) ELSE '' END AS bid, CAST(id % 50 AS VARCHAR) AS alt, CAST(id % 4 AS VARCHAR) AS width, printf('%d.500', id % 7) AS km_value, false AS stored,
      {r(ecef_sql('lng', 'lat', 'alt')[0], 3)} AS m12 FROM ({P}) WHERE {OK} AND {INB}""")
def p5(spark, sf):
    null = F.lit(None).cast("string")
    inst = coarse(spark, sf).withColumns({
        "type": F.lit("hdDevice"), "service_data": F.expr(SVC.replace("{T}", "STRING")), "metadata": null, "width": (c("id") % 4).cast("double"), "height": F.lit(0.0),
        "km_value": (c("id") % 7).cast("double") + 0.5, "travel_type": null, "road_name": null, "type_code": null, "transform": F.lit(None).cast("array<double>")})
    out = build.pose_table(inst)
    return out.select("id", "fid", "ftype", "name", "bid", "alt", "width", "km_value", "stored", g.clean(c("matrix")[12], 3).alias("m12"))


def fnv64(text: str) -> str:
    value = 0xCBF29CE484222325
    for byte in text.encode():
        value = (value ^ byte) * 0x100000001B3 % 2**64
    return f"{value:x}"


@query("P8_dynamic_manifest", f"""
    SELECT p.id, p.model || '?v=' || strftime(e.update_time, '%Y%m%d%H%M%S') || '&code={fnv64('main')}&fid=' || CAST(p.id AS VARCHAR) || '&type=' || e.kind || printf('&lng=%.6f&lat=%.6f&alt=%.6f', p.lng, p.lat, p.alt) AS uri,
      {r(ecef_sql('p.lng', 'p.lat', 'p.alt')[0], 3)} AS m12, {r('-20 * sin(radians(p.lng))', 3)} AS b3, {r('20 * sin(radians(p.lat))', 3)} AS b11
    FROM ({P}) p JOIN ({ED}) e ON p.id = e.id WHERE e.update_time >= TIMESTAMP '2024-01-20 00:00:00' AND (e.del_flag <> '1' OR e.del_flag IS NULL) AND (p.model LIKE '%.glb' OR p.model LIKE '%.gltf')""")
def p8(spark, sf):
    from tilewright.streaming.feeds import changed_feed

    e, pt = EDITS.frame(spark, sf), POINTS.frame(spark, sf)
    feed = changed_feed({k: (pt, e.where(c("kind") == k)) for k in ("hdSign", "hdPole", "hdGantry", "hdDevice")}, "2024-01-20 00:00:00")
    m = build.dynamic_manifest(feed, "main")
    return m.select("id", "uri", g.clean(c("matrix")[12], 3).alias("m12"), g.clean(c("box")[3], 3).alias("b3"), g.clean(c("box")[11], 3).alias("b11"))


@query("P9_incremental_rebuild", LEAF + f""", ch AS (SELECT p.lng + CASE WHEN p.id % 50 = 0 THEN 5 ELSE 0 END AS lng, p.lat FROM ({P}) p WHERE p.id % 37 = 0 OR p.id % 50 = 0),
    cc AS (SELECT {geohash('lng', 'lat', 11)} AS h FROM ch), dirty AS (SELECT DISTINCT leaf.geohash FROM leaf JOIN cc ON substr(cc.h, 1, CAST(leaf.level AS INTEGER)) = leaf.geohash),
    lost AS (SELECT count(*) AS n FROM cc WHERE NOT EXISTS (SELECT 1 FROM leaf WHERE substr(cc.h, 1, CAST(leaf.level AS INTEGER)) = leaf.geohash))
    SELECT geohash, model, count(*) AS instances FROM inst WHERE geohash IN (SELECT geohash FROM dirty) GROUP BY 1, 2
    UNION ALL SELECT 'needs refresh', NULL, n FROM lost""")
def p9(spark, sf):
    pts = POINTS.frame(spark, sf)
    leaves = refine.leaves(refine.refine_points(pts, BOUND))
    changed = pts.where("id % 37 = 0 OR id % 50 = 0").select((c("lng") + F.when(c("id") % 50 == 0, 5).otherwise(0)).alias("lng"), "lat")
    groups, outside = build.rebuild(pts, changed, leaves, BOUND)
    return named(groups).select("geohash", "model", "instances").unionByName(
        outside.agg(F.count("*").alias("instances")).select(F.lit("needs refresh").alias("geohash"), F.lit(None).cast("string").alias("model"), "instances"))


@query("J15_patch_nodes", f"""
    WITH n AS (SELECT DISTINCT {COARSE} AS geohash FROM ({P}) WHERE {INB}), k AS (SELECT geohash FROM n WHERE substr(geohash, 5, 1) IN ('0', '1', '2', '3'))
    SELECT geohash, CASE WHEN geohash IN (SELECT geohash FROM k) THEN CAST(4 AS DOUBLE) ELSE 0 END AS error, CASE WHEN geohash IN (SELECT geohash FROM k) THEN 'new' ELSE 'old' END AS uri FROM n
    UNION ALL SELECT geohash || 'z', NULL, 'no such tile' FROM k""")
def j15(spark, sf):
    tree = POINTS.frame(spark, sf).select(cells.point_hash(c("lng"), c("lat"), 5).alias("geohash")).distinct().withColumns({"error": F.lit(0.0), "uri": F.lit("old")})
    hit = tree.where(F.substring("geohash", 5, 1).isin("0", "1", "2", "3")).select("geohash", F.lit(4.0).alias("error"), F.lit("new").alias("uri"))
    ghosts = hit.withColumn("geohash", F.concat("geohash", F.lit("z")))
    out, missing = tl.changed_nodes(tree, hit.unionByName(ghosts), ["error", "uri"])
    return out.unionByName(missing.select("geohash", F.lit(None).cast("double").alias("error"), F.lit("no such tile").alias("uri")))
