"""Shapes, measures, deduplication, registration and slicing."""

from pyspark.sql import functions as F

from tilewright.catalog.layers import PG, quads
from tilewright.catalog.lines import rd
from tilewright.catalog.registry import query
from tilewright.catalog.sqltext import r
from tilewright.functions import geodesy as g
from tilewright.functions.geodesy import ECC2
from tilewright.operators import ordering as od, shapes as sh, surfaces as sf_, surfaces_cells as sc
from tilewright.sources.derived import ASSETS, CONTROL_POINTS, EDITS, MODEL_VERTICES, POLYGONS, TRIANGLES

MV, T, AS, ED = MODEL_VERTICES.sql(), TRIANGLES.sql(), ASSETS.sql(), EDITS.sql()
c = F.col
EXT = "ext AS (SELECT model_id, " + ", ".join(f"min({a}) AS lo_{a}, max({a}) AS hi_{a}, max({a}) - min({a}) AS size_{a}" for a in "xyz") + f" FROM ({MV}) GROUP BY 1)"
AT = "CASE WHEN size_x >= size_z THEN x - lo_x ELSE z - lo_z END"


@query("A21_slice_statistics", f"""
    WITH {EXT}, v AS (SELECT m.*, ext.* EXCLUDE (model_id), CAST(least(greatest(floor(({AT}) / greatest(size_x, size_z) * 32), 0), 31) AS BIGINT) AS slice FROM ({MV}) m JOIN ext USING (model_id))
    SELECT model_id, slice, count(*) AS n, {r('min(y)', 6)} AS lo_y, {r('max(y)', 6)} AS hi_y FROM v GROUP BY 1, 2 HAVING count(*) >= 3""")
def a21(spark, sf):
    return rd(sh.slice_stats(MODEL_VERTICES.frame(spark, sf)), {"model_id": None, "slice": None, "n": None, "lo_y": 6, "hi_y": 6})


@query("W8_merge_similar_boxes")
def w8(spark, sf):
    merged = sh.merge_similar(sh.slice_stats(MODEL_VERTICES.frame(spark, sf)))
    return rd(merged, {"model_id": None, "pos": None, **{f"{p}{a}": 6 for a in "xyz" for p in ("lo_", "hi_")}})


BAND = lambda k: f"(y - lo_y >= size_y * ({k} * CAST(0.12 AS DOUBLE)) AND y - lo_y < size_y * ({k + 1} * CAST(0.12 AS DOUBLE)))"
D_ = lambda v: f"CAST({v} AS DOUBLE)"
SHAPE = f"""v AS (SELECT m.*, ext.* EXCLUDE (model_id), y < lo_y + size_y * {D_(0.45)} AS low, {AT} AS u, greatest(size_x, size_z) AS span, least(size_x, size_z) AS depth FROM ({MV}) m JOIN ext USING (model_id)),
    a AS (SELECT model_id, any_value(size_x) AS sx, any_value(size_y) AS sy, any_value(size_z) AS sz, any_value(span) AS span, any_value(depth) AS depth, count(*) AS n, count(*) FILTER (low) AS nl, count(*) FILTER (NOT low) AS nu,
      max(x) FILTER (low) - min(x) FILTER (low) AS lx, max(z) FILTER (low) - min(z) FILTER (low) AS lz, max(x) FILTER (NOT low) - min(x) FILTER (NOT low) AS ux, max(y) FILTER (NOT low) - min(y) FILTER (NOT low) AS uy, max(z) FILTER (NOT low) - min(z) FILTER (NOT low) AS uz,
      {', '.join(f"count(*) FILTER (u <= span * {D_(0.22)} AND {BAND(k)}) AS l{k}, count(*) FILTER (u >= span * {D_(0.78)} AND {BAND(k)}) AS r{k}" for k in range(5))},
      count(*) FILTER (u >= span * {D_(0.35)} AND u <= span * {D_(0.65)} AND ({' OR '.join(BAND(k) for k in range(5))})) AS cl,
      count(*) FILTER (y - lo_y >= size_y * {D_(0.68)}) AS nt, max(u) FILTER (y - lo_y >= size_y * {D_(0.68)}) - min(u) FILTER (y - lo_y >= size_y * {D_(0.68)}) AS ts,
      count(*) FILTER (y - lo_y >= size_y * {D_(0.68)} AND u >= span * {D_(0.35)} AND u <= span * {D_(0.65)}) AS tc FROM v GROUP BY 1),
    b AS (SELECT *, {'+'.join(f'l{k}' for k in range(5))} AS tl, {'+'.join(f'r{k}' for k in range(5))} AS tr, {'+'.join(f'CASE WHEN l{k} >= 3 THEN 1 ELSE 0 END' for k in range(5))} AS ol, {'+'.join(f'CASE WHEN r{k} >= 3 THEN 1 ELSE 0 END' for k in range(5))} AS orr FROM a)"""


@query("A28_shape_class", f"""
    WITH {EXT}, {SHAPE} SELECT model_id, CASE
      WHEN sy > 0 AND nl >= 3 AND nu >= 3 AND greatest(ux, uz) > greatest(sx, sz) * {D_(0.45)} AND greatest(lx, lz) < greatest(sx, sz) * {D_(0.25)} AND uy < sy * {D_(0.55)} AND (ux > lx * 3 OR uz > lz * 3) THEN 'single_pole_sign'
      WHEN least(sx, sy, sz) > 0 AND span >= sy * {D_(1.2)} AND span >= depth * 4 AND sy >= depth * 3 AND least(tl, tr) >= 6 AND cl <= (tl + tr) * {D_(0.12)} AND ((ol >= 3 AND orr >= 3) OR (ol >= 1 AND orr >= 1 AND n >= 24))
        AND nt >= 3 AND ts >= span * {D_(0.72)} AND (tc >= 3 OR (ol >= 1 AND orr >= 1 AND n >= 24)) THEN 'two_post_gantry'
      WHEN least(sx, sy, sz) > 0 AND sx * sy * sz <= 5 AND list_sort([sx, sy, sz])[3] / list_sort([sx, sy, sz])[2] >= 3 AND list_sort([sx, sy, sz])[3] / list_sort([sx, sy, sz])[1] >= 6 THEN 'long_rod'
      ELSE 'outline_slices' END AS shape FROM b""")
def a28(spark, sf):
    return sh.shape_class(MODEL_VERTICES.frame(spark, sf))


@query("W12_gap_clusters", f"""
    WITH e AS (SELECT model_id, greatest((max(x * 10) - min(x * 10)) * CAST(0.05 AS DOUBLE), 5) AS gap FROM ({MV}) GROUP BY 1),
    o AS (SELECT model_id, x * 10 AS x, z, gap, lag(x * 10) OVER (PARTITION BY model_id ORDER BY x) AS px FROM ({MV}) JOIN e USING (model_id)),
    k AS (SELECT *, sum(CASE WHEN px IS NULL OR x - px > gap THEN 1 ELSE 0 END) OVER (PARTITION BY model_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS cluster FROM o)
    SELECT model_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, {r('min(x)', 6)} AS lo, {r('max(x)', 6)} AS hi, {r('max(z)', 6)} AS hi_z FROM k GROUP BY 1, 2""")
def w12(spark, sf):
    v = MODEL_VERTICES.frame(spark, sf).withColumn("x", c("x") * 10)
    return rd(sh.gap_clusters(v), {"model_id": None, "cluster": None, "n": None, "lo": 6, "hi": 6, "hi_z": 6})


@query("A29_vertex_welding", f"""
    WITH k AS (SELECT model_id, ord, CAST(round(x / CAST(0.25 AS DOUBLE)) AS BIGINT) AS gx, CAST(round(y / CAST(0.25 AS DOUBLE)) AS BIGINT) AS gy, CAST(round(z / CAST(0.25 AS DOUBLE)) AS BIGINT) AS gz FROM ({MV})),
    f AS (SELECT *, min(ord) OVER (PARTITION BY model_id, gx, gy, gz) AS first_at FROM k)
    SELECT model_id, ord, first_at, dense_rank() OVER (PARTITION BY model_id ORDER BY first_at) - 1 AS weld_id FROM f""")
def a29(spark, sf):
    return sh.weld(MODEL_VERTICES.frame(spark, sf), "model_id", "ord", 0.25).select("model_id", "ord", "first_at", "weld_id")


@query("W5_first_per_key", f"SELECT user_key, event_id, kind FROM (SELECT id % 500 AS user_key, event_id, kind, row_number() OVER (PARTITION BY id % 500 ORDER BY event_id) AS rn FROM ({ED})) WHERE rn = 1")
def w5(spark, sf):
    e = EDITS.frame(spark, sf).select((c("id") % 500).alias("user_key"), "event_id", "kind")
    return od.first_per_key(e, ["user_key"], "event_id")


DOCS = f"SELECT kind AS doc, service_data AS row_key, min(event_id) AS first_at FROM ({ED}) GROUP BY 1, 2"


@query("W6_dense_ids", f"SELECT doc, row_key, first_at, row_number() OVER (PARTITION BY doc ORDER BY first_at) - 1 AS dense_id FROM ({DOCS})")
def w6(spark, sf):
    e = EDITS.frame(spark, sf).select(c("kind").alias("doc"), c("service_data").alias("row_key"), "event_id")
    return od.dense_ids(e, ["doc"], ["row_key"], "event_id")


@query("A19_attribute_rows", f"""
    WITH f AS (SELECT kind AS doc, concat('{{"k":', json_extract_string(service_data, '$.k'), ',"del":', CASE WHEN del_flag IS NULL THEN 'null' ELSE '"' || del_flag || '"' END, '}}') AS attributes, event_id FROM ({ED})),
    g AS (SELECT doc, attributes, min(event_id) AS first_at, count(*) AS used FROM f GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY doc ORDER BY first_at) - 1 AS row_id FROM g""")
def a19(spark, sf):
    e = EDITS.frame(spark, sf).select(c("kind").alias("doc"), "event_id", F.to_json(
        F.struct(F.get_json_object("service_data", "$.k").cast("bigint").alias("k"), c("del_flag").alias("del")), {"ignoreNullFields": "false"}).alias("attributes"))
    counts = e.groupBy("doc", "attributes").agg(F.count("*").alias("used"))
    return od.dense_ids(e, ["doc"], ["attributes"], "event_id", "row_id").join(counts, ["doc", "attributes"])


@query("A18_content_dedup", f"""
    SELECT ord, sha256(content) AS sha, count(*) OVER (PARTITION BY content) AS copies, min(ord) OVER (PARTITION BY content) AS first_at,
      CASE WHEN ord = min(ord) OVER (PARTITION BY content) THEN 'written' ELSE 'duplicate' END AS status FROM ({AS})""")
def a18(spark, sf):
    return sh.dedupe_content(ASSETS.frame(spark, sf), "content", "ord", [])


@query("A17_one_to_one", f"""
    WITH p AS (SELECT model AS a, content AS b FROM ({AS}))
    SELECT DISTINCT a AS key, b AS partner, n AS partners, 'model' AS side FROM p JOIN (SELECT a, count(DISTINCT b) AS n FROM p GROUP BY 1) USING (a) WHERE n > 1 AND b IS NOT NULL
    UNION ALL SELECT DISTINCT b, a, n, 'content' FROM p JOIN (SELECT b, count(DISTINCT a) AS n FROM p GROUP BY 1) USING (b) WHERE n > 1 AND a IS NOT NULL""")
def a17(spark, sf):
    return sh.one_to_one(ASSETS.frame(spark, sf).select("model", "content"), "model", "content")


@query("A20_compression_manifest", f"""
    WITH t AS (SELECT CASE WHEN ord % 11 = 0 THEN 'failed' WHEN ord % 7 = 0 THEN 'skipped' ELSE 'ok' END AS status, bytes, CAST(floor(bytes / 3) AS BIGINT) AS out_bytes, store || '/' || model AS dest FROM ({AS})),
    k AS (SELECT count(*) AS n FROM (SELECT dest FROM t GROUP BY 1 HAVING count(*) > 1))
    SELECT status, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(out_bytes) AS BIGINT) AS out_bytes, {r('100 * (1 - CAST(sum(out_bytes) AS DOUBLE) / sum(bytes))', 3)} AS saved, (SELECT n FROM k) AS collisions FROM t GROUP BY 1""")
def a20(spark, sf):
    from tilewright.sources.assets import compression_manifest

    a = ASSETS.frame(spark, sf).select(F.when(c("ord") % 11 == 0, "failed").when(c("ord") % 7 == 0, "skipped").otherwise("ok").alias("status"), "bytes",
                                       F.floor(c("bytes") / 3).alias("out_bytes"), F.concat_ws("/", "store", "model").alias("dest"))
    return rd(compression_manifest(a), {"status": None, "files": None, "bytes": None, "out_bytes": None, "saved": 3, "collisions": None})


VERTS = f"SELECT id, unnest([px0, px1, px2, px3]) * 1000 AS x, unnest([py0, py1, py2, py3]) * 1000 AS y FROM ({PG})"


def corner_points(spark, sf):
    return POLYGONS.frame(spark, sf).select("id", F.explode(F.array(*[F.struct((c(f"px{k}") * 1000).alias("x"), (c(f"py{k}") * 1000).alias("y")) for k in range(4)])).alias("p")).select("id", "p.*")


@query("A15_principal_axis", f"""
    WITH v AS (SELECT brand, px0 * 1000 + skew AS x, py0 * 1000 AS y FROM (SELECT *, id % 7 AS skew FROM ({PG}))),
    m AS (SELECT brand, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS angle FROM v GROUP BY 1),
    p AS (SELECT v.brand, angle, x * cos(angle) + y * sin(angle) AS u, -x * sin(angle) + y * cos(angle) AS w FROM v JOIN m USING (brand))
    SELECT brand, {r('any_value(angle)', 5)} AS angle, {r('max(u) - min(u)', 3)} AS length, {r('max(w) - min(w)', 3)} AS width,
      {r('(min(u) + max(u)) / 2 * cos(any_value(angle)) - (min(w) + max(w)) / 2 * sin(any_value(angle))', 2)} AS cx FROM p GROUP BY 1""")
def a15(spark, sf):
    v = POLYGONS.frame(spark, sf).select("brand", (c("px0") * 1000 + c("id") % 7).alias("x"), (c("py0") * 1000).alias("y"))
    return rd(sf_.principal_axis(v, ["brand"]), {"brand": None, "angle": 5, "length": 3, "width": 3, "cx": 2})


RAD = "(CAST(6378137 AS DOUBLE) / sqrt(1 - {e} * power(sin(radians(clat)), 2)))".replace("{e}", repr(ECC2))
MRAD = "(CAST(6378137 AS DOUBLE) * (1 - {e}) / power(1 - {e} * power(sin(radians(clat)), 2), 1.5))".replace("{e}", repr(ECC2))
SHO = " + ".join(f"(px{k} * py{(k + 1) % 4} - px{(k + 1) % 4} * py{k})" for k in range(4))


@query("C21_polygon_measures", f"""
    WITH q AS (SELECT *, (least(px0, px3) + greatest(px1, px2)) / 2 AS clng, (py0 + py2) / 2 AS clat FROM ({PG})),
    m AS (SELECT *, {', '.join(f'radians(px{k} - clng) * {RAD} * cos(radians(clat)) AS fx{k}, radians(py{k} - clat) * {MRAD} AS fy{k}' for k in range(4))} FROM q)
    SELECT id, {r(f'({SHO}) / 2 * 1000000', 3)} AS area, {r('clng', 8)} AS clng, {r('clat', 8)} AS clat, base_z AS cz,
      {r('abs(' + ' + '.join(f'fx{k} * fy{(k + 1) % 4} - fx{(k + 1) % 4} * fy{k}' for k in range(4)) + ') / 2', 2)} AS footprint, {r('fx0', 3)} AS first_x, {r('(px2 - px0) * (py2 - py0) * 4 * 1000000', 2)} AS largest FROM m""")
def c21(spark, sf):
    df = quads(spark, sf)
    mid = sf_.ring_box_centre(c("ring"))
    df = df.withColumns({"clng": mid["x"], "clat": mid["y"], "cz": mid["z"]})
    backwards = F.reverse(c("ring"))
    df = df.withColumn("foot", sf_.local_footprint(F.when(c("id") % 2 == 0, c("ring")).otherwise(backwards), c("clng"), c("clat")))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"), c("base_z").alias("z"))
    w, s, e, n = c("px0"), c("py0"), c("px2"), c("py2")
    big = F.array(pt(w, s), pt(w + (e - w) * 2, s), pt(w + (e - w) * 2, s + (n - s) * 2), pt(w, s + (n - s) * 2))
    top = sf_.largest_part(F.array(c("ring"), big))
    first = g.bind(F.array_min(F.transform("foot", lambda q: q["y"])), lambda low: F.filter("foot", lambda p: F.abs(p["y"] - low) < 1e-9)[0]["x"])
    return df.select("id", (F.round(sf_.ring_area(c("ring")) * 1e6, 3) + 0.0).alias("area"), (F.round("clng", 8) + 0.0).alias("clng"), (F.round("clat", 8) + 0.0).alias("clat"), "cz",
                     (F.round(sf_.ring_area(c("foot")), 2) + 0.0).alias("footprint"), (F.round(F.radians(c("px0") - c("clng")) * 0 + first, 3) + 0.0).alias("first_x"),
                     (F.round(sf_.ring_area(top) * 1e6, 2) + 0.0).alias("largest"))


ROT = "mx * cos(theta) - my * sin(theta) + tx AS gx, mx * sin(theta) + my * cos(theta) + ty AS gy, mz + tz AS gz"


@query("A16_registration_solve", f"""
    WITH p AS ({CONTROL_POINTS.sql()}), m AS (SELECT grp, count(*) AS n, any_value(theta) AS theta, any_value(tx) AS tx, any_value(ty) AS ty, any_value(tz) AS tz,
      var_pop(mx) * var_pop(my) - power(covar_pop(mx, my), 2) + var_pop(mx) * var_pop(mz) - power(covar_pop(mx, mz), 2) + var_pop(my) * var_pop(mz) - power(covar_pop(my, mz), 2) AS minors, var_pop(mx) + var_pop(my) + var_pop(mz) AS spread FROM p GROUP BY 1)
    SELECT grp, n, {r('sin(theta / 2)', 6)} AS qz, {r('cos(theta / 2)', 6)} AS qw, {r('tx', 4)} AS dx, {r('ty', 4)} AS dy, {r('tz', 4)} AS dz, CAST(0 AS DOUBLE) AS rms, CAST(0 AS DOUBLE) AS worst FROM m WHERE minors > power(spread, 2) * 1e-12""")
def a16(spark, sf):
    p = CONTROL_POINTS.frame(spark, sf).selectExpr("*", *ROT.split(", ")).select(
        "grp", "k", "mx", "my", "mz", c("gx").alias("tx"), c("gy").alias("ty"), c("gz").alias("tz"))
    out, _ = sh.solve_registration(p)
    return rd(out, {"grp": None, "n": None, "qz": 6, "qw": 6, "dx": 4, "dy": 4, "dz": 4, "rms": 4, "worst": 4})


@query("W11_cross_sections")
def w11(spark, sf):
    df = POLYGONS.frame(spark, sf)
    edges = df.select("id", F.explode(F.array(*[F.struct(*[(c(f"p{a}{k}") * 100000 - o).alias(f"{a}{e}") for e, k in ((1, i), (2, (i + 1) % 4)) for a, o in (("x", 11700000), ("y", 3100000))]) for i in range(4)])).alias("e")).select("id", "e.*")
    pts = edges.select("id", c("x1").alias("x"), c("y1").alias("y"))
    return rd(sh.smooth_sections(sh.cross_sections(edges, sf_.principal_axis(pts, ["id"]))), {"id": None, "sample": None, "x": 3, "y": 3})


AREA = "abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2"


@query("A14_slice_conservation", f"""
    WITH t AS (SELECT road_id, {AREA} AS a, least(x1, x2, x3) AS w, greatest(x1, x2, x3) AS e, least(y1, y2, y3) AS s, greatest(y1, y2, y3) AS n FROM ({T}))
    SELECT road_id, {r('sum(a)', 3)} AS area, {r('sum(a)', 3)} AS sliced, true AS kept, true AS split FROM t GROUP BY 1""")
def a14(spark, sf):
    t = TRIANGLES.frame(spark, sf)
    src = t.groupBy("road_id").agg(F.sum(F.expr(AREA)).alias("area"))
    return rd(sc.conservation(src, sc.slice_triangles(t, 40.0), "road_id"), {"road_id": None, "area": 3, "sliced": 3, "kept": None, "split": None})


@query("P15_slice_triangles")
def p15(spark, sf):
    cut = sc.slice_triangles(TRIANGLES.frame(spark, sf), 40.0)
    tris = sc.fan(cut, ["road_id", "tri_id", "gx", "gy"])
    two = lambda a, b, p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (p["x"] - a["x"]) * (b["y"] - a["y"])
    area = F.abs(two(c("t.a"), c("t.b"), c("t.c"))) / 2
    return tris.groupBy("road_id", "gx", "gy").agg(F.count("*").alias("triangles"), (F.round(F.sum(area), 4) + 0.0).alias("area"), (F.round(F.avg("t.a.z"), 4) + 0.0).alias("height"))
