"""Scans, filters, overlays, unions, search and updates."""

from pyspark.sql import functions as F

from tilewright.catalog.registry import query
from tilewright.catalog.sqltext import geohash, r
from tilewright.catalog.partition import EDGES, E, INB, N, OK, S, W, inside_sql, slab_sql
from tilewright.functions import cells, predicates as p
from tilewright.functions.text import declared_columns
from tilewright.operators import refine
from tilewright.plans import search as s
from tilewright.session import scratch_path
from tilewright.sources import clustered as cl, layers as ly
from tilewright.sources.derived import BOUND, EDITS, LAYER, POINTS, POLYGONS

P, L, ED, PG = POINTS.sql(), LAYER.sql(), EDITS.sql(), POLYGONS.sql()
c = F.col


def quads(spark, sf):
    ring = F.array(*[F.struct(c(f"px{k}").alias("x"), c(f"py{k}").alias("y"), c("base_z").alias("z")) for k in range(4)])
    return POLYGONS.frame(spark, sf).withColumn("ring", ring)


MEETS = f"SELECT id FROM edges GROUP BY id HAVING bool_or({slab_sql('{w}', '{s}', '{e}', '{n}')}) OR sum(CASE WHEN {inside_sql('{w}', '{s}')} THEN 1 ELSE 0 END) % 2 = 1"


def meets(b):
    return MEETS.format(w=b[0], s=b[1], e=b[2], n=b[3])


SMALL = (117.2, 31.1, 117.5, 31.3)
CELLS = ("wte", "wtdz", "wtexb", "wte2q8")


@query("SRC1_bounded_feature_scan", f"""
    WITH poly AS ({PG}), edges AS ({EDGES}) SELECT id, brand, kind FROM poly
    WHERE id % 11 <> 0 AND kind IN ('ECONOMY', 'PROMO', 'STANDARD') AND id IN ({meets(SMALL)})""")
def src1(spark, sf):
    df = quads(spark, sf).withColumn("ring", F.when(c("id") % 11 != 0, c("ring")))
    return ly.scan_features(df, SMALL, category="kind", values=["ECONOMY", "PROMO", "STANDARD"]).select("id", "brand", "kind")


@query("SRC1_clustered_scan", f"""
    WITH poly AS ({PG}), edges AS ({EDGES}) SELECT id, brand, kind FROM poly
    WHERE id % 11 <> 0 AND kind IN ('ECONOMY', 'PROMO', 'STANDARD') AND id IN ({meets(SMALL)})""")
def src1c(spark, sf):
    path = scratch_path(spark, "clustered")
    df = quads(spark, sf).withColumn("ring", F.when(c("id") % 11 != 0, c("ring")))
    cl.write_layer(df, path, [F.when(c("ring").isNotNull(), c(k)) for k in ("px0", "py0", "px2", "py2")])
    return ly.scan_features(cl.read_bound(spark, path, SMALL), SMALL, category="kind", values=["ECONOMY", "PROMO", "STANDARD"]).select("id", "brand", "kind")


@query("F3_inside_bound", f"""
    WITH poly AS ({PG}), edges AS ({EDGES}) SELECT id, count(*) AS n FROM edges GROUP BY id
    HAVING min(x1) >= {SMALL[0]} AND max(x1) <= {SMALL[2]} AND min(y1) >= {SMALL[1]} AND max(y1) <= {SMALL[3]}""")
def f3(spark, sf):
    return ly.scan_features(quads(spark, sf), SMALL, whole=True).select("id", F.size("ring").cast("bigint").alias("n"))


HOLED = ("least(w, e)", "s")
TINY = (117.3, 31.2, 117.3004, 31.2003)


@query("F4_meets_bound", f"""
    WITH poly AS ({PG}), edges AS ({EDGES}), a AS ({meets(SMALL)}),
    hole AS (SELECT id, px0 + (px2 - px0) / 4 AS hx0, py0 + (py2 - py0) / 4 AS hy0, px0 + (px2 - px0) * 3 / 4 AS hx1, py0 + (py2 - py0) * 3 / 4 AS hy1 FROM poly),
    t AS ({meets(TINY)}), sw AS (SELECT id FROM hole WHERE {TINY[0]} > hx0 AND {TINY[2]} < hx1 AND {TINY[1]} > hy0 AND {TINY[3]} < hy1)
    SELECT id, id IN (SELECT id FROM a) AS wide, id IN (SELECT id FROM t) AND id NOT IN (SELECT id FROM sw) AS small FROM poly""")
def f4(spark, sf):
    df = quads(spark, sf)
    hx = [c("px0") + (c("px2") - c("px0")) * k / 4 for k in (1, 3)]
    hy = [c("py0") + (c("py2") - c("py0")) * k / 4 for k in (1, 3)]
    hole = F.array(*[F.struct(x.alias("x"), y.alias("y"), c("base_z").alias("z")) for x, y in
                     ((hx[0], hy[0]), (hx[1], hy[0]), (hx[1], hy[1]), (hx[0], hy[1]))])
    df = df.withColumn("rings", F.array(c("ring"), hole))
    lit = lambda b: [F.lit(v) for v in b]
    return df.select("id", p.ring_meets_box(c("ring"), *lit(SMALL)).alias("wide"), p.polygon_meets_box(c("rings"), *lit(TINY)).alias("small"))


@query("F2_envelope_intersects", f"""
    SELECT id FROM ({PG}) WHERE px0 <= {SMALL[2]} AND px2 >= {SMALL[0]} AND py0 <= {SMALL[3]} AND py2 >= {SMALL[1]}""")
def f2(spark, sf):
    return POLYGONS.frame(spark, sf).where(p.box_intersects("px0", "py0", "px2", "py2", SMALL)).select("id")


@query("F6_model_suffix", f"SELECT id, model FROM ({P}) WHERE {OK} AND {INB}")
def f6(spark, sf):
    df = POINTS.frame(spark, sf)
    return df.where(p.model_ok(c("model")) & p.in_bound(c("lng"), c("lat"), BOUND)).select("id", "model")


@query("F7_soft_delete", f"SELECT event_id, id, del_flag FROM ({ED}) WHERE (del_flag <> '1' OR del_flag IS NULL) AND value <> 0")
def f7(spark, sf):
    return EDITS.frame(spark, sf).where(p.live_feature(c("del_flag"), c("value"), c("id"))).select("event_id", "id", "del_flag")


@query("F8_category_filter", f"SELECT id, brand, kind FROM ({PG}) WHERE CAST(size AS VARCHAR) IN ('7', '11', '28') AND kind IN ('PROMO', 'ECONOMY')")
def f8(spark, sf):
    df = POLYGONS.frame(spark, sf)
    both = p.category_filter(c("size"), ["7", "11", "28"]) & p.category_filter(c("kind"), [], {"PROMO": "a", "ECONOMY": "b"})
    return df.where(both).select("id", "brand", "kind")


@query("F9_condition_builder", f"""
    SELECT id, name, status FROM ({L}) WHERE name LIKE '%00%' AND (status IS NULL OR status = 'none' OR status LIKE '%s2%')
      AND segment = 'BUILDING' ORDER BY id LIMIT 500""")
def f9(spark, sf):
    kinds = {"name": "string", "status": "string", "segment": "string", "nation": "int"}
    cond = p.condition_filter(kinds, {"name": "%00%", "status": ["none", "s2"], "segment": "BUILDING"})
    offset, limit = s.page_window(1, 500)
    return LAYER.frame(spark, sf).where(cond).orderBy("id").offset(offset).limit(limit).select("id", "name", "status")


FIELDS = (
    s.FieldSpec("id"), s.FieldSpec("name", searchable=True, submit=True), s.FieldSpec("area", column="segment", searchable=True),
    s.FieldSpec("grade", storage="json", column="props", path=("grade",), searchable=True, submit=True),
    s.FieldSpec("owner_nation", storage="json", column="props", path=("owner", "nation"), listed=False),
    s.FieldSpec("box", storage="geom", listed=False), s.FieldSpec("remark", listed=False, submit=True, auto_create="text"),
)


@query("F10_keyword_search", f"SELECT id FROM ({L}) WHERE coalesce(name, '') ILIKE '%build%' OR coalesce(segment, '') ILIKE '%build%' OR coalesce(status, '') ILIKE '%build%'")
def f10(spark, sf):
    return LAYER.frame(spark, sf).where(p.keyword_filter([c("name"), c("segment"), c("status")], " Build ")).select("id")


@query("F11_key_match", f"SELECT id, name FROM ({L}) WHERE coalesce(CAST(id AS VARCHAR), '') = '42'")
def f11(spark, sf):
    return LAYER.frame(spark, sf).where(p.key_filter([c("id")], " 42 ")).select("id", "name")


@query("F12_storage_projection", f"""
    SELECT id, name, segment AS area, segment AS grade, CAST(nation AS VARCHAR) AS owner_nation, CAST(NULL AS VARCHAR) AS remark,
      {r("CAST(printf('%.7f', lng - CAST(0.000001 AS DOUBLE)) AS DOUBLE)", 5)} AS west FROM ({L})""")
def f12(spark, sf):
    df = s.project(s.ready(LAYER.frame(spark, sf), FIELDS), FIELDS)
    lng = F.regexp_extract("box", r"\(\((\S+) (\S+) (\S+),", 1).cast("double")
    return df.select("id", "name", "area", "grade", "owner_nation", "remark", (F.round(lng, 5) + 0.0).alias("west"))


@query("F14_missing_columns", f"SELECT id, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS BIGINT) AS hits, status FROM ({L})")
def f14(spark, sf):
    df = declared_columns(LAYER.frame(spark, sf), {"note": "text", "hits": "bigint", "status": "int"})
    return df.select("id", "note", "hits", "status")


@query("F15_subtype_mapping", f"""
    SELECT id, CASE kind WHEN 'ECONOMY' THEN 'wave_two' WHEN 'PROMO' THEN 'wave_three' END AS subtype FROM ({PG}) WHERE kind IN ('ECONOMY', 'PROMO')""")
def f15(spark, sf):
    known = ["wave_two", "wave_three", "wave_nose_end"]
    return p.map_subtype(POLYGONS.frame(spark, sf), "kind", {"ECONOMY": "wave_two", "PROMO": "wave_three"}, known).select("id", "subtype")


HASHES = f"SELECT substr({geohash('lng', 'lat', 8)}, 1, CAST(2 + id % 7 AS INTEGER)) || CASE WHEN id % 13 = 0 THEN 'a' ELSE '' END AS geohash FROM ({P})"


@query("F16_leaf_list_check", f"""
    WITH h AS ({HASHES}), m AS (SELECT DISTINCT geohash FROM h WHERE NOT regexp_full_match(geohash, '[{cells.ALPHABET}]{{3,11}}')),
    g AS (SELECT geohash, count(*) AS n FROM h WHERE regexp_full_match(geohash, '[{cells.ALPHABET}]{{3,11}}') GROUP BY 1)
    SELECT geohash, 'malformed' AS reason FROM m UNION ALL SELECT geohash, 'repeated' FROM g WHERE n > 1
    UNION ALL SELECT geohash, 'overlap' FROM g WHERE length(geohash) > 3 AND EXISTS (SELECT 1 FROM g o WHERE length(o.geohash) < length(g.geohash)
       AND o.geohash IN (substr(g.geohash, 1, 3), substr(g.geohash, 1, 4), substr(g.geohash, 1, 5), substr(g.geohash, 1, 6), substr(g.geohash, 1, 7)))""")
def f16(spark, sf):
    df = POINTS.frame(spark, sf)
    cut = F.substring(cells.point_hash(c("lng"), c("lat"), 8), F.lit(1), (c("id") % 7 + 2).cast("int"))
    listed = df.select(F.concat(cut, F.when(c("id") % 13 == 0, F.lit("a")).otherwise(F.lit(""))).alias("geohash"))
    return p.leaf_list_violations(listed)


def layer_input(spark, sf, k):
    """Rows of one layer: every seventeenth point, with all the columns any layer may use."""
    ring = F.array(*[F.struct((c("lng") + a).alias("x"), (c("lat") + b).alias("y"), (c("alt") + z).alias("z"))
                     for a, b, z in ((-0.001, -0.001, 0.0), (0.001, -0.001, 4.0), (0.001, 0.001, 8.0), (-0.001, 0.001, 2.0))])
    z0 = F.lit(0.0)
    return POINTS.frame(spark, sf).where(c("id") % 17 == k).withColumns({
        "pole_id": c("id") + 1000000, "fid": c("id") + 2000000, "chn_name": F.concat(F.lit("n"), c("id").cast("string")),
        "model_name": F.coalesce("model", F.lit("spare.gltf")), "ring": ring, "angle": c("obj_angle"), "height": (c("id") % 9 + 3).cast("double"),
        "width": (c("id") % 4).cast("double"), "type_code": F.nullif((c("id") % 3).cast("string"), F.lit("0")),
        "transform": F.array(z0, z0, F.lit(2.5), z0, z0, z0, F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(2.0))})


def all_layers(spark, sf, level=6):
    heights = POINTS.frame(spark, sf).where(c("model").isNotNull()).groupBy("model").agg((F.max("alt") - F.min("alt") + 1).alias("height")).withColumn(
        "table_name", F.lit("render_toll_building"))
    edits = latest_edits(EDITS.frame(spark, sf)).select("id", "feature_table", "service_data", F.lit(None).cast("string").alias("metadata"))
    edits = edits.withColumn("feature_table", F.lit("hdtraffic_ene"))
    return ly.union_layers([ly.scan_layer(layer_input(spark, sf, k), spec, BOUND, level, edits, heights)
                            for k, spec in enumerate(ly.LAYERS.values())])


def latest_edits(edits):
    """One row per edited id: the newest, by time and then event."""
    return edits.groupBy("id").agg(F.max_by(F.struct(*[x for x in edits.columns if x != "id"]), F.struct("update_time", "event_id")).alias("e")).select("id", "e.*")


SPECS = list(ly.LAYERS.values())
PICK = lambda f: "CASE id % 17 " + " ".join(f"WHEN {k} THEN {f(sp)}" for k, sp in enumerate(SPECS)) + " END"
LAYER_SQL = f"""
    SELECT id AS rid, {PICK(lambda sp: f"'{sp.table}'")} AS table_name, {PICK(lambda sp: f"'{sp.kind}'")} AS type,
      CAST(CASE WHEN id % 17 = 5 THEN id + 1000000 WHEN id % 17 = 10 THEN id + 2000000 ELSE id END AS VARCHAR) AS id,
      CASE WHEN id % 17 IN (0, 1, 2, 3) THEN 'n' || CAST(id AS VARCHAR) WHEN id % 17 = 12 THEN 'lignt' WHEN id % 17 = 10 THEN CAST(id + 2000000 AS VARCHAR) ELSE CAST(id AS VARCHAR) END AS name,
      CASE WHEN id % 17 IN (8, 9, 15) THEN CAST(id AS VARCHAR) || '.glb' WHEN id % 17 = 10 THEN CAST(id + 2000000 AS VARCHAR) || '.glb'
           WHEN id % 17 IN (11, 16) THEN coalesce(model, 'spare.gltf') ELSE model END AS model,
      {r('lng', 8)} AS lng, {r('lat', 8)} AS lat, {r('CASE WHEN id % 17 IN (8, 9, 10) THEN alt + 4 WHEN id % 17 = 7 THEN alt + 2.5 ELSE alt END', 3)} AS alt,
      CASE WHEN id % 17 IN (8, 9, 10, 13, 14) THEN NULL WHEN id % 17 = 15 THEN CAST((CAST(obj_angle AS BIGINT) + 180) % 360 AS DOUBLE) ELSE obj_angle END AS obj_angle,
      CASE WHEN id % 17 IN (8, 9, 10, 11) THEN NULL WHEN id % 17 = 15 THEN 1 WHEN id % 17 = 13 THEN {r('CAST(id % 9 + 3 AS DOUBLE) / tall', 6)} ELSE 2 END AS z_scale
    FROM (SELECT p.*, h.tall FROM ({P}) p LEFT JOIN (SELECT model AS hm, max(alt) - min(alt) + 1 AS tall FROM ({P}) WHERE model IS NOT NULL GROUP BY 1) h ON p.model = h.hm)
    WHERE id % 17 IN (8, 9, 10, 15) OR (CASE WHEN id % 17 IN (11, 16) THEN coalesce(model, 'spare.gltf') ELSE model END LIKE '%glb'
        OR (id % 17 IN (11, 16) AND model IS NULL))"""


def layer_columns(df):
    return df.select("table_name", "type", "id", "name", "model", *[(F.round(k, 8 if k != "alt" else 3) + 0.0).alias(k) for k in ("lng", "lat", "alt")],
                     "obj_angle", (F.round(F.try_element_at("transform", F.lit(10)), 6)).alias("z_scale"))


@query("SRC2_layer_scan_by_cell", f"""
    WITH i AS ({LAYER_SQL}) SELECT substr({geohash('lng', 'lat', 6)}, 1, 6) AS geohash, table_name, count(*) AS n, min(id) AS first_id, {r('sum(alt)', 3)} AS alts
    FROM i GROUP BY 1, 2""")
def src2(spark, sf):
    df = all_layers(spark, sf)
    return df.groupBy(cells.code_to_hash(c("cell"), 6).alias("geohash"), "table_name").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.round(F.sum("alt"), 3).alias("alts"))


@query("SRC2_clustered_layer_scan", f"""
    WITH i AS ({LAYER_SQL}) SELECT substr({geohash('lng', 'lat', 6)}, 1, 6) AS geohash, table_name, count(*) AS n, min(id) AS first_id, {r('sum(alt)', 3)} AS alts
    FROM i WHERE lng >= {SMALL[0]} AND lng <= {SMALL[2]} AND lat >= {SMALL[1]} AND lat <= {SMALL[3]} GROUP BY 1, 2""")
def src2c(spark, sf):
    path = scratch_path(spark, "clustered")
    cl.write_points(all_layers(spark, sf), path)
    df = cl.read_bound(spark, path, SMALL).where(p.in_bound(c("lng"), c("lat"), SMALL))
    return df.groupBy(cells.code_to_hash(c("cell"), 6).alias("geohash"), "table_name").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.round(F.sum("alt"), 3).alias("alts"))


@query("F5_cell_ranges", " UNION ALL ".join(f"SELECT id, '{h}' AS cell FROM ({P}) WHERE substr({geohash('lng', 'lat', 6)}, 1, {len(h)}) = '{h}'" for h in CELLS))
def f5c(spark, sf):
    path = scratch_path(spark, "clustered")
    cl.write_points(POINTS.frame(spark, sf).select("id", "lng", "lat"), path)
    found = [cl.read_cell(spark, path, h).select("id", F.lit(h).alias("cell")) for h in CELLS]
    return ly.union_layers(found)


@query("U3_union_layers", f"SELECT table_name, type, id, name, model, lng, lat, alt, obj_angle, z_scale FROM ({LAYER_SQL})")
def u3(spark, sf):
    return layer_columns(all_layers(spark, sf))


@query("J1_edit_overlay", f"""
    WITH e AS (SELECT id, service_data FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY update_time DESC, event_id DESC) AS rn FROM ({ED})) WHERE rn = 1)
    SELECT p.id, p.model, e.service_data FROM ({P}) p LEFT JOIN e ON p.id = e.id""")
def j1(spark, sf):
    edits = latest_edits(EDITS.frame(spark, sf))
    return ly.overlay_edits(POINTS.frame(spark, sf), edits, "hd_orders", ["service_data"]).select("id", "model", "service_data")


SINCE = "2024-01-10 00:00:00"


@query("U1_deleted_feed", f"SELECT DISTINCT id, kind AS type, epoch_us(update_time) AS us, del_flag FROM ({ED}) WHERE del_flag = '1' AND update_time >= TIMESTAMP '{SINCE}'")
def u1(spark, sf):
    from tilewright.streaming.feeds import deleted_feed

    e = EDITS.frame(spark, sf)
    tables = {k: e.where(c("kind") == k) for k in ("hdSign", "hdPole", "hdGantry", "hdDevice")}
    return deleted_feed(tables, SINCE).select("id", "type", F.unix_micros("update_time").alias("us"), "del_flag")


@query("U2_changed_feed", f"""
    SELECT p.id, e.kind AS type, p.model AS url, epoch_us(e.update_time) AS us FROM ({P}) p JOIN ({ED}) e ON CAST(p.id AS VARCHAR) = CAST(e.id AS VARCHAR)
    WHERE e.update_time >= TIMESTAMP '{SINCE}' AND (e.del_flag <> '1' OR e.del_flag IS NULL) AND p.lng <> 0 AND (p.model LIKE '%.glb' OR p.model LIKE '%.gltf')""")
def u2(spark, sf):
    from tilewright.streaming.feeds import changed_feed

    e, pt = EDITS.frame(spark, sf), POINTS.frame(spark, sf)
    layers = {k: (pt, e.where(c("kind") == k)) for k in ("hdSign", "hdPole", "hdGantry", "hdDevice")}
    return changed_feed(layers, SINCE).select("id", "type", "url", F.unix_micros("update_time").alias("us"))


@query("U4_stale_cells", f"""
    WITH g AS (SELECT k AS level, substr({geohash('lng', 'lat', 6)}, 1, CAST(k AS INTEGER)) AS geohash, max(update_time) AS t, count(*) AS n
               FROM (SELECT *, unnest(generate_series(3, 6)) AS k FROM ({P})) GROUP BY 1, 2),
    cut AS (SELECT max(t) AS top FROM g)
    SELECT CAST(level AS INTEGER) AS level, geohash, n FROM g, cut WHERE t >= top - INTERVAL 900 DAY AND n >= 2
      AND (level < 5 OR substr(geohash, 1, 4) IN (SELECT geohash FROM g WHERE level = 4 AND n > 900))""")
def u4(spark, sf):
    from tilewright.operators.snapshots import drop_below, drop_expired
    from tilewright.session import checkpoint

    # points are counted once per finest cell, and the small table of cells is kept, as several steps read it
    finest = POINTS.frame(spark, sf).groupBy(cells.point_code(c("lng"), c("lat"), 6).alias("code")).agg(F.max("update_time").alias("update_time"), F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(k).alias("level"), cells.ancestor_code(c("code"), 6, k).alias("cell")) for k in range(3, 7)])
    tree = (finest.select("update_time", "n", F.explode(rows).alias("r")).groupBy("r.level", "r.cell")
            .agg(F.max("update_time").alias("update_time"), F.sum("n").alias("n")))
    tree = checkpoint(refine.describe_cells(tree))
    newest = tree.agg(F.max("update_time").alias("top"))
    fresh = drop_expired(tree, newest, "900 DAYS").where("n >= 2")
    closed = tree.where("level = 4 AND n <= 900").select("geohash", "level")
    return drop_below(fresh, closed).select("level", "geohash", "n")


@query("O1_search_page", f"""
    WITH h AS (SELECT * FROM ({L}) WHERE name ILIKE '%00%' OR segment ILIKE '%00%')
    SELECT id, name, segment AS area, segment AS grade, (SELECT count(*) FROM h) AS total FROM (SELECT * FROM h ORDER BY id LIMIT 50 OFFSET 50)""")
def o1(spark, sf):
    rows, total = s.search(LAYER.frame(spark, sf), FIELDS, "00", 2, 0)
    return rows.join(total, F.lit(True))


@query("O2_detail", f"SELECT id, name, segment AS area, segment AS grade, CAST(nation AS VARCHAR) AS owner_nation, CAST(NULL AS VARCHAR) AS remark FROM ({L}) WHERE id = 77")
def o2(spark, sf):
    return s.detail(LAYER.frame(spark, sf), FIELDS, "77").drop("box")


def changes(spark, sf):
    df = LAYER.frame(spark, sf).where(c("id") % 3 == 0)
    known = df.select(c("id").cast("string").alias("record_key"), F.concat(F.lit("N"), c("id").cast("string")).alias("name"),
                      F.concat(F.lit("g"), c("nation").cast("string")).alias("grade"))
    ghosts = df.where(c("id") % 30 == 0).select(F.concat(F.lit("x"), c("id").cast("string")).alias("record_key"), F.lit("n").alias("name"), F.lit("g").alias("grade"))
    return known.unionByName(ghosts)


def repeated_changes(spark, sf):
    """``changes`` with an older and a name-only change before and behind, and nulls submitted for some grades."""
    base, none = changes(spark, sf), F.lit(None).cast("string")
    number = F.try_to_number("record_key", F.lit("9999999999"))
    older = base.select("record_key", F.lit("older").alias("name"), F.lit("older").alias("grade"), F.lit(1).alias("at"), F.array().cast("array<string>").alias("said"))
    middle = base.select("*", F.lit(2).alias("at"), F.array().cast("array<string>").alias("said"))
    named = base.where(number % 9 == 0).select("record_key", F.concat(F.lit("M"), "record_key").alias("name"), none.alias("grade"), F.lit(3).alias("at"), F.array().cast("array<string>").alias("said"))
    emptied = base.where(number % 15 == 0).select("record_key", none.alias("name"), none.alias("grade"), F.lit(4).alias("at"), F.array(F.lit("grade")).alias("said"))
    return older.unionByName(middle).unionByName(named).unionByName(emptied)


NEW_NAME = "CASE WHEN id % 9 = 0 THEN 'M' ELSE 'N' END || CAST(id AS VARCHAR)"
NEW_GRADE = "CASE WHEN id % 15 = 0 THEN NULL ELSE 'g' || CAST(nation AS VARCHAR) END"


@query("P10_repeated_changes", f"""
    SELECT CAST(id AS VARCHAR) AS k, CASE WHEN id % 3 = 0 THEN {NEW_NAME} ELSE name END AS name, CASE WHEN id % 3 = 0 THEN {NEW_GRADE} ELSE segment END AS grade,
       CASE WHEN id % 3 = 0 THEN concat('{{"grade":', coalesce('"' || {NEW_GRADE} || '"', 'null'), ',"name":"', {NEW_NAME}, '"}}') END AS new_values FROM ({L})
    UNION ALL SELECT 'x' || CAST(id AS VARCHAR), 'not found', NULL, NULL FROM ({L}) WHERE id % 30 = 0""")
def p10_repeated(spark, sf):
    snap, audit, missing = s.update(LAYER.frame(spark, sf), FIELDS, repeated_changes(spark, sf), "t", "s", "layer", order="at", submitted="said")
    rows = snap.select(c("id").cast("string").alias("k"), "name", F.get_json_object("props", "$.grade").alias("grade")).join(
        audit.select(c("record_key").alias("k"), "new_values"), "k", "left")
    return rows.unionByName(missing.select(c("record_key").alias("k"), F.lit("not found").alias("name")), allowMissingColumns=True)


@query("P10_audited_update", f"""
    SELECT CAST(id AS VARCHAR) AS k, CASE WHEN id % 3 = 0 THEN 'N' || CAST(id AS VARCHAR) ELSE name END AS name,
       CASE WHEN id % 3 = 0 THEN 'g' || CAST(nation AS VARCHAR) ELSE segment END AS grade, CAST(nation AS VARCHAR) AS owner,
       CASE WHEN id % 3 = 0 THEN concat('{{"grade":"', segment, '","name":"', name, '"}}') END AS old_values,
       CASE WHEN id % 3 = 0 THEN concat('{{"grade":"g', CAST(nation AS VARCHAR), '","name":"N', CAST(id AS VARCHAR), '"}}') END AS new_values FROM ({L})
    UNION ALL SELECT 'x' || CAST(id AS VARCHAR), 'not found', NULL, NULL, NULL, NULL FROM ({L}) WHERE id % 30 = 0""")
def p10(spark, sf):
    snap, audit, missing = s.update(LAYER.frame(spark, sf), FIELDS, changes(spark, sf), "t", "s", "layer")
    audit = audit.select(c("record_key").alias("k"), "old_values", "new_values")
    rows = snap.select(c("id").cast("string").alias("k"), "name", F.get_json_object("props", "$.grade").alias("grade"),
                       F.get_json_object("props", "$.owner.nation").alias("owner")).join(audit, "k", "left")
    lost = missing.select(c("record_key").alias("k"), F.lit("not found").alias("name"))
    return rows.unionByName(lost, allowMissingColumns=True)


@query("P11_registration_confirm", f"""
    SELECT CAST(id AS VARCHAR) AS k, segment AS grade, CASE WHEN id % 4 = 0 THEN CAST(id % 7 + 12 AS DOUBLE) END AS m12, CASE WHEN id % 4 = 0 THEN CAST(16 AS BIGINT) END AS n
    FROM ({L}) UNION ALL SELECT 'x' || CAST(id AS VARCHAR), 'not found', NULL, NULL FROM ({L}) WHERE id % 40 = 0""")
def p11(spark, sf):
    df = LAYER.frame(spark, sf)
    m = F.array(*[(c("id") % 7 + k).cast("double") for k in range(16)])
    known = df.where(c("id") % 4 == 0).select(c("id").cast("string").alias("record_key"), m.alias("matrix"))
    ghosts = df.where(c("id") % 40 == 0).select(F.concat(F.lit("x"), c("id").cast("string")).alias("record_key"), m.alias("matrix"))
    snap, missing = s.save_registration(df, known.unionByName(ghosts), column="props")
    keys = F.json_object_keys(F.get_json_object("props", "$.transform"))
    rows = snap.select(c("id").cast("string").alias("k"), F.get_json_object("props", "$.grade").alias("grade"),
                       F.get_json_object("props", "$.transform.12").cast("double").alias("m12"),
                       F.when(keys.isNotNull(), F.size(keys)).cast("bigint").alias("n"))
    return rows.unionByName(missing.select(c("record_key").alias("k"), F.lit("not found").alias("grade")), allowMissingColumns=True)
