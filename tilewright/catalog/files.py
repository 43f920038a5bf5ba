"""File sources, sinks and the edit stream. Files are written by Spark from the given tables into the shared folder."""

from pyspark.sql import functions as F

from tilewright.catalog.geodesy import geodetic_sql
from tilewright.catalog.layers import ED, L, P, PG, changes, latest_edits, quads
from tilewright.catalog.partition import BOUND, INB, OK
from tilewright.catalog.registry import query
from tilewright.catalog.sqltext import geohash, r
from tilewright.catalog.tiles import COARSE
from tilewright.functions import cells, geodesy as g
from tilewright.operators import refine, snapshots as sn, tiles as tl
from tilewright.plans import build, search as s
from tilewright.session import scratch_path
from tilewright.sources import assets as at, files as fl, sinks as sk
from tilewright.sources.derived import EDITS, LAYER, POINTS, Derived
from tilewright.streaming import jobs

c = F.col
SUP = Derived("supplier", ("s_suppkey AS k", "s_acctbal AS bal"))
SQ = SUP.sql()


def put(df, label):
    """Write (path, content) rows as files; returns the folder."""
    spark = df.sparkSession
    root = scratch_path(spark, label)
    uri = root if "://" in root else "file://" + root
    sk.export_documents(df, uri).agg(F.sum("bytes")).collect()
    return root


@query("SRC3_geojson_features", f"""
    SELECT CAST(id AS VARCHAR) AS id, 'n' || CAST(id AS VARCHAR) AS name, CAST(id % 50 AS VARCHAR) AS road_id, 'surface' AS feature_type, CAST(5 AS BIGINT) AS vertices, {r('px2', 6)} AS x2 FROM ({PG}) WHERE id % 3 <> 0
    UNION ALL SELECT CAST(id AS VARCHAR), '', CAST(id % 40 + 1 AS VARCHAR), 'line', 2, {r('px0', 6)} FROM ({PG}) WHERE id % 3 = 0""")
def src3(spark, sf):
    df = quads(spark, sf)
    pt = lambda k: F.array(c(f"px{k}"), c(f"py{k}"), c("base_z"))
    text = lambda v: v.cast("string")
    poly = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*[pt(k % 4) for k in range(5)])).alias("coordinates")).alias("geometry"),
                              F.struct(c("id"), F.concat(F.lit("n"), text(c("id"))).alias("name"), F.when(c("id") % 2 == 0, c("id") % 50).alias("road_id"), (c("id") % 50).alias("hroad_id")).alias("properties")))
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.array(pt(0), pt(2)).alias("coordinates")).alias("geometry"),
                              F.struct(c("id"), (c("id") % 40 + 1).alias("ldid")).alias("properties")))
    docs = df.select(F.floor(c("id") / 50).alias("doc"), F.when(c("id") % 3 == 0, line).otherwise(poly).alias("f")).groupBy("doc").agg(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    path = scratch_path(spark, "geojson")
    docs.select("value").write.text(path)
    feats = fl.read_geojson(spark, path)
    surf = fl.surface_features(feats).select("id", "name", "road_id", "feature_type", F.size("ring").cast("bigint").alias("vertices"), F.round(c("ring")[2]["x"], 6).alias("x2"))
    cent = fl.centreline_features(feats).select("id", F.lit("").alias("name"), c("hroad_id").cast("string").alias("road_id"), F.lit("line").alias("feature_type"),
                                                F.size("line").cast("bigint").alias("vertices"), F.round(c("line")[0]["x"], 6).alias("x2"))
    return surf.unionByName(cent)


def building_csv(spark, sf):
    df = quads(spark, sf)
    hole = F.lit(", (0 0 0, 1 0 0, 1 1 0, 0 0 0))")
    wkt = sk.ring_text(c("ring"))
    wkt = F.when(c("id") % 13 == 0, F.lit("LINESTRING (0 0, 1 1)")).when(c("id") % 5 == 0, F.concat(F.substring(wkt, F.lit(1), F.length(wkt) - 1), hole)).otherwise(wkt)
    rows = df.select(c("id").cast("string").alias("id"), "kind", F.when(c("id") % 7 == 0, "n/a").otherwise((c("size") % 20 + 3).cast("string")).alias("height"),
                     F.when(c("id") % 4 == 0, "").otherwise((c("size") % 6).cast("string")).alias("storeys"), wkt.alias("geometry"))
    path = scratch_path(spark, "buildings")
    sk.write_csv(rows, path)
    return fl.read_csv(spark, path, ["id", "kind", "height", "storeys", "geometry"])


@query("SRC4_csv_wkt_polygons", f"SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 13 = 0 THEN NULL ELSE CAST(4 AS BIGINT) END AS vertices, CASE WHEN id % 13 <> 0 THEN {r("CAST(printf('%.8f', px2) AS DOUBLE)", 6)} END AS x2 FROM ({PG})")
def src4(spark, sf):
    df = building_csv(spark, sf).withColumn("ring", fl.parse_polygon(c("geometry")))
    return df.select("id", F.when(c("ring").isNotNull(), F.size("ring")).cast("bigint").alias("vertices"), F.round(c("ring")[2]["x"], 6).alias("x2"))


KINDS = ("ECONOMY", "PROMO", "STANDARD")
STATUS = "CASE WHEN kind NOT IN ('ECONOMY', 'PROMO', 'STANDARD') THEN 'ignored' WHEN id % 17 = 0 THEN 'skipped' WHEN id % 7 = 0 THEN 'skipped' WHEN id % 13 = 0 THEN 'failed' ELSE 'ok' END"
PLACED = f"""SELECT *, {STATUS} AS status FROM ({PG})"""


@query("P19_building_placement", f"""
    SELECT CAST(id AS VARCHAR) AS id, status, CASE WHEN status = 'ok' THEN printf('%d.000000', size % 20 + 3) END AS height,
      CASE WHEN status = 'ok' THEN CAST(CASE WHEN id % 4 = 0 OR size % 6 = 0 THEN 1 ELSE size % 6 END AS DOUBLE) END AS storeys, CASE WHEN status = 'ok' THEN printf('%d.000000', id % 40) END AS altitude FROM ({PLACED})""")
def p19(spark, sf):
    rows = building_csv(spark, sf)
    there = rows.where(c("id").cast("bigint") % 17 == 0).select(F.concat("id", F.lit(".glb")).alias("model"))
    return fl.place_buildings(rows, KINDS, there).select("id", "status", "height", "storeys", "altitude")


@query("SNK8_placement_manifest", f"""
    SELECT CAST(id AS VARCHAR) AS id, CAST(id AS VARCHAR) || '.glb' AS model, {r('(px0 + greatest(px1, px2)) / 2', 5)} AS lng FROM ({PLACED}) WHERE status = 'ok'""")
def snk8(spark, sf):
    rows = building_csv(spark, sf)
    there = rows.where(c("id").cast("bigint") % 17 == 0).select(F.concat("id", F.lit(".glb")).alias("model"))
    path = scratch_path(spark, "placements")
    sk.write_csv(fl.place_buildings(rows, KINDS, there).where("status = 'ok'"), path)
    back = fl.read_csv(spark, path, ["id", "model", "longitude"])
    return back.select("id", "model", (F.round(c("longitude").cast("double"), 5) + 0.0).alias("lng"))


@query("P20_text_sign_placement", f"""
    SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 6 = 0 THEN 'skipped' WHEN id % 11 = 0 THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN id % 6 <> 0 AND id % 11 <> 0 THEN 's_' || CAST(id AS VARCHAR) || '.glb' END AS model, CASE WHEN id % 6 <> 0 AND id % 11 <> 0 THEN printf('%d.000', id % 50) END AS altitude FROM ({P})""")
def p20(spark, sf):
    df = POINTS.frame(spark, sf)
    wkt = F.when(c("id") % 11 == 0, F.lit("POINT (x 1)")).otherwise(F.format_string("POINT Z (%.9f %.9f %.3f)", "lng", "lat", "alt"))
    rows = df.select(F.concat(F.lit("s/"), c("id").cast("string")).alias("id"), F.when(c("id") % 6 == 0, " ").otherwise("name").alias("text"), wkt.alias("geometry"))
    return fl.place_signs(rows).select(F.substring("id", 3, 30).alias("id"), "status", "model", "altitude")


@query("SNK4_csv_export", f"""
    SELECT CAST(id AS VARCHAR) AS id, printf('POLYGON Z ((%.8f', px0) AS head, CAST(size AS VARCHAR) AS size, brand || ', "x"' AS note FROM ({PG})""")
def snk4(spark, sf):
    path = scratch_path(spark, "export")
    df = quads(spark, sf).select("id", "ring", "size", F.concat("brand", F.lit(', "x"')).alias("note"))
    sk.write_csv(sk.csv_table(df, "ring", "public"), path)
    return fl.read_csv(spark, path, ["WKT", "id"]).select("id", F.regexp_extract("WKT", r"^(\S+ \S+ \S+)", 1).alias("head"), "size", "note")


@query("SNK1_partition_upsert", f"""
    WITH o AS (SELECT {geohash('lng', 'lat', 6)} AS geohash, count(*) AS total_count FROM ({P}) WHERE id % 2 = 0 GROUP BY 1),
    n AS (SELECT {geohash('lng', 'lat', 6)} AS geohash, count(*) AS total_count FROM ({P}) WHERE id % 2 <> 0 GROUP BY 1)
    SELECT coalesce(o.geohash, n.geohash) AS geohash, coalesce(n.total_count, o.total_count) AS total_count, CASE WHEN o.geohash IS NULL THEN 'new' ELSE 'old' END AS origin FROM o FULL JOIN n ON o.geohash = n.geohash""")
def snk1(spark, sf):
    df = POINTS.frame(spark, sf).withColumn("geohash", cells.point_hash(c("lng"), c("lat"), 6))
    side = lambda d, n: d.groupBy("geohash").agg(F.count("*").alias("total_count")).withColumns({"level": F.lit(6), "origin": F.lit(n)})
    out = sn.upsert(side(df.where("id % 2 = 0"), "old"), side(df.where("id % 2 <> 0"), "new"), ["geohash", "level"], ["total_count"])
    return out.select("geohash", "total_count", "origin")


@query("SNK3_run_report", f"SELECT CAST(length(h) AS BIGINT) AS level, count(*) AS n FROM (SELECT DISTINCT {COARSE} AS h FROM ({P}) UNION SELECT DISTINCT substr({COARSE}, 1, 4) FROM ({P})) GROUP BY 1")
def snk3(spark, sf):
    path = scratch_path(spark, "report")
    h = POINTS.frame(spark, sf).select(F.explode(F.array(cells.point_hash(c("lng"), c("lat"), 5), cells.point_hash(c("lng"), c("lat"), 4))).alias("h")).distinct()
    sk.write_report(h.groupBy(F.length("h").alias("level")).agg(F.count("*").alias("n")), path)
    return spark.read.schema("level bigint, n bigint").json(path)


@query("SNK5_audit_append", f"SELECT CAST(id AS VARCHAR) AS record_key, concat('{{\"grade\":\"', segment, '\",\"name\":\"', name, '\"}}') AS old_values FROM ({L}) WHERE id % 3 = 0")
def snk5(spark, sf):
    path = scratch_path(spark, "audit")
    ch = changes(spark, sf)
    from tilewright.catalog.layers import FIELDS

    for part in (ch.where("crc32(record_key) % 2 = 0"), ch.where("crc32(record_key) % 2 = 1")):
        _, audit, _ = s.update(LAYER.frame(spark, sf), FIELDS, part, "t", "s", "layer")
        sk.append(audit, path)
    return spark.read.parquet(path).select("record_key", "old_values")


@query("SNK6_history_append_delete", f"SELECT event_id, id FROM ({ED}) WHERE id NOT IN (SELECT id FROM ({ED}) WHERE del_flag = '1')")
def snk6(spark, sf):
    path = scratch_path(spark, "history")
    e = EDITS.frame(spark, sf).select("event_id", "id", "del_flag")
    sk.append(e.where("event_id % 2 = 0"), path)
    sk.append(e.where("event_id % 2 = 1"), path)
    history = spark.read.parquet(path)
    return sn.delete_by_key(history, history.where("del_flag = '1'"), ["id"]).select("event_id", "id")


def model_files(spark, sf, label, keep):
    rows = SUP.frame(spark, sf).where(keep).select(F.format_string("hd_%d/m%d.glb", c("k") % 4, c("k")).alias("path"), F.concat(F.lit("body"), (c("k") % 10).cast("string")).alias("content"))
    return put(rows, label)


@query("SRC5_model_assets", f"""
    SELECT 'hd_' || CAST(k % 4 AS VARCHAR) AS table_name, 'm' || CAST(k AS VARCHAR) || '.glb' AS model, CASE WHEN k % 3 = 0 THEN 'local' WHEN k % 5 <> 0 THEN 'remote' ELSE 'missing' END AS origin,
       CASE WHEN k % 3 = 0 OR k % 5 <> 0 THEN CAST(5 AS BIGINT) END AS bytes FROM ({SQ})""")
def src5(spark, sf):
    local = at.asset_catalogue(spark, model_files(spark, sf, "local", "k % 3 = 0"))
    remote = at.asset_catalogue(spark, model_files(spark, sf, "remote", "k % 5 <> 0"), with_hash=False)
    wanted = SUP.frame(spark, sf).select(F.format_string("hd_%d", c("k") % 4).alias("table_name"), F.format_string("m%d.glb", c("k")).alias("model"))
    return at.resolve_assets(wanted, local, remote).select("table_name", "model", "origin", "bytes")


@query("SNK7_output_inventory", f"SELECT kind, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS expired FROM (SELECT CASE WHEN k % 3 = 0 THEN 'model' WHEN k % 3 = 1 THEN 'manifest' ELSE 'other' END AS kind, k % 7 + 1 AS n FROM ({SQ})) GROUP BY 1")
def snk7(spark, sf):
    suffix = F.when(c("k") % 3 == 0, "glb").when(c("k") % 3 == 1, "json").otherwise("txt")
    root = put(SUP.frame(spark, sf).select(F.concat(F.lit("tiles/f"), c("k").cast("string"), F.lit("."), suffix).alias("path"), F.repeat(F.lit("x"), (c("k") % 7 + 1).cast("int")).alias("content")), "out")
    old = at.expired(spark, root).agg(F.count("*").alias("expired"))
    return at.inventory(spark, root).join(old, F.lit(True))


def child_docs(spark, sf):
    """One child tileset per supplier, each with a box placed by its root transform."""
    lng, lat, alt = F.lit(117.0) + (c("k") % 80) * 0.01, F.lit(31.0) + (c("k") % 60) * 0.01, (c("k") % 30).cast("double")
    z = F.lit(0.0)
    box = F.array(z, z, F.lit(5.0), F.lit(20.0), z, z, z, F.lit(10.0), z, z, z, F.lit(5.0))
    doc = F.to_json(F.struct(
        F.struct(F.when(c("k") % 9 == 0, "1.1").otherwise("1.0").alias("version")).alias("asset"), (c("k") % 500).cast("double").alias("geometricError"),
        F.struct(F.struct(box.alias("box")).alias("boundingVolume"), (c("k") % 500).cast("double").alias("geometricError"),
                 F.array(*g.pose_matrix(lng, lat, alt, F.lit(0.0))).alias("transform")).alias("root")))
    return put(SUP.frame(spark, sf).select(F.format_string("c%d/tileset.json", c("k")).alias("path"), doc.alias("content")), "tree")


@query("SRC6_child_tilesets", f"SELECT 'c' || CAST(k AS VARCHAR) || '/tileset.json' AS uri, CASE WHEN k % 9 = 0 THEN '1.1' ELSE '1.0' END AS version, CAST(k % 500 AS DOUBLE) AS error, 'box' AS kind FROM ({SQ})")
def src6(spark, sf):
    return at.child_tilesets(spark, child_docs(spark, sf)).select("uri", "version", "error", "kind")


def catalogue(spark, sf):
    kids = at.child_tilesets(spark, child_docs(spark, sf))
    baked = g.aabb_box(g.transform_points(g.box_corners(c("box")), c("transform")))
    kids = kids.withColumn("baked", baked).withColumn("rg", g.box_region(c("baked")))
    return tl.merge_catalogue(kids.select("uri", "version", "error", "kind", *[c("rg")[i].alias(k) for i, k in enumerate(("w", "s", "e", "n", "lo", "hi"))]))


@query("A11_merge_child_tilesets", f"SELECT count(*) AS children, 'box' AS kind, max(least(CAST(k % 500 AS DOUBLE), 200)) AS error, max(least(CAST(k % 500 AS DOUBLE), 200)) * 10 AS root_error, '1.1' AS version FROM ({SQ})")
def a11(spark, sf):
    return catalogue(spark, sf).select("children", "kind", "error", "root_error", "version")


@query("P17_merged_catalogue")
def p17(spark, sf):
    out = catalogue(spark, sf)
    return out.select("children", *[g.clean(c(k), 8).alias(k) for k in "wsen"], g.clean(c("lo"), 2).alias("lo"), g.clean(c("hi"), 2).alias("hi"))


def archives(spark, sf):
    """One archive per supplier: three ids each, composites among them, and some broken files."""
    import struct

    rows = SUP.frame(spark, sf).select("k")

    def pack(batches):
        import json

        import pandas as pd

        def b3dm(ids):
            table = json.dumps({"id": ids}).encode()
            body = struct.pack("<4I", 0, 0, len(table), 0) + table
            return b"b3dm" + struct.pack("<2I", 1, len(body) + 12) + body

        for b in batches:
            out = []
            for k in b["k"]:
                one = b3dm([float(k * 3), str(k * 3 + 1)])
                two = b3dm([int(k * 3 + 2), " x"])
                data = one if k % 4 else b"cmpt" + struct.pack("<3I", 1, 16 + len(one) + len(two), 2) + one + two
                out.append((f"contents/{k % 3}/{k % 2}/{k}.{'b3dm' if k % 4 else 'cmpt'}", data if k % 10 != 7 else b"oops" + data))
            yield pd.DataFrame(out, columns=["path", "content"])

    return put(rows.mapInPandas(pack, "path string, content binary"), "archives")


INDEX = f"""SELECT k, 0 AS feature_index, CAST(k * 3 AS VARCHAR) AS feature_id FROM ({SQ}) WHERE k % 10 <> 7 UNION ALL SELECT k, 1, CAST(k * 3 + 1 AS VARCHAR) FROM ({SQ}) WHERE k % 10 <> 7
    UNION ALL SELECT k, 2, CAST(k * 3 + 2 AS VARCHAR) FROM ({SQ}) WHERE k % 4 = 0 AND k % 10 <> 7 UNION ALL SELECT k, 3, 'x' FROM ({SQ}) WHERE k % 4 = 0 AND k % 10 <> 7"""


def file_no():
    return F.regexp_extract("path", r"/(\d+)\.[a-z0-9]+$", 1).cast("bigint")


@query("SRC7_archive_index", f"SELECT k, CAST(feature_index AS BIGINT) AS feature_index, feature_id, false AS broken FROM ({INDEX}) UNION ALL SELECT k, NULL, NULL, true FROM ({SQ}) WHERE k % 10 = 7")
def src7(spark, sf):
    ix = at.archive_index(spark, archives(spark, sf))
    return ix.select(file_no().alias("k"), "feature_index", "feature_id", c("problem").isNotNull().alias("broken"))


@query("J13_requested_ids", f"""
    WITH w AS (SELECT DISTINCT CAST(k * 2 AS VARCHAR) AS feature_id FROM ({SQ})), i AS ({INDEX})
    SELECT feature_id, min(k) AS k, false AS missing FROM i WHERE feature_id IN (SELECT feature_id FROM w) GROUP BY 1
    UNION ALL SELECT feature_id, NULL, true FROM w WHERE feature_id NOT IN (SELECT feature_id FROM i)""")
def j13(spark, sf):
    ix = at.archive_index(spark, archives(spark, sf))
    wanted = SUP.frame(spark, sf).select(F.explode(F.array(F.concat(F.lit(" "), (c("k") * 2).cast("string")), F.lit(""))).alias("feature_id"))
    hits, missing = at.find_features(ix, wanted)
    return hits.select("feature_id", file_no().alias("k"), F.lit(False).alias("missing")).unionByName(
        missing.select("feature_id", F.lit(None).cast("bigint").alias("k"), F.lit(True).alias("missing")))


@query("P18_archive_lookup", f"""
    WITH i AS ({INDEX}), b AS (SELECT * FROM i WHERE k % 2 = 0)
    SELECT feature_id, min(k) AS k FROM b WHERE feature_id <> 'x' GROUP BY 1""")
def p18(spark, sf):
    ix = at.archive_index(spark, archives(spark, sf))
    level, x = F.regexp_extract("path", r"/(\d+)/(\d+)/\d+\.", 1), F.regexp_extract("path", r"/(\d+)/(\d+)/\d+\.", 2)
    # path is level/x/y; y carries the archive number, so the region is tall enough to hold every row
    inside = at.in_query_box(ix, (0.0, 0.0, 8.0, 1.0e9), (0.0, 0.0, 0.5, 1.0e18))
    wanted = ix.select("feature_id").where("feature_id <> 'x'")
    hits, _ = at.find_features(inside, wanted)
    return hits.select("feature_id", file_no().alias("k"))


# ---- edit stream -------------------------------------------------------------------------------------------------

def edit_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = jobs.read_stream(spark, sf, "events.parquet", schema)
    return raw.selectExpr(*[e if isinstance(e, str) else e("spark") for e in EDITS.exprs])


@query("ST1_edit_feed", f"SELECT DISTINCT id, epoch_us(update_time) AS us, CASE WHEN del_flag = '1' THEN 'deleted' ELSE 'changed' END AS feed FROM ({ED})")
def st1(spark, sf):
    out = jobs.run_available(jobs.edit_feed(edit_stream(spark, sf)), jobs.stream_path(spark, "feed"))
    return out.select("id", F.unix_micros("update_time").alias("us"), "feed")


@query("ST2_dirty_windows", f"""
    SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, update_time, TIMESTAMP '2000-01-01 00:00:00')) AS us, id % 16 AS cell, count(*) AS edits FROM ({ED}) GROUP BY 1, 2""")
def st2(spark, sf):
    path = jobs.stream_path(spark, "windows")
    jobs.run_available(jobs.dirty_windows(edit_stream(spark, sf), c("id") % 16, "6 hours"), path, "update", jobs.upsert_batches(path, ["start", "cell"], "edits"))
    return jobs.newest_version(spark, path).select(F.unix_micros("start").alias("us"), "cell", "edits")


REBUILT = f"""
    WITH p AS (SELECT id, model, {COARSE} AS geohash FROM ({P}) WHERE {OK} AND {INB}), d AS (SELECT DISTINCT {COARSE} AS geohash FROM ({P}) p JOIN ({ED}) e ON p.id = e.id WHERE e.del_flag = '1')
    SELECT geohash, model, count(*) AS instances FROM p WHERE geohash IN (SELECT geohash FROM d) GROUP BY 1, 2"""


@query("ST3_incremental_rebuild", REBUILT)
def st3(spark, sf):
    points = POINTS.frame(spark, sf)
    lv = build.encoded(points.where(OK), BOUND).select(F.lit(5).alias("level"), cells.ancestor_code(c("code"), 11, 5).alias("cell")).distinct()

    def rebuild(batch):
        touched = points.join(batch.where("del_flag = '1'").select("id").distinct(), "id", "left_semi").select("lng", "lat")
        groups, _ = build.rebuild(points, touched, lv, BOUND)
        return groups.select("level", "cell", "table_name", "model", "instances"), build.dirty_leaves(touched, lv)[0]

    out = jobs.incremental_rebuild(edit_stream(spark, sf), rebuild, jobs.stream_path(spark, "tiles"), ["level", "cell"])
    return out.select(cells.code_to_hash_at(c("cell"), c("level")).alias("geohash"), "model", "instances")


@query("ST4_latest_state", f"SELECT id, del_flag, event_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY update_time DESC, event_id DESC) AS rn FROM ({ED})) WHERE rn = 1")
def st4(spark, sf):
    path = jobs.stream_path(spark, "state")
    jobs.run_available(jobs.latest_state(edit_stream(spark, sf)), path, "update", jobs.upsert_batches(path, ["id"], "update_time"))
    return jobs.newest_version(spark, path).select("id", "del_flag", "event_id")


@query("ST5_expired_cells", f"""
    WITH g AS (SELECT id % 300 AS cell, max(update_time) AS t FROM ({ED}) GROUP BY 1), m AS (SELECT max(t) AS top FROM g) SELECT cell, epoch_us(t) AS us FROM g, m WHERE t >= top - INTERVAL 12 HOUR""")
def st5(spark, sf):
    path = jobs.stream_path(spark, "touched")
    edits = edit_stream(spark, sf).withColumn("cell", c("id") % 300)
    jobs.run_available(jobs.last_update(edits, "cell"), path, "update", jobs.upsert_batches(path, ["cell"], "update_time"))
    table = jobs.newest_version(spark, path)
    return sn.drop_expired(table, table.agg(F.max("update_time").alias("top")), "12 HOURS").select("cell", F.unix_micros("update_time").alias("us"))


@query("ST6_last_update", f"SELECT kind, epoch_us(max(update_time)) AS us FROM ({ED}) GROUP BY 1")
def st6(spark, sf):
    path = jobs.stream_path(spark, "last")
    jobs.run_available(jobs.last_update(edit_stream(spark, sf), "kind"), path, "update", jobs.upsert_batches(path, ["kind"], "update_time"))
    return jobs.newest_version(spark, path).select("kind", F.unix_micros("update_time").alias("us"))
