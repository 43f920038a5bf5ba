"""Spatial, nearest, drape and chain joins."""

from pyspark.sql import functions as F

from tilewright.catalog.layers import PG
from tilewright.catalog.lines import SEG, rd, seg
from tilewright.catalog.partition import BOUND, slab_sql
from tilewright.catalog.registry import query
from tilewright.catalog.sqltext import geohash, r
from tilewright.functions import cells
from tilewright.operators import chains as ch, crossing, drape as dr, lines as ln, nearest as nr, pyramid as py, refine
from tilewright.operators.boxes import around_points, overlapping
from tilewright.sources.derived import GEO_LINE_VERTICES, LINE_VERTICES, POINTS, POLYGONS, TRIANGLES

P, V, GV, T = POINTS.sql(), LINE_VERTICES.sql(), GEO_LINE_VERTICES.sql(), TRIANGLES.sql()
c = F.col
GSEG = SEG.replace(V, GV).replace("x AS x1", "lng AS x1").replace("y AS y1", "lat AS y1").replace("lead(x)", "lead(lng)").replace("lead(y)", "lead(lat)")


def near_sql(px: str, py: str) -> tuple[str, str]:
    t = f"least(greatest((({px} - x1) * (x2 - x1) + ({py} - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)), 0), 1)"
    return t, f"sqrt(power({px} - (x1 + t * (x2 - x1)), 2) + power({py} - (y1 + t * (y2 - y1)), 2))"


TT, DD = near_sql("lng", "lat")


@query("J5_nearest_line_measure", f"""
    WITH {GSEG}, pr AS (SELECT p.id, p.lng, p.lat, s.*, {TT} AS t FROM ({P}) p CROSS JOIN seg s),
    b AS (SELECT id, arg_min(struct_pack(line_id := line_id, s := s0 + t * length, total := total), struct_pack(d := round({DD}, 12), l := line_id, i := i)) AS x FROM pr GROUP BY id)
    SELECT id, x.line_id AS line_id, round(x.line_id + x.s / x.total * CAST(0.25 AS DOUBLE), 6) AS km_value FROM b""")
def j5(spark, sf):
    g = GEO_LINE_VERTICES.frame(spark, sf).withColumnsRenamed({"lng": "x", "lat": "y"})
    items = nr.segment_items(ln.stations(ln.segments_of(g)).select("line_id", "i", "x1", "y1", "x2", "y2", "s0", "s1", "total"))
    pts = POINTS.frame(spark, sf).select("id", c("lng").alias("px"), c("lat").alias("py"))
    d, t = nr.segment_distance(c("px"), c("py"), c("x1"), c("y1"), c("x2"), c("y2"))
    km = c("line_id") + (c("s0") + t * (c("s1") - c("s0"))) / c("total") * 0.25
    best = py.nearest(pts, items, "id", d, ["line_id", "i"], ["line_id", "i"], 0.004, made={"km": km}, digits=12)
    return best.select("id", "line_id", F.round("km", 6).alias("km_value"))


OFFS = "line_id * 100 + i AS pid, line_id, x + CAST((i * 7) % 5 AS DOUBLE) - 2 AS px, y + CAST((i * 3) % 7 AS DOUBLE) * CAST(0.5 AS DOUBLE) - CAST(1.7 AS DOUBLE) AS py"
TP, DP = near_sql("px", "py")


@query("J12_station_and_offset", f"""
    WITH {SEG}, q AS (SELECT {OFFS} FROM ({V})), pr AS (SELECT q.pid, px, py, seg.*, {TP} AS t FROM q JOIN seg USING (line_id)),
    k AS (SELECT *, round({DP}, 9) AS d FROM pr), b AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, i) AS rn FROM k)
    SELECT pid, {r('s0 + t * length', 3)} AS station, {r('CASE WHEN (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) < 0 THEN -d ELSE d END', 3)} AS "offset" FROM b WHERE rn = 1""")
def j12(spark, sf):
    pts = LINE_VERTICES.frame(spark, sf).selectExpr(*OFFS.split(", "))
    items = nr.segment_items(seg(spark, sf))
    d, t = nr.segment_distance(c("px"), c("py"), c("x1"), c("y1"), c("x2"), c("y2"))
    side = (c("x2") - c("x1")) * (c("py") - c("y1")) - (c("y2") - c("y1")) * (c("px") - c("x1"))
    best = py.nearest(pts, items, "pid", d, ["i"], ["i"], 16.0, on=("line_id",), made={"station": c("s0") + t * (c("s1") - c("s0")), "side": side}, digits=9)
    out = best.select("pid", "station", F.when(c("side") < 0, -c("distance")).otherwise(c("distance")).alias("offset"))
    return rd(out, {"pid": None, "station": 3, "offset": 3})


PADM, RR = 5.0, "CAST(6378137 AS DOUBLE)"


def seg_box_sql() -> str:
    """Metres between a segment and a cell in the cell's own frame."""
    def d(px, py, ax, ay, bx, bw):
        t = f"least(greatest((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({bw} - {ay})) / (power({bx} - {ax}, 2) + power({bw} - {ay}, 2)), 0), 1)"
        return f"sqrt(power({px} - {ax} - {t} * ({bx} - {ax}), 2) + power({py} - {ay} - {t} * ({bw} - {ay}), 2))"

    corners = [d(x, y, "ux1", "uy1", "ux2", "uy2") for x in ("0", "cwid") for y in ("0", "chei")]
    ends = [f"sqrt(power(greatest(-{x}, {x} - cwid, 0), 2) + power(greatest(-{y}, {y} - chei, 0), 2))" for x, y in (("ux1", "uy1"), ("ux2", "uy2"))]
    return f"least({', '.join(corners + ends)})"


@query("J3_within_distance_count", f"""
    WITH {GSEG}, gx AS (SELECT *, unnest(generate_series(CAST(floor((least(x1, x2) - 0.0002 + 180) / 360 * 262144) AS BIGINT), CAST(floor((greatest(x1, x2) + 0.0002 + 180) / 360 * 262144) AS BIGINT))) AS qx FROM seg),
    gy AS (SELECT *, unnest(generate_series(CAST(floor((least(y1, y2) - 0.0002 + 90) / 180 * 131072) AS BIGINT), CAST(floor((greatest(y1, y2) + 0.0002 + 90) / 180 * 131072) AS BIGINT))) AS qy FROM gx),
    b AS (SELECT *, CAST(qx AS DOUBLE) / 262144 * 360 - 180 AS cw, CAST(qy AS DOUBLE) / 131072 * 180 - 90 AS cs FROM gy),
    m AS (SELECT *, radians(CAST(360 AS DOUBLE) / 262144) * {RR} * cos(radians(cs)) AS cwid, radians(CAST(180 AS DOUBLE) / 131072) * {RR} AS chei, radians(x1 - cw) * {RR} * cos(radians(cs)) AS ux1,
       radians(x2 - cw) * {RR} * cos(radians(cs)) AS ux2, radians(y1 - cs) * {RR} AS uy1, radians(y2 - cs) * {RR} AS uy2 FROM b),
    z AS (SELECT *, {seg_box_sql()} AS dist, greatest(least(ux1, ux2), 0) <= least(greatest(ux1, ux2), cwid) AND greatest(least(uy1, uy2), 0) <= least(greatest(uy1, uy2), chei) AS mb FROM m),
    h AS (SELECT DISTINCT line_id, qx, qy FROM z WHERE dist <= {PADM} OR (mb AND dist > {PADM} AND
       (SELECT least((0 - ux1) * (uy2 - uy1) - (0 - uy1) * (ux2 - ux1), (cwid - ux1) * (uy2 - uy1) - (0 - uy1) * (ux2 - ux1), (0 - ux1) * (uy2 - uy1) - (chei - uy1) * (ux2 - ux1), (cwid - ux1) * (uy2 - uy1) - (chei - uy1) * (ux2 - ux1)) <= 0
          AND greatest((0 - ux1) * (uy2 - uy1) - (0 - uy1) * (ux2 - ux1), (cwid - ux1) * (uy2 - uy1) - (0 - uy1) * (ux2 - ux1), (0 - ux1) * (uy2 - uy1) - (chei - uy1) * (ux2 - ux1), (cwid - ux1) * (uy2 - uy1) - (chei - uy1) * (ux2 - ux1)) >= 0)))
    SELECT {geohash('((CAST(qx AS DOUBLE) + 0.5) / 262144 * 360 - 180)', '((CAST(qy AS DOUBLE) + 0.5) / 131072 * 180 - 90)', 7)} AS geohash, count(*) AS n FROM h GROUP BY qx, qy""")
def j3(spark, sf):
    from tilewright.operators.surfaces_cells import lines_near_cells

    g = GEO_LINE_VERTICES.frame(spark, sf).withColumnsRenamed({"lng": "x", "lat": "y"})
    near = lines_near_cells(ln.segments_of(g), 7, PADM)
    return near.groupBy("gx", "gy").agg(F.count("*").alias("n")).select(cells.code_to_hash(cells.pack(c("gx"), c("gy")), 7).alias("geohash"), "n")


def padded_tree_sql(threshold: int, metres: float) -> str:
    """Levels 3 to 11: every (segment, child) pair whose widened boxes meet, then the distance in metres."""
    grid = {k: (1 << (5 * k + 1) // 2, 1 << 5 * k // 2) for k in range(3, 12)}
    clip = lambda v, low, high: f"least(greatest({v}, {low}), {high})"
    steps = [f"t3 AS (SELECT *, unnest(generate_series(CAST(floor((least(x1, x2) - 1e-4 + 180) / 360 * {grid[3][0]}) AS BIGINT), CAST(floor((greatest(x1, x2) + 1e-4 + 180) / 360 * {grid[3][0]}) AS BIGINT))) AS qx FROM seg)",
             f"p3 AS MATERIALIZED (SELECT *, unnest(generate_series(CAST(floor((least(y1, y2) - 1e-4 + 90) / 180 * {grid[3][1]}) AS BIGINT), CAST(floor((greatest(y1, y2) + 1e-4 + 90) / 180 * {grid[3][1]}) AS BIGINT))) AS qy FROM t3)"]
    parts = []
    for k in range(3, 12):
        nx, ny = grid[k]
        if k > 3:
            mx, my = nx // grid[k - 1][0], ny // grid[k - 1][1]
            steps.append(f"p{k} AS MATERIALIZED (SELECT * FROM (SELECT line_id, x1, y1, x2, y2, p.qx * {mx} + a.i AS qx, p.qy * {my} + b.i AS qy FROM p{k - 1} p JOIN c{k - 1} c ON p.qx = c.qx AND p.qy = c.qy AND c.n > {threshold}, "
                         f"range({mx}) a(i), range({my}) b(i)) WHERE CAST(qx AS DOUBLE) / {nx} * 360 - 180 <= greatest(x1, x2) + 1.2e-5 AND CAST(qx + 1 AS DOUBLE) / {nx} * 360 - 180 >= least(x1, x2) - 1.2e-5 "
                         f"AND CAST(qy AS DOUBLE) / {ny} * 180 - 90 <= greatest(y1, y2) + 1.2e-5 AND CAST(qy + 1 AS DOUBLE) / {ny} * 180 - 90 >= least(y1, y2) - 1.2e-5)")
        steps.append(f"""c{k} AS MATERIALIZED (SELECT qx, qy, count(DISTINCT line_id) AS n FROM (SELECT *, (ce - cw) * mx AS cwid, (cn - cs) * my AS chei, (x1 - cw) * mx AS ux1, (x2 - cw) * mx AS ux2, (y1 - cs) * my AS uy1, (y2 - cs) * my AS uy2
            FROM (SELECT *, pi() / 180 * {RR} / sqrt(bend) * cos(lat) AS mx, pi() / 180 * {RR} * (1 - 0.00669437999014::DOUBLE) / (bend * sqrt(bend)) AS my
            FROM (SELECT *, 1 - 0.00669437999014::DOUBLE * sin(lat) * sin(lat) AS bend FROM (SELECT *, radians({clip('(y1 + y2) / 2', 'cs', 'cn')}) AS lat
            FROM (SELECT *, CAST(qx AS DOUBLE) / {nx} * 360 - 180 AS cw, CAST(qy AS DOUBLE) / {ny} * 180 - 90 AS cs, CAST(qx + 1 AS DOUBLE) / {nx} * 360 - 180 AS ce, CAST(qy + 1 AS DOUBLE) / {ny} * 180 - 90 AS cn FROM p{k})))))
            WHERE {slab_sql('cw', 'cs', 'ce', 'cn')} OR {seg_box_sql()} <= {metres} GROUP BY qx, qy)""")
        lng, lat = (f"((CAST({q} AS DOUBLE) + 0.5) / {n} * {span} - {low})" for q, n, span, low in (("qx", nx, 360, 180), ("qy", ny, 180, 90)))
        parts.append(f"SELECT CAST({k} AS INTEGER) AS level, {geohash(lng, lat, k)} AS geohash, n AS total_count, {f'n > {threshold}' if k < 11 else 'false'} AS refined FROM c{k}")
    return f"WITH {GSEG}, {', '.join(steps)} {' UNION ALL '.join(parts)}"


@query("P3_refine_padded", padded_tree_sql(2, 0.5))
def p3_padded(spark, sf):
    g = GEO_LINE_VERTICES.frame(spark, sf).withColumnsRenamed({"lng": "x", "lat": "y"})
    edges = ln.segments_of(g).select(c("line_id").alias("feature"), "x1", "y1", "x2", "y2")
    # every line counts, wherever it lies
    tree = crossing.refine(edges, crossing.extent(edges, 1e-4), threshold=2, closed=False, metres=crossing.swept_reach())
    return refine.describe_cells(tree).where("total_count > 0").select("level", "geohash", "total_count", "refined")


SURF = f"SELECT road_id, tri_id AS surface_id, (x1 + x2 + x3) / 3 AS sx, (y1 + y2 + y3) / 3 AS sy, (z1 + z2 + z3) / 3 AS sz FROM ({T})"
DV = "line_id * 100 + i AS pid, line_id AS road_id, x AS px, y AS py, z + CAST(10 AS DOUBLE) + CAST(i % 3 AS DOUBLE) * CAST(0.4 AS DOUBLE) AS pz"


@query("J7_drape_to_surface_points", f"""
    WITH v AS (SELECT {DV} FROM ({V})), s AS ({SURF}), m AS (SELECT pid, sz, round(sqrt(power(sx - px, 2) + power(sy - py, 2)), 9) AS d, abs(sz - pz) AS rise, surface_id FROM v JOIN s USING (road_id)),
    b AS (SELECT pid, sz, row_number() OVER (PARTITION BY pid ORDER BY d, rise, surface_id) AS rn FROM m WHERE d <= 2 AND rise <= 1)
    SELECT v.pid, {r('coalesce(b.sz, v.pz) + CAST(0.02 AS DOUBLE)', 4)} AS z FROM v LEFT JOIN b ON v.pid = b.pid AND b.rn = 1""")
def j7(spark, sf):
    v = LINE_VERTICES.frame(spark, sf).selectExpr(*DV.split(", "))
    s = TRIANGLES.frame(spark, sf).selectExpr("road_id AS surface_road", "tri_id AS surface_id", "(x1 + x2 + x3) / 3 AS sx", "(y1 + y2 + y3) / 3 AS sy", "(z1 + z2 + z3) / 3 AS sz")
    return rd(dr.drape_to_points(v, s.withColumnRenamed("surface_road", "road_id"), "pid"), {"pid": None, "z": 4})


def probes(spark, sf):
    v = LINE_VERTICES.frame(spark, sf)
    return v.selectExpr("line_id * 100 + i AS pid", "CASE WHEN line_id % 9 = 4 THEN -1 ELSE line_id END AS road_id", "x + 1.25 AS px", "y + CAST(i % 5 AS DOUBLE) - 1.5 AS py", "CAST(10 AS DOUBLE) AS pz")


def edge_sql(a: str, b: str) -> str:
    t = f"least(greatest(((px - x{a}) * (x{b} - x{a}) + (py - y{a}) * (y{b} - y{a})) / (power(x{b} - x{a}, 2) + power(y{b} - y{a}, 2)), 0), 1)"
    return f"struct_pack(d := sqrt(power(px - x{a} - {t} * (x{b} - x{a}), 2) + power(py - y{a} - {t} * (y{b} - y{a}), 2)), h := z{a} + (z{b} - z{a}) * {t})"


DEN = "((y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3))"
CAND = f"""q AS (SELECT line_id * 100 + i AS pid, CASE WHEN line_id % 9 = 4 THEN -1 ELSE line_id END AS rid, x + 1.25 AS px, y + CAST(i % 5 AS DOUBLE) - 1.5 AS py, CAST(10 AS DOUBLE) AS pz FROM ({V})),
    k AS (SELECT pid, pz, tri_id, z1, z2, z3, ((y2 - y3) * (px - x3) + (x3 - x2) * (py - y3)) / {DEN} AS wa, ((y3 - y1) * (px - x3) + (x1 - x3) * (py - y3)) / {DEN} AS wb,
       least({edge_sql('1', '2')}, {edge_sql('2', '3')}, {edge_sql('3', '1')}) AS ed FROM q JOIN ({T}) t ON (q.rid = t.road_id OR q.rid = -1)
       AND px >= least(x1, x2, x3) - 2 AND px <= greatest(x1, x2, x3) + 2 AND py >= least(y1, y2, y3) - 2 AND py <= greatest(y1, y2, y3) + 2),
    w AS (SELECT *, wa >= -1e-9 AND wb >= -1e-9 AND 1 - wa - wb >= -1e-9 AS inn FROM k),
    cand AS (SELECT pid, tri_id, CASE WHEN inn THEN 0 ELSE ed.d END AS dist, CASE WHEN inn THEN wa * z1 + wb * z2 + (1 - wa - wb) * z3 ELSE ed.h END AS height, pz FROM w WHERE inn OR ed.d <= 2)"""


@query("J8_triangle_candidates", f"WITH {CAND} SELECT pid, count(*) AS n, {r('min(dist)', 4)} AS nearest, {r('max(height)', 4)} AS top FROM cand GROUP BY 1")
def j8(spark, sf):
    tri = TRIANGLES.frame(spark, sf)
    pts = probes(spark, sf)
    found = dr.candidates(pts.where("road_id >= 0"), tri, "pid").unionByName(dr.candidates(pts.where("road_id < 0").drop("road_id"), tri, "pid", ()))
    return rd(found.groupBy("pid").agg(F.count("*").alias("n"), F.min("dist").alias("nearest"), F.max("height").alias("top")), {"pid": None, "n": None, "nearest": 4, "top": 4})


@query("W9_weighted_height", f"""
    WITH {CAND}, rk AS (SELECT *, abs(height - pz) AS rise, row_number() OVER (PARTITION BY pid ORDER BY dist, abs(height - pz), tri_id) AS rn FROM cand),
    s AS (SELECT pid, sum(height / greatest(0.02, 0.1 + rise)) FILTER (dist = 0) / sum(1 / greatest(0.02, 0.1 + rise)) FILTER (dist = 0) AS a,
       sum(height / greatest(0.05, dist * dist + 0.25 * rise * rise)) FILTER (rn <= 4) / sum(1 / greatest(0.05, dist * dist + 0.25 * rise * rise)) FILTER (rn <= 4) AS b FROM rk GROUP BY 1)
    SELECT pid, {r('coalesce(a, b)', 4)} AS height FROM s""")
def w9(spark, sf):
    return rd(dr.project_points(probes(spark, sf), TRIANGLES.frame(spark, sf), "pid"), {"pid": None, "height": 4})


@query("P12_line_draping")
def p12(spark, sf):
    return rd(dr.drape_lines(LINE_VERTICES.frame(spark, sf), TRIANGLES.frame(spark, sf), 3.0, 6.0), {"line_id": None, "ord": None, "smoothed": 4})


@query("J11_reference_lookup", f"""
    WITH {SEG}, t AS (SELECT line_id, CAST(floor(line_id / 2) AS BIGINT) AS ref, sum(length) AS len FROM seg GROUP BY 1),
    best AS (SELECT ref, arg_min(line_id, struct_pack(a := -round(len, 6), b := line_id)) AS line_id FROM t GROUP BY 1), dup AS (SELECT ref, count(*) AS n FROM t GROUP BY 1)
    SELECT s.road_id, s.n AS triangles, best.line_id, coalesce(dup.n, 0) > 1 AS repeated FROM (SELECT road_id, count(*) AS n FROM ({T}) GROUP BY 1) s LEFT JOIN best ON s.road_id = best.ref LEFT JOIN dup ON s.road_id = dup.ref""")
def j11(spark, sf):
    from tilewright.operators.surfaces_cells import longest_line, repeated_keys

    lens = ln.line_length(seg(spark, sf)).withColumn("ref", F.floor(c("line_id") / 2)).withColumn("length", F.round("length", 6))
    roads = TRIANGLES.frame(spark, sf).groupBy("road_id").agg(F.count("*").alias("triangles"))
    best = longest_line(lens, "ref", "length", "line_id").select(c("ref").alias("road_id"), "line_id")
    dup = repeated_keys(lens, "ref").select(c("ref").alias("road_id"), F.lit(True).alias("repeated"))
    return roads.join(best, "road_id", "left").join(dup, "road_id", "left").select("road_id", "triangles", "line_id", F.coalesce("repeated", F.lit(False)).alias("repeated"))


@query("W4_longest_line", f"""
    WITH {SEG}, t AS (SELECT line_id, line_id % 17 AS road, round(sum(length), 6) AS len FROM seg GROUP BY 1)
    SELECT road, line_id, len AS length FROM (SELECT *, row_number() OVER (PARTITION BY road ORDER BY len DESC, line_id) AS rn FROM t) WHERE rn = 1""")
def w4(spark, sf):
    from tilewright.operators.surfaces_cells import longest_line

    lens = ln.line_length(seg(spark, sf)).withColumn("road", c("line_id") % 17).withColumn("length", F.round("length", 6))
    return longest_line(lens, "road", "length", "line_id").select("road", "line_id", "length")


TB = f"SELECT road_id * 100 + tri_id AS tid, least(x1, x2, x3) AS w, least(y1, y2, y3) AS s, greatest(x1, x2, x3) AS e, greatest(y1, y2, y3) AS n FROM ({T})"


@query("J10_mesh_cell_candidates", f"""
    WITH t AS ({TB}), g AS (SELECT DISTINCT CAST(floor(w / 40) AS BIGINT) AS gx, CAST(floor(s / 40) AS BIGINT) AS gy FROM t)
    SELECT tid, gx, gy FROM t JOIN g ON gx * 40 <= e + 1e-6 AND gx * 40 + 40 >= w - 1e-6 AND gy * 40 <= n + 1e-6 AND gy * 40 + 40 >= s - 1e-6""")
def j10(spark, sf):
    t = TRIANGLES.frame(spark, sf).selectExpr("road_id * 100 + tri_id AS tid", "least(x1, x2, x3) AS w", "least(y1, y2, y3) AS s", "greatest(x1, x2, x3) AS e", "greatest(y1, y2, y3) AS n")
    g = t.select(F.floor(c("w") / 40).alias("gx"), F.floor(c("s") / 40).alias("gy")).distinct()
    boxes = g.selectExpr("gx", "gy", "gx * 40D AS bw", "gy * 40D AS bs", "gx * 40D + 40 AS be", "gy * 40D + 40 AS bn")
    return overlapping(t, boxes, 40.0, 1e-6).select("tid", "gx", "gy")


@query("J16_cell_ownership", f"""
    WITH v AS (SELECT line_id * 100 + i AS pid, x, y FROM ({V})), g AS (SELECT DISTINCT CAST(floor(x / 25) AS BIGINT) AS gx, CAST(floor(y / 25) AS BIGINT) AS gy FROM v)
    SELECT pid, min(gx * 1000 + gy) AS owner FROM v JOIN g ON x >= gx * 25 - 1e-5 AND x <= gx * 25 + 25 + 1e-5 AND y >= gy * 25 - 1e-5 AND y <= gy * 25 + 25 + 1e-5 GROUP BY 1""")
def j16(spark, sf):
    from tilewright.operators.surfaces_cells import cell_owner

    v = LINE_VERTICES.frame(spark, sf).selectExpr("line_id * 100 + i AS pid", "x AS px", "y AS py")
    g = v.select(F.floor(c("px") / 25).alias("gx"), F.floor(c("py") / 25).alias("gy")).distinct()
    boxes = g.selectExpr("gx * 1000 + gy AS cell", "gx * 25D AS bw", "gy * 25D AS bs", "gx * 25D + 25 AS be", "gy * 25D + 25 AS bn")
    return cell_owner(v, boxes, "pid", 25.0)


Q = f"SELECT id, lng - 0.004 AS w, lat - 0.004 AS s, lng + 0.004 AS e, lat + 0.004 AS n FROM ({P})"
BX = f"SELECT id AS bid, px0 AS bw, py0 AS bs, px2 AS be, py2 AS bn FROM ({PG})"


def boxes(spark, sf):
    return POLYGONS.frame(spark, sf).selectExpr("id AS bid", "px0 AS bw", "py0 AS bs", "px2 AS be", "py2 AS bn")


@query("J17_box_range_search", f"WITH q AS ({Q}), b AS ({BX}) SELECT q.id, b.bid FROM q JOIN b ON bw <= e AND be >= w AND bs <= n AND bn >= s")
def j17(spark, sf):
    pts = POINTS.frame(spark, sf).select("id", c("lng").alias("px"), c("lat").alias("py"))
    return around_points(pts, boxes(spark, sf), 0.004, 0.02).select("id", "bid")


GAP = "power(greatest(bw - e, w - be, 0), 2) + power(greatest(bs - n, s - bn, 0), 2)"


@query("J17_box_k_nearest", f"""
    WITH q AS ({Q.replace('0.004', '0.0')}), b AS ({BX}), d AS (SELECT q.id, b.bid, round(sqrt({GAP}), 10) AS gap FROM q CROSS JOIN b),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, bid) AS rank FROM d QUALIFY rank <= 3) SELECT id, bid, CAST(rank AS INTEGER) AS rank, gap + CAST(0 AS DOUBLE) AS gap FROM k""")
def j17k(spark, sf):
    b = boxes(spark, sf)
    pts = POINTS.frame(spark, sf).select("id", c("lng").alias("px"), c("lat").alias("py"))
    gap = lambda box: F.round(F.sqrt(nr.box_gap2(c("px"), c("py"), c("px"), c("py"), *box)), 10)
    best = py.nearest_boxes(pts, b, "id", gap, "bid", 0.03, 3)
    return best.select("id", "bid", c("rank").cast("int").alias("rank"), (c("distance") + 0.0).alias("gap"))


@query("J18_centreline_plausible", f"""
    WITH b AS (SELECT road_id, min(least(x1, x2, x3)) AS w, max(greatest(x1, x2, x3)) AS e, min(least(y1, y2, y3)) AS s, max(greatest(y1, y2, y3)) AS n FROM ({T}) GROUP BY 1),
    v AS (SELECT line_id, i, x, y + CASE WHEN line_id % 3 = 0 THEN 30 ELSE 0 END AS y FROM ({V}))
    SELECT road_id, count(*) FILTER (x >= w - 5 AND x <= e + 5 AND y >= s - 5 AND y <= n + 5) >= 2 AS plausible FROM b JOIN v ON road_id = line_id GROUP BY 1""")
def j18(spark, sf):
    from tilewright.operators.surfaces_cells import plausible_centrelines

    v = LINE_VERTICES.frame(spark, sf).select(c("line_id").alias("road_id"), "x", (c("y") + F.when(c("line_id") % 3 == 0, 30).otherwise(0)).alias("y"))
    return plausible_centrelines(TRIANGLES.frame(spark, sf), v)


# four parts per line; part 2 of every fifth line is moved away, odd parts of every third line are stored backwards
PARTS = f"""pv AS (SELECT line_id * 10 + p AS part_id, line_id, p, CASE WHEN bk THEN 5 - (i - 5 * p) ELSE i - 5 * p END AS i, x, y + CASE WHEN p = 2 AND line_id % 5 = 0 THEN 1 ELSE 0 END AS y, z, bk
      FROM (SELECT *, line_id % 3 = 0 AND p % 2 = 1 AS bk FROM (SELECT *, {{seq}} AS p FROM ({{v}}))) WHERE i BETWEEN 5 * p AND 5 * p + 5)"""


def parts(spark, sf):
    v = LINE_VERTICES.frame(spark, sf).withColumn("p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint")))).where("i BETWEEN 5 * p AND 5 * p + 5")
    v = v.withColumn("reverse", (c("line_id") % 3 == 0) & (c("p") % 2 == 1))
    return v.select((c("line_id") * 10 + c("p")).alias("part_id"), (c("line_id") % 2).alias("grp"), "reverse",
                    F.when(c("reverse"), 5 - (c("i") - c("p") * 5)).otherwise(c("i") - c("p") * 5).alias("i"), "x",
                    (c("y") + F.when((c("p") == 2) & (c("line_id") % 5 == 0), 1).otherwise(0)).alias("y"), "z")


def chain_parts(spark, sf):
    v = parts(spark, sf)
    st = ln.stations(ln.segments_of(v, "part_id"), "part_id")
    flags = v.select("part_id", "grp", "reverse").distinct()
    return st.join(flags, "part_id"), ch.logical_ends(ch.part_ends(st).join(flags, "part_id"))


CHAIN = PARTS.replace("{{seq}}", "unnest(generate_series(0, 3))").replace("{seq}", "unnest(generate_series(0, 3))").replace("{v}", V) + """,
    lg AS (SELECT part_id, line_id, p, bk, i AS k, x, y, z, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM (SELECT *, CASE WHEN bk THEN 5 - i ELSE i END AS o FROM pv) WINDOW w AS (PARTITION BY part_id ORDER BY o)),
    ln AS (SELECT part_id, line_id, p, sum(sqrt(power(x2 - x, 2) + power(y2 - y, 2))) AS length FROM lg WHERE x2 IS NOT NULL GROUP BY 1, 2, 3),
    nx AS (SELECT part_id, part_id + 1 AS nxt FROM ln WHERE p < 3 AND NOT (line_id % 5 = 0 AND p IN (1, 2)))"""


@query("J9_endpoint_links", f"WITH {CHAIN} SELECT part_id, nxt AS next FROM nx")
def j9(spark, sf):
    _, ends = chain_parts(spark, sf)
    return ch.links(ends)


WALK = f"""WITH RECURSIVE {CHAIN}, hd AS (SELECT part_id FROM ln WHERE part_id NOT IN (SELECT nxt FROM nx)),
    wk AS (SELECT part_id, part_id AS chain, CAST(0 AS DOUBLE) AS off FROM hd UNION ALL
       SELECT nx.nxt, wk.chain, wk.off + ln.length FROM wk JOIN nx ON nx.part_id = wk.part_id JOIN ln ON ln.part_id = wk.part_id)"""


@query("W7_chain_offsets", WALK + f""" SELECT part_id, chain, {r('off', 3)} AS "offset", part_id NOT IN (SELECT part_id FROM nx) AS include_end FROM wk""")
def w7(spark, sf):
    _, ends = chain_parts(spark, sf)
    return rd(ch.chain_offsets(ends, ch.links(ends)), {"part_id": None, "chain": None, "offset": 3, "include_end": None})


@query("P13_chain_posts", WALK + f""", o AS (SELECT wk.*, ln.length, wk.part_id NOT IN (SELECT part_id FROM nx) AS fin FROM wk JOIN ln USING (part_id)),
    f AS (SELECT *, greatest(ceil((off - 0.000001) / 4) * 4 - off, 0) AS first FROM o),
    d AS (SELECT part_id, length, first + CAST(unnest(generate_series(0, CAST(floor((length) / 4) + 1 AS BIGINT))) AS DOUBLE) * 4 AS s, fin FROM f),
    q AS (SELECT part_id, s, length FROM d WHERE s < length - 0.000001 UNION ALL SELECT part_id, length, length FROM f WHERE fin),
    sg AS (SELECT part_id, x, y, x2, y2, sqrt(power(x2 - x, 2) + power(y2 - y, 2)) AS l, sum(sqrt(power(x2 - x, 2) + power(y2 - y, 2))) OVER (PARTITION BY part_id ORDER BY o) AS e
           FROM (SELECT *, CASE WHEN bk THEN 5 - k ELSE k END AS o FROM lg) WHERE x2 IS NOT NULL),
    m AS (SELECT q.part_id, q.s, arg_min(struct_pack(x := x + (x2 - x) * (q.s - e + l) / l, y := y + (y2 - y) * (q.s - e + l) / l), e) AS v FROM q JOIN sg ON sg.part_id = q.part_id AND e >= q.s - 1e-9 GROUP BY 1, 2)
    SELECT part_id, {r('v.x', 3)} AS x, {r('v.y', 3)} AS y, {geohash('(117.1 + v.x * CAST(0.0001 AS DOUBLE))', '(31.1 + v.y * CAST(0.0001 AS DOUBLE))', 6)} AS owner FROM m""")
def p13(spark, sf):
    st, ends = chain_parts(spark, sf)
    posts = ch.chain_posts(st, ch.chain_offsets(ends, ch.links(ends)), 4.0)
    return posts.select("part_id", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"),
                        cells.point_hash(F.lit(117.1) + c("x") * 0.0001, F.lit(31.1) + c("y") * 0.0001, 6).alias("owner"))


@query("P14_instance_spacing", f"""
    WITH {SEG}, t AS (SELECT DISTINCT line_id, total FROM seg),
    post AS (SELECT line_id, CAST(unnest(generate_series(0, CAST(floor(total / 4) AS BIGINT))) AS DOUBLE) * 4 AS s FROM t
             UNION ALL SELECT line_id, total FROM t WHERE total - floor(total / 4) * 4 > 0.01),
    p AS (SELECT *, (s - s0) / length AS q, (x2 - x1) / length AS fx, (y2 - y1) / length AS fy, CASE WHEN line_id % 2 = 1 THEN 0.23 ELSE -0.23 END::DOUBLE AS side
          FROM post JOIN seg USING (line_id) WHERE (s > s0 OR i = 0) AND s <= s1)
    SELECT line_id, {r('s', 3)} AS station, {r('x1 + (x2 - x1) * q + fy * side', 3)} AS x, {r('y1 + (y2 - y1) * q - fx * side', 3)} AS y, {r('z1 + (z2 - z1) * q', 3)} AS z,
       {r('degrees(atan2(fy, fx))', 4)} AS heading FROM p""")
def p14(spark, sf):
    s = ln.samples_at(seg(spark, sf), ln.post_stations(4.0))
    sign = F.when(c("line_id") % 2 == 1, 1.0).otherwise(-1.0)
    out = s.select("line_id", "station", (c("x") + c("fy") * sign * 0.23).alias("x"), (c("y") - c("fx") * sign * 0.23).alias("y"), "z", F.degrees(F.atan2("fy", "fx")).alias("heading"))
    return rd(out, {"line_id": None, "station": 3, "x": 3, "y": 3, "z": 3, "heading": 4})


@query("O4_top_candidates", f"""
    WITH {CAND}, rk AS (SELECT pid, tri_id, row_number() OVER (PARTITION BY pid ORDER BY round(dist, 9), round(abs(height - pz), 9), tri_id) AS pos FROM cand)
    SELECT pid, tri_id, CAST(pos AS INTEGER) AS pos FROM rk WHERE pos <= 4""")
def o4(spark, sf):
    tri, pts = TRIANGLES.frame(spark, sf), probes(spark, sf)
    found = dr.candidates(pts.where("road_id >= 0"), tri, "pid").unionByName(dr.candidates(pts.where("road_id < 0").drop("road_id"), tri, "pid", ()))
    return dr.best_candidates(found.withColumns({"dist": F.round("dist", 9), "rise": F.round("rise", 9)}), "pid", 4).select("pid", "tri_id", "pos")
