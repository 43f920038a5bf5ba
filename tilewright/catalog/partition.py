"""Cells, counting and refinement."""

from pyspark.sql import functions as F

from tilewright.catalog.registry import query
from tilewright.catalog.sqltext import geohash
from tilewright.functions import cells
from tilewright.functions.predicates import in_bound
from tilewright.operators import crossing, refine
from tilewright.sources.derived import BOUND, HOT_POINTS, POINTS, POLYGONS

W, S, E, N = BOUND
P = POINTS.sql()
H = HOT_POINTS.sql()
OK = "(model LIKE '%glb' OR model LIKE '%gltf')"
INB = f"lng >= {W} AND lng <= {E} AND lat >= {S} AND lat <= {N}"


def lng_lat(df):
    return df.select("id", "lng", "lat")


@query("C1_geohash_encode", f"""
    SELECT id, {geohash('lng', 'lat', 11)} AS h11, {geohash('lng', 'lat', 5)} AS h5,
           {geohash('lng', 'lat', 3)} AS h3 FROM ({P})""")
def c1(spark, sf):
    full = cells.point_hash(F.col("lng"), F.col("lat"), 11)
    return POINTS.frame(spark, sf).select(
        "id", full.alias("h11"), F.substring(full, 1, 5).alias("h5"),
        cells.point_hash(F.col("lng"), F.col("lat"), 3).alias("h3"))


def duck_bbox(h: str, level: int) -> dict[str, str]:
    """Box of a hash of known length by summing its bits."""
    lng_n, lat_n = (5 * level + 1) // 2, 5 * level // 2
    digit = [f"(instr('{cells.ALPHABET}', substr({h}, {k + 1}, 1)) - 1)" for k in range(level)]
    bits = [f"(({digit[b // 5]} >> {4 - b % 5}) & 1)" for b in range(5 * level)]
    x = " + ".join(f"{bits[b]} * {1 << (lng_n - 1 - b // 2)}" for b in range(0, 5 * level, 2))
    y = " + ".join(f"{bits[b]} * {1 << (lat_n - 1 - b // 2)}" for b in range(1, 5 * level, 2))
    w = f"(CAST({x} AS DOUBLE) / {1 << lng_n} * 360 - 180)"
    s = f"(CAST({y} AS DOUBLE) / {1 << lat_n} * 180 - 90)"
    return {"west": w, "south": s,
            "east": f"({w} + CAST(360 AS DOUBLE) / {1 << lng_n})",
            "north": f"({s} + CAST(180 AS DOUBLE) / {1 << lat_n})"}


B6 = duck_bbox("h", 6)


@query("C2_cell_bbox", f"""
    WITH c AS (SELECT DISTINCT {geohash('lng', 'lat', 6)} AS h FROM ({P})),
    b AS (SELECT h, {', '.join(f'{v} AS {k}' for k, v in B6.items())} FROM c)
    SELECT h, round(west, 8) AS west, round(south, 8) AS south, round(east, 8) AS east, round(north, 8) AS north,
      printf('POLYGON((%.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f))',
             west, south, west, north, east, north, east, south, west, south) AS wkt FROM b""")
def c2(spark, sf):
    h = POINTS.frame(spark, sf).select(cells.point_hash(F.col("lng"), F.col("lat"), 6).alias("h")).distinct()
    box = h.withColumns(cells.hash_bbox(F.col("h")))
    return box.select("h", *[F.round(c, 8).alias(c) for c in ("west", "south", "east", "north")],
                      cells.bbox_wkt(F.col("west"), F.col("south"), F.col("east"), F.col("north")).alias("wkt"))


@query("C3_parent_children_ancestors", f"""
    WITH c AS (SELECT DISTINCT {geohash('lng', 'lat', 5)} AS h FROM ({P})),
    kids AS (SELECT h, h || substr('{cells.ALPHABET}', CAST(k AS INTEGER), 1) AS other, 'child' AS kind
             FROM (SELECT h, unnest(generate_series(1, 32)) AS k FROM c)),
    ups AS (SELECT h, substr(h, 1, CAST(k AS INTEGER)) AS other, 'ancestor' AS kind
            FROM (SELECT h, unnest(generate_series(1, 5)) AS k FROM c))
    SELECT * FROM kids UNION ALL SELECT * FROM ups
    UNION ALL SELECT h, substr(h, 1, length(h) - 1), 'parent' FROM c""")
def c3(spark, sf):
    h = POINTS.frame(spark, sf).select(cells.point_hash(F.col("lng"), F.col("lat"), 5).alias("h")).distinct()
    parts = F.array(
        F.struct(cells.child_hashes(F.col("h")).alias("o"), F.lit("child").alias("kind")),
        F.struct(cells.ancestor_hashes(F.col("h")).alias("o"), F.lit("ancestor").alias("kind")),
        F.struct(F.array(cells.parent_hash(F.col("h"))).alias("o"), F.lit("parent").alias("kind")))
    return (h.select("h", F.explode(parts).alias("p"))
            .select("h", F.explode("p.o").alias("other"), F.col("p.kind").alias("kind")))


@query("P1_root_cover", f"""
    WITH b AS (SELECT min(lng) AS w, max(lng) AS e, min(lat) AS s, max(lat) AS n FROM ({P})),
    x AS (SELECT unnest(generate_series(CAST(floor((w + 180) / 360 * 8192) AS BIGINT), CAST(floor((e + 180) / 360 * 8192) AS BIGINT))) AS qx FROM b),
    y AS (SELECT unnest(generate_series(CAST(floor((s + 90) / 180 * 4096) AS BIGINT), CAST(floor((n + 90) / 180 * 4096) AS BIGINT))) AS qy FROM b)
    SELECT {geohash('(CAST(qx AS DOUBLE) + 0.5) / 8192 * 360 - 180', '(CAST(qy AS DOUBLE) + 0.5) / 4096 * 180 - 90', 5)} AS geohash
    FROM x, y""")
def p1(spark, sf):
    b = POINTS.frame(spark, sf).agg(F.min("lng").alias("w"), F.max("lng").alias("e"),
                                    F.min("lat").alias("s"), F.max("lat").alias("n"))
    return cells.cover_bbox(b, 5, "w", "s", "e", "n").select(cells.code_to_hash(F.col("cell"), 5).alias("geohash"))


@query("F5_cell_membership", f"""
    WITH p AS (SELECT id, {geohash('lng', 'lat', 6)} AS h6 FROM ({P}))
    SELECT id, h6 FROM p WHERE h6 LIKE 'wt%' AND substr(h6, 1, 4) IN
      (SELECT substr(h6, 1, 4) AS h FROM p GROUP BY 1 HAVING count(*) > 100)""")
def f5(spark, sf):
    p = POINTS.frame(spark, sf).select("id", cells.point_hash(F.col("lng"), F.col("lat"), 6).alias("h6"))
    h4 = F.substring("h6", 1, 4).alias("h4")
    dense = p.groupBy(h4).count().where("count > 100").select("h4")
    return p.where(F.col("h6").startswith("wt")).withColumn("h4", F.substring("h6", 1, 4)).join(
        dense, "h4", "left_semi").select("id", "h6")


@query("A1_count_per_cell", f"""
    WITH u AS (SELECT * FROM (SELECT table_name, lng, lat, model FROM ({P})) UNION ALL
               (SELECT table_name, lng, lat, model FROM ({H}))),
    t AS (SELECT {geohash('lng', 'lat', 5)} AS geohash, table_name, count(*) AS n FROM u WHERE {INB} AND {OK} GROUP BY 1, 2)
    SELECT geohash, CAST(sum(n) AS BIGINT) AS total, count(*) AS tables, max(n) AS largest FROM t GROUP BY 1""")
def a1(spark, sf):
    per = refine.count_by_cell([POINTS.frame(spark, sf), HOT_POINTS.frame(spark, sf)], 5, BOUND)
    return (per.groupBy("cell").agg(F.sum("n").alias("total"), F.count("*").alias("tables"), F.max("n").alias("largest"))
            .select(cells.code_to_hash(F.col("cell"), 5).alias("geohash"), "total", "tables", "largest"))


@query("A2_split_decision", f"""
    WITH c AS (SELECT {geohash('lng', 'lat', 6)} AS h, count(*) AS n FROM ({H}) WHERE {INB} GROUP BY 1),
    p AS (SELECT substr(h, 1, 5) AS parent, CAST(sum(n) AS BIGINT) AS total, count(*) AS non_empty, max(n) AS largest FROM c GROUP BY 1)
    SELECT *, (total > 100 OR (non_empty >= 1 AND floor(total / non_empty) >= 10 AND largest >= floor(total * CAST(0.2 AS DOUBLE)))) AS split FROM p""")
def a2(spark, sf):
    child = (HOT_POINTS.frame(spark, sf).where(in_bound(F.col("lng"), F.col("lat"), BOUND))
             .groupBy(cells.point_code(F.col("lng"), F.col("lat"), 6).alias("cell")).agg(F.count("*").alias("n"))
             .withColumn("parent", cells.ancestor_code(F.col("cell"), 6, 5)))
    return refine.split_decision(child).withColumn("parent", cells.code_to_hash(F.col("parent"), 5))


def tree_sql(src: str, threshold: int = 50) -> str:
    """All cells of the tree: a cell exists when every ancestor from level 3 up splits."""
    low = int(threshold * 0.2)
    enc = f"SELECT {geohash('lng', 'lat', 11)} AS h, CASE WHEN {OK} THEN 1 ELSE 0 END AS ok FROM ({src}) WHERE {INB}"
    counts = " UNION ALL ".join(
        f"SELECT {k} AS level, substr(h, 1, {k}) AS g, count(*) AS n, CAST(sum(ok) AS BIGINT) AS placed FROM enc GROUP BY 2"
        for k in range(3, 12))
    steps = ["l3 AS (SELECT g, placed FROM counts WHERE level = 3 AND placed > 0)"]
    for k in range(4, 12):
        steps.append(
            f"l{k} AS (SELECT g, placed FROM counts WHERE level = {k} AND placed > 0 AND substr(g, 1, {k - 1}) IN (SELECT g FROM l{k - 1}) "
            f"AND substr(g, 1, {k - 1}) IN (SELECT parent FROM rule WHERE level = {k} AND split))")
    out = " UNION ALL ".join(f"SELECT {k} AS level, g AS geohash, placed AS total_count FROM l{k}" for k in range(3, 12))
    return (f"WITH enc AS MATERIALIZED ({enc}), counts AS MATERIALIZED ({counts}), "
            f"rule AS MATERIALIZED (SELECT level, substr(g, 1, level - 1) AS parent, (sum(n) > 100 OR (floor(sum(n) / count(*)) >= {low} "
            f"AND max(n) >= floor(sum(n) * CAST(0.2 AS DOUBLE)))) AS split FROM counts GROUP BY 1, 2), "
            + ", ".join(steps) + f", tree AS MATERIALIZED ({out})")


def hashed(tree):
    return refine.describe_cells(tree)


TREE_SELECT = """ SELECT CAST(t.level AS INTEGER) AS level, t.geohash, t.total_count,
    (t.level < 11 AND EXISTS (SELECT 1 FROM tree k WHERE k.level = t.level + 1 AND substr(k.geohash, 1, t.level) = t.geohash)) AS refined
    FROM tree t"""


@query("P2_refine_points", tree_sql(H) + TREE_SELECT)
def p2(spark, sf):
    tree = refine.refine_points(HOT_POINTS.frame(spark, sf), BOUND)
    return hashed(tree).where("total_count > 0").select("level", "geohash", "total_count", "refined")


@query("J4_leaf_selection", tree_sql(P) + """ SELECT CAST(level AS INTEGER) AS level, geohash, total_count FROM tree t
    WHERE NOT EXISTS (SELECT 1 FROM tree k WHERE k.level = t.level + 1 AND substr(k.geohash, 1, t.level) = t.geohash)""")
def j4(spark, sf):
    tree = refine.refine_points(POINTS.frame(spark, sf), BOUND)
    return refine.leaves(tree, BOUND).select("level", "geohash", "total_count")


def in_box(b: dict) -> str:
    return f"{b['west']} <= {E} AND {b['east']} >= {W} AND {b['south']} <= {N} AND {b['north']} >= {S}"


@query("A4_cells_in_bound", f"""
    WITH g AS (SELECT {geohash('lng', 'lat', 5)} AS h FROM ({P}) UNION SELECT {geohash('lng', 'lat', 4)} FROM ({P})),
    q AS (SELECT 117.2 AS w, 31.1 AS s, 117.5 AS e, 31.3 AS n),
    b5 AS (SELECT h, {', '.join(f'{v} AS {k}' for k, v in duck_bbox('h', 5).items())} FROM g WHERE length(h) = 5),
    b4 AS (SELECT h, {', '.join(f'{v} AS {k}' for k, v in duck_bbox('h', 4).items())} FROM g WHERE length(h) = 4),
    b AS (SELECT * FROM b5 UNION ALL SELECT * FROM b4)
    SELECT CAST(length(h) AS INTEGER) AS level, count(*) AS n, CAST(min(length(h)) OVER () AS INTEGER) AS min_level
    FROM b WHERE west <= 117.5 AND east >= 117.2 AND south <= 31.3 AND north >= 31.1 GROUP BY length(h)""")
def a4(spark, sf):
    finest = POINTS.frame(spark, sf).select(cells.point_code(F.col("lng"), F.col("lat"), 5).alias("code")).distinct()
    tree = finest.select(F.explode(F.array(
        F.struct(F.lit(5).alias("level"), F.col("code").alias("cell")),
        F.struct(F.lit(4).alias("level"), cells.ancestor_code(F.col("code"), 5, 4).alias("cell")))).alias("t")).select("t.*").distinct()
    per = refine.cells_in_bound(refine.describe_cells(tree), (117.2, 31.1, 117.5, 31.3))
    low = per.agg(F.min("level").alias("min_level"), F.collect_list(F.struct("level", "n")).alias("per"))
    return low.select(F.inline("per"), "min_level")


@query("A5_refinement_stats", f"""
    WITH a AS (SELECT DISTINCT 'orders' AS t, k AS level, substr(h, 1, CAST(k AS INTEGER)) AS g FROM
                 (SELECT {geohash('lng', 'lat', 6)} AS h, unnest(generate_series(3, 6)) AS k FROM ({P}))),
    z AS (SELECT DISTINCT 'orders' AS t, k AS level, substr(h, 1, CAST(k AS INTEGER)) AS g FROM
                 (SELECT {geohash('lng', 'lat', 6)} AS h, unnest(generate_series(4, 6)) AS k FROM ({H}))),
    o AS (SELECT t, level, count(*) AS n FROM a GROUP BY 1, 2), w AS (SELECT t, level, count(*) AS n FROM z GROUP BY 1, 2),
    j AS (SELECT coalesce(o.t, w.t) AS table_name, coalesce(o.level, w.level) AS level, coalesce(o.n, 0) AS b, coalesce(w.n, 0) AS f
          FROM o FULL JOIN w ON o.t = w.t AND o.level = w.level)
    SELECT table_name, CAST(level AS INTEGER) AS level, CAST(sum(b) AS BIGINT) AS n_before, CAST(sum(f) AS BIGINT) AS n_after,
      CAST(sum(greatest(f - b, 0)) AS BIGINT) AS created, CAST(sum(greatest(b - f, 0)) AS BIGINT) AS removed
    FROM j GROUP BY ROLLUP (table_name, level)""")
def a5(spark, sf):
    def levels(df, low):
        code = cells.point_code(F.col("lng"), F.col("lat"), 6)
        rows = F.array(*[F.struct(F.lit(k).alias("level"), cells.ancestor_code(code, 6, k).alias("cell")) for k in range(low, 7)])
        return df.select(F.explode(rows).alias("r")).select(F.lit("orders").alias("table_name"), "r.*").distinct()

    return refine.refinement_stats(levels(POINTS.frame(spark, sf), 3), levels(HOT_POINTS.frame(spark, sf), 4))


def polygons(spark, sf):
    ring = F.array(*[F.struct(F.col(f"px{k}").alias("x"), F.col(f"py{k}").alias("y")) for k in range(4)])
    return crossing.edges_of(POLYGONS.frame(spark, sf).withColumn("ring", ring), "id")


# a quadrilateral meets a box: an edge passes the slab test or a corner of the box is inside
EDGES = " UNION ALL ".join(
    f"SELECT id, px{k} AS x1, py{k} AS y1, px{(k + 1) % 4} AS x2, py{(k + 1) % 4} AS y2 FROM poly" for k in range(4))


def slab_sql(w: str, s: str, e: str, n: str) -> str:
    def ax(p, q, lo, hi):
        d = f"({q} - {p})"
        enter = f"CASE WHEN {d} = 0 THEN CASE WHEN {p} BETWEEN {lo} AND {hi} THEN 0 ELSE 2 END ELSE least(({lo} - {p}) / {d}, ({hi} - {p}) / {d}) END"
        leave = f"CASE WHEN {d} = 0 THEN CASE WHEN {p} BETWEEN {lo} AND {hi} THEN 1 ELSE -1 END ELSE greatest(({lo} - {p}) / {d}, ({hi} - {p}) / {d}) END"
        return enter, leave

    ex, lx = ax("x1", "x2", w, e)
    ey, ly = ax("y1", "y2", s, n)
    return f"(greatest({ex}, {ey}, 0) <= least({lx}, {ly}, 1))"


def inside_sql(x: str, y: str) -> str:
    return (f"(((y1 > {y}) <> (y2 > {y})) AND {x} < (x2 - x1) * ({y} - y1) / (CASE WHEN y2 = y1 THEN 1 ELSE y2 - y1 END) + x1)")


def crossing_sql(level: int) -> str:
    lng_n, lat_n = 1 << (5 * level + 1) // 2, 1 << (5 * level // 2)
    return f"""
    WITH poly AS (SELECT * FROM ({POLYGONS.sql()})),
    edges AS (SELECT *, {slab_sql(W, S, E, N)} AS hit FROM ({EDGES})),
    good AS (SELECT id FROM edges GROUP BY id HAVING bool_or(hit) OR sum(CASE WHEN {inside_sql(str(W), str(S))} THEN 1 ELSE 0 END) % 2 = 1),
    boxes AS (SELECT id, min(x1) AS w, min(y1) AS s, max(x1) AS e, max(y1) AS n FROM edges WHERE id IN (SELECT id FROM good) GROUP BY id),
    gx AS (SELECT id, s, n, unnest(generate_series(CAST(floor((w + 180) / 360 * {lng_n}) AS BIGINT), CAST(floor((e + 180) / 360 * {lng_n}) AS BIGINT))) AS qx FROM boxes),
    gxy AS (SELECT id, qx, unnest(generate_series(CAST(floor((s + 90) / 180 * {lat_n}) AS BIGINT), CAST(floor((n + 90) / 180 * {lat_n}) AS BIGINT))) AS qy FROM gx),
    cb AS (SELECT id, CAST(qx AS DOUBLE) / {lng_n} * 360 - 180 AS cw, CAST(qy AS DOUBLE) / {lat_n} * 180 - 90 AS cs,
                  CAST(qx + 1 AS DOUBLE) / {lng_n} * 360 - 180 AS ce, CAST(qy + 1 AS DOUBLE) / {lat_n} * 180 - 90 AS cn, qx, qy FROM gxy),
    m AS (SELECT cb.id, qx, qy, bool_or({slab_sql('cw', 'cs', 'ce', 'cn')}) OR sum(CASE WHEN {inside_sql('cw', 'cs')} THEN 1 ELSE 0 END) % 2 = 1 AS hit
          FROM cb JOIN edges USING (id) WHERE cw <= {E} AND ce >= {W} AND cs <= {N} AND cn >= {S} GROUP BY ALL),
    n AS (SELECT qx, qy, count(*) AS n FROM m WHERE hit GROUP BY ALL)
    SELECT {geohash(f'((CAST(qx AS DOUBLE) + 0.5) / {lng_n} * 360 - 180)', f'((CAST(qy AS DOUBLE) + 0.5) / {lat_n} * 180 - 90)', level)} AS geohash, n FROM n"""


@query("J2_crossing_count", crossing_sql(5))
def j2(spark, sf):
    pairs = crossing.members(polygons(spark, sf), 5, BOUND)
    return (pairs.groupBy("gx", "gy").agg(F.count("*").alias("n"))
            .select(cells.code_to_hash(cells.pack(F.col("gx"), F.col("gy")), 5).alias("geohash"), "n"))


@query("A3_road_split_decision", f"SELECT geohash, n, n > 50 AS need_refine FROM ({crossing_sql(4)})")
def a3(spark, sf):
    pairs = crossing.members(polygons(spark, sf), 4, BOUND)
    return (pairs.groupBy("gx", "gy").agg(F.count("*").alias("n"))
            .select(cells.code_to_hash(cells.pack(F.col("gx"), F.col("gy")), 4).alias("geohash"), "n",
                    ((F.col("n") > 50) & F.lit(4 < cells.MAX_LEVEL)).alias("need_refine")))


def crossing_tree_sql(threshold: int) -> str:
    parts = [f"c{k} AS MATERIALIZED ({crossing_sql(k)})" for k in range(3, 8)]
    steps = ["l3 AS (SELECT * FROM c3)"]
    for k in range(4, 8):
        steps.append(f"l{k} AS (SELECT * FROM c{k} WHERE substr(geohash, 1, {k - 1}) IN (SELECT geohash FROM l{k - 1} WHERE n > {threshold}))")
    out = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS level, geohash, n AS total_count, {f'n > {threshold}' if k < 7 else 'false'} AS refined FROM l{k}" for k in range(3, 8))
    return f"WITH {', '.join(parts)}, {', '.join(steps)} {out}"


@query("P3_refine_crossing", crossing_tree_sql(20))
def p3(spark, sf):
    tree = crossing.refine(polygons(spark, sf), BOUND, threshold=20, max_level=7)
    return refine.describe_cells(tree).where("total_count > 0").select("level", "geohash", "total_count", "refined")
