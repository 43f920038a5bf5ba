"""Lines as ordered vertices."""

from pyspark.sql import functions as F

from tilewright.catalog.registry import query
from tilewright.catalog.sqltext import r
from tilewright.operators import lines as ln
from tilewright.sources.derived import LINE_VERTICES

V = LINE_VERTICES.sql()
SEG = f"""seg0 AS (SELECT line_id, i, x AS x1, y AS y1, z AS z1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM ({V}) WINDOW w AS (PARTITION BY line_id ORDER BY i)),
    seg1 AS (SELECT *, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS length FROM seg0 WHERE x2 IS NOT NULL),
    seg AS (SELECT *, sum(length) OVER (PARTITION BY line_id ORDER BY i) - length AS s0, sum(length) OVER (PARTITION BY line_id ORDER BY i) AS s1,
            sum(length) OVER (PARTITION BY line_id) AS total FROM seg1)"""
c = F.col


def seg(spark, sf):
    return ln.stations(ln.segments_of(LINE_VERTICES.frame(spark, sf)))


def rd(df, spec):
    return df.select(*[(F.round(c(k), n) + 0.0).alias(k) if n is not None else c(k) for k, n in spec.items()])


@query("C16_polyline_length", f"WITH {SEG} SELECT line_id, {r('sum(length)', 3)} AS length, count(*) AS segments FROM seg GROUP BY 1")
def c16(spark, sf):
    dup = LINE_VERTICES.frame(spark, sf)
    twice = dup.withColumn("i", F.explode(F.array(c("i") * 2, c("i") * 2 + 1)))  # every vertex repeated: the repeats must not count
    return rd(ln.line_length(ln.segments_of(twice)), {"line_id": None, "length": 3, "segments": None})


@query("W3_stations", f"WITH {SEG} SELECT line_id, i, {r('s0', 3)} AS s0, {r('s1', 3)} AS s1, {r('total', 3)} AS total FROM seg")
def w3(spark, sf):
    return rd(seg(spark, sf), {"line_id": None, "i": None, "s0": 3, "s1": 3, "total": 3})


@query("C17_densify", f"""
    WITH {SEG}, n AS (SELECT *, greatest(ceil(length / 5), 1) AS n FROM seg), e AS (SELECT *, unnest(generate_series(CAST(CASE WHEN i = 0 THEN 0 ELSE 1 END AS BIGINT), CAST(n AS BIGINT))) AS j FROM n)
    SELECT line_id, i AS seg, j, {r('x1 + (x2 - x1) * j / n', 3)} AS x, {r('y1 + (y2 - y1) * j / n', 3)} AS y, {r('z1 + (z2 - z1) * j / n', 3)} AS z FROM e""")
def c17(spark, sf):
    return rd(ln.densify(seg(spark, sf), 5.0), {"line_id": None, "seg": None, "j": None, "x": 3, "y": 3, "z": 3})


def chaikin_sql(src: str) -> str:
    return (f"SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY o) - 1 AS i, x, y, z FROM ("
            f"WITH q AS (SELECT line_id, i, x, y, z, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM ({src}) WINDOW w AS (PARTITION BY line_id ORDER BY i)) "
            f"SELECT line_id, 2 * i AS o, x, y, z FROM q WHERE i = 0 UNION ALL "
            f"SELECT line_id, 2 * i + 1, x * 0.75 + nx * 0.25, y * 0.75 + ny * 0.25, z FROM q WHERE nx IS NOT NULL UNION ALL "
            f"SELECT line_id, 2 * i + 2, x * 0.25 + nx * 0.75, y * 0.25 + ny * 0.75, nz FROM q WHERE nx IS NOT NULL UNION ALL "
            f"SELECT line_id, 2 * i + 1, x, y, z FROM q WHERE nx IS NULL)")


@query("C18_corner_cutting", f"SELECT line_id, i AS ord, {r('x', 3)} AS x, {r('y', 3)} AS y, {r('z', 3)} AS z FROM ({chaikin_sql(chaikin_sql(V))})")
def c18(spark, sf):
    return rd(ln.smooth_corners(LINE_VERTICES.frame(spark, sf), 2), {"line_id": None, "ord": None, "x": 3, "y": 3, "z": 3})


@query("C19_dash_split", f"""
    WITH {SEG}, p AS (SELECT *, CASE WHEN line_id % 3 = 0 THEN CAST(6 AS DOUBLE) ELSE 3 END AS dash, CASE WHEN line_id % 3 = 0 THEN CAST(15 AS DOUBLE) ELSE 6 END AS cyc,
        CAST(line_id % 4 AS DOUBLE) AS off FROM seg WHERE line_id % 3 < 2),
    k AS (SELECT DISTINCT line_id, dash, cyc, off, total FROM p), d AS (SELECT *, unnest(generate_series(0, CAST(ceil((total + off) / cyc) AS BIGINT))) AS n FROM k),
    v AS (SELECT line_id, n, greatest(n * cyc - off, 0) AS a, least(n * cyc - off + dash, total) AS b FROM d),
    x AS (SELECT v.line_id, n, i, greatest(a, s0) AS d0, least(b, s1) AS d1, x1, x2, y1, y2, s0, length FROM v JOIN p ON v.line_id = p.line_id AND s0 < b AND s1 > a WHERE b > a)
    SELECT line_id, n AS dash_no, i, {r('d0', 3)} AS d0, {r('d1', 3)} AS d1, {r('x1 + (x2 - x1) * (d0 - s0) / length', 3)} AS xa, {r('y1 + (y2 - y1) * (d1 - s0) / length', 3)} AS yb
    FROM x WHERE d1 - d0 > 0.000001""")
def c19(spark, sf):
    text = F.when(c("line_id") % 3 == 0, F.lit(" 6, 9")).when(c("line_id") % 3 == 1, F.lit("3.3")).otherwise(F.lit("solid"))
    dash, gap = ln.dash_pattern(text)
    out = ln.dashes(seg(spark, sf), dash, gap, (c("line_id") % 4).cast("double") - 36.0 * 5).where("d1 - d0 > 0.000001")
    return rd(out, {"line_id": None, "dash_no": None, "i": None, "d0": 3, "d1": 3, "xa": 3, "yb": 3})


PTS = "line_id, i, s, {x} AS x, {y} AS y, {z} AS z, {fx} AS fx".format(
    x=r("x1 + (x2 - x1) * (s - s0) / length", 3), y=r("y1 + (y2 - y1) * (s - s0) / length", 3), z=r("z1 + (z2 - z1) * (s - s0) / length", 3), fx=r("(x2 - x1) / length", 6))


def owned(extra: str) -> str:
    return f"SELECT {PTS} FROM st JOIN seg USING (line_id) WHERE (s > s0 OR i = 0) AND s <= s1 {extra}"


@query("C20_station_sampling", f"""
    WITH {SEG}, t AS (SELECT DISTINCT line_id, total FROM seg),
    post AS (SELECT line_id, CAST(unnest(generate_series(0, CAST(floor(total / 4) AS BIGINT))) AS DOUBLE) * 4 AS s FROM t
             UNION ALL SELECT line_id, total FROM t WHERE total - floor(total / 4) * 4 > 0.01),
    board AS (SELECT line_id, f + CAST(unnest(generate_series(0, CAST(floor((total - f) / 3) AS BIGINT))) AS DOUBLE) * 3 AS s
              FROM (SELECT *, CASE WHEN line_id % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(3 - line_id % 3 AS DOUBLE) END AS f FROM t)),
    u AS (SELECT 'post' AS kind, * FROM post UNION ALL SELECT 'board', * FROM board)
    SELECT kind, line_id, {r('s', 3)} AS station, {r('x1 + (x2 - x1) * (s - s0) / length', 3)} AS x, {r('y1 + (y2 - y1) * (s - s0) / length', 3)} AS y,
       {r('z1 + (z2 - z1) * (s - s0) / length', 3)} AS z, {r('(x2 - x1) / length', 6)} AS fx
    FROM u JOIN seg USING (line_id) WHERE (s > s0 OR i = 0) AND s <= s1""")
def c20(spark, sf):
    s = seg(spark, sf)
    posts = ln.samples_at(s, ln.post_stations(4.0)).withColumn("kind", F.lit("post"))
    boards = ln.samples_at(s, ln.phased_stations(3.0, (c("line_id") % 3).cast("double"))).withColumn("kind", F.lit("board"))
    return rd(posts.unionByName(boards), {"kind": None, "line_id": None, "station": 3, "x": 3, "y": 3, "z": 3, "fx": 6})


D = lambda p, q, s: f"(({q}x - {p}x) * ({s}y - {p}y) - ({q}y - {p}y) * ({s}x - {p}x))"


@query("C22_segment_crossing", f"""
    WITH {SEG}, pr AS (SELECT a.line_id, a.i, a.x1 AS pax, a.y1 AS pay, a.x2 AS pbx, a.y2 AS pby, b.x1 - 49 AS pcx, b.y1 AS pcy, b.x2 - 51 AS pdx, b.y2 AS pdy
        FROM seg a JOIN seg b ON b.line_id = a.line_id + 1 AND b.i = a.i),
    z AS (SELECT *, {D('pc', 'pd', 'pa')} AS s1, {D('pc', 'pd', 'pb')} AS s2, {D('pa', 'pb', 'pc')} AS s3, {D('pa', 'pb', 'pd')} AS s4 FROM pr)
    SELECT line_id, i, s1 * s2 < 0 OR s3 * s4 < 0 AS straddle, s1 * s2 <= 0 AND s3 * s4 <= 0 AS touch,
       CASE WHEN s1 * s2 <= 0 AND s3 * s4 <= 0 AND abs(s1 - s2) > 0.000000001 THEN {r('s1 / (s1 - s2)', 6)} END AS t FROM z""")
def c22(spark, sf):
    s = ln.segments_of(LINE_VERTICES.frame(spark, sf))
    a = s.select("line_id", "i", *[c(p + k).alias(q + p) for p in "xy" for k, q in (("1", "a"), ("2", "b"))])
    b = s.select((c("line_id") - 1).alias("line_id"), "i", (c("x1") - 49).alias("cx"), c("y1").alias("cy"), (c("x2") - 51).alias("dx"), c("y2").alias("dy"))
    args = [c(k) for k in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")]
    return a.join(b, ["line_id", "i"]).select("line_id", "i", ln.straddles(*args).alias("straddle"), ln.segments_touch(*args).alias("touch"),
                                              (F.round(ln.crossing_parameter(*args), 6) + 0.0).alias("t"))


VTX = f"""{SEG}, vt AS (SELECT line_id, i AS ord, x1 AS x, y1 AS y, z1 AS z, s0 AS station FROM seg UNION ALL
    SELECT line_id, i + 1, x2, y2, z2, s1 FROM seg WHERE i = 19)"""


@query("W1_average_by_distance", f"""
    WITH {VTX}, m AS (SELECT *, CAST(round(station * 1000) AS BIGINT) AS mm FROM vt)
    SELECT line_id, ord, {r('avg(z) OVER (PARTITION BY line_id ORDER BY mm RANGE BETWEEN 26000 PRECEDING AND 26000 FOLLOWING)', 4)} AS smoothed FROM m""")
def w1(spark, sf):
    v = ln.vertices_of(seg(spark, sf))
    return rd(ln.average_by_distance(v, 26.0), {"line_id": None, "ord": None, "smoothed": 4})


@query("W2_fill_unmatched", f"""
    WITH {VTX}, g AS (SELECT *, CASE WHEN (ord + line_id) % 4 IN (0, 3) AND line_id % 10 <> 9 AND ord > line_id % 6 THEN z END AS v FROM vt),
    n AS (SELECT *, CASE WHEN v IS NOT NULL THEN ord END AS k FROM g),
    b AS (SELECT *, max(k) OVER (PARTITION BY line_id ORDER BY ord) AS po, min(k) OVER (PARTITION BY line_id ORDER BY ord DESC) AS no FROM n)
    SELECT b.line_id, b.ord, {r('''coalesce(b.v, CASE WHEN p.v IS NULL THEN q.v WHEN q.v IS NULL THEN p.v
        ELSE p.v + (q.v - p.v) * (b.station - p.station) / (q.station - p.station) END)''', 4)} AS filled
    FROM b LEFT JOIN g p ON p.line_id = b.line_id AND p.ord = b.po LEFT JOIN g q ON q.line_id = b.line_id AND q.ord = b.no""")
def w2(spark, sf):
    v = ln.vertices_of(seg(spark, sf))
    seen = ((c("ord") + c("line_id")) % 4).isin(0, 3) & (c("line_id") % 10 != 9) & (c("ord") > c("line_id") % 6)
    return rd(ln.fill_unmatched(v.withColumn("z", F.when(seen, c("z")))), {"line_id": None, "ord": None, "filled": 4})


def smooth_sql(src: str) -> str:
    return f"SELECT line_id, i, avg(z) OVER (PARTITION BY line_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS z FROM ({src})"


def ring_sql(src: str) -> str:
    return f"SELECT a.line_id, a.i, avg(b.z) AS z FROM ({src}) a JOIN ({src}) b ON a.line_id = b.line_id AND (b.i - a.i + 21 + 2) % 21 <= 4 GROUP BY 1, 2"


BASE = f"SELECT line_id, i, z FROM ({V})"


@query("W10_average_by_count", f"""
    SELECT a.line_id, a.i, {r('a.z', 4)} AS open_z, {r('b.z', 4)} AS ring_z FROM ({smooth_sql(smooth_sql(BASE))}) a JOIN ({ring_sql(ring_sql(BASE))}) b USING (line_id, i)""")
def w10(spark, sf):
    v = LINE_VERTICES.frame(spark, sf).select("line_id", "i", "z")
    opened = ln.average_by_count(v, 2, "line_id", "i", "z", 2).withColumnRenamed("z", "open_z")
    ring = ln.average_by_count(v, 2, "line_id", "i", "z", 2, circular=True).withColumnRenamed("z", "ring_z")
    return rd(opened.join(ring, ["line_id", "i"]), {"line_id": None, "i": None, "open_z": 4, "ring_z": 4})


@query("P16_line_to_outline", f"""
    WITH {SEG}, nm AS (SELECT line_id, i, -(y2 - y1) / length AS nx, (x2 - x1) / length AS ny FROM seg),
    j AS (SELECT v.line_id, v.i, v.x, v.y, p.nx AS ax, p.ny AS ay, n.nx AS bx, n.ny AS bny FROM ({V}) v
          LEFT JOIN nm p ON p.line_id = v.line_id AND p.i = v.i - 1 LEFT JOIN nm n ON n.line_id = v.line_id AND n.i = v.i),
    k AS (SELECT *, (coalesce(ax, 0) + coalesce(bx, 0)) AS sx, (coalesce(ay, 0) + coalesce(bny, 0)) AS sy FROM j),
    l AS (SELECT *, sx / sqrt(sx * sx + sy * sy) AS jx, sy / sqrt(sx * sx + sy * sy) AS jy FROM k),
    m AS (SELECT *, least(CASE WHEN ax IS NULL OR bx IS NULL THEN 2 ELSE 2 / greatest(jx * ax + jy * ay, CAST(0.25 AS DOUBLE)) END, 8) AS h FROM l)
    SELECT line_id, i AS pos, {r('x + jx * h', 3)} AS x, {r('y + jy * h', 3)} AS y FROM m UNION ALL
    SELECT line_id, 41 - i, {r('x - jx * h', 3)}, {r('y - jy * h', 3)} FROM m UNION ALL
    SELECT line_id, 42, {r('x + jx * h', 3)}, {r('y + jy * h', 3)} FROM m WHERE i = 0""")
def p16(spark, sf):
    sides = ln.offset_sides(ln.segments_of(LINE_VERTICES.frame(spark, sf)), 4.0)
    return rd(ln.outline_vertices(sides), {"line_id": None, "pos": None, "x": 3, "y": 3})
