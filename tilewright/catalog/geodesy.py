"""Coordinates, poses, boxes and regions over the point layer."""

from pyspark.sql import functions as F

from tilewright.catalog.registry import query
from tilewright.catalog.sqltext import r
from tilewright.functions import geodesy as g
from tilewright.sources.derived import POINTS, POLYGONS

P = POINTS.sql()
A, E2, FL = "CAST(6378137 AS DOUBLE)", repr(g.ECC2), repr(g.FLATTENING)
c = F.col


def ecef_sql(lng: str, lat: str, h: str, ecc: str = E2) -> tuple[str, str, str]:
    n = f"({A} / sqrt(1 - CAST({ecc} AS DOUBLE) * power(sin(radians({lat})), 2)))"
    return (f"(({n} + {h}) * cos(radians({lat})) * cos(radians({lng})))",
            f"(({n} + {h}) * cos(radians({lat})) * sin(radians({lng})))",
            f"(({n} * (1 - CAST({ecc} AS DOUBLE)) + {h}) * sin(radians({lat})))")


def geodetic_sql(src: str, keys: str) -> str:
    """Eight fixed-point steps from columns x, y, z of ``src``."""
    out = f"SELECT {keys}, z, atan2(y, x) AS lon, sqrt(x * x + y * y) AS p, atan2(z, sqrt(x * x + y * y) * (1 - {E2})) AS lat FROM ({src})"
    for _ in range(8):
        n = f"({A} / sqrt(1 - {E2} * sin(lat) * sin(lat)))"
        out = (f"SELECT {keys}, z, lon, p, atan2(z, p * (1 - {E2} * n / (n + p / cos(lat) - n))) AS lat FROM "
               f"(SELECT *, {n} AS n FROM ({out}))")
    return f"SELECT {keys}, lon, lat, p / cos(lat) - {A} / sqrt(1 - {E2} * sin(lat) * sin(lat)) AS h FROM ({out})"


def axes_sql(lng: str, lat: str) -> list[list[str]]:
    sl, cl, sp, cp = f"sin(radians({lng}))", f"cos(radians({lng}))", f"sin(radians({lat}))", f"cos(radians({lat}))"
    return [[f"(-{sl})", cl, "CAST(0 AS DOUBLE)"], [f"(-{sp} * {cl})", f"(-{sp} * {sl})", cp], [f"({cp} * {cl})", f"({cp} * {sl})", sp]]


X, Y, Z = ecef_sql("lng", "lat", "alt")


@query("C5_ecef_and_back", f"""
    WITH f AS (SELECT id, {X} AS x, {Y} AS y, {Z} AS z FROM ({P})), b AS ({geodetic_sql('SELECT * FROM f', 'id')})
    SELECT f.id, {r('x', 3)} AS x, {r('y', 3)} AS y, {r('z', 3)} AS z, {r('degrees(lon)', 8)} AS lng, {r('degrees(lat)', 8)} AS lat,
           {r('h', 3)} AS h FROM f JOIN b ON f.id = b.id""")
def c5(spark, sf):
    x, y, z = g.ecef(c("lng"), c("lat"), c("alt"))
    df = POINTS.frame(spark, sf).select("id", x.alias("x"), y.alias("y"), z.alias("z"))
    lon, lat, h = g.geodetic(c("x"), c("y"), c("z"))
    return df.select("id", *[g.clean(c(k), 3).alias(k) for k in "xyz"], g.clean(F.degrees(lon), 8).alias("lng"),
                     g.clean(F.degrees(lat), 8).alias("lat"), g.clean(h, 3).alias("h"))


def enu_sql() -> str:
    p, o = ecef_sql("lng", "lat", "alt"), ecef_sql("olng", "olat", "oalt")
    ax = axes_sql("olng", "olat")
    d = [f"({p[k]} - {o[k]})" for k in range(3)]
    e, n, u = ["(" + " + ".join(f"{ax[k][j]} * {d[j]}" for j in range(3)) + ")" for k in range(3)]
    return f"{r(e, 3)} AS e, {r(n, 3)} AS n, {r('-' + n, 3)} AS model_n, {r(u, 3)} AS u"


@query("C6_enu_offset", f"""
    WITH p AS ({P}), o AS (SELECT category, min(lng) AS olng, min(lat) AS olat, min(alt) AS oalt FROM p GROUP BY 1)
    SELECT id, {enu_sql()} FROM p JOIN o USING (category)""")
def c6(spark, sf):
    p = POINTS.frame(spark, sf)
    o = p.groupBy("category").agg(F.min("lng").alias("olng"), F.min("lat").alias("olat"), F.min("alt").alias("oalt"))
    pt, og = (c("lng"), c("lat"), c("alt")), (c("olng"), c("olat"), c("oalt"))
    e, n, u = g.enu_offset(pt, og)
    model = g.enu_offset(pt, og, north_positive=False)
    return p.join(o, "category").select("id", g.clean(e, 3).alias("e"), g.clean(n, 3).alias("n"),
                                        g.clean(model[1], 3).alias("model_n"), g.clean(u, 3).alias("u"))


META = "concat('{\"transform\":{'," + ", ',', ".join(
    f"'\"{k}\":', CAST((id + {k}) % 10 AS VARCHAR(9))" for k in range(16)) + ", '}}')"
POSED = ("id", "lng", "lat", "alt", "obj_angle", "CASE WHEN id % 4 = 0 THEN CAST(1 + id % 3 AS DOUBLE) END AS s",
         f"CASE WHEN id % 9 = 0 THEN {META} WHEN id % 9 = 1 THEN '{{\"transform\":{{\"0\":1}}}}' END AS metadata")


def pose_sql() -> str:
    ax = axes_sql("lng", "lat")
    ch, sh = "cos(radians(obj_angle))", "sin(radians(obj_angle))"
    rows = [[f"({ch} * {ax[0][j]} - {sh} * {ax[1][j]})" for j in range(3)],
            [f"({sh} * {ax[0][j]} + {ch} * {ax[1][j]})" for j in range(3)], ax[2]]
    sc = ["coalesce(s, 1)", "coalesce(s * 2, 1)", "coalesce(s * 3, 1)"]
    out = [f"({sc[i]} * {rows[i][j]})" if j < 3 else "CAST(0 AS DOUBLE)" for i in range(3) for j in range(4)] + [X, Y, Z, "CAST(1 AS DOUBLE)"]
    return ", ".join(
        f"CASE WHEN id % 9 = 0 THEN CAST((id + {k}) % 10 AS DOUBLE) ELSE {r(v, 3 if k > 11 else 6)} END AS m{k}" for k, v in enumerate(out))


@query("C7_pose_matrix", f"SELECT id, {pose_sql()} FROM (SELECT {', '.join(POSED)} FROM ({P}))")
def c7(spark, sf):
    df = POINTS.frame(spark, sf).selectExpr(*[e.replace("VARCHAR(9)", "STRING") for e in POSED])
    z = F.lit(0.0)
    trs = F.when(c("s").isNotNull(), F.array(z, z, z, z, z, z, F.lit(1.0), c("s"), c("s") * 2, c("s") * 3))
    df = df.withColumn("trs", trs).withColumn("stored", g.stored_matrix(c("metadata")))
    m = F.coalesce(c("stored"), F.array(*g.pose_matrix(c("lng"), c("lat"), c("alt"), c("obj_angle"), scale=g.trs_scale(c("trs")))))
    return df.select("id", m.alias("m")).select("id", *[g.clean(c("m")[k], 3 if k > 11 else 6).alias(f"m{k}") for k in range(16)])


HPR = ("id", "CAST(id % 360 AS DOUBLE) AS h", "CAST(id % 160 AS DOUBLE) - 80 AS p", "CAST(id % 300 AS DOUBLE) - 150 AS rl")


def mul_sql(a, b):
    return [f"({a[3]} * {b[0]} + {a[0]} * {b[3]} + {a[1]} * {b[2]} - {a[2]} * {b[1]})",
            f"({a[3]} * {b[1]} + {a[1]} * {b[3]} + {a[2]} * {b[0]} - {a[0]} * {b[2]})",
            f"({a[3]} * {b[2]} + {a[2]} * {b[3]} + {a[0]} * {b[1]} - {a[1]} * {b[0]})",
            f"({a[3]} * {b[3]} - {a[0]} * {b[0]} - {a[1]} * {b[1]} - {a[2]} * {b[2]})"]


def q_sql():
    s, co = (lambda a: f"sin(radians({a}) / 2)"), (lambda a: f"cos(radians({a}) / 2)")
    return mul_sql(mul_sql(["0", "0", s("h"), co("h")], [s("p"), "0", "0", co("p")]), ["0", s("rl"), "0", co("rl")])


@query("C8_rotation", f"""
    SELECT id, {', '.join(f'{r(v, 6)} AS q{k}' for k, v in zip('xyzw', q_sql()))},
           h AS heading, p AS pitch, rl AS roll, {r('sin(radians(h) / 2)', 6)} AS trs_z, {r('-cos(radians(h) / 2)', 6)} AS trs_w, true AS same
    FROM (SELECT {', '.join(HPR)} FROM ({P}))""")
def c8(spark, sf):
    df = POINTS.frame(spark, sf).selectExpr(*HPR)
    q = g.quaternion(c("h"), c("p"), c("rl"))
    df = df.select("*", *[v.alias(f"q{k}") for k, v in zip("xyzw", q)])
    qs = tuple(c(f"q{k}") for k in "xyzw")
    h, p, rl = g.euler(*qs)
    one = F.lit(1.0)
    df = df.withColumn("trs", g.heading_trs(c("h"), (one, one, one)))
    return df.select("id", *[g.clean(c(f"q{k}"), 6).alias(f"q{k}") for k in "xyzw"],
                     (g.clean(h, 6) % 360).alias("heading"), g.clean(p, 6).alias("pitch"), g.clean(rl, 6).alias("roll"),
                     g.clean(c("trs")[5], 6).alias("trs_z"), g.clean(c("trs")[6], 6).alias("trs_w"),
                     g.same_rotation(qs, tuple(-q for q in qs), 1e-9).alias("same"))


def box_sql(lng, lat, h, halves):
    ax = axes_sql(lng, lat)
    return [*ecef_sql(lng, lat, h), *[f"({ax[k][j]} * {halves[k]})" for k in range(3) for j in range(3)]]


CELLBOX = ("id", "px0 AS w", "py0 AS s", "px2 AS e", "py2 AS n", "base_z AS lo", "base_z + 10 AS hi")
PG = f"SELECT {', '.join(CELLBOX)} FROM ({POLYGONS.sql()})"
CX, CY = "((w + e) / 2)", "((s + n) / 2)"
MARGIN = f"greatest((n - s) * 111000 / 2, (e - w) * 111000 * cos(radians({CY})) / 2)"


@query("C9_boxes_and_region", f"""
    SELECT id, {', '.join(f'{r(v, 3)} AS b{k}' for k, v in enumerate(box_sql(CX, CY, '((lo + hi) / 2)', [MARGIN, MARGIN, '((hi - lo) / 2)'])))},
      {', '.join(f'{r(v, 3)} AS p{k}' for k, v in enumerate(box_sql('w', 's', 'lo', ['CAST(20 AS DOUBLE)'] * 3)))},
      {', '.join(f'{r(f"radians({v})", 9)} AS r_{v}' for v in 'wsen')} FROM ({PG})""")
def c9(spark, sf):
    df = POLYGONS.frame(spark, sf).selectExpr(*CELLBOX)
    args = [c(k) for k in ("w", "s", "e", "n", "lo", "hi")]
    box, pt = g.bound_box(*args), g.margin_box(c("w"), c("s"), c("lo"), F.lit(20.0))
    reg = g.bound_region(*args)
    return df.select("id", *[g.clean(v, 3).alias(f"b{k}") for k, v in enumerate(box)],
                     *[g.clean(v, 3).alias(f"p{k}") for k, v in enumerate(pt)],
                     *[g.clean(v, 9).alias(f"r_{k}") for k, v in zip("wsen", reg)])


def region_box_sql() -> str:
    corners = " UNION ALL ".join(
        f"SELECT id, w, s, e, n, lo, hi, {i} AS lng, {j} AS lat, {k} AS alt FROM g" for i in "we" for j in "sn" for k in ("lo", "hi"))
    ax, o, p = axes_sql(CX, CY), ecef_sql(CX, CY, "((lo + hi) / 2)"), ecef_sql("lng", "lat", "alt")
    loc = [" + ".join(f"{ax[k][j]} * ({p[j]} - {o[j]})" for j in range(3)) for k in range(3)]
    centre = [f"any_value({o[a]}) + " + " + ".join(f"any_value({ax[k][a]}) * (min(l{k}) + max(l{k})) / 2" for k in range(3)) for a in range(3)]
    half = [f"(max(l{k}) - min(l{k})) / 2 * CAST(1.2 AS DOUBLE)" for k in range(3)]
    vals = centre + [f"any_value({ax[k][j]}) * {half[k]}" for k in range(3) for j in range(3)]
    return (f"WITH g AS ({PG}), k AS ({corners}), l AS (SELECT *, {', '.join(f'{v} AS l{i}' for i, v in enumerate(loc))} FROM k) "
            f"SELECT id, {', '.join(f'{r(v, 3)} AS b{i}' for i, v in enumerate(vals))} FROM l GROUP BY id")


@query("C10_region_to_box", region_box_sql())
def c10(spark, sf):
    df = POLYGONS.frame(spark, sf).selectExpr(*CELLBOX)
    region = F.array(*g.bound_region(*[c(k) for k in ("w", "s", "e", "n", "lo", "hi")]))
    df = df.select("id", region.alias("region")).select("id", g.region_box(c("region"), 1.2).alias("box"))
    return df.select("id", *[g.clean(c("box")[k], 3).alias(f"b{k}") for k in range(12)])


@query("C11_world_to_local_box", f"""
    SELECT id, CAST(0 AS DOUBLE) AS cx, CAST(0 AS DOUBLE) AS cy, CASE WHEN id % 10 = 0 THEN 0 ELSE {r('10 / s', 3)} END AS cz,
      CASE WHEN id % 10 = 0 THEN 0 ELSE {r('20 * sqrt(power(cos(a) / s, 2) + power(sin(a) / (2 * s), 2))', 3)} END AS hx,
      CASE WHEN id % 10 = 0 THEN 0 ELSE {r('20 * sqrt(power(sin(a) / s, 2) + power(cos(a) / (2 * s), 2))', 3)} END AS hy,
      CASE WHEN id % 10 = 0 THEN 0 ELSE {r('20 / s', 3)} END AS hz
    FROM (SELECT id, CAST(1 + id % 3 AS DOUBLE) AS s, radians(obj_angle) AS a FROM ({P}))""")
def c11(spark, sf):
    s = F.when(c("id") % 10 == 0, F.lit(0.0)).otherwise((c("id") % 3 + 1).cast("double"))
    df = POINTS.frame(spark, sf).select(
        "id", F.array(*g.margin_box(c("lng"), c("lat"), c("alt") + 10, F.lit(20.0))).alias("box"),
        F.array(*g.pose_matrix(c("lng"), c("lat"), c("alt"), c("obj_angle"), scale=(s, s * 2, s))).alias("m"))
    b = g.local_box(c("box"), c("m"))
    return df.select("id", *[g.clean(v, 3).alias(n) for n, v in zip(("cx", "cy", "cz", "hx", "hy", "hz"), (b[0], b[1], b[2], b[3], b[7], b[11]))])


def corner_sql(src: str) -> str:
    """Corners of a model box of half sizes 4, 2, 3 placed by the pose of each point."""
    ax = axes_sql("lng", "lat")
    ch, sh = "cos(radians(obj_angle))", "sin(radians(obj_angle))"
    rows = [[f"({ch} * {ax[0][j]} - {sh} * {ax[1][j]})" for j in range(3)], [f"({sh} * {ax[0][j]} + {ch} * {ax[1][j]})" for j in range(3)], ax[2]]
    o = ecef_sql("lng", "lat", "alt")
    return " UNION ALL ".join(
        "SELECT id, " + ", ".join(f"{o[a]} + {i * 4} * {rows[0][a]} + {j * 2} * {rows[1][a]} + {1 + k * 3} * {rows[2][a]} AS {n}" for a, n in enumerate("xyz"))
        + f" FROM ({src})" for i in (-1, 1) for j in (-1, 1) for k in (-1, 1))


@query("C12_box_transform_region", f"""
    WITH k AS ({corner_sql(P)}), b AS (SELECT id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM k GROUP BY id),
    q AS (SELECT id, CASE WHEN i = 0 THEN x0 ELSE x1 END AS x, CASE WHEN j = 0 THEN y0 ELSE y1 END AS y, CASE WHEN l = 0 THEN z0 ELSE z1 END AS z
          FROM b, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j), (SELECT unnest([0, 1]) AS l)),
    d AS ({geodetic_sql('SELECT * FROM k', 'id')}), a AS ({geodetic_sql('SELECT * FROM q', 'id')}),
    da AS (SELECT id, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n, min(h) AS lo, max(h) AS hi FROM d GROUP BY id),
    aa AS (SELECT id, min(lon) AS w, max(lat) AS n, max(h) AS hi FROM a GROUP BY id)
    SELECT da.id, {', '.join(f'{r("da." + k, 9)} AS {k}' for k in 'wsen')}, {r('da.lo', 3)} AS lo, {r('da.hi', 3)} AS hi,
       {r('aa.w', 9)} AS baked_w, {r('aa.n', 9)} AS baked_n, {r('aa.hi', 3)} AS baked_hi FROM da JOIN aa USING (id)""")
def c12(spark, sf):
    z = F.lit(0.0)
    box = F.array(z, z, F.lit(1.0), F.lit(4.0), z, z, z, F.lit(2.0), z, z, z, F.lit(3.0))
    df = POINTS.frame(spark, sf).select(
        "id", F.array(*g.pose_matrix(c("lng"), c("lat"), c("alt"), c("obj_angle"))).alias("m"), box.alias("box"))
    df = df.withColumn("pts", g.transform_points(g.box_corners(c("box")), c("m")))
    df = df.withColumn("baked", g.aabb_box(c("pts")))
    df = df.select("id", g.region_of_points(c("pts")).alias("rg"), g.box_region(c("baked")).alias("bk"))
    return df.select("id", *[g.clean(c("rg")[i], 9).alias(k) for i, k in enumerate("wsen")],
                     g.clean(c("rg")[4], 3).alias("lo"), g.clean(c("rg")[5], 3).alias("hi"), g.clean(c("bk")[0], 9).alias("baked_w"),
                     g.clean(c("bk")[3], 9).alias("baked_n"), g.clean(c("bk")[5], 3).alias("baked_hi"))


DLAT = "degrees(b / 6378137)"
DLNG = "degrees(b / (6378137 * cos(radians((s + n) / 2))))"


@query("C13_buffered_region", f"""
    WITH g AS (SELECT id, CASE WHEN id % 2 = 0 THEN w ELSE e END AS w0, CASE WHEN id % 2 = 0 THEN e ELSE w END AS e0, s, n, lo, hi,
       least(w, e) AS w, greatest(w, e) AS e, CAST(id % 100 AS DOUBLE) AS b FROM ({PG}))
    SELECT id, {r(f'radians(w - {DLNG})', 9)} AS w, {r(f'radians(greatest(s - {DLAT}, -90))', 9)} AS s, {r(f'radians(e + {DLNG})', 9)} AS e,
       {r(f'radians(least(n + {DLAT}, 90))', 9)} AS n, lo - b AS lo, hi + b AS hi FROM g""")
def c13(spark, sf):
    df = POLYGONS.frame(spark, sf).selectExpr(*CELLBOX)
    odd = c("id") % 2 == 1
    w, e = F.when(odd, c("e")).otherwise(c("w")), F.when(odd, c("w")).otherwise(c("e"))
    reg = g.buffered_region(w, c("s"), e, c("n"), c("lo"), c("hi"), -(c("id") % 100).cast("double"))
    return df.select("id", *[g.clean(v, 9).alias(k) for k, v in zip(("w", "s", "e", "n", "lo", "hi"), reg)])


@query("C14_mercator_shift", f"""
    SELECT id, {r('degrees(5 / CAST(6378137 AS DOUBLE))', 8)} AS d_lng,
       {r("degrees(atan((exp(m) - exp(-m)) / 2)) - lat", 8)} AS d_lat
    FROM (SELECT id, lat, ln(tan(radians(lat)) + 1 / cos(radians(lat))) + 5 / CAST(6378137 AS DOUBLE) AS m FROM ({P}))""")
def c14(spark, sf):
    d_lng, d_lat = g.mercator_shift(c("lat"), 5.0)
    return POINTS.frame(spark, sf).select("id", g.clean(d_lng, 8).alias("d_lng"), g.clean(d_lat, 8).alias("d_lat"))


def kruger_sql() -> str:
    """Easting and northing from the conformal latitude and a four-term series."""
    n = f"({FL} / (2 - {FL}))"
    al = [f"({n}/2 - 2*power({n},2)/3 + 5*power({n},3)/16 + 41*power({n},4)/180)", f"(13*power({n},2)/48 - 3*power({n},3)/5 + 557*power({n},4)/1440)",
          f"(61*power({n},3)/240 - 103*power({n},4)/140)", f"(49561*power({n},4)/161280)"]
    rect = f"({A} / (1 + {n}) * (1 + power({n},2)/4 + power({n},4)/64))"
    sh, ch = (lambda v: f"((exp({v}) - exp(-({v}))) / 2)"), (lambda v: f"((exp({v}) + exp(-({v}))) / 2)")
    ath = lambda v: f"(ln((1 + {v}) / (1 - {v})) / 2)"
    conf = f"{ath('sin(f)')} - sqrt({E2}) * {ath(f'(sqrt({E2}) * sin(f))')}"
    x = f"eta + " + " + ".join(f"{a} * cos({2 * j} * xi) * {sh(f'{2 * j} * eta')}" for j, a in enumerate(al, 1))
    y = f"xi + " + " + ".join(f"{a} * sin({2 * j} * xi) * {ch(f'{2 * j} * eta')}" for j, a in enumerate(al, 1))
    return (f"SELECT id, lng, lat, zone, ({x}) * CAST(0.9996 AS DOUBLE) * {rect} + 500000 AS x, ({y}) * CAST(0.9996 AS DOUBLE) * {rect} AS y FROM "
            f"(SELECT *, atan2(t, cos(d)) AS xi, {ath('(sin(d) / sqrt(1 + t * t))')} AS eta FROM "
            f"(SELECT *, {sh('q')} AS t FROM (SELECT *, {conf} AS q FROM (SELECT id, lng, lat, radians(lat) AS f, "
            f"CAST(floor((lng + 180) / 6) + 1 AS INTEGER) AS zone, radians(lng) - radians((floor((lng + 180) / 6) + 1) * 6 - 183) AS d FROM ({P})))))")


@query("C15_utm", f"""
    SELECT id, CAST(32600 + zone AS INTEGER) AS epsg, {r('x', 2)} AS x, {r('y', 2)} AS y, {r('lng', 6)} AS lng, {r('lat', 6)} AS lat FROM ({kruger_sql()})""")
def c15(spark, sf):
    x, y = g.utm_forward(c("lng"), c("lat"))
    df = POINTS.frame(spark, sf).select("id", g.utm_epsg(c("lng"), c("lat")).cast("int").alias("epsg"), x.alias("x"), y.alias("y"))
    lng, lat = g.utm_inverse(c("x"), c("y"), c("epsg"))
    return df.select("id", "epsg", g.clean(c("x"), 2).alias("x"), g.clean(c("y"), 2).alias("y"),
                     g.clean(lng, 6).alias("lng"), g.clean(lat, 6).alias("lat"))
