"""Earth-centred coordinates, local frames, poses, boxes and regions as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from operator import itemgetter

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid.
SEMI_MAJOR = 6378137.0
FLATTENING = 1.0 / 298.257223563
ECC2 = FLATTENING * (2.0 - FLATTENING)
SEMI_MINOR = SEMI_MAJOR * (1.0 - FLATTENING)
# Metres per degree and heights of a project bound.
METRES_PER_DEGREE = 111000.0
BOUND_BOX_HEIGHTS = (-20.0, 300.0)
BOUND_REGION_HEIGHTS = (-20.0, 200.0)

Vec = tuple[Column, Column, Column]


def clean(value: Column, digits: int) -> Column:
    """Rounded, without a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to an expression that mentions it many times."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def ecef(lng: Column, lat: Column, height: Column, ecc2: float = ECC2) -> Vec:
    lon, phi = F.radians(lng), F.radians(lat)
    n = F.lit(SEMI_MAJOR) / F.sqrt(F.lit(1.0) - F.lit(ecc2) * F.sin(phi) * F.sin(phi))
    return (
        (n + height) * F.cos(phi) * F.cos(lon),
        (n + height) * F.cos(phi) * F.sin(lon),
        (n * F.lit(1.0 - ecc2) + height) * F.sin(phi),
    )


def _latitude(p: Column, z: Column, beta: Column) -> Column:
    second = ECC2 / (1.0 - ECC2)
    return F.atan2(
        z + F.lit(second * SEMI_MINOR) * F.pow(F.sin(beta), 3), p - F.lit(ECC2 * SEMI_MAJOR) * F.pow(F.cos(beta), 3)
    )


def _reduced(lat: Column) -> Column:
    return F.atan2(F.lit(1.0 - FLATTENING) * F.sin(lat), F.cos(lat))


def geodetic(x: Column, y: Column, z: Column) -> Vec:
    """Longitude, latitude (radians) and height of an earth-centred point: two closed-form corrections."""
    p = F.sqrt(x * x + y * y)
    lat = _latitude(p, z, F.atan2(z * F.lit(SEMI_MAJOR), p * F.lit(SEMI_MINOR)))
    lat = _latitude(p, z, _reduced(lat))
    height = p * F.cos(lat) + z * F.sin(lat) - F.lit(SEMI_MAJOR) * F.sqrt(F.lit(1.0) - F.lit(ECC2) * F.sin(lat) * F.sin(lat))
    return F.atan2(y, x), lat, height


def geodetic_array(points: Column) -> Column:
    """Array of (x, y, z) to array of (lon, lat, h); each step binds its result so nothing is evaluated twice."""
    step = F.transform(points, lambda p: F.struct(
        F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]).alias("p"), p["z"].alias("z"), F.atan2(p["y"], p["x"]).alias("lon")))
    step = F.transform(step, lambda s: F.struct(
        s["p"].alias("p"), s["z"].alias("z"), s["lon"].alias("lon"),
        F.atan2(s["z"] * F.lit(SEMI_MAJOR), s["p"] * F.lit(SEMI_MINOR)).alias("b")))
    step = F.transform(step, lambda s: F.struct(
        s["p"].alias("p"), s["z"].alias("z"), s["lon"].alias("lon"), _latitude(s["p"], s["z"], s["b"]).alias("lat")))
    step = F.transform(step, lambda s: F.struct(
        s["p"].alias("p"), s["z"].alias("z"), s["lon"].alias("lon"), _reduced(s["lat"]).alias("b")))
    step = F.transform(step, lambda s: F.struct(
        s["p"].alias("p"), s["z"].alias("z"), s["lon"].alias("lon"), _latitude(s["p"], s["z"], s["b"]).alias("lat")))
    return F.transform(step, lambda s: F.struct(
        s["lon"].alias("lon"), s["lat"].alias("lat"),
        (s["p"] * F.cos(s["lat"]) + s["z"] * F.sin(s["lat"]) - F.lit(SEMI_MAJOR)
         * F.sqrt(F.lit(1.0) - F.lit(ECC2) * F.sin(s["lat"]) * F.sin(s["lat"]))).alias("h")))


def enu_axes(lng: Column, lat: Column) -> tuple[Vec, Vec, Vec]:
    """East, north and up unit vectors at a point in degrees."""
    lon, phi = F.radians(lng), F.radians(lat)
    sl, cl, sp, cp = F.sin(lon), F.cos(lon), F.sin(phi), F.cos(phi)
    return (-sl, cl, F.lit(0.0)), (-sp * cl, -sp * sl, cp), (cp * cl, cp * sl, sp)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def enu_offset(point: Vec, origin: Vec, north_positive: bool = True) -> Vec:
    """East, north, up metres of (lng, lat, h) about an origin; model frames count north negative."""
    p, o = ecef(*point), ecef(*origin)
    d = (p[0] - o[0], p[1] - o[1], p[2] - o[2])
    east, north, up = enu_axes(origin[0], origin[1])
    n = dot(d, north)
    return dot(d, east), (n if north_positive else -n), dot(d, up)


def _product(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]


def pose_matrix(
    lng: Column, lat: Column, height: Column, heading: Column, pitch: Column | None = None, roll: Column | None = None,
    scale: Vec | None = None,
) -> list[Column]:
    """Column-major 4x4 placement: heading about up, then pitch and roll where given, then scale."""
    zero, one = F.lit(0.0), F.lit(1.0)
    rot = [list(v) for v in enu_axes(lng, lat)]

    def turn(angle: Column, axis: str) -> list[list[Column]]:
        a = F.radians(angle)
        s, c = F.sin(a), F.cos(a)
        return {
            "z": [[c, -s, zero], [s, c, zero], [zero, zero, one]],
            "x": [[one, zero, zero], [zero, c, -s], [zero, s, c]],
            "y": [[c, zero, s], [zero, one, zero], [-s, zero, c]],
        }[axis]

    rot = _product(turn(heading, "z"), rot)
    if pitch is not None:
        rot = _product(turn(pitch, "x"), rot)
    if roll is not None:
        rot = _product(turn(roll, "y"), rot)
    if scale is not None:
        rot = [[scale[i] * rot[i][j] for j in range(3)] for i in range(3)]
    x, y, z = ecef(lng, lat, height)
    return [*rot[0], zero, *rot[1], zero, *rot[2], zero, x, y, z, one]


def trs_scale(transform: Column, default: Vec | None = None) -> Vec:
    """Scale of a ten-value placement, or the default when it is absent or flat."""
    usable = (F.size(transform) == 10) & (F.try_element_at(transform, F.lit(8)) * F.try_element_at(transform, F.lit(9))
                                          * F.try_element_at(transform, F.lit(10)) != 0)
    base = default or (F.lit(1.0), F.lit(1.0), F.lit(1.0))
    return tuple(F.when(usable, F.try_element_at(transform, F.lit(8 + k))).otherwise(base[k]) for k in range(3))


def stored_matrix(metadata: Column) -> Column:
    """The 16-key transform kept in a JSON document, as an array; null unless all 16 keys are there."""
    keyed = F.from_json(metadata, "transform map<string,double>")["transform"]
    values = F.array(*[F.coalesce(F.try_element_at(keyed, F.lit(str(k))), F.lit(0.0)) for k in range(16)])
    return F.when(F.size(keyed) == 16, values)


def quaternion(heading: Column, pitch: Column, roll: Column) -> tuple[Column, Column, Column, Column]:
    """Heading, then pitch, then roll (degrees) as x, y, z, w."""
    h, p, r = (F.radians(a) / 2 for a in (heading, pitch, roll))
    sz, cz, sx, cx, sy, cy = F.sin(h), F.cos(h), F.sin(p), F.cos(p), F.sin(r), F.cos(r)
    return (cz * sx * cy - sz * cx * sy, cz * cx * sy + sz * sx * cy, sz * cx * cy + cz * sx * sy, cz * cx * cy - sz * sx * sy)


def euler(x: Column, y: Column, z: Column, w: Column) -> Vec:
    """Heading in [0, 360), pitch and roll in [-180, 180); a vertical pitch gives its roll to the heading."""
    n = F.sqrt(x * x + y * y + z * z + w * w)
    x, y, z, w = x / n, y / n, z / n, w / n
    m21 = F.least(F.greatest(2 * (y * z + x * w), F.lit(-1.0)), F.lit(1.0))
    pitch = F.asin(m21)
    locked = F.abs(F.cos(pitch)) <= 1e-8
    heading = F.when(locked, F.atan2(2 * (x * y + z * w), 1 - 2 * (y * y + z * z))).otherwise(
        F.atan2(-2 * (x * y - z * w), 1 - 2 * (x * x + z * z)))
    roll = F.when(locked, F.lit(0.0)).otherwise(F.atan2(-2 * (x * z - y * w), 1 - 2 * (x * x + y * y)))
    wrap = lambda a: F.pmod(a, F.lit(360.0))
    signed = lambda a: F.pmod(a + 180.0, F.lit(360.0)) - 180.0
    return wrap(F.degrees(heading)), signed(F.degrees(pitch)), signed(F.degrees(roll))


def same_rotation(a: tuple[Column, ...], b: tuple[Column, ...], eps: float) -> Column:
    d = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    return F.abs(F.abs(d) - 1) < eps


def heading_trs(heading: Column, scale: Vec) -> Column:
    """Ten-value placement of a heading: translation, quaternion with negated w, scale."""
    angle = F.round(F.pmod(heading + 360.0, F.lit(360.0)), 6)
    x, y, z, w = quaternion(angle, F.lit(0.0), F.lit(0.0))
    zero = F.lit(0.0)
    return F.array(zero, zero, zero, x, y, z, -w, *scale)


def axis_box(lng: Column, lat: Column, height: Column, half: Vec) -> list[Column]:
    """Box of 12 values aligned with east, north and up at a point."""
    centre = ecef(lng, lat, height)
    axes = enu_axes(lng, lat)
    return [*centre, *[axes[k][j] * half[k] for k in range(3) for j in range(3)]]


def margin_box(lng: Column, lat: Column, height: Column, margin: Column) -> list[Column]:
    return axis_box(lng, lat, height, (margin, margin, margin))


def bound_box(west: Column, south: Column, east: Column, north: Column, low: Column, high: Column) -> list[Column]:
    lng, lat = (west + east) / 2, (south + north) / 2
    span_lat = (north - south) * METRES_PER_DEGREE / 2
    span_lng = (east - west) * METRES_PER_DEGREE * F.cos(F.radians(lat)) / 2
    margin = F.greatest(span_lat, span_lng)
    return axis_box(lng, lat, (low + high) / 2, (margin, margin, (high - low) / 2))


def bound_region(west: Column, south: Column, east: Column, north: Column, low: Column, high: Column) -> list[Column]:
    return [F.radians(west), F.radians(south), F.radians(east), F.radians(north), low, high]


def buffered_region(west: Column, south: Column, east: Column, north: Column, low: Column, high: Column, buffer: Column) -> list[Column]:
    """Region in radians of a box in degrees: order repaired, grown by metres, latitudes clamped."""
    b = F.abs(buffer)
    w, e, s, n = F.least(west, east), F.greatest(west, east), F.least(south, north), F.greatest(south, north)
    shrink = F.cos(F.radians((s + n) * 0.5))
    d_lat = F.degrees(b / SEMI_MAJOR)
    d_lng = F.when(F.abs(shrink) < 1e-12, F.lit(0.0)).otherwise(F.degrees(b / (SEMI_MAJOR * shrink)))
    return [F.radians(w - d_lng), F.radians(F.greatest(s - d_lat, F.lit(-90.0))), F.radians(e + d_lng),
            F.radians(F.least(n + d_lat, F.lit(90.0))), low - b, high + b]


def _struct(v: Vec) -> Column:
    return F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


def box_corners(box: Column) -> Column:
    """Eight corners of a 12-value box as (x, y, z)."""
    signs = [(i, j, k) for i in (-1.0, 1.0) for j in (-1.0, 1.0) for k in (-1.0, 1.0)]
    return F.array(*[
        _struct(tuple(box[a] + F.lit(i) * box[3 + a] + F.lit(j) * box[6 + a] + F.lit(k) * box[9 + a] for a in range(3)))
        for i, j, k in signs])


def transform_points(points: Column, matrix: Column) -> Column:
    return F.transform(points, lambda p: _struct(tuple(
        matrix[a] * p["x"] + matrix[4 + a] * p["y"] + matrix[8 + a] * p["z"] + matrix[12 + a] for a in range(3))))


def points_aabb(points: Column) -> tuple[Vec, Vec]:
    axes = [F.transform(points, itemgetter(a)) for a in "xyz"]
    return tuple(F.array_min(a) for a in axes), tuple(F.array_max(a) for a in axes)


def points_span(points: Column) -> Column:
    """Lowest and highest corner of an array of points, as one struct."""
    def span(pts: Column) -> Column:
        low, high = points_aabb(pts)
        return F.struct(_struct(low).alias("low"), _struct(high).alias("high"))

    return bind(points, span)


def aabb_box(points: Column) -> Column:
    """Axis-aligned 12-value box around points."""
    z = F.lit(0.0)

    def build(s: Column) -> Column:
        h = [(s["high"][k] - s["low"][k]) / 2 for k in "xyz"]
        return F.array(*[(s["low"][k] + s["high"][k]) / 2 for k in "xyz"], h[0], z, z, z, h[1], z, z, z, h[2])

    return bind(points_span(points), build)


def region_of_points(points: Column, reference_lon: Column | None = None) -> Column:
    """West, south, east, north, low, high of earth-centred points; longitudes unwrapped about a reference."""
    def lon(g: Column) -> Column:
        if reference_lon is None:
            return g["lon"]
        turn = F.round((reference_lon - g["lon"]) / (2 * math.pi))
        return g["lon"] + turn * (2 * math.pi)

    def extremes(geo: Column) -> Column:
        lons, lats, hs = F.transform(geo, lon), F.transform(geo, itemgetter("lat")), F.transform(geo, itemgetter("h"))
        return F.array(F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats), F.array_min(hs), F.array_max(hs))

    return bind(geodetic_array(points), extremes)


def box_region(box: Column, matrix: Column | None = None) -> Column:
    corners = box_corners(box)
    return region_of_points(corners if matrix is None else transform_points(corners, matrix))


def sample_points(low: Vec, high: Vec) -> Column:
    """Twenty samples of an axis box: eight corners and twelve edge middles."""
    mid = tuple((low[k] + high[k]) / 2 for k in range(3))
    at = lambda p: _struct(tuple((low[k], mid[k], high[k])[p[k]] for k in range(3)))
    picks = [(i, j, k) for i in range(3) for j in range(3) for k in range(3) if (i, j, k).count(1) <= 1]
    return F.array(*[at(p) for p in picks])


def region_box(region: Column, expand: float) -> Column:
    """Oriented box around the eight corners of a region, grown by a factor."""
    origin = (
        F.degrees((region[0] + region[2]) * 0.5), F.degrees((region[1] + region[3]) * 0.5), (region[4] + region[5]) * 0.5)
    centre, axes = ecef(*origin), enu_axes(origin[0], origin[1])
    frame = F.struct(_struct(centre).alias("o"), *[_struct(a).alias(n) for a, n in zip(axes, "enu")])
    corners = F.array(*[
        _struct(ecef(F.degrees(region[i]), F.degrees(region[j]), region[k])) for i in (0, 2) for j in (1, 3) for k in (4, 5)])

    def build(f: Column) -> Column:
        def local(p: Column) -> Column:
            d = tuple(p[k] - f["o"][k] for k in "xyz")
            return _struct(tuple(dot(d, tuple(f[n][k] for k in "xyz")) for n in "enu"))

        def box(s: Column) -> Column:
            mid = [(s["low"][k] + s["high"][k]) * 0.5 for k in "xyz"]
            half = [(s["high"][k] - s["low"][k]) * (0.5 * expand) for k in "xyz"]
            at = [f["o"][k] + f["e"][k] * mid[0] + f["n"][k] * mid[1] + f["u"][k] * mid[2] for k in "xyz"]
            return F.array(*at, *[f[n][k] * half[i] for i, n in enumerate("enu") for k in "xyz"])

        return bind(points_span(F.transform(corners, local)), box)

    return bind(frame, build)


def _columns(m: Column) -> tuple[Vec, Vec, Vec]:
    return tuple(tuple(m[4 * k + j] for j in range(3)) for k in range(3))


def _cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def local_box(box: Column, matrix: Column) -> list[Column]:
    """A world box seen from a placement; only half lengths survive, a singular placement gives zeros."""
    a, b, c = _columns(matrix)
    det = dot(a, _cross(b, c))
    inverse = [_cross(b, c), _cross(c, a), _cross(a, b)]
    zero = F.lit(0.0)
    singular = F.abs(det) < 1e-15
    safe = F.when(singular, F.lit(1.0)).otherwise(det)

    def solve(v: Vec) -> list[Column]:
        return [dot(row, v) / safe for row in inverse]

    centre = solve(tuple(box[k] - matrix[12 + k] for k in range(3)))
    half = []
    for k in range(3):
        v = solve(tuple(box[3 + 3 * k + j] for j in range(3)))
        half.append(F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]))
    values = [*centre, half[0], zero, zero, zero, half[1], zero, zero, zero, half[2]]
    return [F.when(singular, zero).otherwise(v) for v in values]


def mercator_shift(lat: Column, metres: float) -> tuple[Column, Column]:
    """Degrees of longitude and latitude for a shift of ``metres`` on the web-mercator plane."""
    k = metres / SEMI_MAJOR
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    moved = F.degrees(2 * F.atan(F.exp(y + F.lit(k))) - F.lit(math.pi / 2))
    return F.lit(math.degrees(k)), moved - lat


def utm_zone(lng: Column) -> Column:
    return (F.floor((lng + 180.0) / 6.0) + 1).cast("int")


def utm_epsg(lng: Column, lat: Column) -> Column:
    return F.when(lat >= 0, utm_zone(lng) + 32600).otherwise(utm_zone(lng) + 32700)


# Third flattening, rectifying radius, and the series coefficients built from it.
_N = FLATTENING / (2.0 - FLATTENING)
_RECT = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
UTM_SCALE = 0.9996


def _total(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def utm_forward(lng: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in the zone of the point."""
    lon0 = F.radians(utm_zone(lng) * 6 - F.lit(183.0))
    d, s = F.radians(lng) - lon0, F.sin(F.radians(lat))
    e = math.sqrt(ECC2)
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(F.lit(1.0) + t * t))
    x = eta + _total([F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) for j, a in enumerate(_ALPHA, 1)])
    y = xi + _total([F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) for j, a in enumerate(_ALPHA, 1)])
    shift = F.when(lat >= 0, F.lit(0.0)).otherwise(F.lit(10000000.0))
    return x * (UTM_SCALE * _RECT) + 500000.0, y * (UTM_SCALE * _RECT) + shift


def utm_inverse(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a projected point."""
    zone, south = epsg % 100, epsg >= 32700
    xi = (y - F.when(south, F.lit(10000000.0)).otherwise(F.lit(0.0))) / (UTM_SCALE * _RECT)
    eta = (x - 500000.0) / (UTM_SCALE * _RECT)
    u = xi - _total([F.lit(b) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) for j, b in enumerate(_BETA, 1)])
    v = eta - _total([F.lit(b) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) for j, b in enumerate(_BETA, 1)])
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi + _total([F.lit(d) * F.sin(chi * (2 * j)) for j, d in enumerate(_DELTA, 1)])
    lon = F.radians(zone * 6 - F.lit(183.0)) + F.atan2(F.sinh(v), F.cos(u))
    return F.degrees(lon), F.degrees(lat)
