"""Row predicates: bounds, geometry tests, model suffixes, categories, conditions, keyword search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Bound = tuple[float, float, float, float]


def in_bound(lng: Column, lat: Column, bound: Bound) -> Column:
    """Point inside a bound, boundary included; plain comparisons so that they reach the scan."""
    west, south, east, north = bound
    return (lng >= west) & (lng <= east) & (lat >= south) & (lat <= north)


def box_intersects(west: str, south: str, east: str, north: str, bound: Bound) -> Column:
    """Two boxes meet, boundary contact included."""
    w, s, e, n = bound
    return (F.col(west) <= e) & (F.col(east) >= w) & (F.col(south) <= n) & (F.col(north) >= s)


def ring_inside(points: Column, bound: Bound) -> Column:
    """Every vertex is finite and inside the bound."""
    west, south, east, north = bound

    def ok(p: Column) -> Column:
        finite = ~(F.isnan(p["x"]) | F.isnan(p["y"]))
        return F.coalesce(
            finite & (p["x"] >= west) & (p["x"] <= east) & (p["y"] >= south) & (p["y"] <= north), F.lit(False)
        )

    return (F.size(points) > 0) & F.forall(points, ok)


def segments(points: Column, closed: bool) -> Column:
    """Consecutive vertex pairs of a line, or of a ring including the closing edge."""
    after = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
    if closed:
        after = F.concat(after, F.slice(points, 1, 1))
        heads = points
    else:
        heads = F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0)))
    return F.arrays_zip(heads.alias("a"), after.alias("b"))


def segment_meets_box(x1: Column, y1: Column, x2: Column, y2: Column,
                      west: Column, south: Column, east: Column, north: Column) -> Column:
    """A segment and a box meet, contact included: their boxes overlap and the segment's line does not pass the box by.

    The cheap comparisons come first, so most pairs are settled without any product.
    """
    near = (F.least(x1, x2) <= east) & (F.greatest(x1, x2) >= west) & (F.least(y1, y2) <= north) & (F.greatest(y1, y2) >= south)
    dx, dy = x2 - x1, y2 - y1
    off = dx * ((south + north) / 2 - y1) - dy * ((west + east) / 2 - x1)
    return near & (F.abs(off) <= ((east - west) * F.abs(dy) + (north - south) * F.abs(dx)) / 2)


def ring_contains(points: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a ring."""

    def crosses(s: Column) -> Column:
        ay, by = s["a"]["y"], s["b"]["y"]
        hit = ((ay > y) != (by > y)) & (
            x < (s["b"]["x"] - s["a"]["x"]) * (y - ay) / F.when(by == ay, F.lit(1.0)).otherwise(by - ay) + s["a"]["x"]
        )
        return F.when(hit, F.lit(1)).otherwise(F.lit(0))

    count = F.aggregate(segments(points, True), F.lit(0), lambda acc, s: acc + crosses(s))
    return count % 2 == 1


def edges_contain(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against ring edges given as (x1, y1, x2, y2)."""

    def crosses(e: Column) -> Column:
        rise = e["y2"] - e["y1"]
        return ((e["y1"] > y) != (e["y2"] > y)) & (
            x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(rise == 0, F.lit(1.0)).otherwise(rise) + e["x1"])

    return F.size(F.filter(edges, crosses)) % 2 == 1


def edges_meet_box(edges: Column, west: Column, south: Column, east: Column, north: Column, closed: bool = True) -> Column:
    """A line or filled ring meets a box: an edge crosses it, or the box lies inside the ring."""
    edge = F.exists(edges, lambda e: segment_meets_box(e["x1"], e["y1"], e["x2"], e["y2"], west, south, east, north))
    return edge | edges_contain(edges, west, south) if closed else edge


def edge_structs(points: Column, closed: bool = True) -> Column:
    return F.transform(segments(points, closed), lambda s: F.struct(
        s["a"]["x"].alias("x1"), s["a"]["y"].alias("y1"), s["b"]["x"].alias("x2"), s["b"]["y"].alias("y2")))


def ring_meets_box(points: Column, west: Column, south: Column, east: Column, north: Column, closed: bool = True) -> Column:
    return edges_meet_box(edge_structs(points, closed), west, south, east, north, closed)


def polygon_meets_box(rings: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Like :func:`ring_meets_box` for an outer ring with holes: a box wholly inside a hole does not meet it."""
    outer, holes = rings[0], F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    edges = F.exists(
        F.flatten(F.transform(rings, lambda r: segments(r, True))),
        lambda s: segment_meets_box(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], west, south, east, north),
    )
    swallowed = ring_contains(outer, west, south) & ~F.exists(holes, lambda h: ring_contains(h, west, south))
    return edges | swallowed


# Suffixes of placeable models.
MODEL_SUFFIXES = ("glb", "gltf")


def model_ok(model: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(model, F.lit(s)) for s in MODEL_SUFFIXES])


def not_deleted(del_flag: Column) -> Column:
    """Soft delete: a missing flag means the row is live."""
    return F.coalesce(del_flag != "1", F.lit(True))


def live_feature(del_flag: Column, x: Column, id_: Column) -> Column:
    return not_deleted(del_flag) & (x != 0) & (F.length(id_.cast("string")) > 0)


def category_filter(field: Column | None, values: Sequence[str], mapping: Mapping[str, str] | None = None) -> Column:
    """Rows whose category text is listed, and also a key of the mapping where one is given."""
    if field is None:
        if values or mapping:
            raise ValueError("category values need a category field")
        return F.lit(True)
    if not values and not mapping:
        raise ValueError("a category field needs values or a mapping")
    text, tests = field.cast("string"), []
    if values:
        tests.append(text.isin(list(values)))
    if mapping:
        tests.append(text.isin(list(mapping)))
    return reduce(lambda a, b: a & b, tests)


def condition_filter(columns: Mapping[str, str], conditions: Mapping[str, object], update_time: str = "update_time") -> Column:
    """Conjunction of optional conditions.

    ``columns`` maps a condition key to ``"string"`` or ``"int"``. Empty text and ``-`` ask for
    the empty string, ``%`` asks for a pattern, a list asks for any of its parts, and the list
    entry ``none`` on ``status`` also accepts a missing value.
    """
    tests: list[Column] = []
    if conditions.get("updateTime") is not None:
        tests.append(F.col(update_time) >= F.lit(conditions["updateTime"]).cast("timestamp"))
    for key, kind in columns.items():
        value = conditions.get(key)
        if value is None:
            continue
        c = F.col(key)
        if kind == "int":
            tests.append(c == F.lit(int(value)))
        elif isinstance(value, (list, tuple)):
            tests.append(reduce(lambda a, b: a | b, [_one_of(key, c, str(v)) for v in value]))
        elif str(value) in ("", "-"):
            tests.append(c == "")
        elif "%" in str(value):
            tests.append(c.like(str(value)))
        else:
            tests.append(c == str(value))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _one_of(key: str, c: Column, value: str) -> Column:
    if key == "status" and value == "none":
        return c.isNull() | (c == "none")
    return c.like(f"%{value}%")


def keyword_filter(fields: Sequence[Column], keyword: str) -> Column:
    """Case-blind substring match over any of the fields; an empty keyword keeps everything."""
    word = keyword.strip()
    if not word:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.coalesce(f.cast("string"), F.lit("")).ilike(f"%{word}%") for f in fields])


def key_filter(fields: Sequence[Column], key: str) -> Column:
    text = key.strip()
    if not text:
        raise ValueError("primary key is required")
    return reduce(lambda a, b: a & b, [F.coalesce(f.cast("string"), F.lit("")) == text for f in fields])


def map_subtype(df: DataFrame, field: str, mapping: Mapping[str, str], known: Sequence[str], out: str = "subtype") -> DataFrame:
    """Raw category to subtype; unmapped rows are dropped, a mapping to an unknown subtype is an error."""
    wrong = sorted(set(mapping.values()) - set(known))
    if wrong:
        raise ValueError(f"unknown subtypes {wrong}")
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    mapped = F.try_element_at(F.create_map(*pairs), F.col(field).cast("string"))
    return df.withColumn(out, mapped).where(F.col(out).isNotNull())


def check_geometry_kind(build_type: Column, kind: Column, accepted: Mapping[str, Sequence[str]]) -> Column:
    """True where the geometry kind suits the build type."""
    pairs = [x for k, v in accepted.items() for x in (F.lit(k), F.array(*[F.lit(g) for g in v]))]
    return F.coalesce(F.array_contains(F.try_element_at(F.create_map(*pairs), build_type), kind), F.lit(False))


def leaf_list_violations(hashes: DataFrame, column: str = "geohash") -> DataFrame:
    """Badly formed hashes, repeated hashes, and hashes that have another listed hash as prefix."""
    from tilewright.functions.cells import ALPHABET, ancestor_hashes

    bad = hashes.where(~F.col(column).rlike(f"^[{ALPHABET}]{{3,11}}$")).select(column, F.lit("malformed").alias("reason"))
    good = hashes.where(F.col(column).rlike(f"^[{ALPHABET}]{{3,11}}$")).groupBy(column).agg(F.count("*").alias("n"))
    twice = good.where("n > 1").select(column, F.lit("repeated").alias("reason"))
    inner = (
        good.where(F.length(column) > 3)
        .withColumn("_up", F.explode(F.transform(
            F.sequence(F.lit(3), F.length(column) - 1), lambda n: F.substring(F.col(column), F.lit(1), n))))
        .join(good.select(F.col(column).alias("_up")), "_up", "left_semi")
        .select(column, F.lit("overlap").alias("reason")).distinct()
    )
    return bad.distinct().unionByName(twice).unionByName(inner)
