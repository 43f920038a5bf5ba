"""Layers stored along a space-filling curve, so that a bound reads few files and row groups.

A feature's code is the geohash of its place as one number (28 longitude and 27 latitude bits in turn), so a cell
of any level is one range of codes and neighbours in space are mostly neighbours in the table. A layer is written
in ranges of (tier, code), sorted inside each file. ``tier`` is the finest cell level whose cells are at least as
large as the feature's box: a feature of a tier meets a bound only if its middle lies in the bound widened by half
a cell of that tier. A scan turns the widened bound of every tier into at most ``RANGES`` ranges of codes; Parquet's
statistics skip what lies outside, and the exact test decides on the rest. Points are a tier of their own.

Features without a place (null or non-finite box) are kept under tier ``NOWHERE`` and met by no bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import cells
from tilewright.functions.predicates import Bound

CURVE_BITS = cells.LNG_BITS + cells.LAT_BITS
TIER, CODE = "tier", "curve"
#: Tiers beside the cell levels: features without extent, and those without a place.
POINT, NOWHERE = cells.MAX_LEVEL + 1, -1
RANGES = 16
ROW_GROUP_BYTES = 8 << 20

Range = tuple[int, int]


def curve_code(lng: Column, lat: Column) -> Column:
    """The place of a point on the curve: both indices' bits in turn, longitude first."""
    zero = F.lit(0).cast("bigint")
    gx = F.greatest(cells.grid_index(lng, -180.0, 360.0, cells.LNG_BITS), zero)
    gy = F.greatest(cells.grid_index(lat, -90.0, 180.0, cells.LAT_BITS), zero)
    # binary digits read in base 4 leave a free bit between them; the row goes into the free bits
    spread = lambda g: F.conv(F.bin(g), 4, 10).cast("bigint")
    return spread(gx).bitwiseOR(F.shiftleft(spread(gy), 1))


def cell_range(geohash: str) -> Range:
    """First and last code of a cell given as text."""
    value = 0
    for symbol in geohash:
        value = value * 32 + cells.ALPHABET.index(symbol)
    rest = CURVE_BITS - 5 * len(geohash)
    return value << rest, ((value + 1) << rest) - 1


def in_cell(geohash: str, code: str = CODE) -> Column:
    """Whether the stored feature's place lies in a cell of any level: one range."""
    return F.col(code).between(*cell_range(geohash))


def _index(value: float, low: float, span: float, bits: int) -> int:
    return min(max(int((value - low) / span * (1 << bits) // 1), 0), (1 << bits) - 1)


def cover(bound: Bound, most: int = RANGES) -> list[Range]:
    """At most ``most`` ranges of codes that hold every place of a bound, as tight as that many allow.

    Cells are halved along the curve, those first that waste most; a cell inside the bound is never cut.
    Ranges that touch are one.
    """
    if bound[0] > bound[2] or bound[1] > bound[3]:
        return []
    wx, sy = _index(bound[0], -180.0, 360.0, cells.LNG_BITS), _index(bound[1], -90.0, 180.0, cells.LAT_BITS)
    ex, ny = _index(bound[2], -180.0, 360.0, cells.LNG_BITS), _index(bound[3], -90.0, 180.0, cells.LAT_BITS)

    def entry(x: int, y: int, bits: int, code: int) -> tuple | None:
        """A cell fixed by its first ``bits`` bits, the most wasteful first; None where it misses the bound."""
        xbits, ybits = cells.LNG_BITS - (bits + 1) // 2, cells.LAT_BITS - bits // 2
        x0, x1, y0, y1 = x << xbits, ((x + 1) << xbits) - 1, y << ybits, ((y + 1) << ybits) - 1
        if x1 < wx or x0 > ex or y1 < sy or y0 > ny:
            return None
        held = (min(x1, ex) - max(x0, wx) + 1) * (min(y1, ny) - max(y0, sy) + 1)
        return (held - (x1 - x0 + 1) * (y1 - y0 + 1), code, x, y, bits)

    heap = [entry(0, 0, 0, 0)]
    # splitting goes on below the limit where it leaves one half only, and a little beyond, for ranges that touch merge
    while heap[0][0] < 0 and len(heap) < 4 * most:
        _, code, x, y, bits = heapq.heappop(heap)
        for half in (0, 1):
            nx, ny_ = (x * 2 + half, y) if bits % 2 == 0 else (x, y * 2 + half)
            child = entry(nx, ny_, bits + 1, code * 2 + half)
            if child:
                heapq.heappush(heap, child)
    ranges = sorted((code << (CURVE_BITS - bits), ((code + 1) << (CURVE_BITS - bits)) - 1) for _, code, _, _, bits in heap)
    merged: list[list[int]] = []
    for low, high in ranges:
        if merged and low == merged[-1][1] + 1:
            merged[-1][1] = high
        else:
            merged.append([low, high])
    while len(merged) > most:
        i = min(range(1, len(merged)), key=lambda k: merged[k][0] - merged[k - 1][1])
        merged[i - 1:i + 1] = [[merged[i - 1][0], merged[i][1]]]
    return [(low, high) for low, high in merged]


def tier_of(width: Column, height: Column) -> Column:
    """The finest cell level whose cells are at least as wide and as high: 0 is the whole world, ``POINT`` no extent at all."""
    out = F.lit(0)
    for level in range(1, cells.MAX_LEVEL + 1):
        lng_bits, lat_bits = cells.grid_bits(level)
        out = F.when((width <= 360.0 / (1 << lng_bits)) & (height <= 180.0 / (1 << lat_bits)), level).otherwise(out)
    return F.when((width == 0) & (height == 0), POINT).otherwise(out)


def placed(df: DataFrame, box: Sequence[Column]) -> DataFrame:
    """``df`` with ``tier`` and ``curve`` from each row's box (west, south, east, north)."""
    west, south, east, north = box
    finite = lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v)
    here = reduce(lambda a, b: a & b, [finite(v) for v in box])
    return df.withColumns({
        TIER: F.when(here, tier_of(east - west, north - south)).otherwise(NOWHERE).cast("int"),
        CODE: F.when(here, curve_code((west + east) / 2, (south + north) / 2))})


def write_layer(df: DataFrame, path: str, box: Sequence[Column], files: int = 16, row_group_bytes: int = ROW_GROUP_BYTES, mode: str = "errorifexists") -> None:
    """Write a layer in ``files`` ranges of (tier, code), sorted in each. A task writes one range, whatever tier is frequent."""
    ordered = placed(df, box).repartitionByRange(files, TIER, CODE).sortWithinPartitions(TIER, CODE)
    ordered.write.mode(mode).option("parquet.block.size", str(row_group_bytes)).parquet(path)


def write_points(df: DataFrame, path: str, lng: str = "lng", lat: str = "lat", files: int = 16, **options) -> None:
    write_layer(df, path, [F.col(lng), F.col(lat), F.col(lng), F.col(lat)], files, **options)


def widened(bound: Bound, tier: int) -> Bound:
    """The bound and half a cell of the tier around it; places outside the world are counted at its edge."""
    lng_bits, lat_bits = cells.grid_bits(tier)
    dx, dy = 180.0 / (1 << lng_bits), 90.0 / (1 << lat_bits)
    # a little more, for middles are rounded
    return bound[0] - dx - 1e-9, bound[1] - dy - 1e-9, bound[2] + dx + 1e-9, bound[3] + dy + 1e-9


def near_bound(bound: Bound, tiers: Sequence[int] = range(POINT + 1), most: int = RANGES) -> Column:
    """The ranges of all tiers as one filter that Parquet's statistics can answer. It keeps every feature that meets the bound."""
    tests = []
    for tier in tiers:
        inside = [F.col(CODE).between(low, high) for low, high in cover(bound if tier == POINT else widened(bound, tier), most)]
        if inside:
            tests.append((F.col(TIER) == tier) & reduce(lambda a, b: a | b, inside))
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def read_bound(spark: SparkSession, path: str, bound: Bound, most: int = RANGES) -> DataFrame:
    """The stored features that may meet a bound; the caller applies its exact test."""
    table = spark.read.parquet(path)
    tiers = sorted(r[0] for r in table.select(TIER).where(F.col(TIER) != NOWHERE).distinct().collect())
    return table.where(near_bound(bound, tiers, most)) if tiers else table.limit(0)


def read_cell(spark: SparkSession, path: str, geohash: str) -> DataFrame:
    """The stored features whose place lies in a cell."""
    return spark.read.parquet(path).where(in_cell(geohash))
