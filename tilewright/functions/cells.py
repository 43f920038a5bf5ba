"""Geohash cells as bigint codes.

A cell of level ``n`` is one column and one row of a grid with ``2^ceil(5n/2)`` columns and
``2^floor(5n/2)`` rows. The code packs both (column above 27 row bits), so encoding is two
divisions, every ancestor is two shifts, the box is arithmetic, and a join on cells is a join
on one bigint. Text hashes are produced only for output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The geohash alphabet, in value order.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
DIGITS = "0123456789abcdefghijklmnopqrstuv"
# Levels of the partition tree.
MIN_LEVEL = 3
MAX_LEVEL = 11
LNG_BITS = 28
LAT_BITS = 27
ROW_MASK = (1 << LAT_BITS) - 1


def grid_bits(level: int) -> tuple[int, int]:
    """Longitude and latitude bits of a level."""
    return (5 * level + 1) // 2, 5 * level // 2


def _symbols(lng_first: bool) -> str:
    """The alphabet reordered so that (longitude bits, latitude bits) of one symbol index it."""
    wide, narrow = 3, 2
    out = []
    for high in range(1 << wide if lng_first else 1 << narrow):
        for low in range(1 << narrow if lng_first else 1 << wide):
            first, second = (high, low) if lng_first else (low, high)
            value = sum(((first >> k) & 1) << (2 * k) for k in range(wide))
            value += sum(((second >> k) & 1) << (2 * k + 1) for k in range(narrow))
            out.append(ALPHABET[value])
    return "".join(out)


EVEN_SYMBOLS, ODD_SYMBOLS = _symbols(True), _symbols(False)


def grid_index(value: Column, low: float, span: float, bits: int) -> Column:
    scaled = F.floor((value - F.lit(low)) / F.lit(span) * F.lit(float(1 << bits)))
    return F.least(scaled.cast("bigint"), F.lit((1 << bits) - 1).cast("bigint"))


def pack(gx: Column, gy: Column) -> Column:
    return F.shiftleft(gx, LAT_BITS).bitwiseOR(gy)


def column_of(code: Column) -> Column:
    return F.shiftright(code, LAT_BITS)


def row_of(code: Column) -> Column:
    return code.bitwiseAND(F.lit(ROW_MASK))


def point_code(lng: Column, lat: Column, level: int = MAX_LEVEL) -> Column:
    """Cell code of a lon/lat point at ``level``."""
    lng_bits, lat_bits = grid_bits(level)
    return pack(grid_index(lng, -180.0, 360.0, lng_bits), grid_index(lat, -90.0, 180.0, lat_bits))


def ancestor_code(code: Column, from_level: int, to_level: int) -> Column:
    if from_level == to_level:
        return code
    (fx, fy), (tx, ty) = grid_bits(from_level), grid_bits(to_level)
    return pack(F.shiftright(column_of(code), fx - tx), F.shiftright(row_of(code), fy - ty))


def parent_code(code: Column, level: Column) -> Column:
    """Parent code where the level is a column: a symbol holds 3 or 2 bits of each axis in turn."""
    odd = level % 2 == 1
    return F.when(odd, pack(F.shiftright(column_of(code), 3), F.shiftright(row_of(code), 2))).otherwise(
        pack(F.shiftright(column_of(code), 2), F.shiftright(row_of(code), 3))
    )


def _hash_text(gx: Column, gy: Column, level: int) -> Column:
    """Text of full-width indices, one table lookup per symbol."""
    lng_bits, lat_bits = grid_bits(level)
    symbols = []
    for k in range(level):
        wide_lng = k % 2 == 0
        lng_bits -= 3 if wide_lng else 2
        lat_bits -= 2 if wide_lng else 3
        x = F.shiftright(gx, lng_bits).bitwiseAND(F.lit(7 if wide_lng else 3))
        y = F.shiftright(gy, lat_bits).bitwiseAND(F.lit(3 if wide_lng else 7))
        index = x * (4 if wide_lng else 8) + y + 1
        table = EVEN_SYMBOLS if wide_lng else ODD_SYMBOLS
        symbols.append(F.substring(F.lit(table), index.cast("int"), F.lit(1)))
    return F.concat(*symbols)


def code_to_hash(code: Column, level: int) -> Column:
    return _hash_text(column_of(code), row_of(code), level)


def point_hash(lng: Column, lat: Column, level: int = MAX_LEVEL) -> Column:
    lng_bits, lat_bits = grid_bits(level)
    return _hash_text(grid_index(lng, -180.0, 360.0, lng_bits), grid_index(lat, -90.0, 180.0, lat_bits), level)


def code_to_hash_at(code: Column, level: Column) -> Column:
    """Text of a code whose level is a column."""
    gx = F.call_function("shiftleft", column_of(code), F.lit(LNG_BITS) - F.floor((level * 5 + 1) / 2).cast("int"))
    gy = F.call_function("shiftleft", row_of(code), F.lit(LAT_BITS) - F.floor(level * 5 / 2).cast("int"))
    return F.substring(_hash_text(gx, gy, MAX_LEVEL), F.lit(1), level)


def _full_indices(geohash: Column) -> tuple[Column, Column]:
    """Full-width grid indices of a hash of any length: its base-4 digits hold one bit of each axis."""
    pairs = F.conv(F.translate(F.rpad(geohash, MAX_LEVEL, "0"), ALPHABET, DIGITS), 32, 4)
    gx = F.conv(F.translate(pairs, "0123", "0101"), 2, 10).cast("bigint")
    gy = F.conv(F.translate(pairs, "0123", "0011"), 2, 10).cast("bigint")
    return gx, gy


def hash_to_code(geohash: Column, level: int) -> Column:
    gx, gy = _full_indices(geohash)
    return ancestor_code(pack(gx, gy), MAX_LEVEL, level)


def code_bbox(code: Column, level: int) -> dict[str, Column]:
    """West, south, east and north of a cell whose level is known when the plan is built."""
    return index_bbox(column_of(code), row_of(code), level)


def index_bbox(gx: Column, gy: Column, level: int) -> dict[str, Column]:
    lng_bits, lat_bits = grid_bits(level)
    west = gx / F.lit(float(1 << lng_bits)) * F.lit(360.0) - F.lit(180.0)
    south = gy / F.lit(float(1 << lat_bits)) * F.lit(180.0) - F.lit(90.0)
    return {
        "west": west,
        "south": south,
        "east": west + F.lit(360.0 / (1 << lng_bits)),
        "north": south + F.lit(180.0 / (1 << lat_bits)),
    }


def hash_bbox(geohash: Column) -> dict[str, Column]:
    """West, south, east and north of a cell given as text of any length."""
    level = F.length(geohash)
    gx, gy = _full_indices(geohash)
    west = gx / F.lit(float(1 << LNG_BITS)) * F.lit(360.0) - F.lit(180.0)
    south = gy / F.lit(float(1 << LAT_BITS)) * F.lit(180.0) - F.lit(90.0)
    return {
        "west": west,
        "south": south,
        "east": west + F.lit(360.0) / F.pow(F.lit(2.0), F.floor((level * 5 + 1) / 2)),
        "north": south + F.lit(180.0) / F.pow(F.lit(2.0), F.floor(level * 5 / 2)),
    }


def bbox_wkt(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Closed rectangle as text, six decimals (ties to even), from the south-west corner northwards."""
    corner = "%.6f %.6f"
    w, s, e, n = (F.bround(c, 6) for c in (west, south, east, north))
    return F.format_string("POLYGON((" + ", ".join([corner] * 5) + "))", w, s, w, n, e, n, e, s, w, s)


def parent_hash(geohash: Column) -> Column:
    return F.substring(geohash, 1, F.length(geohash) - 1)


def child_hashes(geohash: Column) -> Column:
    return F.transform(F.split(F.lit(ALPHABET), ""), lambda c: F.concat(geohash, c))


def ancestor_hashes(geohash: Column, min_level: int = 1) -> Column:
    """Every proper or improper prefix from ``min_level`` up to the hash itself."""
    return F.transform(
        F.sequence(F.lit(min_level), F.length(geohash)), lambda n: F.substring(geohash, F.lit(1), n)
    )


def grid_span(low: Column, high: Column, axis_low: float, axis_span: float, bits: int) -> Column:
    """Indices of every grid row or column touched by ``[low, high]``."""
    return F.sequence(
        grid_index(low, axis_low, axis_span, bits), grid_index(high, axis_low, axis_span, bits)
    )


def cover_bbox(df: DataFrame, level: int, west: str, south: str, east: str, north: str, out: str = "cell") -> DataFrame:
    """One row per level-``level`` cell touched by each row's box."""
    lng_bits, lat_bits = grid_bits(level)
    xs = grid_span(F.col(west), F.col(east), -180.0, 360.0, lng_bits)
    ys = grid_span(F.col(south), F.col(north), -90.0, 180.0, lat_bits)
    return (
        df.withColumn("_gx", F.explode(xs))
        .withColumn("_gy", F.explode(ys))
        .withColumn(out, pack(F.col("_gx"), F.col("_gy")))
        .drop("_gx", "_gy")
    )


def cover_bound(spark: SparkSession, bound: tuple[float, float, float, float], level: int) -> DataFrame:
    """Every cell of one level that a bound touches: exact index ranges, so no row is missed."""
    west, south, east, north = bound
    box = spark.range(1).select(
        F.lit(float(west)).alias("west"), F.lit(float(south)).alias("south"),
        F.lit(float(east)).alias("east"), F.lit(float(north)).alias("north"),
    )
    return cover_bbox(box, level, "west", "south", "east", "north").select("cell")


def register_sql_functions(spark: SparkSession) -> None:
    """Expose the cell functions to SQL text as SQL-bodied functions (no Python involved)."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cell_parent(h STRING) RETURNS STRING "
        "RETURN substring(h, 1, length(h) - 1)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cell_children(h STRING) RETURNS ARRAY<STRING> "
        f"RETURN transform(split('{ALPHABET}', ''), c -> concat(h, c))"
    )
    def index(value: str, low: int, span: int, bits: int) -> str:
        return f"least(CAST(floor(({value} + {low}) / {span} * {1 << bits}D) AS BIGINT), {(1 << bits) - 1}L)"

    # reading binary digits in base 4 leaves a free bit between them; the row goes into the free bits
    gx = f"CAST(conv(bin({index('lng', 180, 360, LNG_BITS)}), 4, 10) AS BIGINT)"
    gy = f"CAST(conv(bin({index('lat', 90, 180, LAT_BITS)}), 4, 10) AS BIGINT)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cell_of(lng DOUBLE, lat DOUBLE, n INT) RETURNS STRING RETURN "
        f"substring(translate(lpad(lower(conv(CAST({gx} | shiftleft({gy}, 1) AS STRING), 10, 32)), {MAX_LEVEL}, '0'), "
        f"'{DIGITS}', '{ALPHABET}'), 1, n)"
    )
    wide, high = "rpad(h, 11, '0')", f"'{ALPHABET}', '{DIGITS}'"
    for name, digits, low, span, bits in (("west", "0101", 180, 360, LNG_BITS), ("south", "0011", 90, 180, LAT_BITS)):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION cell_{name}(h STRING) RETURNS DOUBLE RETURN "
            f"CAST(conv(translate(conv(translate({wide}, {high}), 32, 4), '0123', '{digits}'), 2, 10) AS BIGINT) "
            f"/ {1 << bits}D * {span} - {low}"
        )
