"""Text, time, cast and JSON helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folders of the written tree.
TILE_DIR, SUBTREE_DIR = "tiles", "subtilesets"
# Digits of the shortened hash.
BASE62 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
# 64-bit FNV-1a offset basis and the low part of its prime (2^40 + 435).
FNV_HIGH, FNV_LOW, FNV_PRIME_LOW = 0xCBF29CE4, 0x84222325, 435
MASK32 = 0xFFFFFFFF


def sharded_dir(geohash: Column) -> Column:
    """Folders of growing two-symbol prefixes, then the hash itself."""
    depth = F.length(geohash) - 2
    ends = F.when(depth > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(depth / 2).cast("int") - 1, F.lit(0))),
                                         lambda k: F.substring(geohash, F.lit(1), F.least(k * 2 + 2, depth))))
    return F.array_join(F.concat(F.coalesce(ends, F.array().cast("array<string>")), F.array(geohash)), "/")


def tile_model_path(geohash: Column, lod: Column) -> Column:
    return F.concat(F.lit(TILE_DIR + "/"), sharded_dir(geohash), F.lit("/lod"), lod.cast("string"), F.lit(".glb"))


def subtree_path(geohash: Column) -> Column:
    return F.concat(F.lit(SUBTREE_DIR + "/"), sharded_dir(geohash), F.lit("/tileset.json"))


def fnv1a_hex(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes as hex, kept in two 32-bit halves so that nothing overflows."""
    digits = F.hex(F.encode(text, "UTF-8"))
    start = F.struct(F.lit(FNV_HIGH).cast("bigint").alias("hi"), F.lit(FNV_LOW).cast("bigint").alias("lo"))

    def step(acc: Column, i: Column) -> Column:
        byte = F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
        lo = acc["lo"].bitwiseXOR(byte)
        low = lo * FNV_PRIME_LOW
        high = acc["hi"] * FNV_PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(lo.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(high.bitwiseAND(F.lit(MASK32)).alias("hi"), low.bitwiseAND(F.lit(MASK32)).alias("lo"))

    whole = F.aggregate(
        F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int"))).otherwise(
            F.array().cast("array<int>")), start, step,
        lambda a: F.concat(F.hex(a["hi"]), F.lpad(F.hex(a["lo"]), 8, "0")))
    return F.regexp_replace(F.lower(whole), "^0+(?=.)", "")


def md5_short(text: Column) -> Column:
    """First eight bytes of the MD5 in base 62, least significant digit first."""
    digest = F.md5(F.encode(text, "UTF-8"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    start = F.struct(half(1).alias("hi"), half(9).alias("lo"), F.lit("").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        rest = F.shiftleft(acc["hi"] % 62, 32).bitwiseOR(acc["lo"])
        digit = F.substring(F.lit(BASE62), (rest % 62 + 1).cast("int"), F.lit(1))
        done = (acc["hi"] == 0) & (acc["lo"] == 0)
        return F.struct(
            F.floor(acc["hi"] / 62).cast("bigint").alias("hi"),
            ((rest - rest % 62) / 62).cast("bigint").alias("lo"),
            F.concat(acc["out"], F.when(done, F.lit("")).otherwise(digit)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(11)), start, step, lambda a: a["out"])


def safe_filename(value: Column) -> Column:
    cleaned = F.regexp_replace(F.trim(value), "[^0-9A-Za-z._-]+", "_")
    stripped = F.regexp_replace(cleaned, "^[._]+|[._]+$", "")
    return F.when(F.length(stripped) > 0, stripped).otherwise(F.lit("unknown"))


def canonical_id(value: Column) -> Column:
    """Text of a number read as double: whole values lose their fraction, so the id survives."""
    whole = (value == F.floor(value)) & (F.abs(value) < 9.0e18)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(F.trim(value.cast("string")))


def to_fixed(value: Column, digits: int) -> Column:
    """Rounded half away from zero on the scaled value."""
    scale = float(10**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def plain_number(value: Column, digits: int) -> Column:
    """Fixed rounding, then the shortest decimal text (no trailing zeros, no exponent)."""
    text = F.format_string(f"%.{digits}f", to_fixed(value, digits))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def versioned_uri(url: Column, when: Column, **params: Column) -> Column:
    """``url?v=<yyyyMMddHHmmss>`` followed by the given parameters in order."""
    parts = [url, F.lit("?v="), F.date_format(when, "yyyyMMddHHmmss")]
    for name, value in params.items():
        parts += [F.lit(f"&{name}="), F.coalesce(value.cast("string"), F.lit(""))]
    return F.concat(*parts)


def parse_time(text: Column) -> Column:
    """Local text, ISO text with an offset, seconds (10 digits) or milliseconds (13 digits)."""
    digits = text.rlike(r"^\d+$")
    return F.coalesce(
        F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), text), F.lit("yyyy-MM-dd HH:mm:ss")),
        F.when(text.rlike(r"^\d{4}-\d\d-\d\dT.*(Z|[+-]\d\d:\d\d)$"), text.try_cast("timestamp")),
        F.when(digits & (F.length(text) == 10), F.timestamp_seconds(text.try_cast("bigint"))),
        F.when(digits & (F.length(text) == 13), F.timestamp_millis(text.try_cast("bigint"))),
    )


def loose_double(text: Column, default: float) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(default))


def loose_long(text: Column, default: int) -> Column:
    return F.coalesce(F.trim(text).try_cast("bigint"), F.lit(default).cast("bigint"))


def loose_bool(text: Column, default: bool) -> Column:
    return F.when(text.isNull(), F.lit(default)).otherwise(F.lower(text) == "true")


def storeys(text: Column) -> Column:
    """A usable repeat count; anything missing, non-numeric, infinite or not positive counts as one."""
    n = F.trim(text).try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (n > 0) & (n != F.lit(float("inf"))), n).otherwise(F.lit(1.0))


def feature_id(key: Column, operator: str | None, value: str = "", field: Column | None = None) -> Column:
    if operator == "eq" and field is not None:
        return F.coalesce(field.cast("string"), F.lit(""))
    if operator == "removePrefix":
        return F.concat(F.lit(value), key)
    return key


def route_features(features: DataFrame, layers: DataFrame, id_column: str = "feature_id") -> DataFrame:
    """Attach the layer whose prefix is the part of the id before the dot."""
    return features.withColumn("prefix", F.substring_index(id_column, ".", 1)).join(layers, "prefix", "left")


def lod_mode(model: Column, mode: str, prefixes: Sequence[str] = (), unmatched: str = "") -> Column:
    """Where a level of detail takes its model from."""
    mode = mode.strip().lower()
    if mode == "":
        return F.lit("local")
    if mode != "copy-lod3-by-prefix":
        return F.lit(mode)
    other = unmatched.strip().lower() or "local"
    if other not in ("local", "reuse-lod3", "skip"):
        return F.raise_error(F.lit(f"unsupported unmatched mode {unmatched!r}"))
    name = F.regexp_replace(F.replace(F.trim(model), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    name = F.regexp_replace(F.regexp_replace(name, r"/(\./)+", "/"), "/{2,}", "/")
    out = F.lit(other)
    for p in prefixes:
        clean = p.strip().replace("\\", "/").removeprefix("./")
        if clean:
            out = F.when(name.startswith(clean), F.lit("copy-lod3")).otherwise(out)
    return out


def json_set(document: Column, path: Sequence[str], value: Column) -> Column:
    """Set a text value at a one- or two-step path of a JSON object, keeping every other key.

    Values other than text survive because the members are carried as raw JSON.
    """
    members = F.from_json(F.coalesce(document, F.lit("{}")), "map<string,variant>")
    none = F.parse_json(F.lit("null"))
    if len(path) == 1:
        leaf = F.to_variant_object(F.create_map(F.lit("v"), value))
        member = F.coalesce(F.try_variant_get(leaf, "$.v", "variant"), none)
    else:
        nested = F.coalesce(F.try_variant_get(F.try_element_at(members, F.lit(path[0])), "$", "map<string,variant>"),
                            F.create_map().cast("map<string,variant>"))
        leaf = F.coalesce(F.try_variant_get(F.to_variant_object(F.create_map(F.lit("v"), value)), "$.v", "variant"), none)
        inner = F.map_concat(F.map_filter(nested, lambda k, v: k != path[1]), F.create_map(F.lit(path[1]), leaf))
        member = F.parse_json(F.to_json(inner))
    kept = F.map_filter(members, lambda k, v: k != path[0])
    return F.to_json(F.map_concat(kept, F.create_map(F.lit(path[0]), member)))


def json_image(**fields: Column) -> Column:
    """Row image as a JSON object, missing values kept as null."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def declared_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add configured columns that the table does not have yet, as typed nulls."""
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(spark_type(kind)))
    return df


# Declared column types and their Spark types.
COLUMN_TYPES = {
    "text": "string", "varchar": "string", "string": "string", "int": "int", "integer": "int", "bigint": "bigint",
    "smallint": "smallint", "real": "float", "float": "float", "double": "double", "double precision": "double",
    "numeric": "decimal(38,10)", "decimal": "decimal(38,10)", "bool": "boolean", "boolean": "boolean", "date": "date",
    "timestamp": "timestamp", "timestamptz": "timestamp", "json": "string", "jsonb": "string",
}


def spark_type(kind: str) -> str:
    key = kind.strip().lower()
    if key not in COLUMN_TYPES:
        raise ValueError(f"unsupported column type {kind!r}")
    return COLUMN_TYPES[key]
