"""Keyword search, detail and audited updates over configured layers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.predicates import key_filter, keyword_filter
from tilewright.functions.text import declared_columns, json_image, json_set

# Paging limits and the padding of a geometry's envelope in degrees.
PAGE_SIZE, MAX_PAGE_SIZE = 50, 500
ENVELOPE_PAD = 0.000001
NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


@dataclass(frozen=True)
class FieldSpec:
    """A configured field: where its value lives and what it may be used for."""

    name: str
    storage: str = "column"  # column, json or geom
    column: str | None = None
    path: tuple[str, ...] = ()
    z_column: str | None = None
    listed: bool = True
    detailed: bool = True
    searchable: bool = False
    submit: bool = False
    auto_create: str | None = None

    def value(self) -> Column:
        column = self.column or self.name
        if self.storage in ("", "column", "text", "varchar", "string"):
            return F.col(column)
        if self.storage == "json":
            for part in self.path:
                if not NAME.match(part):
                    raise ValueError(f"invalid JSON path component {part!r}")
            return F.get_json_object(F.col(column), "$." + ".".join(self.path))
        if self.storage == "geom":
            return envelope_text(F.col("lng"), F.col("lat"), F.col("lng"), F.col("lat"), F.col(self.z_column or "alt"))
        raise ValueError(f"unsupported storage type {self.storage!r}")


def envelope_text(west: Column, south: Column, east: Column, north: Column, z: Column) -> Column:
    """Padded envelope as three-dimensional polygon text."""
    w, s, e, n = west - ENVELOPE_PAD, south - ENVELOPE_PAD, east + ENVELOPE_PAD, north + ENVELOPE_PAD
    corner = "%.7f %.7f %.3f"
    return F.format_string("POLYGON Z ((" + ",".join([corner] * 5) + "))", w, s, z, w, n, z, e, n, z, e, s, z, w, s, z)


def ready(df: DataFrame, fields: Sequence[FieldSpec]) -> DataFrame:
    return declared_columns(df, {f.column or f.name: f.auto_create for f in fields if f.auto_create})


def project(df: DataFrame, fields: Sequence[FieldSpec]) -> DataFrame:
    return df.select(*[f.value().alias(f.name) for f in fields])


def page_window(page: int, size: int) -> tuple[int, int]:
    page = max(page, 1)
    size = PAGE_SIZE if size < 1 else min(size, MAX_PAGE_SIZE)
    return (page - 1) * size, size


def search(df: DataFrame, fields: Sequence[FieldSpec], keyword: str, page: int, size: int, primary_key: str = "id") -> tuple[DataFrame, DataFrame]:
    """One page of matches in key order, and the one-row total of all matches."""
    df = ready(df, fields)
    hits = df.where(keyword_filter([f.value() for f in fields if f.searchable], keyword))
    offset, limit = page_window(page, size)
    rows = project(hits.orderBy(primary_key).offset(offset).limit(limit), [f for f in fields if f.listed])
    return rows, hits.agg(F.count("*").alias("total"))


def detail(df: DataFrame, fields: Sequence[FieldSpec], key: str, primary_key: str = "id") -> DataFrame:
    shown = [f for f in fields if f.listed or f.detailed]
    return project(ready(df, shown).where(key_filter([F.col(primary_key)], key)).limit(1), shown)


def last_changes(changes: DataFrame, names: Sequence[str], order: str | None, submitted: str | None) -> DataFrame:
    """One row per record_key: for every field whether it was submitted (``_set_``) and the value submitted last (``_new_``).

    A field counts as submitted where it isn't null, or where the array ``submitted`` names it, which is
    how a null is submitted. Later means a larger ``order``; equal orders go to the larger value.
    """
    said = {n: F.col(n).isNotNull() | (F.coalesce(F.array_contains(submitted, n), F.lit(False)) if submitted else F.lit(False)) for n in names}
    place = F.col(order) if order else F.lit(0)
    picks = [F.max(F.when(said[n], F.struct(place.alias("o"), F.col(n).alias("v")))).alias(n) for n in names]
    return changes.groupBy("record_key").agg(*picks).select(
        "record_key", *[F.col(n).isNotNull().alias(f"_set_{n}") for n in names], *[F.col(f"{n}.v").alias(f"_new_{n}") for n in names])


def update(
    df: DataFrame, fields: Sequence[FieldSpec], changes: DataFrame, tileset: str, source: str, table: str, primary_key: str = "id",
    order: str | None = None, submitted: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply change rows (record_key, one text column per submitted field): snapshot, audit, unknown keys.

    Several changes of one key are reduced to the last value of each field, by the column ``order`` of
    the changes. Null means "not submitted" unless the array column ``submitted`` names the field. A key
    whose changes submit nothing stays as it is and is not audited. Columns the caller may not submit
    are refused.
    """
    allowed = {f.name: f for f in fields if f.submit and f.name != primary_key}
    names = sorted(c for c in changes.columns if c not in ("record_key", order, submitted))
    wrong = [n for n in names if n not in allowed]
    if wrong:
        raise ValueError(f"fields {wrong} are not allowed to submit")
    if not names:
        raise ValueError("no fields to update")
    df = ready(df, fields)
    side = last_changes(changes, names, order, submitted)
    key = F.coalesce(F.col(primary_key).cast("string"), F.lit(""))
    some = reduce(lambda a, b: a | b, [F.col(f"_set_{n}") for n in names])
    joined = df.withColumn("record_key", key).join(side, "record_key", "left").withColumn("_hit", F.coalesce(some, F.lit(False)))
    before = {n: allowed[n].value() for n in names}
    after: dict[str, Column] = {}
    for n in names:
        f, new = allowed[n], F.col(f"_new_{n}")
        column = f.column or f.name
        base = after.get(column, F.col(column))
        value = json_set(base, f.path, new) if f.storage == "json" else new.cast(df.schema[column].dataType)
        after[column] = F.when(F.col("_hit") & F.col(f"_set_{n}"), value).otherwise(base)
    marked = joined.withColumn("_old", json_image(**before))
    snapshot_rows = marked.withColumns(after)
    audit = snapshot_rows.where("_hit").select(
        F.lit(tileset).alias("tileset_key"), F.lit(source).alias("source_id"), F.lit(table).alias("table_name"), "record_key",
        F.col("_old").alias("old_values"), json_image(**{n: allowed[n].value() for n in names}).alias("new_values"))
    missing = side.select("record_key").join(joined.select("record_key"), "record_key", "left_anti")
    return snapshot_rows.select(*df.columns), audit, missing


def save_registration(df: DataFrame, transforms: DataFrame, column: str = "metadata", primary_key: str = "id", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Store 16-value transforms under ``transform`` of each JSON document; other keys stay, non-objects start empty.

    Of several transforms of one key the last by the column ``order`` counts, the largest without one.
    """
    place = F.col(order) if order else F.lit(0)
    transforms = transforms.groupBy("record_key").agg(F.max(F.struct(place.alias("o"), "matrix")).alias("m")).select("record_key", "m.matrix")
    keyed = F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.concat(
        F.lit('"'), k.cast("string"), F.lit('":'), F.element_at("matrix", k + 1).cast("string"))), ","), F.lit("}"))
    side = transforms.select(F.col("record_key"), keyed.alias("_keyed"))
    joined = df.withColumn("record_key", F.col(primary_key).cast("string")).join(side, "record_key", "left")
    is_object = F.coalesce(F.trim(F.col(column)).startswith("{"), F.lit(False))
    members = F.from_json(F.when(is_object, F.col(column)).otherwise(F.lit("{}")), "map<string,variant>")
    kept = F.map_filter(members, lambda k, v: k != "transform")
    merged = F.to_json(F.map_concat(kept, F.create_map(F.lit("transform"), F.parse_json(F.col("_keyed")))))
    out = joined.withColumn(column, F.when(F.col("_keyed").isNotNull(), merged).otherwise(F.col(column)))
    missing = side.select("record_key").join(joined.select("record_key"), "record_key", "left_anti")
    return out.select(*df.columns), missing
