"""Spatial feature tables derived from the given relational tables.

Each table is a list of select expressions over a base table. The expressions are plain SQL
that Spark and the checking engine read alike; where they differ (row generators) an entry is
a function of the dialect.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tilewright.session import tasks_for

Expr = str | Callable[[str], str]
# The working bound west, south, east, north of the derived features.
BOUND = (117.0, 31.0, 117.8, 31.6)
#: Base rows for each task that multiplies them.
DEALT = 4096


def _text(e: Expr, dialect: str) -> str:
    return e(dialect) if callable(e) else e


@dataclass(frozen=True)
class Derived:
    base: "str | Derived"
    exprs: tuple[Expr, ...]
    where: Expr | None = None
    #: The base column by which rows are dealt to tasks before they are multiplied.
    deal: str | None = None

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if isinstance(self.base, Derived):
            df = self.base.frame(spark, sf_dir)
        else:
            df = spark.read.parquet(f"{sf_dir}/{self.base}.parquet")
        if self.where is not None:
            df = df.where(_text(self.where, "spark"))
        if self.deal is None:
            return df.selectExpr(*[_text(e, "spark") for e in self.exprs])
        # a small file is one task, however many rows are made of it
        return df.repartition(tasks_for(spark, df.count(), DEALT), self.deal).selectExpr(*[_text(e, "spark") for e in self.exprs])

    def sql(self) -> str:
        base = f"({self.base.sql()})" if isinstance(self.base, Derived) else self.base
        where = f" WHERE {_text(self.where, 'duck')}" if self.where is not None else ""
        return f"SELECT {', '.join(_text(e, 'duck') for e in self.exprs)} FROM {base}{where}"


def idiv(a: str, b: int) -> str:
    return f"CAST(floor(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE)) AS BIGINT)"


def dbl(v: float | str) -> str:
    return f"CAST({v} AS DOUBLE)"


def seq(low: int | str, high: int | str, name: str) -> Expr:
    def gen(dialect: str) -> str:
        if dialect == "spark":
            return f"explode(sequence(CAST({low} AS BIGINT), CAST({high} AS BIGINT))) AS {name}"
        return f"unnest(generate_series(CAST({low} AS BIGINT), CAST({high} AS BIGINT))) AS {name}"

    return gen


def frac(value: str, mult: int, mod: int) -> str:
    return f"(CAST(({value} * {mult}) % {mod} AS DOUBLE) / CAST({mod} AS DOUBLE))"


# one point feature per order
POINTS = Derived("orders", (
    "o_orderkey AS id",
    "'hd_orders' AS table_name",
    f"{dbl(117)} + {frac('o_orderkey', 7919, 20011)} * {dbl(0.8)} AS lng",
    f"{dbl(31)} + {frac('o_orderkey', 104729, 30011)} * {dbl(0.6)} AS lat",
    "CAST(o_orderkey % 50 AS DOUBLE) AS alt",
    "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat('m', CAST(o_custkey % 12 AS VARCHAR(20)),"
    " CASE WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.glb' END) END AS model",
    "CAST(o_orderkey % 360 AS DOUBLE) AS obj_angle",
    "CAST(o_orderdate AS TIMESTAMP) AS update_time",
    "o_orderpriority AS category",
))

# one point per line item, squeezed towards one corner so that a few cells are hot
HOT_POINTS = Derived(
    Derived("lineitem", (
        "l_orderkey * 8 + l_linenumber AS id", "l_suppkey AS supp", "CAST(l_shipdate AS TIMESTAMP) AS update_time",
        f"{frac('(l_orderkey * 8 + l_linenumber)', 7919, 20011)} AS fx",
        f"{frac('(l_orderkey * 8 + l_linenumber)', 104729, 30011)} AS fy",
    )),
    (
        "id", "'hd_lineitem' AS table_name",
        f"{dbl(117)} + fx * fx * {dbl(0.8)} AS lng",
        f"{dbl(31)} + fy * fy * {dbl(0.6)} AS lat",
        "CAST(id % 50 AS DOUBLE) AS alt",
        "concat('m', CAST(supp % 12 AS VARCHAR(20)), CASE WHEN id % 7 = 0 THEN '.txt' ELSE '.glb' END) AS model",
        "CAST(id % 360 AS DOUBLE) AS obj_angle", "update_time",
    ),
)

# two edits per edited feature; a quarter of them for each kind of feature
EDITS = Derived("events", (
    "event_id", f"{idiv('event_id', 2)} AS id",
    "CASE WHEN event_type = 'error' THEN '1' WHEN event_type = 'click' THEN NULL ELSE '0' END AS del_flag",
    "CAST(ts AS TIMESTAMP) AS update_time",
    "CASE (user_id % 4) WHEN 0 THEN 'hdSign' WHEN 1 THEN 'hdPole' WHEN 2 THEN 'hdGantry' ELSE 'hdDevice' END AS kind",
    "'hd_orders' AS feature_table",
    "props AS service_data", "value",
))

# 21 ordered vertices per supplier line, metres
LINE_VERTICES = Derived(
    Derived("supplier", ("s_suppkey AS line_id", seq(0, 20, "i")), deal="s_suppkey"),
    (
        "line_id", "i",
        f"CAST(line_id % 100 AS DOUBLE) * {dbl(50)} + CAST(i AS DOUBLE) * {dbl(12.5)} AS x",
        f"CAST({idiv('line_id', 100)} AS DOUBLE) * {dbl(200)} + CAST(i % 3 AS DOUBLE) * {dbl(2)}"
        f" + CAST(line_id % 7 AS DOUBLE) AS y",
        f"CAST((i * (line_id % 5)) % 11 AS DOUBLE) * {dbl(0.1)} AS z",
    ),
)

# the same vertices in degrees, inside the bound
GEO_LINE_VERTICES = Derived(LINE_VERTICES, (
    "line_id", "i",
    f"{dbl(117.1)} + x * {dbl(0.0001)} AS lng",
    f"{dbl(31.1)} + y * {dbl(0.0001)} AS lat",
    "z",
))

# road surface: two triangles per segment of each supplier line, 6 m wide, in metres
TRIANGLES = Derived(
    Derived(
        Derived("supplier", ("s_suppkey AS road_id", seq(0, 19, "i")), deal="s_suppkey"),
        (
            "road_id", "i", seq(0, 1, "half"),
            f"CAST(road_id % 100 AS DOUBLE) * {dbl(50)} + CAST(i AS DOUBLE) * {dbl(12.5)} AS sx",
            f"CAST({idiv('road_id', 100)} AS DOUBLE) * {dbl(200)} + CAST(i % 3 AS DOUBLE) * {dbl(2)} + CAST(road_id % 7 AS DOUBLE) AS sy0",
            f"CAST({idiv('road_id', 100)} AS DOUBLE) * {dbl(200)} + CAST((i + 1) % 3 AS DOUBLE) * {dbl(2)} + CAST(road_id % 7 AS DOUBLE) AS sy1",
            f"{dbl(10)} + CAST(i % 4 AS DOUBLE) * {dbl(0.25)} AS sz0",
            f"{dbl(10)} + CAST((i + 1) % 4 AS DOUBLE) * {dbl(0.25)} AS sz1",
        ),
    ),
    (
        "road_id", "i * 2 + half AS tri_id",
        "sx AS x1", f"sy0 - {dbl(3)} AS y1", "sz0 AS z1",
        f"sx + {dbl(12.5)} AS x2",
        f"CASE WHEN half = 0 THEN sy1 - {dbl(3)} ELSE sy1 + {dbl(3)} END AS y2", "sz1 AS z2",
        f"CASE WHEN half = 0 THEN sx + {dbl(12.5)} ELSE sx END AS x3",
        f"CASE WHEN half = 0 THEN sy1 + {dbl(3)} ELSE sy0 + {dbl(3)} END AS y3",
        "CASE WHEN half = 0 THEN sz1 ELSE sz0 END AS z3",
    ),
)

# one quadrilateral per part: south-west corner, side in degrees, skew
POLYGONS = Derived(
    Derived("part", (
        "p_partkey AS id", "p_brand AS brand", "p_type AS kind", "p_size AS size", "p_retailprice AS price",
        f"{dbl(117)} + {frac('p_partkey', 7919, 20011)} * {dbl(0.8)} AS x0",
        f"{dbl(31)} + {frac('p_partkey', 104729, 30011)} * {dbl(0.6)} AS y0",
        f"CAST(p_size AS DOUBLE) * {dbl(0.0004)} AS side",
        f"CAST(p_partkey % 3 AS DOUBLE) * CAST(p_size AS DOUBLE) * {dbl(0.0001)} AS skew",
    ), deal="p_partkey"),
    (
        "id", "brand", "kind", "size", "price",
        "x0 AS px0", "y0 AS py0", "x0 + side AS px1", "y0 + skew AS py1",
        "x0 + side + skew AS px2", "y0 + side + skew AS py2", "x0 + skew AS px3", "y0 + side AS py3",
        "CAST(id % 40 AS DOUBLE) AS base_z",
    ),
)

# searchable layer
LAYER = Derived("customer", (
    "c_custkey AS id", "c_name AS name", "c_mktsegment AS segment", "CAST(c_nationkey AS BIGINT) AS nation",
    "c_acctbal AS balance",
    f"{dbl(117)} + {frac('c_custkey', 7919, 20011)} * {dbl(0.8)} AS lng",
    f"{dbl(31)} + {frac('c_custkey', 104729, 30011)} * {dbl(0.6)} AS lat",
    "CAST(c_custkey % 30 AS DOUBLE) AS alt",
    "concat('{\"grade\":\"', c_mktsegment, '\",\"owner\":{\"nation\":\"', CAST(c_nationkey AS VARCHAR(20)), '\"}}') AS props",
    "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'none' ELSE concat('s', CAST(c_custkey % 5 AS VARCHAR(20))) END AS status",
))

# model assets with gaps: three of four levels of detail exist
ASSETS = Derived(
    Derived("part", ("p_partkey", "p_size", "p_brand", seq(0, 3, "lod")), deal="p_partkey"),
    (
        "CASE WHEN p_partkey % 2 = 0 THEN 'hd_orders' ELSE 'hd_lineitem' END AS table_name",
        "concat('m', CAST(p_partkey AS VARCHAR(20)), '.glb') AS model", "lod",
        "CASE WHEN (p_partkey + lod) % 5 < 3 THEN 'local' ELSE 'remote' END AS store",
        "concat('body-', CAST(p_size AS VARCHAR(20)), '-', p_brand) AS content",
        "CAST(p_size * (lod + 1) * 100 AS BIGINT) AS bytes",
        "p_partkey * 4 + lod AS ord",
    ),
    where="(p_partkey + lod) % 4 <> 3",
)

# control points: four per supplier group, moved by a rotation about the vertical and a shift
CONTROL_POINTS = Derived(
    Derived("supplier", ("s_suppkey AS grp", seq(0, 3, "k")), deal="s_suppkey"),
    (
        "grp", "k",
        "CAST((k * 37 + grp % 11) % 23 AS DOUBLE) AS mx", "CAST((k * 53 + grp % 7) % 19 AS DOUBLE) AS my",
        "CAST((k * k * 5 + grp % 5) % 13 AS DOUBLE) AS mz",
        f"CAST(grp % 90 AS DOUBLE) * {dbl(0.01)} AS theta",
        f"CAST(grp % 13 AS DOUBLE) * {dbl(1.5)} AS tx", f"CAST(grp % 17 AS DOUBLE) * {dbl(-0.5)} AS ty",
        f"CAST(grp % 3 AS DOUBLE) * {dbl(2)} AS tz",
    ),
)

# model vertices: eight shell points and some interior points per part model
MODEL_VERTICES = Derived(
    Derived("part", ("p_partkey AS model_id", "p_size AS size", seq(0, 63, "k")), deal="p_partkey"),
    (
        "model_id", "k AS ord",
        f"CAST((k * 13 + model_id) % 17 AS DOUBLE) / {dbl(16)} * CAST(1 + size % 9 AS DOUBLE) AS x",
        f"CAST((k * 7 + model_id * 3) % 11 AS DOUBLE) / {dbl(10)} * CAST(1 + model_id % 4 AS DOUBLE) AS y",
        f"CAST((k * 5 + model_id) % 29 AS DOUBLE) / {dbl(28)} * CAST(1 + size % 5 AS DOUBLE) * {dbl(0.5)} AS z",
    ),
)
