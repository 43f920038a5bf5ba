"""Layers stored along the curve: exact answers from a small share of the row groups."""

from __future__ import annotations

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tilewright.functions import cells
from tilewright.functions.predicates import in_bound
from tilewright.sources import clustered as cl

WORLD = (-180.0, -90.0, 180.0, 90.0)


def code_of(spark, lng, lat):
    return spark.range(1).select(cl.curve_code(F.lit(lng), F.lit(lat))).first()[0]


def test_a_cell_is_one_range_of_codes(spark):
    places = [(117.3, 31.2), (-180.0, -90.0), (180.0, 90.0), (0.0, 0.0), (-0.1, 12.5)]
    df = spark.createDataFrame(places, "lng double, lat double")
    df = df.select(cl.curve_code(F.col("lng"), F.col("lat")).alias("code"), *[cells.point_hash(F.col("lng"), F.col("lat"), n).alias(f"h{n}") for n in range(1, 12)])
    for row in df.collect():
        for n in range(1, 12):
            low, high = cl.cell_range(row[f"h{n}"])
            assert low <= row.code <= high and high - low + 1 == 1 << (55 - 5 * n)


@pytest.mark.parametrize("bound", [(117.2, 31.1, 117.5, 31.3), WORLD, (-1.0, -1.0, 1.0, 1.0), (10.0, 10.0, 10.0, 10.0), (179.9, 89.9, 200.0, 95.0)])
@pytest.mark.parametrize("most", [1, 4, 32])
def test_a_cover_holds_the_bound_and_keeps_to_its_number(bound, most):
    ranges = cl.cover(bound, most)
    assert 1 <= len(ranges) <= most and all(a <= b for a, b in ranges)
    assert all(x[1] < y[0] - 1 for x, y in zip(ranges, ranges[1:]))
    rng = random.Random(1)

    def spread(value, bits):
        return int(bin(value)[2:], 4) if value else 0

    for _ in range(300):
        x, y = rng.uniform(bound[0], bound[2]), rng.uniform(bound[1], bound[3])
        code = spread(cl._index(x, -180.0, 360.0, 28), 28) | spread(cl._index(y, -90.0, 180.0, 27), 27) << 1
        assert any(a <= code <= b for a, b in ranges)
    assert cl.cover((1.0, 0.0, 0.0, 1.0)) == []


def test_a_finer_cover_wastes_less():
    size = [sum(b - a + 1 for a, b in cl.cover((117.2, 31.1, 117.5, 31.3), most)) for most in (1, 4, 16, 64)]
    assert size == sorted(size, reverse=True) and size[-1] < size[0] / 10


def boxes(spark):
    rng = random.Random(2)
    rows = []
    for i in range(12000):
        x, y = rng.uniform(117.0, 117.8), rng.uniform(31.0, 31.6)
        side = (0.3 if i % 1000 == 0 else rng.choice([0.0, 1e-7, 1e-4, 0.002])) * rng.random()
        rows.append((i, x, y, x + side, y + side * rng.random()))
    rows += [(9000, None, 31.0, 117.1, 31.1), (9001, float("nan"), 31.0, 117.1, 31.1), (9002, -180.0, -90.0, 180.0, 90.0), (9003, 117.5, 31.3, 117.5, 31.3)]
    return spark.createDataFrame(rows, "id long, w double, s double, e double, n double")


def test_a_bound_meets_the_same_boxes_from_few_row_groups(spark, tmp_path):
    df, path, bound = boxes(spark), str(tmp_path / "layer"), (117.40, 31.20, 117.43, 31.22)
    cl.write_layer(df, path, [F.col(k) for k in "wsen"], files=64)
    meets = (F.col("w") <= bound[2]) & (F.col("e") >= bound[0]) & (F.col("s") <= bound[3]) & (F.col("n") >= bound[1])
    exact = lambda x: sorted(r.id for r in x.where(meets & ~F.isnan("w")).collect())
    near = cl.read_bound(spark, path, bound)
    want = exact(df)
    assert len(want) > 3 and exact(near) == want
    assert spark.read.parquet(path).count() == df.count()
    whole = spark.read.parquet(path).where(cl.TIER + " != -1").count()
    assert cl.read_bound(spark, path, WORLD).count() == whole
    # the statistics of a row group decide whether it is read
    tiers = sorted({r[0] for r in spark.read.parquet(path).select(cl.TIER).distinct().collect()} - {cl.NOWHERE})
    ranges = {t: cl.cover(bound if t == cl.POINT else cl.widened(bound, t)) for t in tiers}
    read = groups = rows = 0
    for file in glob.glob(path + "/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            tier, code = (meta.row_group(g).column(at[c]).statistics for c in (cl.TIER, cl.CODE))
            groups += 1
            if any(tier.min <= t <= tier.max and code.has_min_max and any(code.min <= b and code.max >= a for a, b in ranges[t]) for t in tiers):
                read, rows = read + 1, rows + meta.row_group(g).num_rows
    assert groups >= 60 and read < groups / 3, (read, groups)
    near.write.format("noop").mode("overwrite").save()
    plan = near._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [Or(" in plan.toString()


def test_points_and_cells(spark, tmp_path):
    path = str(tmp_path / "points")
    df = spark.range(3000).select("id", (117.0 + F.col("id") % 71 / 90).alias("lng"), (31.0 + F.col("id") % 53 / 90).alias("lat"))
    cl.write_points(df, path, files=8)
    bound = (117.1, 31.1, 117.3, 31.2)
    for_bound = lambda x: sorted(r.id for r in x.where(in_bound(F.col("lng"), F.col("lat"), bound)).collect())
    assert for_bound(cl.read_bound(spark, path, bound)) == for_bound(df)
    assert cl.read_bound(spark, path, bound).count() < 2 * len(for_bound(df))
    hashes = df.select("id", cells.point_hash(F.col("lng"), F.col("lat"), 5).alias("h"))
    for h in [r.h for r in hashes.select("h").distinct().limit(5).collect()]:
        assert sorted(r.id for r in cl.read_cell(spark, path, h).collect()) == sorted(r.id for r in hashes.where(F.col("h") == h).collect())
    cl.write_points(df.limit(0), str(tmp_path / "none"), files=2)
    assert cl.read_bound(spark, str(tmp_path / "none"), bound).count() == 0
