"""Joins of points and boxes against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tilewright.operators import boxes as bx

QUERIES = entry_module.queries()


def odd_boxes(rng, n):
    """Boxes over each other, in corners of cells, of no size, the wrong way round, with nulls, far off."""
    out = []
    for i in range(n):
        x, y = rng.uniform(-3, 9), rng.uniform(-3, 9)
        out.append((i, x, y, x + rng.random() ** 4 * 3, y + rng.random() ** 4 * 3))
    out += [(n, 1.0, 1.0, 2.0, 2.0), (n + 1, 2.0, 2.0, 2.0, 2.0), (n + 2, 4.0, 4.0, 3.9, 3.9), (n + 3, None, 0.0, 1.0, 1.0), (n + 4, 0.0, 0.0, 1.0, None)]
    return out + [(n + 5, -100.0, -100.0, 100.0, 100.0), (n + 6, 4.0, 4.0, 3.0, 5.0), (None, 0.5, 0.5, 1.5, 1.5), out[0]]


def test_points_meet_all_boxes_around_them(spark):
    rng = random.Random(3)
    boxes = odd_boxes(rng, 60)
    points = [(i, rng.uniform(-4, 10), rng.uniform(-4, 10)) for i in range(120)]
    points += [(200, 0.5, 0.5), (201, 2.5, 1.0), (202, 0.49, 1.0), (203, None, 1.0), (None, 1.0, 1.0), points[0], (0, 5.0, 5.0), (204, 3.95, 3.95)]
    pt, it = spark.createDataFrame(points, "pid int, px double, py double"), spark.createDataFrame(boxes, "bid int, bw double, bs double, be double, bn double")
    text = lambda rows: sorted(str(tuple(r)) for r in rows)
    got = text(bx.around_points(pt, it, 0.5, 1.0).select("pid", "bid").collect())
    want = text((p, b) for p, x, y in points for b, *box in boxes
                if None not in (x, y, *box) and box[0] <= x + 0.5 and box[2] >= x - 0.5 and box[1] <= y + 0.5 and box[3] >= y - 0.5)
    assert got == want


def test_points_of_a_range_search_are_not_multiplied(spark, sf_dir):
    plan = QUERIES["J17_box_range_search"](spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    points = plan.children().head().toString()
    assert "o_orderkey" in points and "Generate" not in points


@pytest.mark.parametrize("few, held", [(0, 0.05), (200_000, 1), (200_000, 100)])
def test_bounds_are_united_as_among_all_pairs(spark, monkeypatch, few, held):
    monkeypatch.setattr(bx, "FEW", few)
    monkeypatch.setattr(bx, "HELD", held)
    rng = random.Random(held)
    boxes = [b[1:] for b in odd_boxes(rng, 150)] + [(x, y, x + 60.0, y + 1.0) for x, y in ((-50.0, 2.0), (3.0, 3.0))]
    queries = []
    for i in range(250):
        x, y, a, b = rng.uniform(-4, 12), rng.uniform(-4, 12), rng.random() * 0.3, rng.random() * 0.3
        queries.append((i, x, y, x + a, y + b))
    queries += [(300, 1.0, 1.0, 1.0, 1.0), (301, 2.0, 2.0, 2.5, 2.0), (302, -200.0, -200.0, 200.0, 200.0), (303, -300.0, 0.0, -299.0, 1.0)]
    queries += [(304, 0.0, 0.0, None, 1.0), (305, None, 0.0, 1.0, 1.0), (None, 1.0, 1.0, 2.0, 2.0), queries[0], (1, 8.0, 8.0, 8.5, 8.5), (306, 5.0, 5.0, 4.0, 4.0)]
    q = spark.createDataFrame(queries, "id int, w double, s double, e double, n double")
    got = sorted(str(tuple(r)) for r in bx.combined_bounds(q, spark.createDataFrame(boxes, "w double, s double, e double, n double"), "id", 1.0).collect())

    def met(k):
        return [b for i, w, s, e, n in queries if i == k is not None and None not in (w, s, e, n)
                for b in boxes if None not in b and b[0] <= e and b[2] >= w and b[1] <= n and b[3] >= s]

    want = sorted(str((k, *(f(x) for f, x in zip((min, min, max, max), zip(*m))))) if (m := met(k)) else str((k, *own)) for k, *own in queries)
    assert got == want


def test_bounds_over_each_other_are_not_met_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(bx, "HELD", 1)
    at = lambda k, width: F.rand(k) * width
    boxes = spark.range(4000).select(at(1, 4).alias("bw"), at(2, 4).alias("bs"), at(5, 1).alias("side")).selectExpr("bw", "bs", "bw + side AS be", "bs + side AS bn")
    queries = spark.range(8000).select("id", at(3, 4).alias("w"), at(4, 4).alias("s")).selectExpr("*", "w + 0.1 AS e", "s + 0.1 AS n")
    boxes, queries = boxes.localCheckpoint(), queries.localCheckpoint()
    assert bx._reached(queries, boxes, "id", 0.5).count() < bx.overlapping(queries, boxes, 0.5).count() / 4
