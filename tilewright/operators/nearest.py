"""Exact nearest-item joins on a grid, without an index and without pairing everything."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators.boxes import grid_cells
from tilewright.session import checkpoint

# Groups of items narrow by this factor per step.
FAN = 8


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Distance of a point to a segment and the share along the segment of the closest point."""
    dx, dy = x2 - x1, y2 - y1
    den = dx * dx + dy * dy
    t = F.when(den == 0, F.lit(0.0)).otherwise(((px - x1) * dx + (py - y1) * dy) / F.when(den == 0, F.lit(1.0)).otherwise(den))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey), t


def box_gap2(w: Column, s: Column, e: Column, n: Column, bw: Column, bs: Column, be: Column, bn: Column) -> Column:
    """Squared gap between two boxes, zero when they meet."""
    gx = F.greatest(bw - e, w - be, F.lit(0.0))
    gy = F.greatest(bs - n, s - bn, F.lit(0.0))
    return gx * gx + gy * gy


def nearest(
    points: DataFrame, items: DataFrame, point_key: str, distance: Column, order: Sequence[str], carry: Sequence[str], size: float,
    k: int = 1, on: Sequence[str] = (),
) -> DataFrame:
    """The ``k`` nearest items of every point (px, py), ties broken by ``order``; exact.

    Items carry their box (bw, bs, be, bn). In each round the items are spread over the grid cells
    within one cell size of them, so a point looks only into its own cell, and any item closer than
    the cell size is seen there. Points whose answer lies within the cell size are finished; only
    the others go on, with cells eight times as large. From the second round on a point first meets
    groups of items, from one box per eighth of a cell downwards, and opens only groups that can still
    beat the best guaranteed distance, so a far cluster is never compared item by item. For
    ``k = 1`` the winner is a map-side combined minimum, so candidates are never collected.
    ``distance`` must not be smaller than the distance to the item's box.
    """
    left, cell, done = points, size, []
    total = None
    extent = items.agg(F.min("bw"), F.min("bs"), F.max("be"), F.max("bn"), F.count("*")).first()
    reach = points.agg(F.min("px"), F.min("py"), F.max("px"), F.max("py")).first()
    if extent[4] == 0 or reach[0] is None:
        none = points.select(point_key).limit(0).join(items.select(*carry).limit(0), F.lit(True))
        return none.withColumns({"distance": F.lit(0.0), "rank": F.lit(1)})
    whole = max(extent[2], reach[2]) - min(extent[0], reach[0]) + max(extent[3], reach[3]) - min(extent[1], reach[1])
    while True:
        last = cell >= whole
        probe = left.withColumns({"_gx": F.floor(F.col("px") / cell), "_gy": F.floor(F.col("py") / cell)})
        if cell == size:
            pairs = _meet(probe, items, cell, on)
        else:
            steps = max(1, math.ceil(math.log(cell / size, FAN)))
            pairs = _descend(probe, items, point_key, cell, steps, k, on)
        pairs = pairs.select(point_key, distance.alias("distance"), *carry)
        if k == 1:
            best = pairs.groupBy(point_key).agg(F.min_by(F.struct("distance", *carry), F.struct("distance", *order)).alias("_b")).select(
                point_key, "_b.*", F.lit(1).alias("rank"))
            found = best if last else best.where(F.col("distance") <= cell)
        else:
            w = Window.partitionBy(point_key).orderBy("distance", *order)
            best = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            enough = best.groupBy(point_key).agg(F.count("*").alias("_n"), F.max("distance").alias("_far")).where(
                (F.col("_n") >= k) & (F.col("_far") <= cell)).select(point_key)
            found = best if last else best.hint("merge").join(enough, point_key, "left_semi")
        found = checkpoint(found)
        done.append(found)
        if last:
            break
        left = left.hint("merge").join(found.select(point_key).distinct(), point_key, "left_anti")
        left = checkpoint(left)
        if left.isEmpty():
            break
        cell *= FAN
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _meet(probe: DataFrame, items: DataFrame, cell: float, on: Sequence[str]) -> DataFrame:
    """Points (with their cell) beside every item within one cell of them."""
    spread = items.withColumn("_c", F.explode(grid_cells(F.col("bw") - cell, F.col("bs") - cell, F.col("be") + cell, F.col("bn") + cell, cell)))
    test = (F.col("_c.gx") == F.col("_gx")) & (F.col("_c.gy") == F.col("_gy"))
    for c in on:
        test = test & (probe[c] == spread[c])
    return probe.hint("merge").join(spread, test).drop("_c", *[spread[c] for c in on])


def _open(seen: DataFrame, point_key: str, k: int) -> DataFrame:
    """Keep the groups of a point that can still hold one of its ``k`` nearest items."""
    low = F.hypot(F.greatest(F.col("bw") - F.col("px"), F.col("px") - F.col("be"), F.lit(0.0)), F.greatest(F.col("bs") - F.col("py"), F.col("py") - F.col("bn"), F.lit(0.0)))
    high = F.hypot(F.greatest(F.abs(F.col("px") - F.col("bw")), F.abs(F.col("px") - F.col("be"))), F.greatest(F.abs(F.col("py") - F.col("bs")), F.abs(F.col("py") - F.col("bn"))))
    seen = seen.withColumns({"_low": low, "_high": high}).drop("bw", "bs", "be", "bn")
    if k == 1:
        limit = seen.groupBy(point_key).agg(F.min("_high").alias("_limit"))
    else:
        rank = F.row_number().over(Window.partitionBy(point_key).orderBy("_high"))
        limit = seen.withColumn("_r", rank).where(F.col("_r") == k).select(point_key, F.col("_high").alias("_limit"))
    kept = seen.hint("merge").join(limit, point_key, "left").where(F.col("_limit").isNull() | (F.col("_low") <= F.col("_limit") + 1e-9))
    return kept.drop("_low", "_high", "_limit")


def _descend(probe: DataFrame, items: DataFrame, point_key: str, cell: float, steps: int, k: int, on: Sequence[str]) -> DataFrame:
    """Points beside the items of the groups left open after narrowing from large groups to small ones."""
    finest = cell / FAN**steps
    keyed = items.withColumns({"_fx": F.floor((F.col("bw") + F.col("be")) / 2 / finest), "_fy": F.floor((F.col("bs") + F.col("bn")) / 2 / finest)})
    up = lambda c, n: F.floor(F.col(c) / FAN**n)

    def groups(n: int) -> DataFrame:
        return keyed.groupBy(up("_fx", n).alias("_nx"), up("_fy", n).alias("_ny"), *on).agg(
            F.min("bw").alias("bw"), F.min("bs").alias("bs"), F.max("be").alias("be"), F.max("bn").alias("bn"))

    opened = checkpoint(_open(_meet(probe, groups(steps - 1), cell, on), point_key, k))
    for n in range(steps - 2, -1, -1):
        kids = groups(n).withColumns({"_px": up("_nx", 1), "_py": up("_ny", 1)}).withColumnsRenamed({"_nx": "_kx", "_ny": "_ky"})
        test = (opened["_nx"] == kids["_px"]) & (opened["_ny"] == kids["_py"])
        for c in on:
            test = test & (opened[c] == kids[c])
        met = opened.hint("merge").join(kids, test).drop("_nx", "_ny", "_px", "_py", *[kids[c] for c in on]).withColumnsRenamed({"_kx": "_nx", "_ky": "_ny"})
        opened = checkpoint(_open(met, point_key, k))
    test = (opened["_nx"] == keyed["_fx"]) & (opened["_ny"] == keyed["_fy"])
    for c in on:
        test = test & (opened[c] == keyed[c])
    return opened.hint("merge").join(keyed, test).drop(*[keyed[c] for c in on])


def within(points: DataFrame, items: DataFrame, distance: Column, reach: float, on: Sequence[str] = (), size: float | None = None) -> DataFrame:
    """Pairs of points and items closer than ``reach``, met in the point's own grid cell, whose ``size`` does not change them."""
    size = size or reach * 4
    spread = items.withColumn("_c", F.explode(grid_cells(F.col("bw") - reach, F.col("bs") - reach, F.col("be") + reach, F.col("bn") + reach, size)))
    probe = points.withColumns({"_gx": F.floor(F.col("px") / size), "_gy": F.floor(F.col("py") / size)})
    test = (F.col("_c.gx") == F.col("_gx")) & (F.col("_c.gy") == F.col("_gy"))
    for c in on:
        test = test & (probe[c] == spread[c])
    joined = probe.hint("merge").join(spread, test)
    for c in on:
        joined = joined.drop(spread[c])
    return joined.withColumn("distance", distance).where(F.col("distance") <= reach).drop("_c", "_gx", "_gy")


def segment_items(segments: DataFrame) -> DataFrame:
    return segments.withColumns({"bw": F.least("x1", "x2"), "be": F.greatest("x1", "x2"), "bs": F.least("y1", "y2"), "bn": F.greatest("y1", "y2")})


def locate_on_lines(points: DataFrame, stationed: DataFrame, point_key: str, size: float, on: Sequence[str] = ()) -> DataFrame:
    """Nearest segment of every point with station and signed lateral offset (left positive)."""
    items = segment_items(stationed)
    d, t = segment_distance(F.col("px"), F.col("py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    best = nearest(points, items, point_key, d, ["line_id", "i"], ["line_id", "i", "x1", "y1", "x2", "y2", "z1", "z2", "s0", "s1", "total"], size, on=on)
    rows = best.hint("merge").join(points.select(point_key, "px", "py"), point_key)
    _, t = segment_distance(F.col("px"), F.col("py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    rows = rows.withColumn("t", t)
    side = (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("px") - F.col("x1"))
    return rows.withColumns({"station": F.col("s0") + F.col("t") * (F.col("s1") - F.col("s0")),
                             "offset": F.when(side < 0, -F.col("distance")).otherwise(F.col("distance"))})
