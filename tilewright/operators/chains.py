"""Linking line parts end to start, chain offsets, and posts along chains."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import lines
from tilewright.session import checkpoint

# Tolerances of a link.
XY_TOLERANCE, Z_TOLERANCE, MAX_TURN = 0.05, 0.05, 60.0


def part_ends(stationed: DataFrame, key: str = "part_id", order: str = "i") -> DataFrame:
    """Start, end, directions there and length of each part, along its stored order.

    Vertical moves have no direction: the first and last moves with a plan length give the directions,
    while the heights are those of the very ends.
    """
    flat = F.col("length") > 0
    towards = F.struct(((F.col("x2") - F.col("x1")) / F.nullif("length", F.lit(0.0))).alias("dx"), ((F.col("y2") - F.col("y1")) / F.nullif("length", F.lit(0.0))).alias("dy"))
    at = F.when(flat, F.col(order))
    ends = stationed.groupBy(key).agg(
        F.min_by(F.struct("x1", "y1", "z1"), order).alias("a"), F.max_by(F.struct("x2", "y2", "z2"), order).alias("b"),
        F.min_by(towards, at).alias("u"), F.max_by(towards, at).alias("v"), F.max("total").alias("length"))
    return ends.select(
        key, "length", F.col("a.x1").alias("sx"), F.col("a.y1").alias("sy"), F.col("a.z1").alias("sz"), F.col("u.dx").alias("sdx"), F.col("u.dy").alias("sdy"),
        F.col("b.x2").alias("ex"), F.col("b.y2").alias("ey"), F.col("b.z2").alias("ez"), F.col("v.dx").alias("edx"), F.col("v.dy").alias("edy"))


def logical_ends(ends: DataFrame, reverse: str = "reverse") -> DataFrame:
    """Swap ends and turn directions of parts that run against their stored order."""
    pick = lambda a, b, s=1: F.when(F.col(reverse), F.col(b) * s).otherwise(F.col(a))
    swapped = {"sx": pick("sx", "ex"), "sy": pick("sy", "ey"), "sz": pick("sz", "ez"), "ex": pick("ex", "sx"), "ey": pick("ey", "sy"), "ez": pick("ez", "sz"),
               "sdx": pick("sdx", "edx", -1), "sdy": pick("sdy", "edy", -1), "edx": pick("edx", "sdx", -1), "edy": pick("edy", "sdy", -1)}
    closed = (F.col("sx") == F.col("ex")) & (F.col("sy") == F.col("ey")) & (F.col("sz") == F.col("ez"))
    return ends.withColumns({**swapped, "closed": closed})


def links(parts: DataFrame, key: str = "part_id", group: str = "grp") -> DataFrame:
    """(key, next) for ends that meet exactly one start which meets exactly one end.

    A closed part meets itself and nothing else. Open parts are met by place: equal ends, and equal
    starts, are one row with their number, so a pile of parts costs one row and is still counted in
    full. A part whose own start lies within reach of its own end is no partner of itself.
    """
    closed = parts.where("closed").select(key, F.col(key).alias("next"))
    opened = checkpoint(parts.where("not closed").select(
        key, F.struct(F.col(group).alias("g"), *[F.col(c).alias(c[1:]) for c in ("ex", "ey", "ez", "edx", "edy")]).alias("end"),
        F.struct(F.col(group).alias("g"), *[F.col(c).alias(c[1:]) for c in ("sx", "sy", "sz", "sdx", "sdy")]).alias("start")))
    cell = lambda c: F.floor(c / XY_TOLERANCE)
    around = F.sequence(F.lit(-1), F.lit(1))
    ends = opened.groupBy("end").agg(F.count("*").alias("n_ends")).withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumns(
        {"_g": F.col("end.g"), "_cx": cell(F.col("end.x")) + F.col("_dx"), "_cy": cell(F.col("end.y")) + F.col("_dy")})
    starts = opened.groupBy("start").agg(F.count("*").alias("n_starts"), F.min(key).alias("low"), F.max(key).alias("high")).withColumns(
        {"_g": F.col("start.g"), "_cx": cell(F.col("start.x")), "_cy": cell(F.col("start.y"))})
    e, s = F.col("end"), F.col("start")
    near = F.hypot(e["x"] - s["x"], e["y"] - s["y"]) <= XY_TOLERANCE
    level = F.abs(e["z"] - s["z"]) <= Z_TOLERANCE
    straight = e["dx"] * s["dx"] + e["dy"] * s["dy"] >= math.cos(math.radians(MAX_TURN)) - 1e-7
    met = checkpoint(ends.join(starts, ["_g", "_cx", "_cy"]).where(near & level & straight).select("end", "n_ends", "start", "n_starts", "low", "high"))
    out = met.groupBy("end").agg(F.sum("n_starts").alias("n_out"), F.min("low").alias("low"), F.max("high").alias("high"))
    into = met.groupBy("start").agg(F.sum("n_ends").alias("n_in"))
    own = opened.join(met.select("end", "start"), ["end", "start"], "left_semi").select(key, F.lit(1).alias("own"))
    counted = checkpoint(opened.join(own, key, "left").withColumn("own", F.coalesce("own", F.lit(0))))
    other = F.when((F.col("own") == 1) & (F.col("low") == F.col(key)), F.col("high")).otherwise(F.col("low"))
    leaving = counted.join(out, "end").where("n_out - own = 1").select(key, other.alias("next"))
    arriving = counted.join(into, "start").where("n_in - own = 1").select(F.col(key).alias("next"))
    return closed.unionByName(leaving.join(arriving, "next", "left_semi").select(key, "next"))


def _ranked(parts: DataFrame, back: DataFrame, key: str, limit: int) -> DataFrame:
    """Pointer doubling: distance from the head of the chain, the head, and the smallest key met."""
    state = parts.join(back, key, "left").select(
        key, F.col("prev").alias("ptr"), F.when(F.col("prev").isNotNull(), F.col("prev_length")).otherwise(0.0).alias("offset"),
        F.coalesce("prev", key).alias("head"), F.least(F.col(key), F.coalesce("prev", key)).alias("least"))
    state = checkpoint(state)
    for _ in range(limit):
        t = state.select(F.col(key).alias("ptr"), F.col("ptr").alias("_p"), F.col("offset").alias("_o"), F.col("head").alias("_h"), F.col("least").alias("_l"))
        live = state.where("ptr IS NOT NULL")
        moved = live.join(t, "ptr").select(key, F.col("_p").alias("ptr"), (F.col("offset") + F.col("_o")).alias("offset"), F.col("_h").alias("head"), F.least("least", "_l").alias("least"))
        state = checkpoint(state.where("ptr IS NULL").unionByName(moved))
        if state.where("ptr IS NOT NULL").isEmpty():
            break
    return state


def chain_offsets(parts: DataFrame, linked: DataFrame, key: str = "part_id") -> DataFrame:
    """Chain id, start offset and end flag per part; loops start at their smallest key and have no end.

    A chain of any length takes a logarithmic number of joins.
    """
    lengths = parts.select(F.col(key).alias("prev"), F.col("length").alias("prev_length"))
    back = checkpoint(linked.select(F.col("next").alias(key), F.col(key).alias("prev")).join(lengths, "prev"))
    rounds = max(1, math.ceil(math.log2(max(back.count(), 1) + 1)) + 1)
    ids = parts.select(key, "length")
    state = _ranked(ids, back, key, rounds)
    loops = state.where("ptr IS NOT NULL").select(key, "least")
    open_rows = state.where("ptr IS NULL").select(key, F.col("head").alias("chain"), "offset", F.lit(False).alias("loop"))
    if loops.isEmpty():
        rows = open_rows
    else:
        cut = back.join(loops, key, "left_semi").join(loops.where(F.col(key) == F.col("least")).select(key), key, "left_anti")
        again = _ranked(ids.join(loops.select(key), key, "left_semi"), cut, key, rounds)
        rows = open_rows.unionByName(again.select(key, F.col("head").alias("chain"), "offset", F.lit(True).alias("loop")))
    followed = linked.select(key).withColumn("_more", F.lit(True))
    return rows.join(followed, key, "left").select(key, "chain", "offset", (~F.col("loop") & F.col("_more").isNull()).alias("include_end"))


def chain_posts(stationed: DataFrame, offsets: DataFrame, spacing: float, key: str = "part_id") -> DataFrame:
    """Posts along each part, phased by its place in the chain."""
    rows = stationed.join(offsets, key)
    at = lines.chained_stations(spacing, F.col("offset"), F.col("include_end"), F.col("reverse"))
    return lines.samples_at(rows, at, key)
