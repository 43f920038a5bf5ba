"""Model shapes from vertex tables: bins, classes, clusters, box merging, cross sections, welding, registration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators import lines
from tilewright.operators.ordering import ranked
from tilewright.operators.tiles import model_extents
from tilewright.session import checkpoint

# Slices along the long axis, least vertices per slice, similarity of merged boxes, least thickness.
SLICES, MIN_VERTICES, WIDTH_TOLERANCE, HEIGHT_TOLERANCE = 32, 3, 0.25, 0.25
#: Distinct contents that are broadcast: about 5 MB.
SMALL = 50_000


def with_extents(vertices: DataFrame, key: str = "model_id") -> DataFrame:
    return vertices.hint("merge").join(model_extents(vertices, [key]), key)


def slice_stats(vertices: DataFrame, key: str = "model_id", slices: int = SLICES, least: int = MIN_VERTICES) -> DataFrame:
    """Count and extents per slice along the longer horizontal axis (x or z); sparse slices are dropped."""
    rows = with_extents(vertices, key)
    by_x = F.col("size_x") >= F.col("size_z")
    at = F.when(by_x, F.col("x") - F.col("lo_x")).otherwise(F.col("z") - F.col("lo_z"))
    length = F.greatest("size_x", "size_z")
    index = F.least(F.greatest(F.floor(at / length * slices), F.lit(0)), F.lit(slices - 1))
    return rows.where(length > 0).withColumn("slice", index).groupBy(key, "slice").agg(
        F.count("*").alias("n"), F.first(by_x).alias("by_x"),
        *[fn(a).alias(f"{p}{a}") for a in "xyz" for p, fn in (("lo_", F.min), ("hi_", F.max))]).where(F.col("n") >= least)


def merge_similar(boxes: DataFrame, key: str = "model_id", order: str = "slice") -> DataFrame:
    """Neighbouring boxes merged while width and height stay close to the running merged box.

    The comparison is with the box merged so far, so it is a fold in slice order. A model has at
    most as many boxes as there are slices, which bounds the array that is folded.
    """
    box = F.struct(*[F.col(f"{p}{a}").cast("double").alias(f"{p}{a}") for a in "xyz" for p in ("lo_", "hi_")])
    rows = boxes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "by_x", box.alias("b")))).alias("a"))
    empty = F.filter(F.transform("a", lambda v: v["b"]), lambda v: F.lit(False))

    def step(done: Column, item: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        size = lambda b, a: b[f"hi_{a}"] - b[f"lo_{a}"]
        width = lambda b: F.when(item["by_x"], size(b, "z")).otherwise(size(b, "x"))
        gap = lambda p, q: F.abs(p - q) / F.greatest(p, q, F.lit(0.0001))
        similar = (gap(width(last), width(item["b"])) <= WIDTH_TOLERANCE) & (gap(size(last, "y"), size(item["b"], "y")) <= HEIGHT_TOLERANCE)
        grown = F.struct(*[(F.least if p == "lo_" else F.greatest)(last[f"{p}{a}"], item["b"][f"{p}{a}"]).alias(f"{p}{a}") for a in "xyz" for p in ("lo_", "hi_")])
        merged = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))
        return F.when((F.size(done) > 0) & F.coalesce(similar, F.lit(False)), merged).otherwise(F.concat(done, F.array(item["b"])))

    folded = rows.select(key, F.aggregate("a", empty, step).alias("m"))
    return folded.select(key, F.posexplode("m").alias("pos", "b")).select(key, "pos", "b.*")


def shape_class(vertices: DataFrame, key: str = "model_id", least: int = MIN_VERTICES) -> DataFrame:
    """Class per model: single-pole sign, two-post gantry, long rod, or outline, by the ordered rules of the shape tests."""
    v = with_extents(vertices, key)
    lower = F.col("y") < F.col("lo_y") + F.col("size_y") * 0.45
    span = F.greatest("size_x", "size_z")
    depth = F.least("size_x", "size_z")
    at = F.when(F.col("size_x") >= F.col("size_z"), F.col("x") - F.col("lo_x")).otherwise(F.col("z") - F.col("lo_z"))
    left, right, centre = at <= span * 0.22, at >= span * 0.78, (at >= span * 0.35) & (at <= span * 0.65)
    rise = F.col("y") - F.col("lo_y")
    band = lambda k: (rise >= F.col("size_y") * (k * 0.12)) & (rise < F.col("size_y") * ((k + 1) * 0.12))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    ext = lambda a, cond: F.max(F.when(cond, F.col(a))) - F.min(F.when(cond, F.col(a)))
    low_part = F.lit(False)
    for k in range(5):
        low_part = low_part | band(k)
    top = rise >= F.col("size_y") * 0.68
    aggs = {
        "n": F.count("*"), "n_low": n(lower), "n_up": n(~lower),
        **{f"{p}_{a}": ext(a, cond) for p, cond in (("low", lower), ("up", ~lower)) for a in "xyz"},
        **{f"l{k}": n(left & band(k)) for k in range(5)}, **{f"r{k}": n(right & band(k)) for k in range(5)},
        "c_low": n(centre & low_part), "n_top": n(top), "top_span": F.max(F.when(top, at)) - F.min(F.when(top, at)), "top_centre": n(centre & top),
        **{f"size_{a}": F.first(f"size_{a}") for a in "xyz"},
    }
    m = v.groupBy(key).agg(*[e.alias(k) for k, e in aggs.items()])
    wide, up_wide, low_wide = F.greatest("size_x", "size_z"), F.greatest("up_x", "up_z"), F.greatest("low_x", "low_z")
    sign = (
        (F.col("size_y") > 0) & (F.col("n_low") >= least) & (F.col("n_up") >= least) & (up_wide > wide * 0.45) & (low_wide < wide * 0.25)
        & (F.col("up_y") < F.col("size_y") * 0.55) & ((F.col("up_x") > F.col("low_x") * 3) | (F.col("up_z") > F.col("low_z") * 3)))
    total = lambda p: sum((F.col(f"{p}{k}") for k in range(1, 5)), F.col(f"{p}0"))
    held = lambda p: sum((F.when(F.col(f"{p}{k}") >= least, 1).otherwise(0) for k in range(1, 5)), F.when(F.col(f"{p}0") >= least, 1).otherwise(0))
    sparse = (held("l") >= 1) & (held("r") >= 1) & (F.col("n") >= 24)
    posts = ((held("l") >= 3) & (held("r") >= 3)) | sparse
    m_span, m_depth = F.greatest("size_x", "size_z"), F.least("size_x", "size_z")
    gantry = (
        (F.least("size_x", "size_y", "size_z") > 0) & (m_span >= F.col("size_y") * 1.2) & (m_span >= m_depth * 4) & (F.col("size_y") >= m_depth * 3)
        & (F.least(total("l"), total("r")) >= least * 2) & (F.col("c_low") <= (total("l") + total("r")) * 0.12) & posts
        & (F.col("n_top") >= least) & (F.col("top_span") >= m_span * 0.72) & ((F.col("top_centre") >= least) | sparse))
    ordered = F.sort_array(F.array("size_x", "size_y", "size_z"))
    rod = (ordered[0] > 0) & (F.col("size_x") * F.col("size_y") * F.col("size_z") <= 5.0) & (ordered[2] / ordered[1] >= 3.0) & (ordered[2] / ordered[0] >= 6.0)
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    return m.select(key, F.when(yes(sign), "single_pole_sign").when(yes(gantry), "two_post_gantry").when(yes(rod), "long_rod").otherwise("outline_slices").alias("shape"))


def gap_clusters(vertices: DataFrame, key: str = "model_id", axis: str = "x", configured: float = 0.0, share: float = 0.05, floor: float = 5.0) -> DataFrame:
    """Clusters along an axis: a gap wider than the limit starts a new one. Bounds per cluster.

    Values are first reduced to one row per distinct position and bucket; a bucket is as wide as
    half the limit, so a gap can only lie between buckets or between neighbours inside one, and
    the window runs over buckets instead of vertices.
    """
    ext = vertices.groupBy(key).agg(F.min(axis).alias("_lo"), F.max(axis).alias("_hi"))
    limit = F.lit(configured) if configured > 0 else F.greatest((F.col("_hi") - F.col("_lo")) * share, F.lit(floor))
    rows = vertices.hint("merge").join(ext.withColumn("_gap", limit), key).withColumn("_b", F.floor((F.col(axis) - F.col("_lo")) / (F.col("_gap") / 2)))
    other = [a for a in "xyz" if a != axis]
    buckets = rows.groupBy(key, "_b").agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"), F.first("_gap").alias("_gap"), F.count("*").alias("n"),
                                          *[fn(a).alias(f"{p}{a}") for a in other for p, fn in (("lo_", F.min), ("hi_", F.max))])
    w = Window.partitionBy(key).orderBy("_b")
    start = F.coalesce((F.col("lo") - F.lag("hi").over(w) > F.col("_gap")).cast("int"), F.lit(1))
    grouped = buckets.withColumn("_s", start).withColumn("cluster", F.sum("_s").over(w))
    return grouped.groupBy(key, "cluster").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                               *[fn(f"{p}{a}").alias(f"{p}{a}") for a in other for p, fn in (("lo_", F.min), ("hi_", F.max))])


def weld(vertices: DataFrame, key: str, order: str, eps: float = 0.001) -> DataFrame:
    """Dense vertex ids per key: points equal after rounding to ``eps`` share the id of the first of them."""
    grid = [F.round(F.col(a) / eps).cast("bigint").alias(f"_{a}") for a in "xyz"]
    keyed = vertices.select("*", *grid)
    firsts = keyed.groupBy(key, "_x", "_y", "_z").agg(F.min(order).alias("first_at"))
    ids = ranked(firsts, [key], ["first_at"], "weld_id").withColumn("weld_id", F.col("weld_id") - 1)
    return keyed.hint("merge").join(ids, [key, "_x", "_y", "_z"]).drop("_x", "_y", "_z")


def cross_sections(edges: DataFrame, axes: DataFrame, key: str = "id") -> DataFrame:
    """Middle points of cross sections along the principal axis.

    ``edges`` (key, x1, y1, x2, y2) are boundary edges, ``axes`` (key, angle, cx, cy, length). Each
    edge emits the samples it crosses, so no sample meets an edge it cannot hit; per sample the
    nearest hit on either side of the axis gives the middle, or the outermost two where one side
    has none.
    """
    rows = edges.hint("merge").join(axes, key)
    co, si = F.cos("angle"), F.sin("angle")
    u = lambda x, y: (F.col(x) - F.col("cx")) * co + (F.col(y) - F.col("cy")) * si
    v = lambda x, y: -(F.col(x) - F.col("cx")) * si + (F.col(y) - F.col("cy")) * co
    rows = rows.withColumns({"u1": u("x1", "y1"), "u2": u("x2", "y2"), "v1": v("x1", "y1"), "v2": v("x2", "y2")})
    count = F.least(F.greatest(F.ceil(F.col("length") / 4.0), F.lit(8)), F.lit(48))
    rows = rows.withColumn("count", count).withColumn("_step", F.col("length") / F.col("count")).where("u1 <> u2")
    place = lambda k: (k + 0.5) * F.col("_step") - F.col("length") / 2
    low = F.greatest(F.ceil((F.least("u1", "u2") + F.col("length") / 2) / F.col("_step") - 0.5), F.lit(0))
    high = F.least(F.floor((F.greatest("u1", "u2") + F.col("length") / 2) / F.col("_step") - 0.5), F.col("count") - 1)
    hits = rows.where(high >= low).withColumn("sample", F.explode(F.sequence(low, high)))
    t = (place(F.col("sample")) - F.col("u1")) / (F.col("u2") - F.col("u1"))
    hits = hits.withColumns({"at": place(F.col("sample")), "hit": F.col("v1") + (F.col("v2") - F.col("v1")) * t})
    per = hits.groupBy(key, "sample").agg(
        F.first("at").alias("at"), F.first("angle").alias("angle"), F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.count("*").alias("n"),
        F.max(F.when(F.col("hit") <= 0, F.col("hit"))).alias("below"), F.min(F.when(F.col("hit") >= 0, F.col("hit"))).alias("above"),
        F.min("hit").alias("lowest"), F.max("hit").alias("highest")).where("n >= 2")
    both = F.col("below").isNotNull() & F.col("above").isNotNull()
    mid = F.when(both, (F.col("below") + F.col("above")) / 2).otherwise((F.col("lowest") + F.col("highest")) / 2)
    return per.select(key, "sample", (F.col("cx") + F.col("at") * F.cos("angle") - mid * F.sin("angle")).alias("x"),
                      (F.col("cy") + F.col("at") * F.sin("angle") + mid * F.cos("angle")).alias("y"))


def smooth_sections(sections: DataFrame, key: str = "id", radius: int = 1) -> DataFrame:
    """Cross-section middles averaged with their neighbours."""
    out = lines.average_by_count(sections, radius, key, "sample", "x")
    return lines.average_by_count(out, radius, key, "sample", "y")


def _moments(pairs: DataFrame, key: str) -> DataFrame:
    """Centroids and covariances per group; ``solvable``: three points or more, and not on one line, judged against their spread."""
    m = pairs.groupBy(key).agg(
        F.count("*").alias("n"), *[F.avg(f"{p}{a}").alias(f"c{p}{a}") for p in "mt" for a in "xyz"],
        *[(F.covar_pop(f"m{a}", f"t{b}")).alias(f"s{a}{b}") for a in "xyz" for b in "xyz"],
        *[F.covar_pop(f"m{a}", f"m{b}").alias(f"v{a}{b}") for a in "xyz" for b in "xyz" if a <= b])
    minors = ((F.col("vxx") * F.col("vyy") - F.col("vxy") * F.col("vxy")) + (F.col("vxx") * F.col("vzz") - F.col("vxz") * F.col("vxz"))
              + (F.col("vyy") * F.col("vzz") - F.col("vyz") * F.col("vyz")))
    spread = F.col("vxx") + F.col("vyy") + F.col("vzz")
    return m.withColumn("solvable", (F.col("n") >= 3) & (minors > spread * spread * 1e-12))


def unsolvable(pairs: DataFrame, key: str = "grp") -> DataFrame:
    """Groups of control points that determine no rotation, with their number of points."""
    return _moments(pairs, key).where("not solvable").select(key, "n")


def solve_registration(pairs: DataFrame, key: str = "grp") -> tuple[DataFrame, DataFrame]:
    """Rigid transform per group of control points (mx, my, mz to tx, ty, tz), and residuals per point.

    Centroids and covariances are plain aggregates; only the small eigenproblem, one row per group,
    is solved in Arrow batches. Groups with fewer than three points or on one line are left out of both;
    ``unsolvable`` names them.
    """
    solvable = _moments(pairs, key).where("solvable").drop("solvable")

    def rotations(batches):
        """Optimal rotation of each row of centred moments: 4x4 eigenproblems solved in one call."""
        import numpy as np

        for pdf in batches:
            s = pdf[[f"s{a}{b}" for a in "xyz" for b in "xyz"]].to_numpy().reshape(-1, 3, 3)
            sxx, sxy, sxz, syx, syy, syz, szx, szy, szz = (s[:, i, j] for i in range(3) for j in range(3))
            n = np.stack([
                np.stack([sxx + syy + szz, syz - szy, szx - sxz, sxy - syx], -1), np.stack([syz - szy, sxx - syy - szz, sxy + syx, szx + sxz], -1),
                np.stack([szx - sxz, sxy + syx, -sxx + syy - szz, syz + szy], -1), np.stack([sxy - syx, szx + sxz, syz + szy, -sxx - syy + szz], -1)], 1)
            q = np.linalg.eigh(n)[1][:, :, -1]
            q = q * np.where(q[:, :1] < 0, -1.0, 1.0)
            yield pdf.assign(qw=q[:, 0], qx=q[:, 1], qy=q[:, 2], qz=q[:, 3])

    schema = solvable.schema.simpleString()[7:-1]
    solved = solvable.mapInPandas(rotations, schema.replace(":", " ").replace(",", ", ") + ", qw double, qx double, qy double, qz double")
    w, x, y, z = (F.col(f"q{k}") for k in "wxyz")
    rot = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
           [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    shift = [F.col(f"ct{a}") - sum((rot[i][j] * F.col(f"cm{b}") for j, b in enumerate("yz", 1)), rot[i][0] * F.col("cmx")) for i, a in enumerate("xyz")]
    out = solved.select(key, "n", "qx", "qy", "qz", "qw", *[rot[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)], *[s.alias(f"d{a}") for a, s in zip("xyz", shift)])
    moved = pairs.hint("merge").join(out.drop("n"), key)
    err = [F.col(f"r{i}0") * F.col("mx") + F.col(f"r{i}1") * F.col("my") + F.col(f"r{i}2") * F.col("mz") + F.col(f"d{a}") - F.col(f"t{a}") for i, a in enumerate("xyz")]
    residuals = moved.withColumn("residual", F.sqrt(err[0] * err[0] + err[1] * err[1] + err[2] * err[2])).select(*pairs.columns, "residual")
    quality = residuals.groupBy(key).agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms"), F.max("residual").alias("worst"))
    return out.hint("merge").join(quality, key), residuals


def one_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Keys of either side that meet more than one partner: one row for each of the partners, with their number."""
    def many(a: str, b: str) -> DataFrame:
        each = pairs.select(F.col(a).cast("string").alias("key"), F.col(b).cast("string").alias("partner")).where("partner is not null").distinct()
        return each.join(each.groupBy("key").agg(F.count("*").alias("partners")).where("partners > 1"), "key").select("key", "partner", "partners", F.lit(a).alias("side"))

    return many(left, right).unionByName(many(right, left))


def dedupe_content(assets: DataFrame, content: str, order: str, keys: Sequence[str]) -> DataFrame:
    """First occurrence of each content by hash; later ones point to it. A counted small number of contents goes to where the assets are."""
    hashed = assets.withColumn("sha", F.sha2(F.col(content).cast("binary"), 256))
    firsts = checkpoint(hashed.groupBy("sha").agg(F.min(order).alias("first_at"), F.count("*").alias("copies")))
    met = hashed.join(F.broadcast(firsts), "sha") if firsts.count() <= SMALL else hashed.hint("merge").join(firsts, "sha")
    return met.select(*keys, order, "sha", "copies", "first_at", F.when(F.col(order) == F.col("first_at"), "written").otherwise("duplicate").alias("status"))
