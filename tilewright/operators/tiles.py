"""Leaves, model groups, the tile hierarchy and its manifests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import cells, geodesy as g
from tilewright.session import checkpoint
from tilewright.functions.text import lod_mode, subtree_path, tile_model_path

# Growth of a merged box, of a leaf box, and of the error per grouping level.
MERGE_GROWTH, LEAF_GROWTH, ERROR_SCALE = 1.05, 1.2, 2.0
# Padding and limits of a merged catalogue.
CATALOGUE_PAD_DEG, CATALOGUE_PAD_M, CHILD_ERROR_CAP, ROOT_ERROR_SCALE = 0.0001, 2500.0, 200.0, 10.0
# Heights that every leaf region covers.
SEED_HEIGHTS = (0.0, 100.0)


@dataclass(frozen=True)
class LodLevel:
    level: int
    error: float
    mode: str = ""
    prefixes: tuple[str, ...] = ()
    unmatched: str = ""


def lod_levels(enabled: bool, levels: Sequence[LodLevel]) -> list[LodLevel]:
    """Configured levels in order; only level 3 when switched off."""
    ordered = sorted(levels, key=lambda v: v.level)
    return ordered if enabled else [v for v in ordered if v.level == 3]


def error_base(levels: Sequence[LodLevel]) -> float:
    """First positive error; a tree with error zero would never refine to its content."""
    return next((v.error for v in levels if v.error > 0), 1.0)


def to_leaves(points: DataFrame, leaves: DataFrame, code: str = "code", levels: Sequence[int] = range(3, 12)) -> DataFrame:
    """Attach the leaf (level, cell) whose code is an ancestor of each level-11 code.

    Every point emits its ancestors only on levels where leaves can be, and meets the leaves by
    equality; each point has at most one leaf, because leaves do not nest.
    """
    levels = list(levels) or [cells.MIN_LEVEL]
    ups = F.explode(F.array(*[
        F.struct(F.lit(k).alias("level"), cells.ancestor_code(F.col(code), cells.MAX_LEVEL, k).alias("cell")) for k in levels]))
    exploded = points.withColumn("_up", ups).select("*", F.col("_up.level").alias("level"), F.col("_up.cell").alias("cell")).drop("_up")
    return exploded.join(leaves, ["level", "cell"])


def unmatched_points(points: DataFrame, leaves: DataFrame, code: str = "code", levels: Sequence[int] = range(3, 12)) -> DataFrame:
    """Points outside every leaf; any such point means the partition has to be refined again."""
    covered = to_leaves(points.select(code).distinct(), leaves.select("level", "cell"), code, levels).select(code).distinct()
    return points.join(covered, code, "left_anti")


def group_models(instances: DataFrame, keys: Sequence[str] = ("level", "cell", "table_name", "model"), order: str = "id") -> DataFrame:
    """Instances per leaf, table and model: count, whether any has content, and the first one."""
    return instances.groupBy(*keys).agg(
        F.count("*").alias("instances"), F.max("has_content").alias("has_content"), F.sum(F.col("has_content").cast("bigint")).alias("with_content"),
        F.min_by(F.struct("id", "lng", "lat", "alt"), F.col(order)).alias("first"))


def leaf_extent(instances: DataFrame, keys: Sequence[str] = ("level", "cell"), counted: bool = False) -> DataFrame:
    counts = [F.count("*").alias("instances")] if counted else []
    return instances.groupBy(*keys).agg(F.floor(F.min("alt")).alias("low"), F.ceil(F.max("alt")).alias("high"), *counts)


def resolve_lods(groups: DataFrame, assets: DataFrame, levels: Sequence[LodLevel], keep: Sequence[str] = ()) -> DataFrame:
    """Requested groups per level of detail: available, skipped or missing, with the reason.

    ``assets`` holds (table_name, model, lod) of existing content. Level 3 takes its own content;
    lower levels take it from where their mode says. Layers in ``keep`` stay for lower levels even
    without level-3 content.
    """
    wanted = groups.withColumn("lod", F.explode(F.array(*[F.lit(v.level) for v in levels])))
    mode = F.lit("lod3")
    for v in levels:
        if v.level < 3:
            mode = F.when(F.col("lod") == v.level, lod_mode(F.col("model"), v.mode, v.prefixes, v.unmatched)).otherwise(mode)
    wanted = wanted.withColumn("mode", mode).withColumn("source_lod", F.when(F.col("mode") == "local", F.col("lod")).otherwise(F.lit(3)))
    have = assets.groupBy("table_name", "model", F.col("lod").cast("int").alias("source_lod")).agg(F.sum("bytes").alias("bytes"))
    found = wanted.join(have, ["table_name", "model", "source_lod"], "left")
    dropped = F.lit(False)
    if keep:
        dropped = ~F.col("table_name").isin(*keep) & ~F.col("has_content") & (F.col("lod") < 3)
    status = (
        F.when(F.col("mode") == "skip", F.lit("skipped"))
        .when(F.col("bytes").isNotNull() & ~dropped, F.lit("available")).otherwise(F.lit("missing")))
    reason = F.when(status == "missing", F.when(F.col("mode") == "local", F.lit("local model file not found")).otherwise(F.lit("LOD3 model content unavailable")))
    return found.withColumns({"status": status, "reason": reason})


def generation_report(resolved: DataFrame) -> DataFrame:
    """Per level of detail: groups requested, available, skipped and missing, and instances and bytes available."""
    is_ = lambda s: F.col("status") == s
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return resolved.groupBy("lod").agg(
        F.count("*").alias("requested"), n(is_("available")).alias("available"), n(is_("skipped")).alias("skipped"), n(is_("missing")).alias("missing"),
        F.sum(F.when(is_("available"), F.col("instances")).otherwise(0)).alias("instances"),
        F.sum(F.when(is_("available"), F.col("bytes")).otherwise(0)).alias("bytes"))


def leaf_report(leaves: DataFrame, with_data: DataFrame, with_output: DataFrame) -> DataFrame:
    """Leaves found, with and without data, generated and without output."""
    flags = leaves.select("level", "cell").join(with_data.select("level", "cell", F.lit(1).alias("d")).distinct(), ["level", "cell"], "left").join(
        with_output.select("level", "cell", F.lit(1).alias("o")).distinct(), ["level", "cell"], "left")
    return flags.agg(F.count("*").alias("found"), F.count("d").alias("with_data"), (F.count("*") - F.count("d")).alias("without_data"),
                     F.count("o").alias("generated"), (F.count("*") - F.count("o")).alias("without_output"))


def grouping_prefixes(geohash: Column) -> Column:
    """Grouping nodes above a leaf, nearest first: down to length 3, or one of length 2 above a length-3 leaf."""
    n = F.length(geohash)
    low = F.least(F.lit(3), n - 1)
    return F.transform(F.sequence(n - 1, low, F.lit(-1)), lambda k: F.substring(geohash, F.lit(1), k))


def roll_up(leaves: DataFrame, base: float) -> DataFrame:
    """Every grouping node with its parent, leaf and instance counts and geometric error.

    The level-by-level rule (twice the largest child error, at least the base) has a closed form
    over the leaves below: with ``k`` grouping steps, the larger of ``base * 2^(k-1)`` and
    ``error * 2^k``. So one explode and one aggregation build the whole hierarchy.
    """
    prefixes = grouping_prefixes(F.col("geohash"))
    paths = F.concat(prefixes, F.array(F.lit("root")))
    rows = leaves.select("geohash", "error", "instances", F.posexplode(paths).alias("step", "node"), paths.alias("path"))
    parent = F.get(F.col("path"), F.col("step") + 1)
    k = F.col("step") + 1
    grown = F.greatest(F.lit(base) * F.pow(F.lit(ERROR_SCALE), k - 1), F.col("error") * F.pow(F.lit(ERROR_SCALE), k))
    return rows.withColumns({"parent": parent, "grown": grown}).groupBy("node").agg(
        F.first("parent").alias("parent"), F.count("*").alias("leaves"), F.sum("instances").alias("instances"), F.max("grown").alias("error"))


def merge_boxes(children: DataFrame, key: str, order: str, box: str = "box", growth: float = MERGE_GROWTH) -> DataFrame:
    """Oriented box around child boxes, in the frame of the first child by ``order``; a single child's box is kept."""
    f = F.col("_f")
    vec = lambda n: tuple(F.col(n)[i] for i in range(3))
    unit = lambda v: F.array(*[x / F.sqrt(g.dot(v, v)) for x in v])
    names = ("ux", "uy", "uz")
    frames = (
        children.groupBy(key).agg(F.min_by(box, order).alias("_f"), F.count("*").alias("_n"))
        .withColumn("ux", unit((f[3], f[4], f[5]))).withColumn("_ry", unit((f[6], f[7], f[8])))
        .withColumn("_c", F.array(*g._cross(vec("ux"), vec("_ry")))).withColumn("uz", unit(vec("_c")))
        .withColumn("_d", F.array(*g._cross(vec("uz"), vec("ux")))).withColumn("uy", unit(vec("_d"))).drop("_ry", "_c", "_d")
    )
    rows = children.select(key, F.col(box).alias("_b")).join(frames, key)
    corner = rows.withColumn("_p", F.explode(g.box_corners(F.col("_b"))))
    d = tuple(F.col("_p")[a] - f[i] for i, a in enumerate("xyz"))
    proj = {f"_{n}": g.dot(d, tuple(F.col(n)[i] for i in range(3))) for n in names}
    spans = corner.withColumns(proj).groupBy(key).agg(
        F.first("_f").alias("_f"), F.first("_n").alias("_n"), *[F.first(n).alias(n) for n in names],
        *[fn(f"_{n}").alias(f"{p}{n}") for n in names for p, fn in (("lo_", F.min), ("hi_", F.max))])
    mid = [(F.col(f"lo_{n}") + F.col(f"hi_{n}")) * 0.5 for n in names]
    half = [(F.col(f"hi_{n}") - F.col(f"lo_{n}")) * (0.5 * growth) for n in names]
    centre = [F.col("_f")[a] + reduce(lambda s, t: s + t, [F.col(n)[a] * m for n, m in zip(names, mid)]) for a in range(3)]
    merged = F.array(*centre, *[F.col(n)[a] * h for n, h in zip(names, half) for a in range(3)])
    return spans.select(key, F.when(F.col("_n") == 1, F.col("_f")).otherwise(merged).alias(box))


def hierarchy(leaves: DataFrame, base: float, levels: Sequence[int]) -> DataFrame:
    """Boxes of all nodes (leaves, grouping nodes, root). They rise one level at a time, at most nine passes over cells.

    ``levels`` are the levels that hold leaves.
    """
    paths = F.concat(grouping_prefixes(F.col("geohash")), F.array(F.lit("root")))
    own = leaves.select(F.col("geohash").alias("node"), "box", F.element_at(paths, 1).alias("parent"))
    up = lambda n: F.when(F.length(n) > 3, F.substring(n, F.lit(1), F.length(n) - 1)).otherwise(F.lit("root"))
    done, risen = [own.select("node", "box")], None
    for depth in range(max(levels), 1, -1):
        now = own.where(F.length("node") == depth)
        if risen is not None:
            now = now.unionByName(risen.where(F.length("node") == depth))
        made = checkpoint(merge_boxes(now.where("parent <> 'root'"), "parent", "node").select(
            F.col("parent").alias("node"), "box", up(F.col("parent")).alias("parent")))
        done.append(made.select("node", "box"))
        risen = made if risen is None else risen.unionByName(made)
        if depth == min(4, *levels):
            break
    top = risen.where("parent = 'root'")
    done.append(merge_boxes(top, "parent", "node").withColumnRenamed("parent", "node"))
    return reduce(lambda a, b: a.unionByName(b), done)


def lod_chain(leaves: DataFrame, resolved: DataFrame, levels: Sequence[LodLevel], stamp: str) -> DataFrame:
    """Content nodes per leaf: one per available level, each the child of the coarser one.

    The coarsest carries the transform and the leaf's own name; the finest available has error zero.
    """
    ok = resolved.where("status = 'available'").select("level", "cell", "lod").distinct()
    per = ok.groupBy("level", "cell").agg(F.sort_array(F.collect_set("lod")).alias("lods"))
    errors = F.create_map(*[x for v in levels for x in (F.lit(v.level), F.lit(float(v.error)))])
    rows = leaves.join(per, ["level", "cell"]).select("*", F.posexplode("lods").alias("pos", "lod_no"))
    name = lambda p, l: F.when(p == 0, F.col("geohash")).otherwise(F.concat("geohash", F.lit("#lod"), l.cast("string")))
    last = F.col("pos") == F.size("lods") - 1
    before = F.get(F.col("lods"), F.col("pos") - 1)
    return rows.select(
        "geohash", name(F.col("pos"), F.col("lod_no")).alias("node"),
        F.when(F.col("pos") > 0, name(F.col("pos") - 1, before)).alias("above"), F.col("lod_no").alias("lod"),
        F.when(last, F.lit(0.0)).otherwise(F.element_at(errors, F.col("lod_no"))).alias("error"), F.lit("REPLACE").alias("refine"),
        F.concat(tile_model_path(F.col("geohash"), F.col("lod_no")), F.lit(f"?t={stamp}")).alias("uri"), (F.col("pos") == 0).alias("has_transform"))


def manifests(nodes: DataFrame, split_level: int, stamp: str) -> DataFrame:
    """Manifest documents (path, nodes, content): nested JSON built from the leaves upwards.

    Input: geohash, parent, error, uri (leaves) and box as array. A node becomes a document of its
    own at ``split_level``; a deeper level gives smaller documents, whatever the size of the data.
    Content links are relative to the document that holds them, and a parent gathers at most its 32
    children.
    """
    holder = F.when((F.length("geohash") >= split_level) & (F.col("geohash") != "root"), subtree_path(F.substring("geohash", 1, split_level))).otherwise(F.lit(""))
    nodes = nodes.withColumn("uri", F.concat(F.repeat(F.lit("../"), F.length(holder) - F.length(F.replace(holder, F.lit("/"), F.lit("")))), F.col("uri")))
    box = F.col("box")
    own = lambda children: F.to_json(F.struct(
        F.struct(box.alias("box")).alias("boundingVolume"), F.col("error").alias("geometricError"),
        F.when(F.col("uri").isNull(), F.lit("ADD")).otherwise(F.lit("REPLACE")).alias("refine"),
        F.when(F.col("uri").isNotNull(), F.struct(F.col("uri"))).alias("content"),
        F.col("geohash"), *([children] if children is not None else [])))
    documents: list[DataFrame] = []
    lifted = None
    deepest = nodes.agg(F.max(F.length("geohash"))).first()[0]
    nodes = checkpoint(nodes)
    for depth in range(deepest, 0, -1):
        if depth == 2 and nodes.where(F.length("geohash") == 2).isEmpty():
            continue
        here = nodes.where((F.length("geohash") == depth) if depth > 1 else (F.col("geohash") == "root"))
        here = here.where(F.col("geohash") != "root") if depth > 1 else here
        if lifted is not None:
            kids = lifted.where(F.length("parent") == depth if depth > 1 else F.col("parent") == "root").groupBy("parent").agg(
                F.sort_array(F.collect_list(F.struct("geohash", "text"))).alias("kids"), F.sum("n").alias("below"))
            here = here.join(kids.withColumnRenamed("parent", "geohash"), "geohash", "left")
        else:
            here = here.withColumns({"kids": F.lit(None).cast("array<struct<geohash:string,text:string>>"), "below": F.lit(None).cast("bigint")})
        children = F.array_join(F.transform("kids", lambda k: k["text"]), ",")
        body = own(None)
        full = F.when(F.col("kids").isNull(), body).otherwise(
            F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"children":['), children, F.lit("]}")))
        count = F.coalesce("below", F.lit(0)) + 1
        here = here.withColumns({"text": full, "n": count})
        apart = (F.length("geohash") == split_level) if depth > 1 else F.lit(True)
        path = F.when(F.col("geohash") == "root", F.lit("tileset.json")).otherwise(subtree_path(F.col("geohash")))
        marked = here.withColumns({"apart": apart, "path": path})
        documents.append(marked.where("apart").select(
            "path", "geohash", "n", F.concat(F.lit('{"asset":{"version":"1.1"},"geometricError":'), F.col("error").cast("string"), F.lit(',"root":'), F.col("text"), F.lit("}")).alias("content")))
        link = F.to_json(F.struct(
            F.struct(box.alias("box")).alias("boundingVolume"), F.col("error").alias("geometricError"), F.lit("ADD").alias("refine"),
            F.struct(F.concat("path", F.lit(f"?t={stamp}")).alias("uri")).alias("content"), F.col("geohash")))
        up = marked.select("geohash", "parent", F.when(F.col("apart"), link).otherwise(F.col("text")).alias("text"),
                           F.when(F.col("apart"), F.lit(1).cast("bigint")).otherwise(F.col("n")).alias("n"))
        waiting = up if lifted is None else up.unionByName(lifted.where("parent = 'root'"))
        lifted = checkpoint(waiting)
    return reduce(lambda a, b: a.unionByName(b), documents)


def union_regions(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return regions.groupBy(*keys).agg(F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"),
                                      F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def merge_catalogue(children: DataFrame) -> DataFrame:
    """One root over child tilesets: padded region, capped child errors, newest version; mixed volume kinds are an error."""
    c = children.withColumn("error", F.least("error", F.lit(CHILD_ERROR_CAP)))
    out = c.agg(F.count("*").alias("children"), F.count_distinct("kind").alias("kinds"), F.first("kind").alias("kind"),
                F.max("error").alias("error"), F.max((F.col("version") == "1.1").cast("int")).alias("v11"),
                F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    pad = F.when(F.col("kind") == "box", F.radians(F.lit(CATALOGUE_PAD_DEG))).otherwise(F.lit(0.0))
    lift = F.when(F.col("kind") == "box", F.lit(CATALOGUE_PAD_M)).otherwise(F.lit(0.0))
    checked = F.when(F.col("kinds") > 1, F.raise_error(F.lit("mixed bounding volume kinds are not supported")).cast("bigint")).otherwise(F.col("children"))
    return out.select(
        checked.alias("children"), "kind", "error", (F.col("error") * ROOT_ERROR_SCALE).alias("root_error"),
        F.when(F.col("v11") == 1, F.lit("1.1")).otherwise(F.lit("1.0")).alias("version"),
        (F.col("w") - pad).alias("w"), (F.col("s") - pad).alias("s"), (F.col("e") + pad).alias("e"), (F.col("n") + pad).alias("n"),
        (F.col("lo") - lift).alias("lo"), (F.col("hi") + lift).alias("hi"))


def merge_spheres(spheres: DataFrame, key: str, order: str) -> DataFrame:
    """Union sphere per group as a fold from the first sphere to the last.

    The fold depends on the order, so a group is read as a sorted stream; a task keeps one sphere, never a group.
    """
    name, columns = spheres.schema[key].dataType.simpleString(), [key, *"xyzr"]

    def fold(batches):
        import math

        import pyarrow as pa

        group, ball, out = None, None, []
        for batch in batches:
            for k, x, y, z, r in zip(*(batch.column(c).to_pylist() for c in columns)):
                if ball is None or k != group:
                    if ball is not None:
                        out.append((group, *ball))
                    group, ball = k, (x, y, z, r)
                    continue
                move = (x - ball[0], y - ball[1], z - ball[2])
                gap = math.sqrt(move[0] * move[0] + move[1] * move[1] + move[2] * move[2])
                if ball[3] >= gap + r:
                    continue
                if r >= gap + ball[3]:
                    ball = (x, y, z, r)
                    continue
                grown = (gap + ball[3] + r) / 2
                share = (grown - ball[3]) / gap
                ball = (*(b + m * share for b, m in zip(ball, move)), grown)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(key).type if i == 0 else pa.float64()) for i, c in enumerate(zip(*out))], columns)
                out = []
        if ball is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], batch.schema.field(key).type if i == 0 else pa.float64()) for i, v in enumerate((group, *ball))], columns)

    rows = spheres.select(key, F.col(order).alias("_o"), *[F.col(k).cast("double").alias(k) for k in "xyzr"])
    return rows.repartition(key).sortWithinPartitions(key, "_o").select(*columns).mapInArrow(fold, f"`{key}` {name}, x double, y double, z double, r double")


def changed_nodes(tree: DataFrame, changes: DataFrame, columns: Sequence[str], key: str = "geohash") -> tuple[DataFrame, DataFrame]:
    """Stored nodes with their changed columns replaced, and changes whose cell is not in the tree (an error for the caller)."""
    side = changes.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = tree.join(side, key, "left")
    out = joined.select(*[
        F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in tree.columns])
    return out, changes.join(tree.select(key), key, "left_anti")


def model_extents(vertices: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    return vertices.groupBy(*keys).agg(*[fn(a).alias(f"{p}{a}") for a in "xyz" for p, fn in (("lo_", F.min), ("hi_", F.max))]).withColumns(
        {f"size_{a}": F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in "xyz"})


def placed_regions(instances: DataFrame, extents: DataFrame, model: str = "model_id") -> DataFrame:
    """Region of each leaf from its placed models, together with the leaf cell and the seed heights."""
    rows = instances.join(extents, model)
    matrix = F.array(*g.pose_matrix(F.col("lng"), F.col("lat"), F.col("alt"), F.col("obj_angle"), scale=(F.col("sx"), F.col("sy"), F.col("sz"))))
    pts = g.sample_points(tuple(F.col(f"lo_{a}") for a in "xyz"), tuple(F.col(f"hi_{a}") for a in "xyz"))
    # one row per sample keeps the earth-centred arithmetic in generated code; the aggregation shrinks it again map-side
    rows = rows.select("level", "cell", F.radians("lng").alias("_ref"), matrix.alias("_m"), F.explode(pts).alias("_p"))
    m, p = F.col("_m"), F.col("_p")
    rows = rows.select("level", "cell", "_ref", *[
        (m[i] * p["x"] + m[4 + i] * p["y"] + m[8 + i] * p["z"] + m[12 + i]).alias(f"_{a}") for i, a in enumerate("xyz")])
    lon, lat, h = g.geodetic(F.col("_x"), F.col("_y"), F.col("_z"))
    rows = rows.select("level", "cell", "_ref", lon.alias("_lon"), lat.alias("_lat"), h.alias("_h"))
    turned = F.col("_lon") + F.round((F.col("_ref") - F.col("_lon")) / (2 * math.pi)) * (2 * math.pi)
    merged = rows.groupBy("level", "cell").agg(
        F.min(turned).alias("w"), F.min("_lat").alias("s"), F.max(turned).alias("e"), F.max("_lat").alias("n"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
    full = merged.withColumn("geohash", cells.code_to_hash_at(F.col("cell"), F.col("level")))
    box = cells.hash_bbox(F.col("geohash"))
    return full.select("level", "cell", "geohash",
                       F.least("w", F.radians(box["west"])).alias("w"), F.least("s", F.radians(box["south"])).alias("s"),
                       F.greatest("e", F.radians(box["east"])).alias("e"), F.greatest("n", F.radians(box["north"])).alias("n"),
                       F.least("lo", F.lit(SEED_HEIGHTS[0])).alias("lo"), F.greatest("hi", F.lit(SEED_HEIGHTS[1])).alias("hi"))
