"""Steps that have to grow no faster than their input: no rows made from a small scan are sent whole, and no work is done twice."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tilewright.operators import crossing, pyramid
from tilewright.operators import surfaces_cells as sc
from tilewright.streaming import jobs

QUERIES = entry_module.queries()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "A3_road_split_decision", "A21_slice_statistics", "A29_vertex_welding", "J12_station_and_offset", "W11_cross_sections",
    "W8_merge_similar_boxes", "A25_combined_bounds", "A28_shape_class", "J2_crossing_count", "P12_line_draping", "J17_box_range_search"])
def test_multiplied_rows_are_not_broadcast(name, spark, sf_dir, monkeypatch):
    monkeypatch.setattr(pyramid, "SMALL", 0)
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cuts_are_written_once_and_whole_triangles_stay(spark):
    t = spark.createDataFrame([(1, 0, 1.0, 1.0, 0.0, 9.0, 1.0, 0.0, 1.0, 9.0, 5.0), (1, 1, 8.0, 1.0, 0.0, 12.0, 1.0, 4.0, 8.0, 3.0, 0.0)],
                              "road_id int, tri_id int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, x3 double, y3 double, z3 double")
    cut = sc.slice_triangles(t, 10.0)
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("zip_with") <= 12
    rows = {(r["tri_id"], r["gx"]): r for r in cut.collect()}
    assert [tuple(p) for p in rows[0, 0]["poly"]] == [(1.0, 1.0, 0.0), (9.0, 1.0, 0.0), (1.0, 9.0, 5.0)]
    assert sorted(k for k in rows if k[0] == 1) == [(1, 0), (1, 1)]
    assert sum(r["area"] for k, r in rows.items() if k[0] == 1) == pytest.approx(4.0)


def test_change_and_deletion_of_one_moment_both_stay(spark, tmp_path):
    rows = spark.range(4).select(F.lit(7).alias("id"), F.timestamp_seconds(F.lit(1000)).alias("update_time"), F.when(F.col("id") % 2 == 0, "1").alias("del_flag"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = jobs.run_available(jobs.edit_feed(stream), str(tmp_path / "out"))
    assert sorted(r["feed"] for r in out.collect()) == ["changed", "deleted"]


def test_padded_tree_reaches_as_far_as_its_lines(spark):
    edges = spark.createDataFrame([(1, 117.2, 31.2, 117.3, 31.2), (2, 117.2, 32.9, 117.3, 32.9)], "feature int, x1 double, y1 double, x2 double, y2 double")
    bound = crossing.extent(edges, 1e-4)
    assert bound == pytest.approx((117.1999, 31.1999, 117.3001, 32.9001))
    assert crossing.extent(edges.limit(0)) == (0.0, 0.0, 0.0, 0.0)
    tree = crossing.refine(edges, bound, threshold=2, closed=False, metres=0.5, max_level=3)
    assert tree.agg(F.sum("total_count")).first()[0] == 2


def logical(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["U2_changed_feed", "P8_dynamic_manifest"])
def test_features_meet_all_kinds_of_edits_in_one_join(name, spark, sf_dir):
    plan = logical(QUERIES[name](spark, sf_dir))
    assert plan.count("Join Inner") == 1 and "strategy=merge" in plan


def test_cells_are_kept_not_counted_again(spark, sf_dir):
    assert "o_orderkey" not in logical(QUERIES["U4_stale_cells"](spark, sf_dir))


def test_points_are_reduced_before_their_levels_are_made(spark, sf_dir):
    plan = logical(QUERIES["A4_cells_in_bound"](spark, sf_dir))
    assert "Aggregate" in plan[plan.index("Generate"):]


def test_measures_of_pairs_are_short_enough_to_be_compiled(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = QUERIES["W9_weighted_height"](spark, sf_dir)
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(int(part.split(";")[0]) for part in text.split("maxMethodCodeSize:")[1:]) < 8000


def test_instances_of_a_hierarchy_are_read_for_leaves_and_extents_alone(spark, sf_dir):
    from tilewright.catalog import tiles

    rows, nodes = tiles.leaf_boxes(spark, sf_dir)
    assert "o_orderkey" not in logical(rows) + logical(nodes)


def test_a_ring_is_worked_out_once_for_its_area(spark):
    from tilewright.operators.surfaces import ring_area

    ring = F.transform(F.sequence(F.lit(0), F.col("id").cast("int") + 3), lambda k: F.struct(F.cos(k.cast("double")).alias("x"), F.sin(k.cast("double")).alias("y")))
    assert logical(spark.range(1).select(ring_area(ring).alias("a"))).lower().count("sequence") == 1


def test_assets_stay_where_they_are_beside_few_contents(spark, monkeypatch):
    from tilewright.operators import shapes

    assets = spark.range(1000).select(F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("content"), F.col("id").alias("ord"))
    few = shapes.dedupe_content(assets, "content", "ord", [])
    assert "SortMergeJoin" not in plan_of(few)
    monkeypatch.setattr(shapes, "SMALL", 3)
    many = shapes.dedupe_content(assets, "content", "ord", [])
    assert "BroadcastHashJoin" not in plan_of(many)
    assert sorted(few.collect()) == sorted(many.collect()) and few.where("status = 'written'").count() == 7


def test_codes_of_points_are_not_made_once_per_level(spark, sf_dir, monkeypatch):
    from tilewright.operators import refine

    seen = []
    monkeypatch.setattr(refine, "checkpoint", lambda df: seen.append(logical(df)) or df.localCheckpoint())
    QUERIES["P2_refine_points"](spark, sf_dir)
    # rows per level come out of the counts; nothing is counted after them
    assert seen[0].index("Generate") < seen[0].index("Aggregate")


def test_tasks_grow_with_the_rows_they_multiply(spark, sf_dir, monkeypatch):
    from tilewright.sources import derived

    monkeypatch.setattr(derived, "DEALT", 1)
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    assert derived.LINE_VERTICES.frame(spark, sf_dir).rdd.getNumPartitions() >= rows


def cut_corners(points):
    out = [points[0]]
    for a, b in zip(points, points[1:]):
        cut = [tuple(p * (1 - t) + q * t for p, q in zip(a[:2], b[:2])) for t in (0.25, 0.75)]
        out += [a] if a[:2] == b[:2] else [(*cut[0], a[2]), (*cut[1], b[2])]
    return [*out, points[-1]]


def test_corners_are_cut_in_one_go_across_chunks(spark, sf_dir):
    from tilewright.operators import lines

    # repeated vertices before, on and behind the border of two chunks; the first of them are at the start
    flat = {0, 5, 32763, 32764, 32765, 32766, 32767, 32768, 32770}
    points, x = [], 0.0
    for i in range(32780):
        points.append((x, float((x * 7) % 5), float(i % 11)))
        x += 0.0 if i in flat else 1.0
    vertices = spark.createDataFrame([(1, i, *p) for i, p in enumerate(points)] + [(2, 0, 0.0, 0.0, 0.0), (2, 1, 4.0, 8.0, 1.0)], "line_id int, i long, x double, y double, z double")
    got = sorted(lines.smooth_corners(vertices, 3).select("line_id", "ord", "x", "y", "z").collect())
    for line, wanted in ((1, points), (2, [(0.0, 0.0, 0.0), (4.0, 8.0, 1.0)])):
        for _ in range(3):
            wanted = cut_corners(wanted)
        mine = [tuple(r[1:]) for r in got if r[0] == line]
        assert mine == [(i, *p) for i, p in enumerate(wanted)]
    assert "s_suppkey" not in logical(QUERIES["C18_corner_cutting"](spark, sf_dir))


def test_surface_points_meet_vertices_narrow_and_in_bounded_tasks(spark, monkeypatch):
    from tilewright.operators import drape

    monkeypatch.setattr(drape, "MET", 1, raising=False)
    place = lambda k, m: ((F.col("id") * k) % m).cast("double") / 3
    vertices = spark.range(150).select(F.col("id").alias("pid"), F.when(F.col("id") % 7 != 3, F.col("id") % 3).alias("road_id"), (place(37, 150) - 20).alias("px"), place(11, 13).alias("py"), (F.col("id") % 4).cast("double").alias("pz"))
    surface = spark.range(100).select(F.col("id").alias("surface_id"), (F.col("id") % 3).alias("road_id"), (place(53, 149) - 20).alias("sx"), place(7, 13).alias("sy"), (F.col("id") % 5 / 2).alias("sz"))
    out = drape.drape_to_points(vertices, surface, "pid")
    plan = logical(out)
    assert "bw" not in plan and "RepartitionByExpression" in plan
    faces = surface.collect()
    for v in out.collect():
        near = [(d, abs(s.sz - v.pz), s.surface_id, s.sz) for s in faces if s.road_id == v.road_id
                and (d := ((s.sx - v.px) ** 2 + (s.sy - v.py) ** 2) ** 0.5) <= 2 and abs(s.sz - v.pz) <= 1]
        assert v.z == (min(near)[3] if near else v.pz) + 0.02
    assert out.count() == 150 and out.where("face IS NOT NULL").count() > 20


@pytest.mark.parametrize("name, source", [("J5_nearest_line_measure", "o_orderkey"), ("J12_station_and_offset", "s_suppkey")])
def test_points_do_not_meet_their_nearest_items_again(name, source, spark, sf_dir):
    assert source not in logical(QUERIES[name](spark, sf_dir))


def test_pairs_of_near_copies_meet_in_the_longest_list_they_share():
    import pyarrow as pa
    from tilewright.llm import near_copies

    lists = [(5, [1, 2]), (9, [1, 2, 3]), (7, [2, 3])]
    members = pa.array([[{"sig": s, "n": 10} for s in sigs] for _, sigs in lists], pa.list_(pa.struct([("sig", pa.int64()), ("n", pa.int64())])))
    batch = pa.record_batch({"value": pa.array([v for v, _ in lists], pa.int64()), "members": members})
    homes = {}
    for out in near_copies._pairer(near_copies.Rule())(iter([batch])):
        for a, b, home in zip(*(out.column(c).to_pylist() for c in ("a", "b", "home"))):
            homes[a, b] = min(home, homes.get((a, b), home))
    assert sorted(homes) == [(1, 2), (1, 3), (2, 3)] and len(set(homes.values())) == 1


def test_parts_of_pairs_are_gone_when_texts_are_scored(spark, sf_dir):
    import glob
    from tilewright.session import shared_dir

    kept = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/pairs-*"))
    before = kept()
    QUERIES["op6_language_model"](spark, sf_dir)
    assert kept() == before
