"""Edge rows and invariants on small frames; brute force where SQL is too slow."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import cells, geodesy as g, predicates as p, text as t
from tilewright.operators import boxes, chains, lines, nearest, ordering, refine, surfaces_cells, tiles
from tilewright.sources import files, layers
from tilewright.streaming import jobs


def bisect_hash(lng, lat, n):
    lo, hi, bits = [-180.0, -90.0], [180.0, 90.0], []
    for k in range(5 * n):
        a, v = (0, lng) if k % 2 == 0 else (1, lat)
        mid = (lo[a] + hi[a]) / 2
        bits.append(int(v >= mid))
        (lo if v >= mid else hi)[a] = mid
    return "".join(cells.ALPHABET[int("".join(map(str, bits[i:i + 5])), 2)] for i in range(0, 5 * n, 5))


def test_hash_matches_bisection_also_on_edges(spark):
    rnd = random.Random(7)
    pts = [(rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for _ in range(300)] + [(0.0, 0.0), (-180.0, -90.0), (45.0, 22.5), (117.0703125, 31.2890625)]
    df = spark.createDataFrame(pts, "lng double, lat double")
    got = df.select("lng", "lat", *[cells.point_hash(F.col("lng"), F.col("lat"), n).alias(f"h{n}") for n in (3, 6, 11)]).collect()
    for r in got:
        for n in (3, 6, 11):
            assert r[f"h{n}"] == bisect_hash(r.lng, r.lat, n)


def test_code_round_trip_parent_and_box(spark):
    df = spark.createDataFrame([("wte1yr",), ("s00000",), ("zzzzzz",)], "h string")
    code = cells.hash_to_code(F.col("h"), 6)
    row = df.select("h", cells.code_to_hash(code, 6).alias("b"), cells.code_to_hash(cells.ancestor_code(code, 6, 4), 4).alias("up"),
                    cells.code_to_hash(cells.parent_code(code, F.lit(6)), 5).alias("parent")).collect()
    assert all(r.b == r.h and r.up == r.h[:4] and r.parent == r.h[:5] for r in row)


def test_sql_functions(spark):
    cells.register_sql_functions(spark)
    r = spark.sql("SELECT cell_of(117.3D, 31.2D, 7) AS h, cell_parent('wte1') AS p, size(cell_children('w')) AS n, cell_west('wte1yr') AS w").first()
    assert r.h == bisect_hash(117.3, 31.2, 7) and r.p == "wte" and r.n == 32 and abs(r.w - 116.99340820) < 1e-6


@pytest.mark.parametrize("total,non_empty,largest,split", [(101, 32, 4, True), (100, 10, 20, True), (99, 10, 50, False), (9, 1, 9, False), (10, 1, 10, True), (0, 0, 0, False)])
def test_density_rule_truncates(spark, total, non_empty, largest, split):
    df = spark.createDataFrame([(total, non_empty, largest)], "a bigint, b bigint, c bigint")
    assert df.select(refine.density_rule(F.col("a"), F.col("b"), F.col("c"))).first()[0] is split


def test_refinement_conserves_points_and_nests(spark):
    rnd = random.Random(3)
    rows = [(i, 117.2 + rnd.random() ** 4 * 0.3, 31.2 + rnd.random() ** 4 * 0.2, "a.glb" if i % 5 else "a.txt") for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, lng double, lat double, model string")
    tree = refine.refine_points(df, (117.0, 31.0, 117.8, 31.6)).cache()
    leaf = refine.describe_cells(refine.leaves(tree)).collect()
    assert sum(r.total_count for r in leaf) == sum(1 for r in rows if r[3] == "a.glb")
    names = sorted(r.geohash for r in leaf)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_boxes_meet_like_brute_force(spark):
    rnd = random.Random(1)
    def some(n, s):
        return [(i, x, y, x + rnd.random() * s, y + rnd.random() * s) for i, (x, y) in enumerate((rnd.random() * 10, rnd.random() * 10) for _ in range(n))]
    a, b = some(80, 3.0), some(90, 0.5) + [(500, 1.0, 1.0, 1.0, 1.0)] * 1
    left = spark.createDataFrame(a, "id int, w double, s double, e double, n double")
    right = spark.createDataFrame(b, "bid int, bw double, bs double, be double, bn double")
    got = sorted((r.id, r.bid) for r in boxes.overlapping(left, right, 0.7).select("id", "bid").collect())
    want = sorted((i, j) for i, w, s, e, n in a for j, bw, bs, be, bn in b if bw <= e and be >= w and bs <= n and bn >= s)
    assert got == want


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_is_exact_with_a_dense_cluster(spark, k):
    rnd = random.Random(k)
    items = [(i, rnd.gauss(50, 0.05), rnd.gauss(50, 0.05)) for i in range(200)] + [(1000 + i, rnd.random() * 100, rnd.random() * 100) for i in range(20)]
    pts = [(i, rnd.random() * 120 - 10, rnd.random() * 120 - 10) for i in range(60)]
    it = spark.createDataFrame([(i, x, y, x, y) for i, x, y in items], "bid int, bw double, bs double, be double, bn double")
    pt = spark.createDataFrame(pts, "pid int, px double, py double")
    d = F.hypot(F.col("px") - F.col("bw"), F.col("py") - F.col("bs"))
    got = sorted((r.pid, r["rank"], r.bid) for r in nearest.nearest(pt, it, "pid", d, ["bid"], ["bid"], 0.5, k=k).collect())
    want = sorted((i, n + 1, b) for i, x, y in pts for n, (_, b) in enumerate(sorted((math.hypot(x - u, y - v), b) for b, u, v in items)[:k]))
    assert got == want


def parts_frame(spark, rows):
    ends = spark.createDataFrame(rows, "part_id int, grp int, length double, sx double, sy double, sz double, sdx double, sdy double, ex double, ey double, ez double, edx double, edy double, reverse boolean")
    return chains.logical_ends(ends)


def part(i, x0, x1, **kw):
    row = dict(part_id=i, grp=0, length=float(abs(x1 - x0)), sx=float(x0), sy=0.0, sz=0.0, sdx=1.0, sdy=0.0, ex=float(x1), ey=0.0, ez=0.0, edx=1.0, edy=0.0, reverse=False)
    row.update(kw)
    return tuple(row.values())


def test_branch_stops_all_arms_and_reversed_part_joins(spark):
    rows = [part(1, 0, 10), part(2, 10, 20), part(3, 20, 30), part(4, 20, 25), part(5, 0, 8, sy=50.0, ey=50.0),
            part(6, 16, 8, sy=50.0, ey=50.0, sdx=-1.0, edx=-1.0, reverse=True)]
    rows[5] = part(6, 16, 8, sy=50.0, ey=50.0, sdx=-1.0, edx=-1.0, reverse=True)
    ends = parts_frame(spark, rows)
    got = sorted((r.part_id, r.next) for r in chains.links(ends).collect())
    assert (1, 2) in got and not any(a == 2 for a, _ in got)
    assert all(b != 5 for a, b in got)


def test_loops_start_at_smallest_key_and_have_no_end(spark):
    ids = spark.createDataFrame([(i, 10.0) for i in range(1, 8)], "part_id int, length double")
    linked = spark.createDataFrame([(3, 1), (1, 2), (2, 3), (4, 5), (5, 6)], "part_id int, next int")
    got = {r.part_id: (r.chain, r.offset, r.include_end) for r in chains.chain_offsets(ids, linked).collect()}
    assert got == {1: (1, 0.0, False), 2: (1, 10.0, False), 3: (1, 20.0, False), 4: (4, 0.0, False), 5: (4, 10.0, False), 6: (4, 20.0, True), 7: (7, 0.0, True)}


def test_long_line_is_cut_into_chunks_with_the_same_stations(spark, monkeypatch):
    monkeypatch.setattr(lines, "CHUNK", 16)
    monkeypatch.setattr(lines.with_halo, "__defaults__", (16,))
    monkeypatch.setattr(lines.chunk_of, "__defaults__", (16,))
    v = spark.range(200).select(F.lit(1).alias("line_id"), F.col("id").alias("i"), (F.col("id") * 2.0).alias("x"), F.lit(0.0).alias("y"),
                                F.when(F.col("id") % 50 == 0, F.col("id") * 1.0).alias("z0"))
    st = lines.stations(lines.segments_of(v.withColumn("z", F.lit(0.0)))).collect()
    assert len(st) == 199 and all(r.s0 == r.i * 2.0 and r.total == 398.0 for r in st)
    filled = lines.fill_unmatched(v.select("line_id", F.col("i").alias("ord"), (F.col("i") * 2.0).alias("station"), F.col("z0").alias("z"))).collect()
    assert all(abs(r.filled - min(r.ord, 150)) < 1e-9 for r in filled)


def test_zero_length_segments_do_not_count(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 0.0, 0.0, 0.0), (1, 2, 3.0, 4.0, 0.0)], "line_id int, i bigint, x double, y double, z double")
    assert [(r.length, r.segments) for r in lines.line_length(lines.segments_of(v)).collect()] == [(5.0, 1)]


def test_slices_keep_area_and_stay_inside(spark):
    rnd = random.Random(5)
    rows = [(1, i, *[rnd.random() * 100 for _ in range(9)]) for i in range(40)]
    df = spark.createDataFrame(rows, "road_id int, tri_id int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, x3 double, y3 double, z3 double")
    cut = surfaces_cells.slice_triangles(df, 13.0).collect()
    area = sum(abs((r[5] - r[2]) * (r[9] - r[3]) - (r[8] - r[2]) * (r[6] - r[3])) / 2 for r in rows)
    assert abs(sum(r.area for r in cut) - area) < area * 1e-9
    assert all(r.gx * 13 - 1e-9 <= q.x <= r.gx * 13 + 13 + 1e-9 and r.gy * 13 - 1e-9 <= q.y <= r.gy * 13 + 13 + 1e-9 for r in cut for q in r.poly)


def test_ranks_with_one_key_holding_most_rows(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("k"), (5000 - F.col("id")).alias("o"))
    got = ordering.ranked(df, ["k"], ["o"]).where("k = 0").orderBy("o").collect()
    assert [r.pos for r in got] == list(range(1, 4501))


def test_grouping_of_a_level_three_leaf(spark):
    df = spark.createDataFrame([("wte", 0.0, 4), ("wtb12", 8.0, 1)], "geohash string, error double, instances int")
    got = {r.node: (r.parent, r.error) for r in tiles.roll_up(df, 16.0).collect()}
    assert got["wt"] == ("root", 16.0) and got["wtb1"] == ("wtb", 16.0) and got["wtb"] == ("root", 32.0) and got["root"] == (None, 64.0)


def test_single_child_box_is_kept(spark):
    box = [1.0, 2.0, 3.0, 4.0, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 6.0]
    df = spark.createDataFrame([("p", "a", box), ("q", "a", box), ("q", "b", [v + 20 if i == 0 else v for i, v in enumerate(box)])], "up string, o string, box array<double>")
    got = {r.up: r.box for r in tiles.merge_boxes(df, "up", "o").collect()}
    assert got["p"] == box and abs(got["q"][0] - 11.0) < 1e-9 and abs(got["q"][3] - 14.0 * 1.05) < 1e-9


def test_manifest_links_are_relative_to_their_document(spark):
    rows = [("root", None, 8.0, None), ("wte", "root", 4.0, None)] + [("wte" + c, "wte", 2.0, "tiles/" + c) for c in "bcd"]
    df = spark.createDataFrame([(*r, [0.0] * 12) for r in rows], "geohash string, parent string, error double, uri string, box array<double>")
    one = tiles.manifests(df, 9, "t").collect()
    two = {r.path: r.content for r in tiles.manifests(df, 3, "t").collect()}
    assert [r.path for r in one] == ["tileset.json"] and one[0].content.count('"uri":"tiles/') == 3
    assert sorted(two) == ["subtilesets/w/wte/tileset.json", "tileset.json"]
    assert two["subtilesets/w/wte/tileset.json"].count('"uri":"../../../tiles/') == 3


def test_spheres_are_folded_in_order(spark):
    def fold(rows):
        x, y, z, r = rows[0]
        for a, b, c, q in rows[1:]:
            d = math.dist((x, y, z), (a, b, c))
            if r >= d + q:
                continue
            if q >= d + r:
                x, y, z, r = a, b, c, q
                continue
            g = (d + r + q) / 2
            t = (g - r) / d
            x, y, z, r = x + (a - x) * t, y + (b - y) * t, z + (c - z) * t, g
        return x, y, z, r

    rnd = random.Random(9)
    rows = [(k, n * 10**11 * (-1) ** k, *(rnd.random() * 50 for _ in range(3)), rnd.random() * 5) for k in (1, 2, 3) for n in range(40)]
    got = {r.k: (r.x, r.y, r.z, r.r) for r in tiles.merge_spheres(spark.createDataFrame(rows, "k int, o bigint, x double, y double, z double, r double").repartition(5), "k", "o").collect()}
    for k in (1, 2, 3):
        want = fold([r[2:] for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])])
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[k], want))


def test_piles_loops_and_branches_of_parts(spark):
    loop = dict(ex=0.0, ey=0.0, edx=1.0)
    rows = [part(i, 0, 0, length=4.0, **loop) for i in (1, 2, 3, 4)]
    rows += [part(10, 100, 110), part(11, 110, 120), part(12, 200, 210), part(13, 200, 210), part(14, 200, 210), part(15, 210, 220), part(20, 300, 310), part(21, 310, 320), part(22, 310, 320), part(23, 310, 330)]
    rows += [part(30, 400, 400.04), part(31, 400.04, 410), part(40, 500, 500.03)]
    got = sorted((r.part_id, r.next) for r in chains.links(parts_frame(spark, rows)).collect())
    want = []
    frame = parts_frame(spark, rows).collect()
    meets = {p.part_id: [q.part_id for q in frame if (p.part_id == q.part_id) == p.closed and (p.part_id == q.part_id or not q.closed) and math.hypot(p.ex - q.sx, p.ey - q.sy) <= 0.05] for p in frame}
    for p, to in meets.items():
        if len(to) == 1 and sum(to[0] in other for other in meets.values()) == 1:
            want.append((p, to[0]))
    assert got == sorted(want) and {(1, 1), (2, 2), (3, 3), (4, 4), (10, 11)} <= set(got)


def test_vertical_moves_have_no_direction_and_no_station(spark):
    line = [(0.0, 0.0, 0.0), (0.0, 0.0, 2.0), (5.0, 0.0, 2.0), (5.0, 0.0, 3.0), (10.0, 0.0, 3.0), (10.0, 0.0, 9.0)]
    v = spark.createDataFrame([(1, i, *p) for i, p in enumerate(line)], "line_id int, i bigint, x double, y double, z double")
    st = lines.stations(lines.segments_of(v))
    posts = sorted((r.station, r.x, r.z, r.fx) for r in lines.samples_at(st, lines.post_stations(4.0)).collect())
    assert posts == [(0.0, 0.0, 2.0, 1.0), (4.0, 4.0, 2.0, 1.0), (8.0, 8.0, 3.0, 1.0), (10.0, 10.0, 3.0, 1.0)]
    assert sorted(r.ord for r in lines.vertices_of(st).collect()) == [0, 1, 2, 3, 4, 5]
    end = chains.part_ends(st.withColumnRenamed("line_id", "part_id")).first()
    assert (end.sz, end.ez, end.sdx, end.edx) == (0.0, 9.0, 1.0, 1.0)


def test_wkt_and_points(spark):
    df = spark.createDataFrame([("POLYGON Z ((0 0 1, 2 0 1, 2 2 1, 0 0 1))",), ("POLYGON ((0 0, 1 1, 0 0))",), ("LINESTRING (0 0, 1 1)",), (None,)], "w string")
    assert [None if r[0] is None else len(r[0]) for r in df.select(files.parse_polygon(F.col("w"))).collect()] == [3, None, None, None]
    pt = spark.createDataFrame([("POINT Z (1 2 3)",), ("POINT(1.5 -2e0)",), ("POINT (a b)",)], "w string")
    assert [r[0] and tuple(r[0]) for r in pt.select(files.parse_point(F.col("w"))).collect()] == [(1.0, 2.0, 3.0), (1.5, -2.0, 0.0), None]


def test_ids_beyond_double_precision_survive(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, 117.1, 31.1, 0.0, "a.glb", 1.0, None)], "id bigint, lng double, lat double, alt double, model string, obj_angle double, transform array<double>")
    spec = layers.LayerSpec("x", "hdX", extra=("obj_angle", "transform"))
    assert layers.scan_layer(df, spec, (117.0, 31.0, 118.0, 32.0)).first().id == str(big)


def test_wrong_configuration_is_refused(spark):
    with pytest.raises(ValueError):
        p.category_filter(F.col("a"), [])
    with pytest.raises(ValueError):
        t.spark_type("blob")
    with pytest.raises(ValueError):
        layers.Registry().run("nothing", None)


def test_vertical_pitch_gives_roll_to_heading(spark):
    df = spark.createDataFrame([(30.0, 90.0, 0.0)], "h double, p double, r double")
    q = g.quaternion(F.col("h"), F.col("p"), F.col("r"))
    h, pi, r = df.select(*g.euler(*q)).first()
    assert abs(h - 30) < 1e-5 and abs(pi - 90) < 1e-5 and r == 0.0


def test_stream_upserts_over_several_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k bigint, v bigint, t timestamp"
    for n in range(3):
        spark.range(10).select((F.col("id") % (4 + n)).alias("k"), (F.col("id") + n * 100).alias("v"), F.timestamp_seconds(F.col("id") + n * 1000).alias("t")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    latest = stream.groupBy("k").agg(F.max("t").alias("t"), F.max("v").alias("v"))
    jobs.run_available(latest, out, "update", jobs.upsert_batches(out, ["k"], "t"))
    got = {r.k: r.v for r in jobs.newest_version(spark, out).collect()}
    want = {r.k: r.v for r in spark.read.parquet(src).groupBy("k").agg(F.max("v").alias("v")).collect()}
    assert got == want


def test_stream_rebuild_empties_touched_cells(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, rows in enumerate([[(1, 5), (2, 6)], [(3, 5), (3, 7)], [(-1, 6)]]):
        spark.createDataFrame(rows, "v bigint, cell bigint").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("v bigint, cell bigint").option("maxFilesPerTrigger", 1).parquet(src)
    got = jobs.incremental_rebuild(stream, lambda b: (b.where("v > 0"), b.select("cell")), out, ["cell"]).collect()
    assert sorted(tuple(r) for r in got) == [(3, 5), (3, 7)]


def test_rotations_of_small_groups_and_of_lines(spark):
    from tilewright.operators import shapes

    rows = [(g, k, x * size, y * size, z * size, x * size + 1, y * size + 2, z * size + 3) for g, size in ((1, 0.005), (2, 5.0)) for k, (x, y, z) in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)])]
    rows += [(3, k, float(k), 2.0 * k, 0.0, float(k), 2.0 * k, 0.0) for k in range(4)]
    df = spark.createDataFrame([(g, k, *map(float, v)) for g, k, *v in rows], "grp int, k int, mx double, my double, mz double, tx double, ty double, tz double")
    out, _ = shapes.solve_registration(df)
    assert sorted(r.grp for r in out.collect()) == [1, 2]
    assert [(r.grp, r.n) for r in shapes.unsolvable(df).collect()] == [(3, 4)]


def test_queries_load_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 100"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0


def test_archives_with_binary_properties_and_unknown_tiles(spark, tmp_path):
    import json
    import struct

    from tilewright.sources import assets

    def tile(kind, head, features, table, binary=b""):
        f, t = (json.dumps(x).encode() for x in (features, table))
        body = struct.pack("<4I", len(f), 0, len(t), len(binary)) + (struct.pack("<I", 1) if kind == b"i3dm" else b"") + f + t + binary
        return kind + struct.pack("<2I", 1, len(body) + 12) + body

    one = tile(b"b3dm", 28, {"BATCH_LENGTH": 3}, {"id": {"byteOffset": 4, "componentType": "UNSIGNED_INT", "type": "SCALAR"}}, struct.pack("<4I", 9, 70000, 2, 3))
    two = tile(b"i3dm", 32, {"INSTANCES_LENGTH": 1}, {"id": [5.0]})
    other = b"pnts" + struct.pack("<2I", 1, 16) + b"...."
    inner = one + other + two
    for name, data in {"a.b3dm": one, "b.cmpt": b"cmpt" + struct.pack("<3I", 1, 16 + len(inner), 3) + inner, "c.b3dm": one[:40], "d.b3dm": b"oops"}.items():
        (tmp_path / name).write_bytes(data)
    got = sorted((r.path[-6:], r.feature_index if r.feature_index is not None else -1, r.feature_id, r.problem is not None) for r in assets.archive_index(spark, str(tmp_path)).collect())
    assert got == [("a.b3dm", 0, "70000", False), ("a.b3dm", 1, "2", False), ("a.b3dm", 2, "3", False), ("b.cmpt", 0, "70000", False), ("b.cmpt", 1, "2", False),
                   ("b.cmpt", 2, "3", False), ("b.cmpt", 3, "5", False), ("c.b3dm", -1, None, True), ("d.b3dm", -1, None, True)]
