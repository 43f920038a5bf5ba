"""The pipeline over the small tables and over odd rows, each stage judged on its own input."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm import brute
from tilewright.llm.shared import stored

KINDS = "doc_id long, text string, lang string, source string, n_chars long, score string, found string, gone string, mark string, row string"


def test_stages_on_odd_rows(spark, sf_dir):
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    base = prose(200)
    rows = [(i, prose(120)) for i in range(8)] + [(20, base), (21, base + " more"), (22, base), (22, base), (30, None), (31, ""), (None, prose(60)), (None, None)]
    rows += [(40, f"{prose(30)} {bench[0].text} {prose(30)}"), (41, f"{prose(40)} token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff {prose(40)}")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or ""), *"sfgmr") for i, t in rows], KINDS)
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, sf_dir), name)
        seen[name] = now
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    near = seen["near_copies"].collect()
    assert [r.doc_id for r in near if r.doc_id in (21, 22)] == [] and {20, 30, 31, 40, 41} <= {r.doc_id for r in near}
    assert sum(r.doc_id is None for r in near) == 2
    clean = seen["decontamination"].collect()
    assert {r.doc_id for r in near} - {r.doc_id for r in clean} == {40}
    masked = {r.doc_id: r for r in seen["secrets"].collect()}
    assert "[secret]" in masked[41].text and not brute.secret_spans(masked[41].text) and masked[41].n_chars == len(masked[41].text)
    packed = seen["packing"].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean}


def test_one_row_of_each_group_where_ids_repeat_or_are_null(spark, sf_dir):
    rng = random.Random(9)
    x, y, z, u, alone = (" ".join(f"w{rng.randrange(3000)}" for _ in range(120)) for _ in range(5))
    rows = [(3, y), (7, x), (7, y + " more"), (9, x), (None, z), (None, z), (None, z + " more"), (12, u), (12, u), (12, u), (None, alone), (30, ""), (30, None)]
    docs = spark.createDataFrame([(i, t, "en", f"src{n}", len(t or ""), *"sfgmr") for n, (i, t) in enumerate(rows)], KINDS)
    got = corpus_pipeline.keep_one_of_each(spark, docs, sf_dir)
    assert got.columns == docs.columns
    got = [(r.doc_id, r.text) for r in got.collect()]
    nulls = [t for i, t in got if i is None]
    assert sorted((i, t or "") for i, t in got if i is not None) == sorted([(3, y), (7, x), (12, u), (30, ""), (30, "")])
    assert len(nulls) == 2 and alone in nulls and {z, z + " more"} & set(nulls)


def test_run_on_the_small_tables(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_stages_on_an_empty_table(spark, sf_dir):
    now = spark.createDataFrame([], KINDS)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
        assert now.count() == 0
