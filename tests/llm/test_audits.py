"""Lexicon fingerprints, pivot clusters and the source audit against plain versions, on odd rows too."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.test_operators import ordered, sentence
from tilewright.llm import lexicon_prints, pivot_clusters, source_audit

TEXTS = "doc_id long, text string, term string, id string, mark string, copies string, edit string, body string, lang string, source string, n string, place string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, " ".join(sentence(rng, rng.randrange(1, 200), 300))) for i in range(60)]
    out += [(100, out[4][1]), (70, out[4][1]), (70, out[4][1]), (70, out[4][1]), (71, out[9][1])]
    out += [(200, None), (201, ""), (202, " \t"), (203, "One"), (None, "one two"), (None, None), (None, None)]
    return out + [(300, " ".join(sentence(rng, 30_000, 4000))), (301, "ä😀" * 5000)]


def whole_table(spark, rows):
    return spark.createDataFrame([(i, t, *"tkmcebxyzw") for i, t in rows], TEXTS).repartition(3)


def terms_of(text):
    return set(brute.ITEM_WORD.findall((text or "").translate(brute.LOWER)))


def plain_print(text, known):
    out, below = [], 36
    mine = {t: int(hashlib.md5(t.encode()).hexdigest()[:9], 16) for t in terms_of(text) & known}
    for bits, kept in lexicon_prints.LEVELS:
        below -= bits
        for j in range(kept):
            held = sorted((t for t, deal in mine.items() if deal >> below & (1 << bits) - 1 == j), key=str.encode)
            out.append(hashlib.md5(" ".join(held).encode()).hexdigest()[:8] if held else "")
    return out


def plain_likeness(a, b):
    some, same, at = [], [], 0
    for _, kept in lexicon_prints.LEVELS:
        pairs = list(zip(a[at: at + kept], b[at: at + kept]))
        some.append(sum(x != "" or y != "" for x, y in pairs))
        same.append(sum(x == y != "" for x, y in pairs))
        at += kept
    sparse = [i for i, (_, kept) in enumerate(lexicon_prints.LEVELS) if 4 * some[i] <= 3 * kept]
    if sum(some[i] for i in sparse):
        return sum(same[i] for i in sparse) / sum(some[i] for i in sparse)
    return sum(same) / sum(some) if sum(some) else 1.0


def plain_edits(rows, band):
    seen = Counter(t for _, text in rows for t in terms_of(text))
    known = {t for t, n in seen.items() if n >= band.least * len(rows) and n - band.grace <= band.most * len(rows)}
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(t or "")
    out = []
    # rows of one id are ordered by a hash of the text; these tables repeat an id with equal texts only
    line = [(i, t) for i in sorted(by_id, key=lambda i: (i is None, -(i or 0))) for t in sorted(by_id[i])]
    for (i, t), (_, after) in zip(line, line[1:] + line[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b, c = (plain_print(x, known) for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), ".".join(a), ".".join(b), plain_likeness(a, b), plain_likeness(a, c)))
    return out


@pytest.mark.parametrize("band", [lexicon_prints.Band(), lexicon_prints.Band(least=0.05, most=0.4, grace=0)])
def test_prints_of_texts_and_their_edits(spark, rows, band):
    rows = [r for r in rows if r != (None, "one two")]
    found = lexicon_prints.edit_prints(whole_table(spark, rows), band)
    got = [(r.doc_id, r.n_chars, r.edited_sha256, ".".join(r.print), ".".join(r.edited_print), r.near_edited, r.near_next) for r in found.collect()]
    assert ordered(got) == ordered(plain_edits(rows, band))
    assert len({g[3] for g in got if g[0] in (4, 70, 100)}) == 1


def test_prints_of_few_rows(spark, rows):
    for few in ([], rows[:1], [(1, "a b c")] * 3, [(None, None)], [(2, "b"), (1, "a"), (2, "b")]):
        got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in lexicon_prints.edit_prints(whole_table(spark, few)).collect()]
        assert ordered(got) == ordered([p[:3] for p in plain_edits(few, lexicon_prints.Band())])


def test_rows_of_one_id_follow_each_other(spark):
    rows = [(5, "alpha beta"), (5, "gamma delta"), (5, None), (None, "x y"), (4, "epsilon")]
    got = lexicon_prints.followers(whole_table(spark, rows)).collect()
    after = {(r.id, r.mark): (r.next_id, r.next_mark) for r in got}
    at = chain = next(iter(after))
    for n in range(1, 6):
        chain = after[chain]
        assert (chain == at) == (n == 5)
    assert lexicon_prints.edit_prints(whole_table(spark, rows)).count() == 5


def test_the_texts_are_dealt_out_once(spark, rows, tmp_path):
    """Both uses of the texts read one shuffle."""
    whole_table(spark, rows).select("doc_id", "text").write.parquet(str(tmp_path / "docs"))
    edits = lexicon_prints.half_edits(spark.read.parquet(str(tmp_path / "docs")))
    edits.write.format("noop").mode("overwrite").save()
    assert edits.collect() and "ReusedExchange" in edits._jdf.queryExecution().executedPlan().toString()


def plain_clusters(rows, k, rounds, size, scale):
    kept = [(i, [math.floor(Fraction(float(x)) * scale) for x in v], v) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    centroids = [r[1] for r in start[:k]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v, _ in kept:
            mine[near(v)[1]].append(v)
        centroids = [[sum(x) // len(mine[n]) for x in zip(*mine[n])] if mine[n] else c for n, c in enumerate(centroids)]
    named = [(i, *reversed(near(v))) for i, v, _ in kept]
    inertia = Counter()
    for _, c, d in named:
        inertia[c] += d
    fit = lambda x: x if x < 1 << 63 else None
    return [(i, c, fit(d), fit(inertia[c]), fit(sum(inertia.values())), ",".join(map(str, centroids[c]))) for i, c, d in named]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, cluster string, vector string").repartition(3)


def clusters(spark, rows, **options):
    return ordered(tuple(r) for r in pivot_clusters.clustered(vectors(spark, rows), **options).collect())


def test_clusters_are_those_of_all_distances(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(6, 8))
    rows = [(i, (middles[i % 6] + rng.normal(size=8) * 0.2).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (400, [0.0] * 8), (401, [0.0] * 8), (None, [1.0] * 8), (402, None), (403, [1.0] * 7), (404, [1.0] * 9), (405, [])]
    rows += [(406, [None] + [1.0] * 7), (407, [float("nan")] * 8), (408, [float("inf")] + [0.0] * 7), (409, [-0.5 / 64, 0.5 / 64] * 4)]
    want = plain_clusters(rows, 16, 3, 8, 64)
    assert clusters(spark, rows, size=8) == ordered(want)
    assert clusters(spark, rows, size=8, pivots=1) == ordered(want)
    assert clusters(spark, rows[:5], size=8) == ordered(plain_clusters(rows[:5], 16, 3, 8, 64))
    assert clusters(spark, [], size=8) == [] and clusters(spark, rows[-4:-1], size=8) == []
    lone = [(None, [1.0, 2.0]), (None, [3.0, 4.0])]
    assert clusters(spark, lone, size=2) == ordered(plain_clusters(lone, 16, 3, 2, 64))


def test_clusters_of_components_of_any_size(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randrange(0, 30) for _ in range(4)]) for i in range(40)]
    rows += [(100, [1.7e308, -1.7e308, 0.0, 1.0]), (101, [1.7e308, 0.0, 0.0, 1.0]), (102, [2.0 ** 20] * 4)]
    assert clusters(spark, rows, size=4, k=5) == ordered(plain_clusters(rows, 5, 3, 4, 64))


def test_bounds_are_never_above_the_distance_and_leave_work_out():
    rng = np.random.default_rng(5)
    centres = (rng.normal(size=(16, 64)) * 64).astype(np.int64)
    points = np.concatenate([c + rng.integers(-6, 7, size=(100, 64)) for c in centres])
    now = pivot_clusters.Round.of(centres.tolist(), centres[:8].tolist())
    cached = np.stack([pivot_clusters.measured(points, p) for p in centres[:8]], axis=1)
    low = pivot_clusters.bounds(cached, now)
    exact = np.stack([pivot_clusters.measured(points, c) for c in centres], axis=1)
    assert (low <= exact).all() and (low > 0).any()
    nearest, distance, count = pivot_clusters.assign(points, cached, now)
    assert (nearest == exact.argmin(axis=1)).all() and (distance == pivot_clusters.squared(points, centres[nearest])).all()
    assert count < 0.5 * exact.size


SPLIT = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, least, most):
    of, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = SPLIT.findall((text or "").translate(brute.LOWER))
        groups.add((lang or "", source or ""))
        of[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang, source in groups:
        kept = {t for t, n in docs[lang].items() if n >= least}
        all_ = Counter()
        for (x, _), c in of.items():
            if x == lang:
                all_.update({t: n for t, n in c.items() if t in kept})
        price = lambda c: {t: 1 + 10 ** 9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = price(of[lang, source]), price(all_)
        pairs = [(sum(abs(p[t] - r[t]) for t in kept), other) for x, other in groups if x == lang and other != source for r in [price(of[x, other])]]
        terms = [(p[t] - q[t], t) for t in kept if of[lang, source][t] and p[t] > q[t]]
        for part, items, limit in (("pair", pairs, len(pairs)), ("term", terms, most)):
            items.sort(key=lambda i: (-i[0], i[1].encode()))
            out += [(lang, source, part, item, value, n + 1) for n, (value, item) in enumerate(items[:limit])]
    return out


@pytest.fixture(scope="module")
def sourced():
    rng = random.Random(6)
    out = []
    for i in range(160):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "b", "b", "ü", None, ""])
        out.append((" ".join(sentence(rng, rng.randrange(0, 120), 40 if source == "b" else 90)), lang, source))
    return out + [(None, "en", "none"), ("7 8 9", "xx", "only"), ("alone", "yy", "p"), (None, "yy", "q"), ("AÄa " * 3000, "de", "b"), (None, None, None)]


def audit_frame(spark, rows):
    return spark.createDataFrame([(1, t, a, b, "x", "y", "z") for t, a, b in rows], "doc_id long, text string, lang string, source string, term string, n string, total string").repartition(3)


@pytest.mark.parametrize("shape", [(2048, 64, 1024), (7, 2, 5)])
def test_the_audit_prices_every_term(spark, sourced, shape, monkeypatch):
    for name, value in zip(("TERMS", "SOURCES", "COLUMNS"), shape):
        monkeypatch.setattr(source_audit, name, value)
    got = source_audit.audit(audit_frame(spark, sourced), least_docs=5, most=4).collect()
    assert ordered(map(tuple, got)) == ordered(plain_audit(sourced, 5, 4))
    assert source_audit.audit(audit_frame(spark, sourced[:0])).count() == 0


def test_level_prices_of_very_large_counts():
    levels = np.array([0, 3, 10 ** 13])
    assert source_audit.level_prices(levels, 10 ** 13 + 3, 2).tolist() == [1 + 10 ** 9 * (int(x) + 5) // (10 ** 13 + 13) for x in levels]
