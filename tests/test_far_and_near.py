"""Farthest points and pairs, and nearest shapes, against brute force."""

import math
import random

import pytest

from pointweave.operators import spatial as sp

SCHEMA = "item_id long, point_id long, x double, y double, z double"


def sphere(n, seed=1, item=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(3)]
        out.append((item, item * 100_000 + i, *(c / math.hypot(*v) for c in v)))
    return out


def longest(rows):
    return min((-round(sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])), 9), a[1], b[1]) for a in rows for b in rows if a[1] < b[1])


def test_farthest_pair(spark, monkeypatch):
    monkeypatch.setattr(sp, "FEW", 4)
    groups = [sphere(400), [(1, 100_000 + i, 2.0, 2.0, 2.0) for i in range(5)], [(2, 200_000 + i, float(i % 2), 0.0, 0.0) for i in range(9)], [(3, 300_000, 0.0, 0.0, 1e9), (3, 300_001, 0.0, 0.0, 1e9 + 1)]]
    got = {r.item_id: (r.a, r.b) for r in sp.farthest_pair(spark.createDataFrame([r for g in groups for r in g], SCHEMA), ["item_id"]).collect()}
    assert got == {g[0][0]: longest(g)[1:] for g in groups}


def test_farthest_pair_of_many_points_on_a_sphere(spark):
    """Nearly all points end a nearly longest pair; the pairs compared grow with the points and not their square."""
    n = 30_000
    df = spark.createDataFrame(sphere(n, 5), SCHEMA)
    (row,) = sp.farthest_pair(df, ["item_id"]).collect()
    assert row.length > 1.9999


def greedy(rows, k):
    rows = sorted(rows, key=lambda r: r[1])
    gaps = [math.inf] * len(rows)
    out, best = [], 0
    while len(out) < min(k, len(rows)):
        out.append(rows[best][1])
        gaps = [min(g, round(sum((p - q) ** 2 for p, q in zip(r[2:], rows[best][2:])), 12)) for g, r in zip(gaps, rows)]
        gaps[best] = -1
        gaps = [-1 if r[1] in out else g for g, r in zip(gaps, rows)]
        best = max(range(len(rows)), key=lambda i: (gaps[i], -i))
    return out


@pytest.mark.parametrize("candidates", [512, 12])
def test_farthest_points_in_batches(spark, monkeypatch, candidates):
    monkeypatch.setattr(sp, "CANDIDATES", candidates)
    rng = random.Random(3)
    groups = [[(0, i, rng.random(), rng.random(), rng.random()) for i in range(120)], [(1, 1000 + i, float(i // 4), float(i % 4), 0.0) for i in range(24)], [(2, 2000 + i, 1.0, 1.0, 1.0) for i in range(4)]]
    rounds = []
    durable = sp.durable
    monkeypatch.setattr(sp, "durable", lambda df, name: rounds.append(name) or durable(df, name))
    out = sp.farthest_points(spark.createDataFrame([r for g in groups for r in g], SCHEMA), 20, ["item_id"]).collect()
    for g in groups:
        got = [r.point_id for r in sorted((r for r in out if r.item_id == g[0][0]), key=lambda r: r.rank)]
        assert got == greedy(g, 20)
    assert rounds.count("gaps") <= (3 if candidates == 512 else 16)


def segments(rng, item, shift, n):
    out = []
    for i in range(n):
        a = [rng.random() + shift for _ in range(3)]
        b = [c + rng.uniform(-0.1, 0.1) * (30 if i == 0 else 1) for c in a]
        out.append((item, item * 1000 + i, *a, *b))
    return out


def reach(p, s):
    a, b = s[2:5], s[5:8]
    d = [y - x for x, y in zip(a, b)]
    n = sum(x * x for x in d)
    t = 0 if n == 0 else max(0.0, min(1.0, sum((q - x) * y for q, x, y in zip(p, a, d)) / n))
    return math.dist(p, [x + t * y for x, y in zip(a, d)])


def test_nearest_segments_of_groups_far_apart(spark):
    rng = random.Random(8)
    shapes = segments(rng, 0, 0.0, 60) + segments(rng, 1, 10_000.0, 60) + [(2, 2000, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0), (3, 3000, 0.0, 0.0, 0.0, 1e-3, 0.0, 0.0), (3, 3001, 1e6, 0.0, 0.0, 1e6 + 1, 0.0, 0.0)]
    points = [(item, item * 1000 + i, *(rng.random() + shift for _ in range(3))) for item, shift in ((0, 0.0), (1, 10_000.0), (2, 5.0), (3, 0.0)) for i in range(20)] + [(0, 99, 500.0, -70.0, 3.0), (2, 2099, 5.0, 5.0, 5.0)]
    names = "item_id long, seg_id long, ax double, ay double, az double, bx double, by_ double, bz double"
    rounds = []
    durable = sp.durable
    sp.durable = lambda df, name: rounds.append(name) or durable(df, name)
    try:
        got = {r.point_id: (r.seg_id, r.distance) for r in sp.nearest_segment(spark.createDataFrame(points, SCHEMA), spark.createDataFrame(shapes, names), ["item_id"]).collect()}
    finally:
        sp.durable = durable
    assert len(got) == len(points)
    for item, point_id, *p in points:
        own = sorted((round(reach(p, s), 12), s[1]) for s in shapes if s[0] == item)
        assert got[point_id][1] == pytest.approx(own[0][0], abs=1e-9) and got[point_id][0] in {i for d, i in own if d - own[0][0] < 1e-9}


def test_nearest_vectors_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(sp, "VECTORS", 7)
    rng = random.Random(11)
    rows = [(i % 2, i, [float(rng.randrange(3)) for _ in range(5)]) for i in range(50)] + [(2, 90, [1.0] * 5)]
    got = {}
    for r in sp.knn_feature(spark.createDataFrame(rows, "g long, id long, v array<double>"), 4, "g", "id", "v").collect():
        got.setdefault(r.id, []).append((r["rank"], r.d2, r.other))
    for g, i, v in rows:
        want = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for h, j, w in rows if h == g)[:4]
        assert [(d, o) for _, d, o in sorted(got[i])] == want
