"""Subsets with spacing, and nearest points of groups without extent."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pointweave.operators import spatial as sp

SCHEMA = "item_id long, point_id long, x double, y double, z double"


def gap(p, q):
    return math.dist(p[2:], q[2:])


def cloud(n, items=2, seed=1):
    rng = random.Random(seed)
    return [(i % items, i, rng.random(), rng.random() * 0.3, 0.0) for i in range(n)]


@pytest.mark.parametrize("rows,radius", [([(0, i, float(i), 0.0, 0.0) for i in range(200)], 1.5), (cloud(150), 0.1), ([(0, i, 0.0, 0.0, 0.0) for i in range(9)], 0.5)])
def test_thinned_points_are_a_maximal_spaced_subset(spark, rows, radius):
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r.point_id for r in sp.thin(df, radius, ["item_id"], 3).collect()}
    own = [r for r in rows if r[1] in kept]
    for a in own:
        assert all(a[0] != b[0] or a[1] == b[1] or gap(a, b) > radius for b in own)
    for r in rows:
        assert r[1] in kept or any(r[0] == b[0] and gap(r, b) <= radius for b in own)


def test_wanted_number_with_spacing(spark):
    rows = cloud(120) + [(5, 1000 + i, 7.0, 7.0, 7.0) for i in range(4)] + [(6, 2000, 1.0, 1.0, 1.0)] + [(7, 3000 + i, 0.0, float(i // 3), 0.0) for i in range(9)]
    got = sp.spaced_sample(spark.createDataFrame(rows, SCHEMA), 8, ["item_id"], 3).collect()
    at = {r[1]: r for r in rows}
    by = {}
    for r in got:
        by.setdefault(r.item_id, []).append((r.spacing, at[r.point_id]))
    assert {k: len(v) for k, v in by.items()} == {0: 8, 1: 8, 5: 4, 6: 1, 7: 8}
    for members in by.values():
        least = min(s for s, _ in members)
        assert all(a[1] == b[1] or gap(a, b) > least or least == 0 for _, a in members for _, b in members)
    # a group of equal points has no spacing, and copies come after the places of their own
    assert {s for s, _ in by[5]} == {0.0} and len({p[3] for s, p in by[7] if s > 0}) == 3
    assert min(s for s, _ in by[0]) > 0.05


@pytest.mark.parametrize("rows", [
    [(0, 1, 1e9, 1e9, 1e9)],
    [(0, i, 5.0, 5.0, 5.0) for i in range(6)],
    [(0, i, 1e9 + i * 1e-3, -1e9, 0.0) for i in range(30)],
    [(0, 0, 0.0, 0.0, 0.0), (0, 1, 1e-300, 0.0, 0.0), (0, 2, 1e-290, 0.0, 0.0)],
    [(0, i, 0.0, 0.0, 0.0) for i in range(50)] + [(0, 99, 1e12, 0.0, 0.0)],
])
def test_nearest_points_of_odd_groups(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in sp.knn(df, df, 2, ["item_id"]).collect():
        got.setdefault(r.point_id, []).append((r.rank, r.d2, r.other))
    for p in rows:
        want = sorted((sum((a - b) ** 2 for a, b in zip(p[2:], q[2:])), q[1]) for q in rows)[:2]
        assert [(d, o) for _, d, o in sorted(got[p[1]])] == want
    assert sp.chamfer(df, df, ["item_id"]).count() == 1
