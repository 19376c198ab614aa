"""Graphs and balls of crowded places, found without listing their pairs, against brute force."""

import numpy as np
import pytest

from pointweave.operators import graph as gr
from pointweave.operators import spatial as sp

R = 0.3


@pytest.fixture(scope="module")
def crowd():
    """Two discs face to face, joined by one pair of inner points alone in item 0 and by none in item 1, with copies and lone points."""
    rng = np.random.default_rng(5)
    rows = []
    for item, gap in ((0, R - 0.002), (1, R + 0.002)):
        disc = lambda x, n: np.column_stack([np.full(n, x), rng.uniform(-0.06, 0.06, (n, 2))])
        one, two = disc(0.0, 60), disc(R + 0.01, 60)
        one[30], two[31] = (0.004, 0.001, 0.0), (0.004 + gap, 0.001, 0.0)
        loose = rng.uniform(-2, 2, (80, 3))
        at = np.concatenate([one, two, loose, one[:3]])
        rows += [(item, 10 * int(k) + item, *map(float, p)) for k, p in zip(rng.permutation(len(at)), at)]
    return [*rows, (0, 9001, None, 0.0, 0.0)]


@pytest.fixture(scope="module")
def cloud(spark, crowd):
    return spark.createDataFrame(crowd, "item_id long, point_id long, x double, y double, z double").repartition(3)


def linked(crowd):
    near = {}
    for i, a, *p in crowd:
        for j, b, *q in crowd:
            if i == j and None not in (*p, *q) and sum((u - v) * (u - v) for u, v in zip(p, q)) <= R * R:
                near.setdefault(a, set()).add(b)
    return near


def test_components_of_the_radius_graph(cloud, crowd):
    near, part = linked(crowd), {}
    for a in sorted(near):
        todo = [a] if a not in part else []
        while todo:
            b = todo.pop()
            if b not in part:
                part[b] = a
                todo += near[b]
    want = {a: c for a, c in part.items() if len(near[a]) > 1}
    got = {r["node"]: r["component"] for r in sp.radius_components(cloud, R, ["item_id"]).collect()}
    assert got == want and len(set(got.values())) > 3


def test_labels_that_touch(cloud, crowd):
    rows = [(*r, i % 7 + 10 * r[0]) for i, r in enumerate(crowd) if i % 3 == 0]
    near, label = linked(crowd), {r[1]: r[5] for r in rows}
    want = {(min(label[a], label[b]), max(label[a], label[b])) for a in label for b in near.get(a, ()) if b in label and label[a] != label[b]}
    got = sp.touching_labels(cloud.sparkSession.createDataFrame(rows, "item_id long, point_id long, x double, y double, z double, node long"), "node", R, ["item_id"])
    assert {(r["a"], r["b"]) for r in got.collect()} == want


def test_balls_and_patches_in_rounds(cloud, crowd, monkeypatch):
    monkeypatch.setattr(sp, "FIRST", 4)
    monkeypatch.setattr(sp, "TASK", 50)
    near = linked(crowd)
    hits = {}
    for r in sp.ball_hits(cloud, cloud, R, 5, ["item_id"], inclusive=True).collect():
        hits.setdefault(r["point_id"], []).append(r["hit"])
    assert {k: sorted(v) for k, v in hits.items()} == {k: sorted(v)[:5] for k, v in near.items()}
    seeds = cloud.where("point_id % 7 = 0").selectExpr("point_id AS seed", "point_id AS node")
    pairs = sp.radius_pairs(cloud, R, ["item_id"])
    rows = lambda df: sorted(tuple(r[c] for c in ("seed", "node", "hop", "nth")) for r in df.collect())
    assert rows(sp.ball_patches(cloud, seeds, R, 9, ["item_id"])) == rows(gr.bfs_patches(pairs, seeds, 9))


def test_close_pairs_are_copied_to_the_cells_they_reach_only(spark):
    """Pairs across a cell's border are found, points away from borders stay single."""
    at = [(0, k, x, 0.5, 0.5) for k, x in enumerate((0.5, 0.5, 1.5999999, 1.6000001, 1.7, 1.8, 3.0))]
    df = spark.createDataFrame(at, "item_id long, point_id long, x double, y double, z double")
    want = sorted((a[1], b[1]) for a in at for b in at if (a[2] - b[2]) ** 2 <= 0.01)
    assert sorted((r["point_id"], r["p_point_id"]) for r in sp.close_pairs(df, 0.1, ["item_id"]).collect()) == want


def test_spaced_sample_lists_no_pairs(cloud, monkeypatch):
    monkeypatch.setattr(sp, "radius_pairs", None)
    placed = cloud.where("x IS NOT NULL")
    assert sp.spaced_sample(placed, 5, ["item_id"], 9).groupBy("item_id").count().where("count = 5").count() == 2
