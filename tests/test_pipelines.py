"""Scan pipelines, pruning, wireframes, paths and streams against hand-built cases and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import graph as gr
from pointweave.operators import spatial as sp
from pointweave.plans import pipelines as pl
from pointweave.sources import tables as so
from pointweave.streaming import streams as st
from tests.test_fixtures import CUBE_V, QUADS

ONE = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


@pytest.fixture(scope="module")
def cube_shape(spark):
    tris = [t for a, b, c, d in QUADS for t in ((a, b, c), (a, c, d))]
    faces = [(0, i, *t, *(x for v in t for x in CUBE_V[v])) for i, t in enumerate(tris)]
    sides = sorted({tuple(sorted((q[i], q[(i + 1) % 4]))) for q in QUADS for i in range(4)})
    return pl.Shape(
        spark.createDataFrame(faces, "item_id long, fid long, v0 long, v1 long, v2 long, ax double, ay double, az double, bx double, by_ double, bz double, cx double, cy double, cz double"),
        spark.createDataFrame([(0, i // 2, i) for i in range(12)], "item_id long, surf_id long, fid long"),
        spark.createDataFrame([(0, i, 100 + i, a, b, *CUBE_V[a], *CUBE_V[b]) for i, (a, b) in enumerate(sides)], "item_id long, curve_id long, seg_id long, va long, vb long, ax double, ay double, az double, bx double, by_ double, bz double"),
        spark.createDataFrame([(0, i, v) for i, s in enumerate(sides) for v in s], "item_id long, curve_id long, vid long"),
        spark.createDataFrame([(0, i, "Line", True) for i in range(12)], "item_id long, curve_id long, type string, sharp boolean"),
    )


def on_cube(rng, n):
    """Points on the faces, away from the edges, and their distance to the nearest edge."""
    out = []
    for i in range(n):
        p = [rng.uniform(0.05, 0.95) for _ in range(3)]
        axis = i % 3
        p[axis] = float(rng.random() < 0.5)
        others = [p[k] for k in range(3) if k != axis]
        out.append((0, i, *p, min(min(x, 1 - x) for x in others)))
    return out


def test_scan_points_on_a_cube(spark, cube_shape):
    rows = on_cube(random.Random(1), 90)
    points = spark.createDataFrame([(*r[:5],) for r in rows] + [(0, 900, 3.0, 3.0, 3.0)], "item_id long, point_id long, x double, y double, z double")
    out = pl.annotate_scan_points(points, ONE, cube_shape, 0.3, 0.1, 2, 90, 1.5).collect()
    want = {r[1]: min(r[5], 0.3) for r in rows}
    # both patches hold the whole cube, whose submesh has no boundary
    assert len(out) == 180 and {r["point_id"] for r in out} == set(want)
    for r in out:
        assert r["distance"] == pytest.approx(want[r["point_id"]], abs=1e-9) and not r["jump"]
        assert (r["seg_id"] is None) == (want[r["point_id"]] == 0.3)


def test_a_patch_sees_its_own_surfaces_only(spark, cube_shape):
    rows = [r for r in on_cube(random.Random(2), 60) if r[4] == 0.0]  # the face z = 0
    members = spark.createDataFrame([(0, 5, *r[1:5]) for r in rows], "item_id long, patch_id long, point_id long, x double, y double, z double")
    kept = pl.on_mesh(members, cube_shape, 0.1)
    open_ = {r["point_id"]: r["distance"] for r in pl.label_patches(kept, cube_shape, 0.3, "none").collect()}
    assert open_ == pytest.approx({r[1]: min(r[5], 0.3) for r in rows})
    # a single face is all boundary: nothing is left to be near to
    closed = pl.label_patches(kept, cube_shape, 0.3, "edges").collect()
    assert {r["distance"] for r in closed} == {0.3} and {r["seg_id"] for r in closed} == {None}


def test_repair_keeps_what_it_cannot_label(spark, cube_shape):
    rows = on_cube(random.Random(3), 40)
    stored = spark.createDataFrame([(0, 7, *r[1:5], 9.0, "kept") for r in rows] + [(0, 7, 99, 5.0, 5.0, 5.0, 8.0, "kept")], "item_id long, patch_id long, point_id long, x double, y double, z double, distance double, note string")
    out = pl.repair_patches(stored, cube_shape, 0.3, 0.1).collect()
    want = {r[1]: min(r[5], 0.3) for r in rows} | {99: 8.0}
    assert {r["point_id"]: r["distance"] for r in out} == pytest.approx(want)
    assert {r["note"] for r in out} == {"kept"}


def test_views_keep_the_nearest_point_of_a_pixel(spark, cube_shape):
    rows = on_cube(random.Random(4), 120)
    points = spark.createDataFrame([(0, r[1], r[2], r[3], r[4] + 2.0) for r in rows], "item_id long, point_id long, x double, y double, z double")
    back = [*ONE[:11], -2.0, *ONE[12:]]
    out = {(r["pr"], r["pc"]): (r["point_id"], r["distance"]) for r in pl.annotate_scan_views(points, back, cube_shape, 0.3, 0.1, 1.0, 0.1, 0.1, 16, 16).collect()}
    best = {}
    for _, i, x, y, z, d in rows:
        z += 2.0
        pc, pr = round(x / z / 0.1 + 8), round(y / z / 0.1 + 8)
        if 0 < pc < 16 and 0 < pr < 16:
            best[pr, pc] = min(best.get((pr, pc), (99.0,)), (z, i, min(d, 0.3)))
    assert out == {k: (i, pytest.approx(d)) for k, (_, i, d) in best.items()}


def test_vertex_patches_follow_both_rules(spark, cube_shape):
    vertices = spark.createDataFrame([(0, i, *v) for i, v in enumerate(CUBE_V)], "item_id long, vid long, x double, y double, z double")
    seeds = spark.createDataFrame([(0, 0), (7, 7)], "seed long, node long")
    # every curve has two vertices, every surface only sharp ones
    assert pl.mesh_vertex_patches(cube_shape, vertices, seeds, 4).count() == 0
    assert pl.mesh_vertex_patches(cube_shape, vertices, seeds, 4, short=2).count() == 0
    out = pl.mesh_vertex_patches(cube_shape, vertices, seeds, 4, short=2, most_sharp=1.0).collect()
    for seed in (0, 7):
        own = np.array([[r["x"], r["y"], r["z"]] for r in out if r["seed"] == seed])
        assert len(own) == 4 and np.abs(own.mean(0)).max() < 1e-9 and np.linalg.norm(own, axis=1).max() == pytest.approx(1)
    assert all(r["sharp"] for r in out)


def test_crops_share_the_least_label(spark, cube_shape):
    rows = on_cube(random.Random(8), 60)
    points = spark.createDataFrame([(*r[:5],) for r in rows] + [(0, 900, 0.5, 0.5, 0.5)], "item_id long, point_id long, x double, y double, z double")
    # one crop is the whole cube, the other the triangles of a single face, all of whose edges are boundary
    crops = spark.createDataFrame([(0, 70, f) for f in range(12)] + [(0, 71, f) for f in (0, 1)], "item_id long, patch_id long, fid long")
    out = pl.label_crops(points, cube_shape, crops, 0.02, 0.3).collect()
    want = {r[1]: min(r[5], 0.3) for r in rows}
    whole = {r["global_idx"]: r for r in out if r["patch_id"] == 70}
    part = {r["global_idx"]: r for r in out if r["patch_id"] == 71}
    assert set(whole) == set(want) and set(part) == {r[1] for r in rows if r[2] == 0.0}
    assert {r["value"] for r in part.values()} == {0.3}
    for own in (whole, part):
        assert {i: r["fused"] for i, r in own.items()} == pytest.approx({i: want[i] for i in own})


def greedy(near, stats, threshold, beta=0.5):
    """The same pruning for one shape, primitive by primitive."""
    total, left = len(near), dict(stats)

    def score(prims):
        h, n = sum(left[p][0] for p in prims), sum(left[p][1] for p in prims)
        r = sum(any(near[i].get(p, 9) < threshold for p in prims) for i in near)
        if not n or not h + r:
            return 0.0
        p, q = h / n, r / total
        return (1 + beta * beta) * p * q / (beta * beta * p + q) if beta * beta * p + q else 0.0

    prims = set(left)
    while True:
        now = round(score(prims), 12)
        gains = [(-round(score(prims - {p}), 12), p) for p in prims]
        gains = [g for g in gains if -g[0] > now]
        if not gains:
            return prims
        prims -= {min(gains)[1]}


def test_pruning_reaches_the_fixed_point(spark):
    rng = random.Random(5)
    distances, precision, want = [], [], set()
    for item in range(3):
        stats = {p: (rng.randrange(0, 10), 10) for p in range(9)}
        near = {i: {p: round(rng.random(), 3) for p in rng.sample(range(9), 3)} for i in range(40)}
        distances += [(item, i, p, d) for i, own in near.items() for p, d in own.items()]
        precision += [(item, p, *s) for p, s in stats.items()]
        want |= {(item, p) for p in greedy(near, stats, 0.3)}
    out = pl.prune_primitives(spark.createDataFrame(distances, "item_id long, point_id long, prim long, d double"), spark.createDataFrame(precision, "item_id long, prim long, hits long, n long"), 0.3)
    assert {(r["item_id"], r["prim"]) for r in out.collect()} == want and len(want) < 26


def test_wireframe_of_a_bent_line(spark):
    """Two straight runs that meet at (1, 0, 0), where the field varies: their pieces meet at the corner."""
    rows = [(0, i, 0.05 * i, 0.0, 0.0, 0.06 * (i == 19)) for i in range(21)] + [(0, 100 + i, 1.0, 0.05 * i, 0.0, 0.06 * (i == 1)) for i in range(1, 21)]
    points = spark.createDataFrame(rows + [(0, 999, 0.5, 0.5, 0.0, 0.9)], "item_id long, point_id long, x double, y double, z double, distance double")
    out = pl.extract_wireframe(points, 0.2, 1e-6, 0.08, 3, [0.1], 0.5, 0.4, 0.2).collect()
    ends = sorted(sorted([(round(r["ax"], 1), round(r["ay"], 1)), (round(r["bx"], 1), round(r["by_"], 1))]) for r in out)
    assert ends == [[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (1.0, 1.0)]]


def test_shortest_paths(spark):
    rng = random.Random(6)
    edges = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(55)) if a != b}
    link = {}
    for a, b in edges:
        link.setdefault(a, set()).add(b), link.setdefault(b, set()).add(a)
    pairs = [(0, t) for t in range(0, 60, 7)] + [(1, 1), (2, 3)]
    out = gr.shortest_paths(spark.createDataFrame(sorted(edges), "a long, b long"), spark.createDataFrame(pairs, "seed long, target long"), 2).collect()
    for seed, target in pairs:
        hop, back, level = {seed: 0}, {}, [seed]
        while level:
            new = {}
            for a in level:
                for b in link.get(a, ()):
                    if b not in hop:
                        new[b] = min(new.get(b, a), a)
            hop |= {b: hop[level[0]] + 1 for b in new}
            back |= new
            level = sorted(new)
        path = {}
        if target in hop:
            node = target
            while node is not None:
                path[node], node = hop[node], back.get(node)
        assert {r["node"]: r["hop"] for r in out if (r["seed"], r["target"]) == (seed, target)} == {n: h for n, h in path.items() if h % 2 == 0 or n == target}


def test_eigenvalues_and_end_points(spark):
    rng = np.random.default_rng(7)
    p = rng.normal(size=(60, 3)) * [0.3, 0.1, 0.02]
    points = spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(p)], "item_id long, point_id long, x double, y double, z double")
    ratios = {r["point_id"]: (r["r1"], r["r2"], r["r3"]) for r in sp.pca_ratio(points, 0.3, ["item_id"]).collect()}
    sides = {r["point_id"]: r["side"] for r in pl.endpoint_candidates(points, 0.3, -1.0).collect()}
    for i, x in enumerate(p):
        own = p[((p - x) ** 2).sum(1) < 0.09]
        if len(own) <= 5:
            assert ratios[i] == (1.0, 0.0, 0.0)
            continue
        values, vectors = np.linalg.eigh(np.cov(own.T, bias=True))
        assert ratios[i] == pytest.approx(tuple(values[::-1] / values.sum()), abs=1e-7)
        assert sides[i] == pytest.approx(abs(np.sign(np.round((own - x) @ vectors[:, 2], 12)).mean()), abs=1e-9)


# streams -------------------------------------------------------------------------------------------


def _file(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_dropped_and_a_stream_goes_on(spark, tmp_path):
    schema = "ts string, flag boolean, kind string"
    source, sink = f"{tmp_path}/in", f"{tmp_path}/sink"
    _file(spark, source, [("2024-01-01 00:10:00", True, "a"), ("2024-01-01 01:20:00", False, "a")], schema)
    _file(spark, source, [("2024-01-01 00:50:00", False, "a"), ("2024-01-01 05:00:00", True, "a")], schema)  # out of order, in time
    _file(spark, source, [("2024-01-01 06:10:00", True, "a")], schema)
    _file(spark, source, [("2024-01-01 00:30:00", True, "a"), ("2024-01-01 09:00:00", True, "a")], schema)  # late: its window is closed

    def rates():
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("ts", F.to_timestamp("ts"))
        return st.settle(st.stream_flag_rates(rows, "ts", "flag", "1 hour", "1 hour", ["kind"]), "append", sink).orderBy("start").collect()

    first = rates()
    assert [(r["n"], r["rate"]) for r in first] == [(2, 0.5), (1, 0.0), (1, 1.0), (1, 1.0)]
    assert rates() == first  # nothing new: nothing is emitted twice
    _file(spark, source, [("2024-01-01 20:00:00", False, "a")], schema)
    assert [r["n"] for r in rates()] == [2, 1, 1, 1, 1]


def test_upserts_survive_a_restart(spark, tmp_path):
    schema = "id long, version long, value string, ts timestamp"
    source, sink = f"{tmp_path}/in", f"{tmp_path}/sink"

    def at(i):
        return F.to_timestamp(F.lit(f"2024-01-01 00:00:{i:02d}"))

    def put(rows):
        spark.createDataFrame([r[:3] for r in rows], "id long, version long, value string").withColumn("ts", at(rows[0][1] % 60)).coalesce(1).write.mode("append").parquet(source)

    def table():
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        out = st.stream_apply_fixes(rows, ["id"], "ts", "version", "1 hour", sink)
        return {r["id"]: r["value"] for r in out.collect()}, out.schema

    put([(1, 5, "new"), (2, 1, "b1")])
    put([(1, 3, "old"), (1, 5, "new")])
    assert table()[0] == {1: "new", 2: "b1"}
    put([(2, 2, "b2"), (3, 1, "c")])
    got, kept = table()
    assert got == {1: "new", 2: "b2", 3: "c"}
    merged = st.compact(spark, sink, kept, ["id"], "version")
    assert spark.read.parquet(f"{merged}/out/batch=0").count() == 3


def test_an_empty_stream_gives_an_empty_table(spark, tmp_path):
    schema = "id long, version long, value string, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    assert st.stream_apply_fixes(rows, ["id"], "ts", "version", "1 hour", f"{tmp_path}/sink").count() == 0
    assert st.settle(st.stream_fusion(rows.select("id", F.lit(1.0).alias("value")), ["id"])).count() == 0


def test_numbered_vectors(spark, tmp_path):
    for name, text in (("test_3.txt", "1.5 2\n-3e2\n"), ("test_12_x.txt", "7"), ("test_4.txt", "\n")):
        (tmp_path / name).write_text(text)
    out = {r["number"]: r["vector"] for r in so.merge_numbered_vectors(spark, str(tmp_path)).collect()}
    assert out == {3: [1.5, 2.0, -300.0], 12: [7.0], 4: []}
    assert so.predictions_from_numbered_files(spark, str(tmp_path)).where("patch_id = 3").count() == 3


def test_pruning_makes_many_removals_a_round(spark, monkeypatch):
    """Most primitives go in a few rounds, more if a round looks at few, and distances may repeat."""
    rng = random.Random(11)
    for candidates, followed in ((4096, 200_000), (8, 20)):
        distances, precision, want, most = [], [], set(), 0
        for item in range(2):
            stats = {p: (rng.choice((0, 0, 1, 2)), 2) for p in range(36)}
            near = {i: {p: round(rng.random(), 3) for p in rng.sample(range(36), rng.choice((1, 2, 3, 6)))} for i in range(90)}
            distances += [(item, i, p, d) for i, own in near.items() for p, d in own.items() for _ in range(1 + p % 2)]
            precision += [(item, p, *s) for p, s in stats.items()]
            left = greedy(near, stats, 0.5)
            want |= {(item, p) for p in left}
            most = max(most, 36 - len(left))
        monkeypatch.setattr(pl, "CANDIDATES", candidates)
        monkeypatch.setattr(pl, "FOLLOWED", followed)
        rounds = []
        monkeypatch.setattr(pl, "release", lambda *tables: rounds.append(len(tables)))
        out = pl.prune_primitives(spark.createDataFrame(distances, "item_id long, point_id long, prim long, d double"), spark.createDataFrame(precision, "item_id long, prim long, hits long, n long"), 0.5)
        assert {(r["item_id"], r["prim"]) for r in out.collect()} == want
        if candidates > 36:
            assert most > 9 and len(rounds) < most / 2


def test_pruning_of_near_samples_lists_covers_of_few_points(spark, monkeypatch):
    """Points that no sample sees do not count, and only points without a lasting cover are paired with samples."""
    rng = random.Random(13)
    rows = [(item, 100 * item + i, 100 * item + i // 3, *(rng.randint(0, 4) / 10 for _ in range(3))) for item in range(2) for i in range(60)] + [(0, 99, 33, 9.0, 9.0, 9.0)]
    stats = {(r[0], r[2]): (rng.choice((0, 0, 1, 2)), 2) for r in rows}
    precision = spark.createDataFrame([(*k, *s) for k, s in stats.items()], "item_id long, prim long, hits long, n long")
    points = spark.createDataFrame(rows, "item_id long, point_id long, prim long, x double, y double, z double")
    want, unsure = set(), set()
    for item in range(2):
        near = {}
        for _, i, own, *p in (r for r in rows if r[0] == item):
            for _, _, prim, *q in (r for r in rows if r[0] == item and r[2] != own):
                d = sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5
                if d < 0.25:
                    near.setdefault(i, {})[prim] = min(d, near.get(i, {}).get(prim, 9.0))
        unsure |= {i for i in near if not any(d < 0.15 and stats[item, p][0] == 2 for p, d in near[i].items())}
        want |= {(item, p) for p in greedy(near, {p: s for (k, p), s in stats.items() if k == item}, 0.15)}
    asked, joined = [], pl.sp.radius_join
    monkeypatch.setattr(pl.sp, "radius_join", lambda q, *args: asked.append({r.point_id for r in q.collect()}) or joined(q, *args))
    for block in (4096, 16):
        monkeypatch.setattr(pl.sp, "BLOCK", block)
        out = pl.prune_near(points, precision, 0.25, 0.15)
        assert {(r["item_id"], r["prim"]) for r in out.collect()} == want and 5 < len(want) < 20
    assert all(unsure <= a < {r[1] for r in rows} and len(a - unsure) <= 1 for a in asked) and len(asked) == 2
