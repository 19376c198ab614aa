"""Small groups are compared whole, and labelling searches no face again."""

import random

import pytest

from pointweave.operators import mesh as ms
from pointweave.operators import spatial as sp
from pointweave.plans import pipelines as pl
from tests.test_pipelines import cube_shape, on_cube  # noqa: F401

POINTS = "item_id long, point_id long, x double, y double, z double"


def cloud(rng, groups, n):
    return [(g, 1000 * g + i, *(rng.randint(0, 6) / 4 for _ in range(3))) for g in range(groups) for i in range(n)]


def test_neighbours_of_small_groups(spark, monkeypatch):
    rows = cloud(random.Random(3), 4, 30) + [(9, 9000, 1.0, 1.0, 1.0), (9, 9001, None, 1.0, 1.0), (8, 8000, 0.0, 0.0, 0.0)]
    points, asked = spark.createDataFrame(rows, POINTS), spark.createDataFrame([r for r in rows if r[1] % 3 == 0], POINTS)
    read = lambda: sorted((r.item_id, r.point_id, r["rank"], r.other, r.d2) for r in sp.knn(asked, points, 4, ["item_id"]).collect())
    want = []
    for g, i, *p in (r for r in rows if r[1] % 3 == 0 and None not in r):
        near = sorted((sum((a - b) ** 2 for a, b in zip(p, q[2:])), q[1]) for q in rows if q[0] == g and None not in q)[:4]
        want += [(g, i, n + 1, other, d2) for n, (d2, other) in enumerate(near)]
    names = []
    write = sp.durable
    monkeypatch.setattr(sp, "durable", lambda df, name: names.append(name) or write(df, name))
    assert read() == sorted(want) and names == ["grids", "knn"]
    monkeypatch.setattr(sp, "WHOLE", 20)  # some groups by cells
    assert read() == sorted(want)


def test_few_shapes_are_settled_at_once(spark, monkeypatch):
    rng = random.Random(4)
    # a far point, which took many rounds of growing reach
    points = spark.createDataFrame(cloud(rng, 3, 40) + [(1, 1900, 900.0, 900.0, 900.0)], POINTS)
    segments = spark.createDataFrame([(g, 1000 * g + i, *(rng.random() for _ in range(6))) for g in range(3) for i in range(25)], "item_id long, seg_id long, ax double, ay double, az double, bx double, by_ double, bz double")
    read = lambda: sorted((r.point_id, r.seg_id, round(r.distance, 9)) for r in sp.nearest_segment(points, segments, ["item_id"]).collect())
    names = []
    write = sp.durable
    monkeypatch.setattr(sp, "durable", lambda df, name: names.append(name) or write(df, name))
    whole = read()
    assert names.count("nearest") == 1 and len(whole) == 121
    monkeypatch.setattr(sp, "WHOLE", 0)
    assert read() == whole


def test_labels_search_no_face_that_is_known(spark, cube_shape, monkeypatch):  # noqa: F811
    rows = on_cube(random.Random(5), 40)
    kept = pl.on_mesh(spark.createDataFrame([(0, 7, *r[1:5]) for r in rows], "item_id long, patch_id long, point_id long, x double, y double, z double"), cube_shape, 0.1)

    def searched(*args, **more):
        raise AssertionError("the nearest faces are known")

    monkeypatch.setattr(sp, "nearest_face", searched)
    got = {r.point_id: r.distance for r in pl.label_patches(kept, cube_shape, 0.3).collect()}
    assert got == pytest.approx({r[1]: min(r[5], 0.3) for r in rows})


def test_faces_outside_a_crop_may_be_nearer(spark, cube_shape, monkeypatch):  # noqa: F811
    rows = on_cube(random.Random(6), 90)
    points = spark.createDataFrame([(*r[:5],) for r in rows], POINTS)
    # one triangle of each of three sides: their surfaces have another one each
    crops = spark.createDataFrame([(0, 70, f) for f in (0, 2, 4)], "item_id long, patch_id long, fid long")
    seen = []
    real = ms.annotate_points

    def watched(own, faces, *args):
        told = {(r.point_id, r.fid) for r in args[-1].collect()}
        found = {(r.point_id, r.fid) for r in sp.nearest_face(own, faces, ["item_id"]).collect()}
        seen.append((told, found))
        return real(own, faces, *args)

    monkeypatch.setattr(ms, "annotate_points", watched)
    pl.label_crops(points, cube_shape, crops, 0.4, 0.3)
    told, found = seen[0]
    assert told == found and {1, 3, 5} & {f for _, f in told}
