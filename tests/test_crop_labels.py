"""Labels of crops: each point is met once a crop, and what is found is not sent on."""

import random

import pytest

from pointweave.operators import spatial as sp
from pointweave.plans import pipelines as pl
from tests.test_pipelines import cube_shape, on_cube  # noqa: F401

POINTS = "item_id long, point_id long, x double, y double, z double"


def test_whole_surfaces_are_labelled_without_searches(spark, cube_shape, monkeypatch):  # noqa: F811
    """Crops of whole surfaces need no neighbours, no second search for faces and no distances to them."""
    rows = on_cube(random.Random(9), 60)
    points = spark.createDataFrame([(*r[:5],) for r in rows], POINTS)
    crops = spark.createDataFrame([(0, 70, f) for f in range(12)] + [(0, 71, f) for f in range(4)], "item_id long, patch_id long, fid long")

    def searched(*args, **more):
        raise AssertionError("nothing is searched again")

    for name in ("knn", "nearest_face", "nearest_segment"):
        monkeypatch.setattr(sp, name, searched)
    wrote = []
    write = pl.durable
    monkeypatch.setattr(pl, "durable", lambda df, name: wrote.append(df.columns) or write(df, name))
    out = pl.label_crops(points, cube_shape, crops, 0.02, 0.3).collect()
    want = {r[1]: min(r[5], 0.3) for r in rows}
    assert {r["global_idx"]: r["value"] for r in out if r["patch_id"] == 70} == pytest.approx(want)
    assert sum("point_id" in c and "patch_id" in c for c in wrote) == 1 and not any("off" in c for c in wrote)


def test_segments_of_small_groups(spark, monkeypatch):
    """As the general search, ties to the least id, and nulls where a group has no segment."""
    rng = random.Random(10)
    points = spark.createDataFrame([(g, s, 1000 * g + 10 * i + s, *(rng.randint(0, 8) / 4 for _ in range(3))) for g in range(3) for s in range(3) for i in range(30)], "item_id long, surf_id long, point_id long, x double, y double, z double")
    ends = [(g, s, 100 * g + 10 * s + i, *(rng.randint(0, 8) / 4 for _ in range(6))) for g in range(3) for s in range(2) for i in range(7)]
    ends += [(g, s, i + 5000, *p) for g, s, i, *p in ends[::3]]  # copies of greater ids
    segments = spark.createDataFrame(ends, "item_id long, surf_id long, seg_id long, ax double, ay double, az double, bx double, by_ double, bz double")
    by = ["item_id", "surf_id"]
    read = lambda df: {r.point_id: (r.distance, r.seg_id) for r in df.collect()}
    want = read(sp.nearest_segment(points, segments, by))
    monkeypatch.setattr(sp, "ROWS", 50)
    got = read(sp.nearest_of_few(points, segments, by))
    assert len(got) == 270 and len(want) == 180
    assert {k: v for k, v in got.items() if v[0] is not None} == want and all(v == (None, None) for k, v in got.items() if k not in want)


def test_parts_near_a_cell_are_compared_once(spark, monkeypatch):
    """Each point and part have one result, though cells are dealt to blocks, and large parts in pieces."""
    rng = random.Random(12)
    points = spark.createDataFrame([(g, 100 * g + i, *(rng.random() for _ in range(3))) for g in range(2) for i in range(80)] + [(1, 999, 50.0, 50.0, 50.0)], POINTS)
    names = ", ".join(f"{n} double" for n in ("ax", "ay", "az", "bx", "by_", "bz", "cx", "cy", "cz"))
    faces = spark.createDataFrame([(g, 10 * g + f // 8, f, *(rng.random() for _ in range(9))) for g in range(2) for f in range(40)], f"item_id long, patch_id long, fid long, {names}")
    read = lambda: sorted((r.point_id, r.patch_id, r.fid, r.distance) for r in sp.faces_within(points, faces, 0.1, ["item_id"], ["patch_id"]).collect())
    want = read()
    assert len(want) > 100 and len({w[:2] for w in want}) == len(want)
    monkeypatch.setattr(sp, "MEETINGS", 20)
    monkeypatch.setattr(sp, "BLOCK", 16)
    assert read() == want
    monkeypatch.setattr(sp, "BLOCK", 4)
    assert read() == want
