"""Nearest shapes of crowded cells, compared block by block."""

import numpy as np
import pytest

from pointweave.operators import spatial as sp

A, B, C = ("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx", "cy", "cz")


def on_segment(p, a, b):
    ab = b - a
    t = np.clip((p - a) @ ab / (ab @ ab), 0, 1) if ab @ ab > 0 else 0.0
    return np.linalg.norm(p - a - t * ab)


def on_triangle(p, a, b, c):
    n = np.cross(b - a, c - a)
    if n @ n > 0:
        u, v = np.cross(b - a, p - a) @ n / (n @ n), np.cross(p - a, c - a) @ n / (n @ n)
        if u >= 0 and v >= 0 and u + v <= 1:
            return abs((p - a) @ n) / np.sqrt(n @ n)
    return min(on_segment(p, *e) for e in ((a, b), (b, c), (c, a)))


@pytest.fixture(scope="module")
def crowd(spark):
    """Long triangles through one another, with copies, slivers and points among them, beside a group far from the origin."""
    rng = np.random.default_rng(7)
    points, shapes = [], []
    for item, (n, m, far) in enumerate(((120, 90, 0.0), (40, 30, 1e4))):
        at = rng.normal(size=(m, 3, 3)) + far
        at[1], at[2, 2], at[3] = at[0], (at[2, 0] + at[2, 1]) / 2, at[3, 0]  # a copy, a sliver, a point
        shapes += [(item, i, i // 6, *map(float, x.ravel())) for i, x in enumerate(at)]
        points += [(item, 1000 * item + i, *map(float, x)) for i, x in enumerate(rng.normal(size=(n, 3)) + far)]
    faces = spark.createDataFrame(shapes, "item_id long, fid long, patch_id long, " + ", ".join(f"{c} double" for c in (*A, *B, *C)))
    return points, shapes, spark.createDataFrame(points, "item_id long, point_id long, x double, y double, z double"), faces


def test_blocks_find_the_nearest_shape(crowd, monkeypatch):
    monkeypatch.setattr(sp, "BLOCK", 16)
    monkeypatch.setattr(sp, "CHUNK", 5)
    points, shapes, cloud, faces = crowd
    for of, found in ((3, sp.nearest_face(cloud, faces, ["item_id"])), (2, sp.nearest_segment(cloud, faces.drop(*C), ["item_id"], segment_key="fid"))):
        got = {r["point_id"]: (r["distance"], r["fid"]) for r in found.collect()}
        assert len(got) == len(points)
        for item, key, *p in points:
            far = [((on_triangle if of == 3 else on_segment)(np.array(p), *np.array(s[3:]).reshape(3, 3)[:of]), s[1]) for s in shapes if s[0] == item]
            least = min(d for d, _ in far)
            assert got[key][0] == pytest.approx(least, abs=1e-9)
            assert got[key][1] in [i for d, i in far if d < least + 1e-9] and got[key][1] != 1  # 1 is a copy of 0


def test_blocks_find_the_nearest_face_of_each_patch(crowd, monkeypatch):
    monkeypatch.setattr(sp, "BLOCK", 16)
    points, shapes, cloud, faces = crowd
    got = {(r["point_id"], r["patch_id"]): r["distance"] for r in sp.faces_within(cloud, faces, 0.4, ["item_id"], ["patch_id"]).collect()}
    want = {}
    for item, key, *p in points:
        for s in shapes:
            d = on_triangle(np.array(p), *np.array(s[3:]).reshape(3, 3)) if s[0] == item else 1.0
            if d < 0.4:
                want[key, s[2]] = min(d, want.get((key, s[2]), 1.0))
    assert got == pytest.approx(want, abs=1e-9) and len(want) > 100


def test_bounds_of_blocks_reach_past_ends_and_sides():
    """What lies on a line or plane but beyond the shape is not near it; bounds never exceed distances."""
    rng = np.random.default_rng(3)
    corners, points = [rng.normal(size=(60, 3)) for _ in range(3)], rng.normal(size=(50, 3))
    for kind, of in ((sp._Segments, 2), (sp._Triangles, 3)):
        shapes = kind(corners[:of], np.zeros(3))
        low = np.sqrt(np.maximum(shapes.below(points), 0.0))
        exact = shapes.exact(np.repeat(points, 60, axis=0), np.tile(np.arange(60), 50))[0].reshape(50, 60)
        assert (low <= exact + 1e-9).all() and (low > 0.999 * exact).mean() > (0.999 if of == 2 else 0.7)
