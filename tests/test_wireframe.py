"""Wireframes of hand-built shapes: a ring, a T, the edges of a cube, a bent line, and noise around them."""

import math
import random

import pytest

from pointweave.plans import pipelines as pl

SCHEMA = "item_id long, point_id long, x double, y double, z double, distance double"


def line(a, b, step=0.02):
    n = round(math.dist(a, b) / step)
    return [tuple(p + (q - p) * i / n for p, q in zip(a, b)) for i in range(n + 1)]


def rows(points, item=0, noise=0.0, seed=1):
    rng = random.Random(seed)
    seen = sorted({tuple(round(c, 9) for c in p) for p in points})
    out = []
    for i, p in enumerate(seen):
        off = [rng.uniform(-noise, noise) for _ in p]
        out.append((item, item * 100_000 + i, *(c + o for c, o in zip(p, off)), math.hypot(*off)))
    return out


def traced(spark, data, level=2.0, split=0.05):
    out = pl.extract_wireframe(spark.createDataFrame(data, SCHEMA), 0.2, 1e-3, 0.07, 4, [1.0], level, 0.1, split).collect()
    curves = {}
    for r in out:
        curves.setdefault((r.item_id, r.curve, r.closed), []).append(((r.ax, r.ay, r.az), (r.bx, r.by_, r.bz)))
    return curves


def degrees(pieces, grid=0.15):
    ends = []
    for piece in pieces:
        for p in piece:
            for e in ends:
                if math.dist(e[0], p) < grid:
                    e[1] += 1
                    break
            else:
                ends.append([p, 1])
    return sorted(n for _, n in ends)


def test_ring_and_t(spark):
    ring = [(math.cos(t * math.pi / 180), math.sin(t * math.pi / 180), 0.0) for t in range(0, 360, 1)]
    tee = line((-1, 0, 0), (1, 0, 0)) + line((0, 0, 0), (0, 1, 0))
    curves = traced(spark, rows(ring, 0) + rows(tee, 1, 0.004))
    # nothing is a corner at this level: the ring is one closed curve around its centre
    (key, pieces), = [(k, v) for k, v in curves.items() if k[0] == 0]
    assert key[2] and 6 <= len(pieces) <= 16
    assert all(abs(math.hypot(*p[:2]) - 1) < 1e-6 for piece in pieces for p in piece)
    assert degrees(pieces, 0.01) == [2] * len(pieces)
    own = [v for k, v in curves.items() if k[0] == 1]
    assert len(own) == 3 and all(not k[2] for k in curves if k[0] == 1)
    tips = [p for v in own for piece in v for p in piece]
    for end in ((-1, 0, 0), (1, 0, 0), (0, 1, 0)):
        assert min(math.dist(end, p) for p in tips) < 0.02
    assert sum(math.dist(*piece) for v in own for piece in v) == pytest.approx(3, abs=0.15)


def test_cube_edges(spark):
    corners = [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]
    edges = [(a, b) for a in corners for b in corners if a < b and sum(p != q for p, q in zip(a, b)) == 1]
    curves = traced(spark, rows([p for a, b in edges for p in line(a, b)], 3))
    pieces = [p for v in curves.values() for p in v]
    ends = []
    for v in curves.values():
        once = [p for piece in v for p in piece]
        ends.append(tuple(p for p in once if once.count(p) == 1))
    assert len(curves) == 12 and all(len(e) == 2 for e in ends) and degrees(ends) == [3] * 8
    assert sum(math.dist(*p) for p in pieces) == pytest.approx(12, abs=0.8)
    for c in corners:
        assert min(math.dist(c, p) for piece in pieces for p in piece) < 0.08


def test_pieces_split_until_they_fit(spark):
    """Many bends: no number of rounds ends the splitting."""
    zigzag = [(0.1 * i, 0.3 * (i % 2), 0.0) for i in range(40)]
    data = [(0, 7, i, *p, 0.0) for i, p in enumerate(zigzag)]
    df = spark.createDataFrame(data, "item_id long, curve long, pos long, x double, y double, z double, distance double")
    got = sorted((r.lo, r.hi) for r in pl.straight_pieces(df, 0.01).collect())
    assert got == [(i, i + 1) for i in range(39)]
    flat = spark.createDataFrame([(0, 7, i, 0.1 * i, 0.02 * (i % 2), 0.0, 0.02 * (i % 2)) for i in range(41)], df.schema)
    assert [(r.lo, r.hi) for r in pl.straight_pieces(flat, 0.01).collect()] == [(0, 40)]
