"""Hand-built cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.functions import geometry as ge
from pointweave.operators import fusion as fu
from pointweave.operators import graph as gr
from pointweave.operators import mesh as ms
from pointweave.operators import metrics as me
from pointweave.operators import raster as ra
from pointweave.operators import spatial as sp
from pointweave.operators import tables as tb
from pointweave.sources import tables as so

CUBE_V = [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]
QUADS = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]


@pytest.fixture(scope="module")
def cube(spark):
    vertices = spark.createDataFrame([(0, i, *v) for i, v in enumerate(CUBE_V)], "item_id long, vid long, x double, y double, z double")
    tris = [t for a, b, c, d in QUADS for t in ((a, b, c), (a, c, d))]
    faces = spark.createDataFrame([(0, i, *t) for i, t in enumerate(tris)], "item_id long, fid long, v0 long, v1 long, v2 long")
    sides = sorted({tuple(sorted((q[i], q[(i + 1) % 4]))) for q in QUADS for i in range(4)})
    curve_verts = spark.createDataFrame([(0, i, v) for i, s in enumerate(sides) for v in s], "item_id long, curve_id long, vid long")
    surface_faces = spark.createDataFrame([(0, i // 2, i) for i in range(12)], "item_id long, surf_id long, fid long")
    return vertices, faces, curve_verts, surface_faces


def test_cube(cube):
    vertices, faces, curve_verts, surface_faces = cube
    assert ms.boundary_edges(faces).count() == 0
    assert ms.corner_vertices(curve_verts).count() == 8
    per_surface = ms.surface_curves(faces, surface_faces, curve_verts).groupBy("surf_id").count()
    assert {r["count"] for r in per_surface.collect()} == {8}
    assert ms.edges_in_curve(faces, curve_verts).count() == 12
    assert {r["extent"] for r in ms.curve_extents(curve_verts, vertices).collect()} == {1 + 1e-8}


def test_open_square(spark):
    faces = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 0, 2, 3)], "item_id long, fid long, v0 long, v1 long, v2 long")
    assert ms.boundary_edges(faces).count() == 4
    assert ms.boundary_vertices(faces).count() == 4
    assert ms.edges(faces).where("n_faces = 2").count() == 1


def test_l_path(spark):
    path = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 1.0, 1.0, 0.0)], "curve long, pos long, x double, y double, z double")
    assert ge.polyline_length(path, ["curve"], "pos").first()["length"] == 2
    assert [r["t"] for r in ge.arc_parameter(path, ["curve"], "pos").orderBy("pos").collect()] == [0, 0.5, 1]
    assert [r["turn"] for r in ge.turn_cosines(path, ["curve"], "pos").orderBy("pos").collect()] == [None, 0, None]


def test_line_vs_points(spark):
    pts = spark.createDataFrame([(0, 0.5, 1.0, 0.0), (1, -1.0, 0.0, 0.0), (2, 2.0, 0.0, 0.0)], "point_id long, x double, y double, z double")
    seg = spark.createDataFrame([(7, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "seg_id long, ax double, ay double, az double, bx double, by_ double, bz double")
    rows = sp.nearest_segment(pts, seg).orderBy("point_id").collect()
    assert [r["distance"] for r in rows] == [1, 1, 1]
    assert [r["t"] for r in rows] == [0.5, 0, 1]


def test_raster_4x4(spark):
    px = spark.createDataFrame([(0, r, c, 0.0 if (r, c) == (0, 0) else 1.0) for r in range(4) for c in range(4)], "view_id long, pr long, pc long, depth double")
    assert ra.erode(px, 1, F.col("depth") > 0).count() == 12


def test_votes_5(spark):
    votes = spark.createDataFrame([(0, 0, v) for v in (0.0, 0.1, 0.2, 0.3, 1.0)], "item_id long, global_idx long, value double")
    get = lambda df: df.first()["distance"]
    assert get(fu.combine(votes, "min")) == 0
    assert get(fu.combine(votes, "median")) == pytest.approx(0.2)
    assert get(fu.combine(votes, "mean")) == pytest.approx(0.32)
    assert get(fu.combine_trimmed(votes, 0.6, "min")) == pytest.approx(0.1)
    assert get(fu.combine_trimmed(votes, 0.6, "mean")) == pytest.approx(0.2)


def test_fpr_2(spark):
    rows = [("A", 1, 1.0, 0.0), ("A", 2, 1.0, 1.0), ("B", 1, 0.0, 0.0)]
    pairs = spark.createDataFrame(rows, "item_id string, sample_id long, true_d double, pred_d double")
    assert me.dataset_metrics(pairs, 0.5).first()["mean_fpr"] == 0.5
    assert me.dataset_metrics(pairs, 0.5, strict=True).first()["mean_fpr"] == 1.5


def test_align_refuses_missing_keys(spark):
    truth = spark.createDataFrame([(1, 0.1), (2, 0.2)], "k long, true_d double")
    pred = spark.createDataFrame([(1, 0.1)], "k long, pred_d double")
    with pytest.raises(Exception, match="same keys"):
        me.align_truth_pred(truth, pred, ["k"]).collect()


def test_components_and_loops(spark):
    edges = spark.createDataFrame([(0, i, (i + 1) % 5) for i in range(5)] + [(0, 10, 11), (0, 11, 12)], "item_id long, a long, b long")
    labels = {r["node"]: r["component"] for r in gr.connected_components(edges, "a", "b").collect()}
    assert {labels[i] for i in range(5)} == {0} and {labels[i] for i in (10, 11, 12)} == {10}
    assert sorted(r["n_edges"] for r in gr.polyline_chains(edges).collect()) == [2, 5]


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([((i * 7) % n, ((i + 1) * 7) % n) for i in range(n - 1)], "src long, dst long")
    rows = gr.connected_components(edges).collect()
    assert len(rows) == n and {r["component"] for r in rows} == {0}


def test_mesh_text(spark, cube):
    vertices, faces, _, _ = cube
    lines = [f"v {x} {y} {z}" for x, y, z in CUBE_V] + ["vn 0 0 1"] + [f"f {r['v0'] + 1}//1 {r['v1'] + 1}//1 {r['v2'] + 1}//1" for r in faces.orderBy("fid").collect()]
    v, f = so.mesh_text_to_tables(spark.createDataFrame([(0, "\n".join(lines))], "item_id long, text string"))
    assert sorted(map(tuple, v.collect())) == sorted(map(tuple, vertices.collect()))
    assert sorted(map(tuple, f.collect())) == sorted(map(tuple, faces.collect()))


def test_numbered_is_dense_with_ties(spark):
    df = spark.createDataFrame([(i // 7, i) for i in range(200)], "a long, b long")
    rows = tb.numbered(df, "a", "b").orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(200)) and [r["b"] for r in rows] == list(range(200))


def test_knn_far_query(spark):
    pts = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(20)], "point_id long, x double, y double, z double")
    q = spark.createDataFrame([(0, 500.0, 3.0, 0.0)], "point_id long, x double, y double, z double")
    assert [r["other"] for r in sp.knn(q, pts, 3).orderBy("rank").collect()] == [19, 18, 17]


def test_degenerate_triangle_and_segment(spark):
    df = spark.range(1).select(ge.segment_project((1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0))[0].alias("d"), ge.point_triangle((0.0, 0.0, 2.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (2.0, 0.0, 0.0)).alias("t"))
    row = df.first()
    assert row["d"] == 1 and math.isclose(row["t"], 4)


def test_bilinear_fit_is_least_squares(spark):
    rng = np.random.default_rng(3)
    u, v = rng.normal(size=(2, 30))
    d = rng.normal(size=30)
    rows = [(0, *map(float, r)) for r in zip(u, v, d)] + [(1, 0.5, 0.5, 1.0), (2, 0.0, 0.0, 7.0), (3, -1.0, 0.0, 2.0), (3, 1.0, 0.0, 4.0)]
    out = {r["k"]: r["distance"] for r in fu.least_squares_fit(spark.createDataFrame(rows, "k long, u double, v double, d double"), ["k"], "u", "v", "d").collect()}
    best = np.linalg.lstsq(np.stack([np.ones(30), u, v, u * v], 1), d, rcond=None)[0][0]
    assert out[0] == pytest.approx(best)
    assert out[1] is None and out[2] == pytest.approx(7) and out[3] == pytest.approx(3)


def test_tables_without_a_named_folder(spark):
    from pointweave.sources import durable

    class Bare:
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: {"spark.sql.warehouse.dir": "hdfs:/w/"}.get(k, d))})
        sparkContext = type("Context", (), {"master": "local[4]"})

    own = durable.shared_dir(Bare)
    assert own == durable.shared_dir(Bare) and "spark-tables-" in own
    Bare.sparkContext.master = "local-cluster[2,1,1024]"
    assert durable.shared_dir(Bare) == "hdfs:/w/checkpoints"
    assert durable.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
