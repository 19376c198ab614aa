"""Queries of spatial joins and what builds on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointweave.operators import spatial as sp
from pointweave.plans.geometry_queries import _TRI, measured
from pointweave.plans.registry import add

I = ["item_id"]  # noqa: E741
_D2 = "(q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)"


def _nn(k: int, where_q: str = "TRUE", where_p: str = "TRUE") -> str:
    return f"""(SELECT * FROM (SELECT q.item_id, q.point_id, p.point_id AS other, {_D2} AS d2, ROW_NUMBER() OVER (PARTITION BY q.item_id, q.point_id ORDER BY {_D2}, p.point_id) AS rank
      FROM fx_points q JOIN fx_points p USING (item_id) WHERE ({where_q}) AND ({where_p})) WHERE rank <= {k})"""


EVEN, ODD = "q.point_id % 2 = 0", "p.point_id % 2 = 1"
ev = lambda v: v("fx_points").where("point_id % 2 = 0")
od = lambda v: v("fx_points").where("point_id % 2 = 1")

add("j3_knn", lambda v: sp.knn(v("fx_points"), v("fx_points"), 5, I), f"SELECT * FROM {_nn(5)}", "d2")
add("w1_neighbour_rank", lambda v: sp.knn(ev(v), od(v), 4, I).select("item_id", "point_id", "other", "rank"), f"SELECT item_id, point_id, other, rank FROM {_nn(4, EVEN, ODD)}")
add("j4_knn_feature", lambda v: sp.knn_feature(v("embeddings").withColumn("item_id", F.col("label").cast("long")).withColumnRenamed("vec_id", "point_id"), 4, "item_id", "point_id", "embedding").drop("d2"),
    """WITH e AS (SELECT label::BIGINT AS item_id, vec_id AS point_id, list_transform(embedding, lambda x: x::DOUBLE) AS u FROM embeddings), n AS (SELECT *, list_sum(list_transform(u, lambda x: x * x)) AS uu FROM e)
    SELECT * FROM (SELECT a.item_id, a.point_id, b.point_id AS other, ROW_NUMBER() OVER (PARTITION BY a.item_id, a.point_id ORDER BY ROUND(a.uu - 2 * list_dot_product(a.u, b.u) + b.uu, 9), b.point_id) AS rank FROM n a JOIN n b USING (item_id)) WHERE rank <= 4""")
add("j5_knn_exclude", lambda v: sp.knn(v("fx_points"), v("fx_points"), 5, I).where("rank > 1").withColumn("rank", F.col("rank") - 1), f"SELECT item_id, point_id, other, d2, rank - 1 AS rank FROM {_nn(5)} WHERE rank > 1", "d2")
add("j6_ball_query", lambda v: sp.ball_query(v("fx_points"), v("fx_points"), 0.1234, 6, I).select("item_id", "point_id", F.array_join(F.transform("hits", lambda x: x.cast("string")), ",").alias("hits")),
    f"""WITH h AS (SELECT q.item_id, q.point_id, list_sort(list(p.point_id))[1:6] AS hits FROM fx_points q JOIN fx_points p ON q.item_id = p.item_id AND {_D2} < 0.1234 * 0.1234 GROUP BY 1, 2)
    SELECT item_id, point_id, array_to_string(list_concat(hits, list_transform(range(6 - len(hits)), lambda i: hits[1])), ',') AS hits FROM h""")
add("j7_radius_pairs", lambda v: sp.radius_pairs(v("fx_points"), 0.1567, I), f"SELECT q.item_id, q.point_id AS a, p.point_id AS b, {_D2} AS d2 FROM fx_points q JOIN fx_points p ON q.item_id = p.item_id AND q.point_id < p.point_id AND {_D2} <= 0.1567 * 0.1567", "d2")
add("j8_three_nn_interpolate", lambda v: sp.interpolate(sp.knn(ev(v), od(v), 3, I), od(v), "distance", I), f"SELECT n.item_id, n.point_id, SUM(f.distance / (d2 + 1e-8)) / SUM(1 / (d2 + 1e-8)) AS distance FROM {_nn(3, EVEN, ODD)} n JOIN fx_points f ON f.point_id = other GROUP BY 1, 2", "distance")
add("j9_assign_nearest", lambda v: sp.knn(v("fx_points"), v("fx_points").where("point_id % 10 = 4"), 1, I).join(v("fx_points").select("item_id", F.col("point_id").alias("other"), F.col("distance").alias("feature")), ["item_id", "other"]).select("item_id", "point_id", "other", "feature"),
    f"SELECT n.item_id, n.point_id, other, f.distance AS feature FROM {_nn(1, 'TRUE', 'p.point_id % 10 = 4')} n JOIN fx_points f ON f.point_id = other", "feature")
_ND = """(SELECT p.item_id, p.point_id, p.x, p.y, p.z, p.distance AS own, s.*, SQRT((p.x - ax - t * (bx - ax)) ** 2 + (p.y - ay - t * (by_ - ay)) ** 2 + (p.z - az - t * (bz - az)) ** 2) AS distance FROM fx_points p, LATERAL (SELECT seg_id, ax, ay, az, bx, by_, bz,
    GREATEST(LEAST(((p.x - ax) * (bx - ax) + (p.y - ay) * (by_ - ay) + (p.z - az) * (bz - az)) / ((bx - ax) ** 2 + (by_ - ay) ** 2 + (bz - az) ** 2), 1.0), 0.0) AS t FROM fx_sharp_segments g WHERE g.item_id = p.item_id) s)"""
NEAREST_SEGMENT = f"(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id, point_id ORDER BY ROUND(distance, 12), seg_id) AS nth FROM {_ND}) WHERE nth = 1)"
add("j11_nearest_segment", lambda v: sp.nearest_segment(v("fx_points"), v("fx_sharp_segments"), I).select("item_id", "point_id", "seg_id", "distance"), f"SELECT item_id, point_id, seg_id, distance FROM {NEAREST_SEGMENT}", "distance")
add("g9_match_to_segments", lambda v: sp.nearest_segment(v("fx_points"), v("fx_sharp_segments"), I).withColumn("distance", F.round("distance", 9)).groupBy("item_id", "seg_id").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("total")),
    f"SELECT item_id, seg_id, COUNT(*) AS n, SUM(ROUND(distance, 9)) AS total FROM {NEAREST_SEGMENT} GROUP BY 1, 2", "total")


def plane_faces(v):
    return measured(v).join(v("fx_plane_faces").select("item_id", "fid"), ["item_id", "fid"], "left_semi").withColumnRenamed("by", "by_")


def _edge(a: str, b: str) -> str:
    t = f"GREATEST(LEAST(((p.x - {a[0]}) * ({b[0]} - {a[0]}) + (p.y - {a[1]}) * ({b[1]} - {a[1]}) + (p.z - {a[2]}) * ({b[2]} - {a[2]})) / (({b[0]} - {a[0]}) ** 2 + ({b[1]} - {a[1]}) ** 2 + ({b[2]} - {a[2]}) ** 2), 1.0), 0.0)"
    return " + ".join(f"(p.{c} - {x} - {t} * ({y} - {x})) ** 2" for c, x, y in zip("xyz", a, b))


_A, _B, _C3 = ("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx", "cy", "cz")


def point_faces(join: str, keys: str, points: str = "fx_points") -> str:
    """SQL of every point's distance to the triangles that ``join`` pairs it with; needs the CTEs of ``_TRI``."""
    return f"""(SELECT p.*, CASE WHEN u >= 0 AND w >= 0 AND u + w <= 1 THEN ABS(h) / SQRT(nn) ELSE SQRT(LEAST(d0, d1, d2)) END AS distance FROM (
  SELECT {keys}, nx * nx + ny * ny + nz * nz AS nn, (p.x - ax) * nx + (p.y - ay) * ny + (p.z - az) * nz AS h,
    ((by_ - ay) * (p.z - az) - (bz - az) * (p.y - ay)) * nx / (4 * area * area) + ((bz - az) * (p.x - ax) - (bx - ax) * (p.z - az)) * ny / (4 * area * area) + ((bx - ax) * (p.y - ay) - (by_ - ay) * (p.x - ax)) * nz / (4 * area * area) AS u,
    ((p.y - ay) * (cz - az) - (p.z - az) * (cy - ay)) * nx / (4 * area * area) + ((p.z - az) * (cx - ax) - (p.x - ax) * (cz - az)) * ny / (4 * area * area) + ((p.x - ax) * (cy - ay) - (p.y - ay) * (cx - ax)) * nz / (4 * area * area) AS w,
    {_edge(_A, _B)} AS d0, {_edge(_B, _C3)} AS d1, {_edge(_C3, _A)} AS d2 FROM {points} p JOIN tri ON {join}) p)"""


_FACED = point_faces("tri.item_id = p.item_id AND (tri.item_id, tri.fid) IN (SELECT (item_id, fid) FROM fx_plane_faces)", "p.item_id, p.point_id, tri.fid")
add("j12_nearest_face", lambda v: sp.nearest_face(v("fx_points"), plane_faces(v), I).select("item_id", "point_id", "fid", "distance"), _TRI + f" SELECT item_id, point_id, fid, distance FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id, point_id ORDER BY ROUND(distance, 12), fid) AS nth FROM {_FACED}) WHERE nth = 1", "distance")
add("a37_chamfer", lambda v: sp.chamfer(ev(v), od(v), I), f"SELECT item_id, a.m AS a_to_b, b.m AS b_to_a, a.m + b.m AS chamfer FROM (SELECT item_id, AVG(d2) AS m FROM {_nn(1, EVEN, ODD)} GROUP BY 1) a JOIN (SELECT item_id, AVG(d2) AS m FROM {_nn(1, 'q.point_id % 2 = 1', 'p.point_id % 2 = 0')} GROUP BY 1) b USING (item_id)", "a_to_b", "b_to_a", "chamfer")
add("a38_fbeta", lambda v: sp.fbeta(ev(v), od(v), I, 0.1234), f"SELECT item_id, p AS precision, r AS recall, COALESCE(1.25 * p * r / NULLIF(0.25 * p + r, 0), 0) AS fbeta FROM (SELECT item_id, AVG(CASE WHEN d2 < 0.1234 * 0.1234 THEN 1.0 ELSE 0 END) AS p FROM {_nn(1, EVEN, ODD)} GROUP BY 1) JOIN (SELECT item_id, AVG(CASE WHEN d2 < 0.1234 * 0.1234 THEN 1.0 ELSE 0 END) AS r FROM {_nn(1, 'q.point_id % 2 = 1', 'p.point_id % 2 = 0')} GROUP BY 1) USING (item_id)", '"precision"', "recall", "fbeta")
add("a53_nn_distance", lambda v: sp.knn(v("fx_points"), v("fx_points"), 2, I).where("rank = 2").withColumn("d", F.sqrt("d2")).groupBy("item_id").agg(F.avg("d").alias("mean"), F.percentile("d", 0.5).alias("median")), f"SELECT item_id, AVG(SQRT(d2)) AS mean, QUANTILE_CONT(SQRT(d2), 0.5) AS median FROM {_nn(2)} WHERE rank = 2 GROUP BY 1", "mean", "median")
add("a54_flag_deviating_resolution", lambda v: sp.knn(v("fx_points"), v("fx_points"), 2, I).where("rank = 2").groupBy("item_id").agg((F.abs(F.avg(F.sqrt("d2")) - 0.1) > 0.0101).alias("deviating")), f"SELECT item_id, ABS(AVG(SQRT(d2)) - 0.1) > 0.0101 AS deviating FROM {_nn(2)} WHERE rank = 2 GROUP BY 1")
add("a55_flag_sharpness_discontinuity", lambda v: (lambda n, p: n.join(p.select("point_id", F.col("distance").alias("di")), "point_id").join(p.select(F.col("point_id").alias("other"), F.col("distance").alias("dj")), "other").groupBy("item_id").agg(F.bool_or(F.abs(F.col("di") - F.col("dj")) > 1.1 * F.sqrt("d2")).alias("jump")))(sp.knn(v("fx_points"), v("fx_points"), 2, I).where("rank = 2"), v("fx_points")),
    f"SELECT n.item_id, BOOL_OR(ABS(a.distance - b.distance) > 1.1 * SQRT(d2)) AS jump FROM {_nn(2)} n JOIN fx_points a ON a.point_id = n.point_id JOIN fx_points b ON b.point_id = other WHERE rank = 2 GROUP BY 1")
add("a71_label_stat_ball", lambda v: sp.radius_join(v("fx_points").select("item_id", "point_id", "x", "y", "z"), v("fx_points").withColumn("cls", F.col("point_id") % 3).select("item_id", "point_id", "cls", "x", "y", "z"), 0.1567, I).groupBy("item_id", "point_id").agg(*(F.sum((F.col("p_cls") == c).cast("long")).alias(f"n{c}") for c in range(3))),
    "SELECT q.item_id, q.point_id, " + ", ".join(f"SUM(CASE WHEN p.point_id % 3 = {c} THEN 1 ELSE 0 END)::BIGINT AS n{c}" for c in range(3)) + f" FROM fx_points q JOIN fx_points p ON q.item_id = p.item_id AND {_D2} < 0.1567 * 0.1567 GROUP BY 1, 2")
add("a72_voxel_downsample", lambda v: sp.voxel_downsample(v("fx_points"), 0.1003, I, ["distance"]).select("item_id", "n", "x", "distance"), "SELECT item_id, COUNT(*) AS n, AVG(x) AS x, AVG(distance) AS distance FROM fx_points GROUP BY item_id, FLOOR(x / 0.1003), FLOOR(y / 0.1003), FLOOR(z / 0.1003)", "x", "distance")
#: Moments of each point's neighbourhood of radius 0.2 and the ratios of its covariance's eigenvalues.
PCA = f"""(SELECT *, CASE WHEN n <= 5 OR q <= 0 THEN 1.0 ELSE GREATEST(l1, 0) / (3 * q) END AS r1, CASE WHEN n <= 5 OR q <= 0 THEN 0.0 ELSE GREATEST(3 * q - l1 - l3, 0) / (3 * q) END AS r2, CASE WHEN n <= 5 OR q <= 0 THEN 0.0 ELSE GREATEST(l3, 0) / (3 * q) END AS r3 FROM (
  SELECT *, q + 2 * e * COS(phi) AS l1, q + 2 * e * COS(phi + 2 * PI() / 3) AS l3 FROM (
  SELECT *, CASE WHEN e > 0 THEN ACOS(GREATEST(LEAST(((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * e * e * e), 1.0), -1.0)) / 3 ELSE 0 END AS phi FROM (
  SELECT *, SQRT(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS e FROM (
  SELECT *, (xx + yy + zz) / 3 AS q FROM (
  SELECT q.item_id, q.point_id, COUNT(*) AS n, VAR_POP(p.x) AS xx, VAR_POP(p.y) AS yy, VAR_POP(p.z) AS zz, COVAR_POP(p.x, p.y) AS xy, COVAR_POP(p.x, p.z) AS xz, COVAR_POP(p.y, p.z) AS yz
  FROM fx_points q JOIN fx_points p ON q.item_id = p.item_id AND {_D2} < 0.2 * 0.2 GROUP BY 1, 2))))))"""
add("a73_pca_ratio", lambda v: sp.pca_ratio(v("fx_points"), 0.2, I), f"SELECT item_id, point_id, n, r1, r2, r3 FROM {PCA}", "r1", "r2", "r3")
add("a74_corner_probability", lambda v: (lambda n: sp.corner_probability(sp.variance_dynamics(v("fx_points"), n, I, "distance"), [0.5, 5.0, 50.0], I))(sp.knn(v("fx_points"), v("fx_points"), 5, I)),
    f"SELECT item_id, point_id, (CASE WHEN s > 0.5 THEN 1.0 ELSE 0 END + CASE WHEN s > 5 THEN 1.0 ELSE 0 END + CASE WHEN s > 50 THEN 1.0 ELSE 0 END) / 3 AS corner FROM (SELECT n.item_id, n.point_id, SUM((b.distance - a.distance) ** 2 / d2) AS s FROM {_nn(5)} n JOIN fx_points a ON a.point_id = n.point_id JOIN fx_points b ON b.point_id = other WHERE d2 > 0 GROUP BY 1, 2)", "corner")
add("a75_knn_regress", lambda v: sp.knn_mean(sp.knn(v("fx_points"), od(v), 6, I), od(v), "distance", I), f"SELECT n.item_id, n.point_id, AVG(f.distance) AS distance FROM {_nn(6, 'TRUE', ODD)} n JOIN fx_points f ON f.point_id = other GROUP BY 1, 2", "distance")
add("k8_farthest_pair", lambda v: sp.farthest_pair(v("fx_points"), I), f"SELECT item_id, a, b, SQRT(d) AS length FROM (SELECT q.item_id, q.point_id AS a, p.point_id AS b, ROUND({_D2}, 9) AS d, ROW_NUMBER() OVER (PARTITION BY q.item_id ORDER BY ROUND({_D2}, 9) DESC, q.point_id, p.point_id) AS n FROM fx_points q JOIN fx_points p ON q.item_id = p.item_id AND q.point_id < p.point_id) WHERE n = 1", "length")


def _farthest(k: int) -> str:
    """Rounds of farthest-point sampling, unrolled."""
    ctes = ["c1 AS (SELECT p.*, 0::DOUBLE AS gap, 1 AS n FROM fx_points p JOIN (SELECT item_id, MIN(point_id) AS point_id FROM fx_points GROUP BY 1) USING (item_id, point_id))", "g0 AS (SELECT *, 1e300::DOUBLE AS gap FROM fx_points)"]
    for i in range(1, k):
        ctes.append(f"g{i} AS (SELECT q.item_id, q.point_id, q.x, q.y, q.z, CASE WHEN q.point_id = p.point_id THEN -1 ELSE LEAST(q.gap, ROUND({_D2}, 12)) END AS gap FROM g{i - 1} q JOIN c{i} p USING (item_id))")
        ctes.append(f"c{i + 1} AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY gap DESC, point_id) AS n FROM g{i}) WHERE n = 1)")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT item_id, point_id, {i}::BIGINT AS rank FROM c{i}" for i in range(1, k + 1))


add("k9_farthest_point_sampling", lambda v: sp.farthest_points(v("fx_points"), 4, I), _farthest(4))
#: A walk through the points in the order of their hashes; each is kept if none kept before is within the radius.
_WALK = """WITH RECURSIVE o AS MATERIALIZED (SELECT item_id, point_id, x, y, z, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY md5('9|' || point_id), point_id) AS n FROM fx_points),
walk(item_id, n, kept) AS (SELECT DISTINCT item_id, 0::BIGINT, []::STRUCT(p BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[] FROM o
  UNION ALL SELECT w.item_id, o.n, CASE WHEN len(list_filter(kept, lambda k: (k.x - o.x) ** 2 + (k.y - o.y) ** 2 + (k.z - o.z) ** 2 <= 0.1567 * 0.1567)) = 0 THEN list_append(kept, {'p': o.point_id, 'x': o.x, 'y': o.y, 'z': o.z}) ELSE kept END
  FROM walk w JOIN o ON o.item_id = w.item_id AND o.n = w.n + 1)
SELECT item_id, UNNEST(kept).p AS point_id FROM (SELECT * FROM walk QUALIFY ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY n DESC) = 1)"""
add("k11_thin", lambda v: sp.thin(v("fx_points"), 0.1567, I, 9).select("item_id", "point_id"), _WALK)
add("k11_spaced_sample", lambda v: sp.spaced_sample(v("fx_points"), 12, I, 9).select("item_id", "point_id", "spacing"))
add("j21_cross_view_candidates", lambda v: (lambda n: n.groupBy("item_id", "point_id").agg(F.max("d2").alias("far"), F.count(F.lit(1)).alias("n")).where("n = 4 and far < 0.0401").select("item_id", "point_id"))(sp.knn(ev(v), od(v), 4, I, xyz=("x", "y"))),
    f"SELECT item_id, point_id FROM (SELECT q.item_id, q.point_id, (q.x - p.x) ** 2 + (q.y - p.y) ** 2 AS d2, ROW_NUMBER() OVER (PARTITION BY q.item_id, q.point_id ORDER BY (q.x - p.x) ** 2 + (q.y - p.y) ** 2, p.point_id) AS rank FROM fx_points q JOIN fx_points p USING (item_id) WHERE {EVEN} AND {ODD}) WHERE rank <= 4 GROUP BY 1, 2 HAVING COUNT(*) = 4 AND MAX(d2) < 0.0401")
