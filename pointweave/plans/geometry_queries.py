"""Queries of geometry, raster and curve operators (F, R, W2, W8-W11, S14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointweave.functions import geometry as ge
from pointweave.operators import graph as gr
from pointweave.operators import raster as ra
from pointweave.operators.tables import uniform
from pointweave.plans.registry import add

P, A, B = ("px", "py", "pz"), ("ax", "ay", "az"), ("bx", "by_", "bz")
XYZ = ("x", "y", "z")
_SEG = "SELECT s.item_id, s.seg_id, p.point_id, p.x AS px, p.y AS py, p.z AS pz, ax, ay, az, bx, by_, bz FROM fx_sharp_segments s JOIN fx_points p ON p.item_id = s.item_id"
_T = "GREATEST(LEAST(((px - ax) * (bx - ax) + (py - ay) * (by_ - ay) + (pz - az) * (bz - az)) / NULLIF((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) + (bz - az) * (bz - az), 0), 1.0), 0.0)"
_PROJ = f"""WITH s AS ({_SEG}), t AS (SELECT *, {_T} AS t FROM s), q AS (SELECT *, ax + t * (bx - ax) AS qx, ay + t * (by_ - ay) AS qy, az + t * (bz - az) AS qz FROM t),
  a AS (SELECT *, SQRT((px - qx) * (px - qx) + (py - qy) * (py - qy) + (pz - qz) * (pz - qz)) AS dist FROM q),
  d AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id, point_id ORDER BY ROUND(dist, 12), seg_id) AS nth FROM a) WHERE nth = 1)"""


def _projected(v):
    """Each point on its nearest sharp segment."""
    from pointweave.operators.spatial import nearest_segment

    near = nearest_segment(v("fx_points"), v("fx_sharp_segments"), ["item_id"]).select("item_id", "point_id", "seg_id")
    d, q, t = ge.segment_project(P, A, B)
    own = v("fx_points").select("item_id", "point_id", *(F.col(c).alias(f"p{c}") for c in XYZ))
    return near.join(own, ["item_id", "point_id"]).join(v("fx_sharp_segments"), ["item_id", "seg_id"]).withColumns({"dist": d, "t": t, "qx": q[0], "qy": q[1], "qz": q[2]})


def _label(v):
    d, n = ge.bounded_label(P, ("qx", "qy", "qz"), 0.1)
    return _projected(v).select("seg_id", "point_id", d.alias("label"), n[0].alias("nx"), n[1].alias("ny"), n[2].alias("nz"))


def _box(v):
    lo, hi = ge.aabb([A, B], 0.01)
    return v("fx_segments").select("seg_id", *(c.alias(n) for c, n in zip((*lo, *hi), ("lx", "ly", "lz", "hx", "hy", "hz"))))


_CORNERS = "fx_faces f JOIN fx_points a ON a.point_id = f.v0 JOIN fx_points b ON b.point_id = f.v1 JOIN fx_points c ON c.point_id = f.v2"


def corners(v):
    """Faces with the coordinates of their corners."""
    out = v("fx_faces")
    for k, n in zip(("v0", "v1", "v2"), "abc"):
        out = out.join(v("fx_points").select(F.col("point_id").alias(k), *(F.col(x).alias(n + x) for x in XYZ)), k)
    return out


_TRI = f"""WITH k AS (SELECT f.item_id, fid, v0, v1, v2, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM {_CORNERS}),
  e AS (SELECT *, SQRT((bx - ax) ** 2 + (by_ - ay) ** 2 + (bz - az) ** 2) AS e0, SQRT((cx - bx) ** 2 + (cy - by_) ** 2 + (cz - bz) ** 2) AS e1, SQRT((ax - cx) ** 2 + (ay - cy) ** 2 + (az - cz) ** 2) AS e2,
    (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM k),
  tri AS (SELECT *, SQRT(nx * nx + ny * ny + nz * nz) / 2 AS area FROM e)"""
ca, cb, cc = [[n + x for x in XYZ] for n in "abc"]


def measured(v):
    """Faces with edges, area and radii."""
    edges, area = ge.triangle_edges(ca, cb, cc), ge.triangle_area(ca, cb, cc)
    return corners(v).withColumns({"area": area, "e0": edges[0], "e1": edges[1], "e2": edges[2], "circum": ge.circumradius(edges, area), "inner": ge.inradius(edges, area)})


add("f1_bounded_label", _label, _PROJ + " SELECT seg_id, point_id, LEAST(dist, 0.1) AS label, CASE WHEN dist <= 0.1 THEN (qx - px) / (dist + 1e-6) ELSE 0 END AS nx, CASE WHEN dist <= 0.1 THEN (qy - py) / (dist + 1e-6) ELSE 0 END AS ny, CASE WHEN dist <= 0.1 THEN (qz - pz) / (dist + 1e-6) ELSE 0 END AS nz FROM d", "label", "nx", "ny", "nz")
add("f2_segment_project", lambda v: _projected(v).select("seg_id", "point_id", "dist", "t", "qx"), _PROJ + " SELECT seg_id, point_id, dist, t, qx FROM d", "dist", "t", "qx")
add("f3_aabb", _box, "SELECT seg_id, LEAST(ax, bx) - 0.01 AS lx, LEAST(ay, by_) - 0.01 AS ly, LEAST(az, bz) - 0.01 AS lz, GREATEST(ax, bx) + 0.01 AS hx, GREATEST(ay, by_) + 0.01 AS hy, GREATEST(az, bz) + 0.01 AS hz FROM fx_segments", "lx", "ly", "lz", "hx", "hy", "hz")
add("f4_triangles", lambda v: measured(v).select("fid", "item_id", "area", "e0", "circum", "inner"), _TRI + " SELECT fid, item_id, area, e0, e0 * e1 * e2 / (4 * area) AS circum, 2 * area / (e0 + e1 + e2) AS inner FROM tri".replace("AS inner", 'AS "inner"'), "area", "e0", "circum", '"inner"')
_M = [0.0, -1.0, 0.0, 0.5, 1.0, 0.0, 0.0, -0.25, 0.0, 0.0, 1.0, 2.0, 0.0, 0.0, 0.0, 1.0]
add("f5_transform_points", lambda v: v("fx_points").select("point_id", *(c.alias(n) for c, n in zip(ge.transform_point(_M, XYZ), ("tx", "ty", "tz"))), *(c.alias(n) for c, n in zip(ge.transform_point(ge.rigid_inverse(_M), XYZ), ("ix", "iy", "iz")))),
    "SELECT point_id, -y + 0.5 AS tx, x - 0.25 AS ty, z + 2 AS tz, y + 0.25 AS ix, 0.5 - x AS iy, z - 2 AS iz FROM fx_points", "tx", "ty", "tz", "ix", "iy", "iz")
add("f6_project", lambda v: v("fx_points").select("point_id", *(c.alias(n) for c, n in zip(ge.project(2.0, [F.col("x"), F.col("y"), F.col("z") + 3]), "uvw"))), "SELECT point_id, 2 * x / (z + 3) AS u, 2 * y / (z + 3) AS v, z + 3 AS w FROM fx_points", "u", "v", "w")


def _pixel(v):
    row, col, inside = ge.to_pixel(F.col("x"), F.col("y"), 0.0123, 0.0123, 20, 20)
    return v("fx_points").select("point_id", row.alias("pr"), col.alias("pc"), inside.alias("inside")).where("inside")


add("f7_to_pixel", _pixel, "SELECT * FROM (SELECT point_id, ROUND_EVEN(y / 0.0123 + 10, 0)::BIGINT AS pr, ROUND_EVEN(x / 0.0123 + 10, 0)::BIGINT AS pc, TRUE AS inside FROM fx_points) WHERE pr > 0 AND pr < 20 AND pc > 0 AND pc < 20")
add("f6_unproject", lambda v: (lambda uvz: v("fx_points").select("point_id", *(c.alias(n) for c, n in zip(ge.unproject(2.0, uvz), XYZ))))(ge.project(2.0, [F.col("x"), F.col("y"), F.col("z") + 3])), "SELECT point_id, x, y, z + 3 AS z FROM fx_points", "x", "y", "z")


def _metric(v):
    x, y = ge.from_pixel(F.col("pr"), F.col("pc"), 0.0123, 0.0123, 16, 64)
    return v("fx_pixels").select("view_id", "pr", "pc", x.alias("x"), y.alias("y"))


add("f7_from_pixel", _metric, "SELECT view_id, pr, pc, (pc - 8) * 0.0123 AS x, (pr - 32) * 0.0123 AS y FROM fx_pixels", "x", "y")
add("f8_ortho_points", lambda v: v("fx_pixels").where("depth <> 0").select("view_id", "pr", "pc", *(c.alias(n) for c, n in zip(ge.ortho_point(F.col("pr"), F.col("pc"), F.col("depth"), 0.02, 16, 64), XYZ))),
    "SELECT view_id, pr, pc, (pc - 7.5) * 0.02 AS x, (pr - 31.5) * 0.02 AS y, depth AS z FROM fx_pixels WHERE depth <> 0", "x", "y", "z")
add("f9_rotate_scale", lambda v: v("fx_points").select("point_id", *(c.alias(n) for c, n in zip(ge.transform_point(ge.matmul4(ge.rotation("z", 0.3), ge.scaling(2.0)), XYZ), XYZ))),
    "SELECT point_id, 2 * (COS(0.3) * x - SIN(0.3) * y) AS x, 2 * (SIN(0.3) * x + COS(0.3) * y) AS y, 2 * z AS z FROM fx_points", "x", "y", "z")
add("f10_center_normalize", lambda v: ge.normalize_max(ge.center(v("fx_points"), ["item_id"], XYZ), ["item_id"], XYZ).drop("distance"),
    "WITH c AS (SELECT item_id, point_id, x - AVG(x) OVER w AS x, y - AVG(y) OVER w AS y, z - AVG(z) OVER w AS z FROM fx_points WINDOW w AS (PARTITION BY item_id)), m AS (SELECT *, MAX(SQRT(x * x + y * y + z * z)) OVER (PARTITION BY item_id) AS k FROM c) SELECT item_id, point_id, x / k AS x, y / k AS y, z / k AS z FROM m", "x", "y", "z")
add("f11_normalize_depth", lambda v: ge.normalize_depth(v("fx_pixels").withColumn("depth", F.when(F.col("depth") < 20, 0.0).otherwise(F.col("depth"))), ["view_id"], "depth", 0.0).drop("event_id"),
    "WITH p AS (SELECT view_id, pr, pc, CASE WHEN depth < 20 THEN 0.0 ELSE depth END AS depth FROM fx_pixels), l AS (SELECT view_id, MIN(depth) AS low, MAX(depth) AS high, QUANTILE_CONT(depth, 0.95) AS cut FROM p WHERE depth <> 0 GROUP BY 1) SELECT view_id, pr, pc, CASE WHEN depth <> 0 THEN (depth - low) / COALESCE(NULLIF(cut - low, 0), NULLIF(high - low, 0), 1) ELSE depth END AS depth FROM p LEFT JOIN l USING (view_id)", "depth")
add("f12_histogram_expectation", lambda v: v("fx_points").select("point_id", ge.histogram_expectation(F.array("x", "y", "z"), 0.0, 1.0, 0.1).alias("e")),
    "SELECT point_id, (EXP(x) * (-0.1 + 0.5 * 0.4) + EXP(y) * (-0.1 + 1.5 * 0.4) + EXP(z) * (-0.1 + 2.5 * 0.4)) / (EXP(x) + EXP(y) + EXP(z)) AS e FROM fx_points", "e")
add("f14_tangent_frame", lambda v: (lambda t, b: v("fx_points").select("point_id", t[0].alias("tx"), t[2].alias("tz"), b[1].alias("by_")))(*ge.tangent_frame(XYZ)),
    "SELECT point_id, -z / SQRT(x * x + z * z) AS tx, x / SQRT(x * x + z * z) AS tz, (z * -z - x * x) / SQRT(x * x + z * z) AS by_ FROM fx_points", "tx", "tz", "by_")
_PATH = "concat('d', {s}, '/d', {s}, '_h', {s}, '_feat_', {k}, '.yml')"
add("f15_ids_from_paths", lambda v: v("pages").withColumn("path", F.expr(_PATH.format(s="cast(page_id as string)", k="'007'"))).select("page_id", ge.item_id_from_path(F.col("path")).alias("item"), ge.modality_from_path(F.col("path")).alias("modality")),
    "SELECT page_id, 'd' || page_id || '_h' || page_id || '_007' AS item, 'feat' AS modality FROM pages")
add("f15_chunk_from_path", lambda v: v("pages").select("page_id", ge.chunk_from_path(F.expr("concat('/data/abc_', lpad(cast(page_id % 100 as string), 4, '0'), '_obj_v00.7z')")).alias("plain"), ge.chunk_from_path(F.expr("concat('/data/', lpad(cast(page_id as string), 4, '0'), '_obj_v00/x.yml')")).alias("chunk")),
    "SELECT page_id, lpad((page_id % 100)::VARCHAR, 4, '0') AS plain, lpad(page_id::VARCHAR, 4, '0') AS chunk FROM pages")
_UN = lambda s: f"((('0x' || substr(md5('{s}|' || point_id), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0"
add("f16_add_noise", lambda v: ge.add_noise(v("fx_points"), "z", 0.01, 11, ["point_id"]).select("point_id", "z"), f"SELECT point_id, z + 0.01 * SQRT(-2 * LN({_UN(11)})) * COS(2 * PI() * {_UN(12)}) AS z FROM fx_points", "z")
add("f16_many_scales", lambda v: ge.many_scales(v("fx_points"), "isotropic", [0.0, 0.01, 0.05], 11, ["point_id"]).select("point_id", "noise_scale", "x"),
    f"SELECT point_id, s AS noise_scale, x + s * SQRT(-2 * LN({_UN(11)})) * COS(2 * PI() * {_UN(12)}) AS x FROM fx_points, (SELECT UNNEST([0.0::DOUBLE, 0.01, 0.05]) AS s)", "noise_scale", "x")
_UV = lambda s: f"((('0x' || substr(md5('{s}|' || view_id), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0"
add("f17_augment", lambda v: ge.augment(v("fx_pixels").withColumn("label", F.col("depth") / 2), 21, ["view_id"], "pr", "pc", "depth", "label", 0.9, 1.1, 16, 64).drop("event_id"),
    f"SELECT view_id, CASE WHEN {_UV(22)} < 0.5 THEN 63 - pr ELSE pr END AS pr, CASE WHEN {_UV(23)} < 0.5 THEN 15 - pc ELSE pc END AS pc, depth * (0.9 + 0.2 * {_UV(21)}) AS depth, depth / 2 * (0.9 + 0.2 * {_UV(21)}) AS label FROM fx_pixels", "depth", "label")
# curves
_C = "(SELECT item_id, curve_id, vid, x, y, z FROM fx_curve_verts JOIN fx_points p USING (item_id) WHERE vid = point_id)"


def _curves(v):
    return v("fx_curve_verts").join(v("fx_points").select("item_id", F.col("point_id").alias("vid"), *XYZ), ["item_id", "vid"])


_GAP = f"(SELECT *, SQRT((x - LAG(x) OVER w) ** 2 + (y - LAG(y) OVER w) ** 2 + (z - LAG(z) OVER w) ** 2) AS gap, SQRT((LEAD(x) OVER w - x) ** 2 + (LEAD(y) OVER w - y) ** 2 + (LEAD(z) OVER w - z) ** 2) AS nxt FROM {_C} WINDOW w AS (PARTITION BY item_id, curve_id ORDER BY vid))"
CURVE = ["item_id", "curve_id"]
add("w2_polyline_length", lambda v: ge.polyline_length(_curves(v), CURVE, "vid"), f"SELECT item_id, curve_id, COALESCE(SUM(gap), 0) AS length FROM {_GAP} GROUP BY 1, 2", "length")
add("w8_arc_parameter", lambda v: ge.arc_parameter(_curves(v), CURVE, "vid").select(*CURVE, "vid", "t"), f"SELECT item_id, curve_id, vid, COALESCE(SUM(gap) OVER (PARTITION BY item_id, curve_id ORDER BY vid ROWS UNBOUNDED PRECEDING), 0) / SUM(gap) OVER (PARTITION BY item_id, curve_id) AS t FROM {_GAP}", "t")
add("w9_spacing_weights", lambda v: ge.spacing_weights(_curves(v), CURVE, "vid").select(*CURVE, "vid", "weight"), f"SELECT item_id, curve_id, vid, (COALESCE(gap, 0) + COALESCE(nxt, 0)) / 2 AS weight FROM {_GAP}", "weight")
_TURN = f"(SELECT *, ((x - LAG(x) OVER w) * (LEAD(x) OVER w - x) + (y - LAG(y) OVER w) * (LEAD(y) OVER w - y) + (z - LAG(z) OVER w) * (LEAD(z) OVER w - z)) / (gap * nxt) AS turn FROM {_GAP} WINDOW w AS (PARTITION BY item_id, curve_id ORDER BY vid))"
add("w10_turn_cosines", lambda v: ge.turn_cosines(_curves(v), CURVE, "vid").select(*CURVE, "vid", "turn"), f"SELECT item_id, curve_id, vid, turn FROM {_TURN}", "turn")
add("w11_split_at_breakpoints", lambda v: ge.split_at_breakpoints(_curves(v), CURVE, "vid", -0.5).select(*CURVE, "vid", "piece"),
    f"WITH s AS (SELECT *, COALESCE(turn >= -0.5, TRUE) AS st FROM {_TURN}), f AS (SELECT *, CASE WHEN st <> LAG(st) OVER (PARTITION BY item_id, curve_id ORDER BY vid) THEN 1 ELSE 0 END AS flip FROM s) SELECT item_id, curve_id, vid, SUM(flip) OVER (PARTITION BY item_id, curve_id ORDER BY vid ROWS UNBOUNDED PRECEDING)::BIGINT AS piece FROM f")
# raster
def fore():
    return F.col("depth") >= 20


for keep, o in (("min", "depth"), ("max", "-depth")):
    add(f"r1_z_buffer_{keep}", lambda v, keep=keep: ra.z_buffer(v("fx_pixel_hits"), keep), f"SELECT view_id, pr, pc, depth, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY view_id, pr, pc ORDER BY {o}, event_id) AS n FROM fx_pixel_hits) WHERE n = 1", "depth")
add("r2_erode", lambda v: ra.erode(v("fx_pixels"), 1, fore()), "SELECT * FROM fx_pixels p WHERE depth >= 20 AND NOT EXISTS (SELECT 1 FROM fx_pixels b WHERE b.depth < 20 AND b.view_id = p.view_id AND ABS(b.pr - p.pr) <= 1 AND ABS(b.pc - p.pc) <= 1)", "depth")
_SOB = "SELECT view_id, pr, pc, SQRT(gr * gr + gc * gc) / SQRT(2.0::DOUBLE) AS magnitude FROM (SELECT p.view_id, p.pr, p.pc, COUNT(*) AS n, SUM(b.depth * (b.pr - p.pr) * (2 - ABS(b.pc - p.pc)) / 4) AS gr, SUM(b.depth * (b.pc - p.pc) * (2 - ABS(b.pr - p.pr)) / 4) AS gc FROM fx_pixels p JOIN fx_pixels b ON b.view_id = p.view_id AND ABS(b.pr - p.pr) <= 1 AND ABS(b.pc - p.pc) <= 1 AND b.depth >= 2 GROUP BY 1, 2, 3) WHERE n = 9"
add("r3_sobel", lambda v: ra.sobel(v("fx_pixels"), F.col("depth") >= 2), _SOB, "magnitude")
add("r4_tiles", lambda v: ra.tiles(v("fx_pixels"), 6, 4, 16, fore()).groupBy("view_id", "tr", "tc").agg(F.count(F.lit(1)).alias("n"), F.sum("lr").alias("s")),
    "SELECT view_id, tr, tc, COUNT(*) AS n, SUM(pr - tr)::BIGINT AS s FROM fx_pixels, (SELECT UNNEST([0, 4, 8])::BIGINT AS tr), (SELECT UNNEST([0, 4, 8])::BIGINT AS tc) WHERE pr >= tr AND pr < tr + 6 AND pc >= tc AND pc < tc + 6 GROUP BY 1, 2, 3 HAVING SUM(CASE WHEN depth >= 20 THEN 1 ELSE 0 END) > 0")
add("r5_crop_pad", lambda v: ra.pad(ra.crop_center(v("fx_pixels").select("view_id", "pr", "pc", "depth"), 16, 16, 8, 8), 8, 8, {"depth": 0.0}),
    "WITH g AS (SELECT view_id, r AS pr, c AS pc FROM (SELECT DISTINCT view_id FROM fx_pixels WHERE pr BETWEEN 4 AND 11 AND pc BETWEEN 4 AND 11), (SELECT UNNEST(range(8)) AS r), (SELECT UNNEST(range(8)) AS c)) SELECT g.view_id, g.pr, g.pc, COALESCE(depth, 0) AS depth FROM g LEFT JOIN fx_pixels p ON p.view_id = g.view_id AND p.pr = g.pr + 4 AND p.pc = g.pc + 4", "depth")
add("r5_uncrop", lambda v: ra.uncrop(ra.crop_center(v("fx_pixels").select("view_id", "pr", "pc", "depth"), 16, 16, 8, 8), 16, 16, 8, 8), "SELECT view_id, pr, pc, depth FROM fx_pixels WHERE pr BETWEEN 4 AND 11 AND pc BETWEEN 4 AND 11", "depth")
add("r6_snap_inside", lambda v: ra.common_bbox(v("fx_pixels"), ["view_id"], F.col("depth") > 20, 2).select("view_id", ra.snap_inside(F.col("top"), F.lit(9).cast("long"), 16).alias("top")), "SELECT view_id, GREATEST(LEAST(MIN(pr) - 2, 16 - 9), 0)::BIGINT AS top FROM fx_pixels WHERE depth > 20 GROUP BY 1")
add("r6_common_bbox", lambda v: ra.common_bbox(v("fx_pixels"), ["view_id"], F.col("depth") > 20, 2).withColumn("side", ra.snap_pow2(F.col("bottom") - F.col("top"))),
    'SELECT *, (2 ** CEIL(LOG2(GREATEST(bottom - top, 1))))::BIGINT AS side FROM (SELECT view_id, MIN(pr) - 2 AS top, MAX(pr) + 2 AS bottom, MIN(pc) - 2 AS "left", MAX(pc) + 2 AS "right" FROM fx_pixels WHERE depth > 20 GROUP BY 1)')
add("r7_tile_normalize", lambda v: ra.tile_normalize(v("fx_pixels"), 4, fore(), 2.5).drop("event_id", "tr", "tc"),
    "SELECT view_id, pr, pc, CASE WHEN depth >= 20 THEN (depth - MIN(CASE WHEN depth >= 20 THEN depth END) OVER (PARTITION BY view_id, pr // 4, pc // 4)) / 2.5 ELSE depth END AS depth FROM fx_pixels", "depth")
add("r8_signal_on_foreground", lambda v: ra.signal_on_foreground(v("fx_pixels").withColumns({"signal": F.col("pc") * 1.5, "depth": F.when(F.col("depth") < 20, 0.0).otherwise(F.col("depth"))}), "signal", 0.0, -1.0).select("view_id", "pr", "pc", "signal"),
    "SELECT view_id, pr, pc, CASE WHEN depth < 20 THEN -1.0 ELSE pc * 1.5 END AS signal FROM fx_pixels", "signal")


def _views(v):
    pose = v("fx_pixels").select("view_id").distinct().withColumn("m", F.array(*(F.lit(float(x)) for x in _M)))
    return ra.fuse_views_plain(v("fx_pixels"), 0.02, 16, 64, pose).select("view_id", "pr", "pc", "global_idx", "x", "y", "z")


_FUSED = "SELECT view_id, pr, pc, ROW_NUMBER() OVER (ORDER BY view_id, pr, pc) - 1 AS global_idx, -(pr - 31.5) * 0.02 + 0.5 AS x, (pc - 7.5) * 0.02 - 0.25 AS y, depth + 2 AS z FROM fx_pixels"
add("r9_fuse_views_plain", _views, _FUSED, "x", "y", "z")
add("s14_points_from_views", lambda v: _views(v).select("global_idx", "x", "y", "z", F.lit(1.0).alias("distance"), F.lit(-1).cast("long").alias("num_surfaces")), f"SELECT global_idx, x, y, z, 1.0::DOUBLE AS distance, -1::BIGINT AS num_surfaces FROM ({_FUSED})", "x", "y", "z")
add("a59_flag_background", lambda v: v("fx_pixels").groupBy("view_id").agg(F.bool_or(F.col("depth") < 20).alias("has_background"), F.count(F.lit(1)).alias("n")), "SELECT view_id, BOOL_OR(depth < 20) AS has_background, COUNT(*) AS n FROM fx_pixels GROUP BY 1")
add("a59_flag_depth_discontinuity", lambda v: ra.sobel(v("fx_pixels"), F.col("depth") >= 2).groupBy("view_id").agg(F.bool_or(F.col("magnitude") > 10.5).alias("jump")), f"SELECT view_id, BOOL_OR(magnitude > 10.5) AS jump FROM ({_SOB}) GROUP BY 1")
add("v5_tile_expansion", lambda v: v("fx_pixels").select("view_id", "pr", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pc"))).alias("step")).groupBy("view_id", "step").agg(F.count(F.lit(1)).alias("n")), "SELECT view_id, step, COUNT(*) AS n FROM (SELECT view_id, UNNEST(range(pc + 1)) AS step FROM fx_pixels) GROUP BY 1, 2")
add("v5_sampled_segments", lambda v: gr.sample_segments(v("fx_segments"), 0.0603).groupBy("item_id", "seg_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last")),
    "SELECT item_id, seg_id, CASE WHEN n >= 1 THEN n ELSE 2 END AS n, CASE WHEN n >= 1 THEN n - 1 ELSE 1 END AS last FROM (SELECT *, FLOOR(SQRT((bx - ax) ** 2 + (by_ - ay) ** 2 + (bz - az) ** 2) / 0.0603)::BIGINT AS n FROM fx_segments)")
add("v5_tiled_pixels", lambda v: ra.tiles(v("fx_pixels"), 6, 3, 16, fore()).groupBy("view_id", "pr", "pc").agg(F.count(F.lit(1)).alias("n")),
    """WITH t AS (SELECT UNNEST([0, 3, 6, 9])::BIGINT AS o), p AS (SELECT view_id, pr, pc, depth, r.o AS tr, c.o AS tc FROM fx_pixels JOIN t r ON pr >= r.o AND pr < r.o + 6 JOIN t c ON pc >= c.o AND pc < c.o + 6)
    SELECT view_id, pr, pc, COUNT(*) AS n FROM p WHERE (view_id, tr, tc) IN (SELECT (view_id, tr, tc) FROM p WHERE depth >= 20) GROUP BY 1, 2, 3""")
