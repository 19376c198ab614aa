"""Compositions that users call: annotation, repair, fusion across views, wireframes."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.functions import geometry as ge
from pointweave.operators import fusion as fu
from pointweave.operators import graph as gr
from pointweave.operators import mesh as ms
from pointweave.operators import spatial as sp
from pointweave.operators import tables as tb
from pointweave.sources.durable import durable, release

ITEM = "item_id"


def cross_view_candidates(targets: DataFrame, sources: DataFrame, k: int, radius: float, z_gap: float | None, by: Sequence[str] = (ITEM,), plane: Sequence[str] = ("x", "y"), least_share: float = 0.0) -> DataFrame:
    """The k nearest source pixels of each target, where all k lie within the radius (and the depth gap).

    Pairs of views (``by``) that keep under ``least_share`` of their targets
    are dropped whole.  With a three-axis ``plane`` this is the 3-D variant.
    """
    near = sp.knn(targets, sources, k, by, xyz=plane)
    own = targets.select(*by, "point_id", F.col("z").alias("tz"))
    other = sources.select(*by, F.col("point_id").alias("other"), F.col("z").alias("sz"))
    pairs = near.join(own, [*by, "point_id"]).join(other, [*by, "other"])
    good = F.col("d2") < radius * radius
    if z_gap is not None:
        good = good & (F.abs(F.col("sz") - F.col("tz")) < z_gap)
    kept = pairs.groupBy(*by, "point_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(good).alias("all_near")).where((F.col("n") == k) & F.col("all_near"))
    if least_share > 0:
        total = targets.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
        share = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("held")).join(total, list(by)).where(F.col("held") >= least_share * F.col("total"))
        kept = kept.join(share.select(*by), list(by), "left_semi")
    return pairs.join(kept.select(*by, "point_id"), [*by, "point_id"], "left_semi").drop("tz", "sz")


def interpolated_fusion(targets: DataFrame, sources: DataFrame, value: str, k: int, radius: float, how: str = "mean", by: Sequence[str] = (ITEM,)) -> DataFrame:
    """A target's own value and the bilinear fit of its candidates, combined."""
    near = cross_view_candidates(targets, sources, k, radius, None, by)
    t = targets.select(*by, "point_id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    s = sources.select(*by, F.col("point_id").alias("other"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col(value).alias("value"))
    local = near.join(t, [*by, "point_id"]).join(s, [*by, "other"]).withColumns({"u": F.col("sx") - F.col("tx"), "v": F.col("sy") - F.col("ty")})
    fits = fu.least_squares_fit(local, [*by, "point_id"], "u", "v", "value").where("distance is not null").select(*by, "point_id", F.col("distance").alias("value"))
    return fu.combine(targets.select(*by, "point_id", F.col(value).alias("value")).unionByName(fits), how, [*by, "point_id"])


def match_meshes_to_clouds(points: DataFrame, faces_xyz: DataFrame, pairs: DataFrame, tolerance: float, k: int = 5) -> DataFrame:
    """For each cloud the k meshes whose largest squared point-to-mesh distance is least and under the tolerance.

    ``pairs`` (cloud, mesh) are the candidates, for instance of like extents.
    """
    cloud = pairs.join(points.withColumnRenamed(ITEM, "cloud"), "cloud")
    mesh = pairs.join(faces_xyz.withColumnRenamed(ITEM, "mesh"), "mesh")
    near = sp.nearest_face(cloud, mesh, ["cloud", "mesh"])
    worst = near.groupBy("cloud", "mesh").agg(F.max(F.round(F.col("distance") * F.col("distance"), 9)).alias("worst")).where(F.col("worst") < tolerance)
    return tb.top_k(worst, ["cloud"], ["worst", "mesh"], k)


def sphere_neighbourhood(points: DataFrame, faces: DataFrame, centre: Sequence[float], radius: float) -> DataFrame:
    """Faces all of whose vertices touch, or share a face with, a vertex inside the sphere."""
    inside = points.where(ge.squared_distance(("x", "y", "z"), centre) < radius * radius).select(ITEM, F.col("point_id").alias("vid"))
    fv = ms.face_vertices(faces)
    touched = fv.join(inside, [ITEM, "vid"], "left_semi").select(ITEM, "fid").distinct()
    verts = fv.join(touched, [ITEM, "fid"], "left_semi").select(ITEM, "vid").distinct()
    full = fv.join(verts, [ITEM, "vid"], "left_semi").groupBy(ITEM, "fid").agg(F.count(F.lit(1)).alias("n")).where("n = 3")
    return faces.join(full.select(ITEM, "fid"), [ITEM, "fid"], "left_semi")


def principal_direction(points: DataFrame, radius: float, by: Sequence[str] = (ITEM,), key: str = "point_id") -> DataFrame:
    """Leading eigenvector of each neighbourhood's covariance, by cross products of the rows of M - l I."""
    m = durable(sp.explained(sp.moments(points, radius, by, key)).drop("r2", "r3"), "moments").withColumn("l", F.col("r1") * (F.col("xx") + F.col("yy") + F.col("zz")))
    rows = [[F.col("xx") - F.col("l"), F.col("xy"), F.col("xz")], [F.col("xy"), F.col("yy") - F.col("l"), F.col("yz")], [F.col("xz"), F.col("yz"), F.col("zz") - F.col("l")]]
    options = [ge.cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    sized = [F.struct(ge.dot(o, o).alias("size"), *(c.alias(n) for c, n in zip(o, ("ex", "ey", "ez")))) for o in options]
    best = F.greatest(*sized)
    return m.withColumn("e", best).where("n > 5 and e.size > 0").select(*by, key, *(F.col(f"e.{n}").alias(n) for n in ("ex", "ey", "ez")))


def endpoint_candidates(points: DataFrame, radius: float, threshold: float, by: Sequence[str] = (ITEM,), key: str = "point_id") -> DataFrame:
    """Points whose neighbours lie mostly on one side along the principal direction.

    Points bring their directions into the join, so that pairs are summed where they are made and not sent on.
    """
    p = points.select(*by, key, "x", "y", "z")
    pairs = sp.radius_join(p.join(principal_direction(points, radius, by, key), [*by, key]), p, radius, by)
    side = F.signum(ge.dot([F.col("p_x") - F.col("x"), F.col("p_y") - F.col("y"), F.col("p_z") - F.col("z")], ("ex", "ey", "ez")))
    return pairs.groupBy(*by, key).agg(F.abs(F.avg(side)).alias("side")).where(F.col("side") > threshold)


#: Primitives of a shape that a round of :func:`prune_primitives` considers, and the rows of points covered by them alone that it follows.
CANDIDATES, FOLLOWED = 65_536, 200_000


def prune_primitives(distances: DataFrame, precision: DataFrame, threshold: float, beta: float = 0.5, by: Sequence[str] = (ITEM,)) -> DataFrame:
    """Primitives left after greedily removing the one whose removal raises its shape's F-beta most, until none does.

    distances: by, point_id, prim, d (distances of a point to each primitive
    near it, one or several), and optionally ``fixed`` (whether all samples of the primitive are hits); precision:
    by, prim, hits, n (samples of a primitive near the cloud, and all).

    Removing a primitive whose samples are all hits never raises the score, so points that one covers
    stay covered and only the covers of the others are kept.  A round makes many removals of a shape: its best
    ``CANDIDATES`` go through the greedy walk together, as do the points that nothing else covers.
    Other points keep a cover, and the gain of the other primitives is bounded by what they have lost
    so far; the walk stops where one of them might be better.  The driver sees whether any was removed.
    """
    names, left = list(by), durable(precision.select(*by, "prim", "hits", "n"), "prune")
    if "fixed" not in distances.columns:
        distances = distances.join(left.select(*by, "prim", (F.col("hits") >= F.col("n")).alias("fixed")), [*names, "prim"], "left").withColumn("fixed", F.coalesce("fixed", F.lit(True)))
    covers = F.col("d") < threshold
    points = durable(distances.groupBy(*by, "point_id").agg(F.coalesce(F.bool_or(covers & F.col("fixed")), F.lit(False)).alias("sure")), "prune")
    total = durable(points.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("sure").alias("sure")), "prune")
    unsure = durable(points.where("not sure").select(*by, "point_id"), "prune")
    open_ = durable(distances.where(covers).join(unsure, [*names, "point_id"], "left_semi").select(*by, "point_id", "prim").distinct(), "prune")
    release(points)
    return _pruned(left, total, open_, beta, names)


def prune_near(points: DataFrame, precision: DataFrame, reach: float, threshold: float, beta: float = 0.5, by: Sequence[str] = (ITEM,)) -> DataFrame:
    """:func:`prune_primitives` where each point is a sample of a primitive and sees the samples of others nearer than ``reach``.

    points: by, point_id, prim, x, y, z.  Pairs of points are not listed: that a point sees any sample, and that it is covered
    by a primitive all of whose samples are hits, are looked up, and only the covers of the points left are made.
    """
    names, left = list(by), durable(precision.select(*by, "prim", "hits", "n"), "prune")
    fixed = left.select(*by, "prim", (F.col("hits") >= F.col("n")).alias("fixed"))
    own = durable(points.select(*by, "point_id", "prim", "x", "y", "z").join(fixed, [*names, "prim"], "left").withColumn("fixed", F.coalesce("fixed", F.lit(True))), "prune")
    most = min(threshold, reach)
    seen = durable(sp.within_reach(own, own, reach, names, apart="prim"), "prune")
    sure = durable(sp.within_reach(own, own.where("fixed"), most, names, apart="prim"), "prune")
    total = seen.groupBy(*by).agg(F.count(F.lit(1)).alias("total")).join(sure.groupBy(*by).agg(F.count(F.lit(1)).alias("sure")), names, "left")
    total = durable(total.withColumn("sure", F.coalesce("sure", F.lit(0))), "prune")
    unsure = durable(own.join(sure, [*names, "point_id"], "left_anti"), "prune")
    near = sp.radius_join(unsure, own.where("not fixed").drop("fixed"), most, names).where("prim <> p_prim")
    open_ = durable(near.select(*by, "point_id", F.col("p_prim").alias("prim")).distinct(), "prune")
    release(own, seen, sure, unsure)
    return _pruned(left, total, open_, beta, names)


def _pruned(left: DataFrame, total: DataFrame, open_: DataFrame, beta: float, by: list[str]) -> DataFrame:
    """The rounds of :func:`prune_primitives`: left: by, prim, hits, n; total: by, total, sure (points, and those covered for good); open_: by, point_id, prim (the covers of the others)."""
    b2, names = beta * beta, by
    score = lambda h, m, r: F.coalesce((1 + b2) * (h / m) * (r / F.col("total")) / F.nullif(b2 * (h / m) + r / F.col("total"), F.lit(0.0)), F.lit(0.0))
    kinds = dict(left.dtypes)
    columns = [*names, "prim", "hits", "n", "lost", "pos", "h", "m", "r", "total"]

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["kind"] == 0].sort_values("pos")
        if own.empty:
            return own[[*names, "prim"]]
        other, followed = rows[rows["kind"] == 1], rows[rows["kind"] == 2]
        ids, hits, n, lost = (own[c].to_numpy() for c in ("prim", "hits", "n", "lost"))
        lost = lost.copy()
        outs = [other[c].to_numpy() for c in ("hits", "n", "lost")]
        h, m, r, whole = (own[c].iloc[0] for c in ("h", "m", "r", "total"))

        def scored(hits, n, lost):
            with np.errstate(all="ignore"):
                p, q = np.where(m - n != 0, (h - hits) / (m - n), np.nan), (r - lost) / whole
                f = (1 + b2) * p * q / (b2 * p + q)
            return np.round(np.where(np.isfinite(f), f, 0.0), 12)

        at = pd.Index(ids).get_indexer(followed["prim"])
        of: dict[int, list] = {}
        held: dict[object, set] = {}
        for point, i in zip(followed["point_id"], at):
            of.setdefault(i, []).append(point)
            held.setdefault(point, set()).add(i)
        # primitives of the same hits, n and lost score alike: the least id of each such class stands for it
        order = np.argsort(ids, kind="stable")
        nth = np.argsort(order)
        classes: dict[tuple, int] = {}
        heaps: list[list] = []
        fields, tops, lives_in = np.zeros((3, 0)), np.zeros(0, np.int64), np.full(len(ids), -1)

        def put(i: int) -> int:
            k = classes.setdefault((hits[i], n[i], lost[i]), len(heaps))
            if k == len(heaps):
                heaps.append([])
            heapq.heappush(heaps[k], int(nth[i]))
            lives_in[i] = k
            return k

        touched, gone = {put(i) for i in order}, []
        while True:
            if len(tops) < len(heaps):
                fields, tops = np.array(list(classes)).T, np.append(tops, np.full(len(heaps) - len(tops), len(ids)))
            for k in touched:
                while heaps[k] and lives_in[order[heaps[k][0]]] != k:
                    heapq.heappop(heaps[k])
                tops[k] = heaps[k][0] if heaps[k] else len(ids)
            if (tops == len(ids)).all():
                break
            gain = np.where(tops < len(ids), scored(*fields), -1.0)
            best = int(order[tops[gain == gain.max()].min()]) if gone else 0  # the first is the best of all
            if gone:
                rest = scored(*outs) if len(other) else np.zeros(0)
                ahead = (rest > gain.max()) | ((rest == gain.max()) & (other["prim"].to_numpy() < ids[best]))
                if gain.max() <= scored(0, 0, 0) or ahead.any():
                    break
            gone.append(best)
            touched = {lives_in[best]}
            h, m, r, lives_in[best] = h - hits[best], m - n[best], r - lost[best], -1
            for point in of.get(best, ()):
                held[point].discard(best)
                if len(held[point]) == 1:
                    one = next(iter(held[point]))
                    lost[one] += 1
                    touched |= {lives_in[one], put(one)}
        return own.iloc[gone][[*names, "prim"]]

    while True:
        counts = durable(open_.groupBy(*by, "point_id").agg(F.count(F.lit(1)).alias("covers"), F.min("prim").alias("prim")), "prune")
        lost = counts.where("covers = 1").groupBy(*by, "prim").agg(F.count(F.lit(1)).alias("lost"))
        sums = left.groupBy(*by).agg(F.sum("hits").alias("h"), F.sum("n").alias("m")).join(total, names).join(counts.groupBy(*by).agg(F.count(F.lit(1)).alias("r")), names, "left").withColumn("r", F.col("sure") + F.coalesce("r", F.lit(0)))
        each = left.where("hits < n").join(lost, [*names, "prim"], "left").fillna(0, ["lost"]).join(sums, names)
        gain, now = score(F.col("h") - F.col("hits"), F.nullif(F.col("m") - F.col("n"), F.lit(0)), F.col("r") - F.col("lost")), score(F.col("h"), F.col("m"), F.col("r"))
        each = durable(each.withColumns({"gain": F.round(gain, 12), "now": F.round(now, 12)}), "prune")
        first = Window.partitionBy(*by).orderBy(F.desc("gain"), "prim")
        best = durable(each.where("gain > now").withColumn("pos", F.row_number().over(first)).where(F.col("pos") <= CANDIDATES).select(*columns), "prune")
        if best.isEmpty():
            return left.select(*by, "prim")
        # points that only candidates cover, by the last of them; a shape's candidates end where these points would be too many
        alone = open_.join(best.select(*by, "prim", "pos"), [*names, "prim"]).groupBy(*by, "point_id").agg(F.count(F.lit(1)).alias("own"), F.max("pos").alias("last"))
        alone = durable(alone.join(counts.drop("prim"), [*names, "point_id"]).where("own = covers and covers > 1").select(*by, "point_id", "last", "covers"), "prune")
        so_far = F.sum("rows").over(Window.partitionBy(*by).orderBy("last"))
        cut = alone.groupBy(*by, "last").agg(F.sum("covers").alias("rows")).withColumn("rows", so_far).where(F.col("rows") > FOLLOWED).groupBy(*by).agg(F.min("last").alias("cut"))
        cut = durable(cut, "prune")
        inside = durable(best.join(cut, names, "left").where("cut is null or pos < cut").drop("cut"), "prune")
        followed = open_.join(alone.join(cut, names, "left").where("cut is null or last < cut").select(*by, "point_id"), [*names, "point_id"], "left_semi")
        outside = each.join(inside.select(*by, "prim"), [*names, "prim"], "left_anti").groupBy(*by, "hits", "n").agg(F.min("lost").alias("lost"), F.min("prim").alias("prim"))
        rows = inside.withColumn("kind", F.lit(0)).unionByName(outside.withColumn("kind", F.lit(1)), True).unionByName(followed.withColumn("kind", F.lit(2)), True)
        gone = durable(rows.groupBy(*by).applyInPandas(walk, ", ".join(f"`{c}` {kinds[c]}" for c in (*names, "prim"))), "prune")
        before = left, open_, gone, counts, each, best, alone, cut, inside
        left = durable(left.join(gone, [*names, "prim"], "left_anti"), "prune")
        open_ = durable(open_.join(gone, [*names, "prim"], "left_anti"), "prune")
        release(*before)


def corner_curve_segmentation(points: DataFrame, cornerness: Column, level: float, radius: float, by: Sequence[str] = (ITEM,)) -> DataFrame:
    """Points split by cornerness, each part clustered by the radius graph: kind, node, component."""
    split = durable(points.withColumn("kind", F.when(cornerness > level, "corner").otherwise("curve")), "kinds")
    labels = sp.radius_components(split.select(*by, "kind", "point_id", "x", "y", "z"), radius, [*by, "kind"])
    return split.select("kind", F.col("point_id").alias("node")).join(labels, "node")


class Shape:
    """The tables of annotated meshes that labels come from.

    faces: item_id, fid, v0, v1, v2 and corner coordinates; surface_faces:
    item_id, surf_id, fid; segments: item_id, curve_id, seg_id, va, vb (end
    vertices) and end points; curve_verts: item_id, curve_id, vid; curves:
    item_id, curve_id, type, sharp.
    """

    def __init__(self, faces: DataFrame, surface_faces: DataFrame, segments: DataFrame, curve_verts: DataFrame, curves: DataFrame) -> None:
        self.faces, self.surface_faces, self.segments, self.curve_verts, self.curves = faces, surface_faces, segments, curve_verts, curves

    def written(self) -> Shape:
        """The columns that labels need, made once: labelling reads the tables many times."""
        corners = [f"{n}{c}" for n in "abc" for c in ("x", "y" if n != "b" else "y_", "z")]
        faces = self.faces.select(ITEM, "fid", "v0", "v1", "v2", *corners)
        segments = self.segments.select(ITEM, "curve_id", "seg_id", "va", "vb", *corners[:6])
        return Shape(*(durable(df, "shape") for df in (faces, self.surface_faces, segments, self.curve_verts, self.curves)))


def on_mesh(points: DataFrame, shape: Shape, far: float) -> DataFrame:
    """Points nearer than ``far`` to their mesh, with the face they lie on."""
    near = sp.nearest_face(points.select(ITEM, "point_id", "x", "y", "z").distinct(), shape.faces, [ITEM]).where(F.col("distance") < far).select(ITEM, "point_id", "fid")
    return durable(points.join(near, [ITEM, "point_id"]), "on_mesh")


def label_patches(members: DataFrame, shape: Shape, most: float, how: str = "edges", crops: DataFrame | None = None, flagged: bool = True) -> DataFrame:
    """Labels of the points of each patch: patch_id, point_id, distance, seg_id, and, if ``flagged``, the patch's flag ``jump``.

    members: item_id, patch_id, point_id, fid (the nearest face of the mesh), x, y, z; a patch_id belongs to one item.
    With ``crops`` (item_id, patch_id, fid), members are written, each point once a crop, fid is the nearest face of the crop, ``off``
    from the point, and only faces that surfaces have outside the crop may be nearer; without ``off`` there are none such.  A patch sees the whole
    surfaces that its points lie on, their sharp curves clipped to that
    submesh, without boundary features (``how``).  Each point takes the
    distance to the nearest segment of the curves at its surface, cut at
    ``most``.  ``jump`` tells a patch in which a label and that of the nearest
    neighbour differ by over 1.1 times their distance.
    """
    # every patch is a small mesh of its own: its id takes the item's place
    own = durable(members.select(ITEM, "patch_id", "point_id", "fid", "x", "y", "z"), "members") if crops is None else members
    hits = own.select(ITEM, "patch_id", "fid").distinct()
    touched = hits.join(shape.surface_faces, [ITEM, "fid"]).select(ITEM, "patch_id", "surf_id").distinct()
    parts = durable(touched.join(shape.surface_faces, [ITEM, "surf_id"]).select(ITEM, "patch_id", "surf_id", "fid"), "members")
    named = F.col("patch_id").alias(ITEM)
    moved = lambda df: df.drop(ITEM).withColumnRenamed("patch_id", ITEM)
    surface_faces = moved(parts)
    faces = durable(moved(shape.faces.join(parts.select(ITEM, "patch_id", "fid").distinct(), [ITEM, "fid"])), "members")
    verts = parts.join(ms.face_vertices(shape.faces), [ITEM, "fid"]).select(ITEM, "patch_id", "vid").distinct()
    clipped = durable(verts.join(shape.curve_verts, [ITEM, "vid"]).select(ITEM, "patch_id", "curve_id", "vid"), "members")
    curve_verts = durable(ms.drop_boundary_features(moved(clipped), faces, how), "members")
    held = clipped.select(ITEM, "patch_id", "curve_id").distinct()
    curves = moved(held.join(shape.curves, [ITEM, "curve_id"]))
    end = lambda v: curve_verts.select(ITEM, "curve_id", F.col("vid").alias(v))
    segments = moved(held.join(shape.segments, [ITEM, "curve_id"])).join(end("va"), [ITEM, "curve_id", "va"], "left_semi").join(end("vb"), [ITEM, "curve_id", "vb"], "left_semi")
    points = own.select(named, "point_id", "x", "y", "z")
    if crops is None:
        faced = own.select(named, "point_id", "fid").distinct()
    elif "off" not in own.columns:
        points = own.select(named, "point_id", "fid", "x", "y", "z")
        faced = points.select(ITEM, "point_id", "fid")
    else:
        faced = own.select(named, "point_id", "fid", "off")
        beyond = durable(faces.join(crops.select(named, "fid"), [ITEM, "fid"], "left_anti"), "members")
        if not beyond.isEmpty():
            there = sp.nearest_face(points.join(beyond.select(ITEM).distinct(), ITEM, "left_semi"), beyond, [ITEM]).select(ITEM, "point_id", "fid", F.col("distance").alias("off"))
            nearer = F.min(F.struct(F.round("off", 12).alias("off"), "fid")).alias("to")
            faced = faced.unionByName(there).groupBy(ITEM, "point_id").agg(nearer).select(ITEM, "point_id", "to.fid")
        faced = faced.select(ITEM, "point_id", "fid")
    labels = ms.annotate_points(points, faces, surface_faces, segments, ms.surface_curves(faces, surface_faces, curve_verts, curves), most, faced)
    if not flagged:
        return labels.select(F.col(ITEM).alias("patch_id"), "point_id", "distance", "seg_id")
    labels = durable(labels, "labels")
    return labels.join(discontinuous(points, labels), ITEM, "left").select(F.col(ITEM).alias("patch_id"), "point_id", "distance", "seg_id", F.coalesce("jump", F.lit(False)).alias("jump"))


def discontinuous(points: DataFrame, labels: DataFrame, factor: float = 1.1) -> DataFrame:
    """Groups with a label that differs from its nearest neighbour's by over ``factor`` times their distance."""
    near = sp.knn(points, points, 2, [ITEM]).where("rank = 2")
    one, two = labels.select(ITEM, "point_id", F.col("distance").alias("di")), labels.select(ITEM, F.col("point_id").alias("other"), F.col("distance").alias("dj"))
    return near.join(one, [ITEM, "point_id"]).join(two, [ITEM, "other"]).groupBy(ITEM).agg(F.bool_or(F.abs(F.col("di") - F.col("dj")) > factor * F.sqrt("d2")).alias("jump"))


def annotate_scan_points(points: DataFrame, matrix: Sequence[float], shape: Shape, most: float, far: float, patches: int, size: int, radius: float) -> DataFrame:
    """Scan points in the mesh's frame, without those far from it, cut into patches that are labelled and flagged.

    ``patches`` seeds a shape are spread by farthest-point sampling; each grows
    breadth-first over the radius graph to ``size`` points.
    """
    moved = points.withColumns(dict(zip("xyz", ge.transform_point(matrix, ("x", "y", "z")))))
    shape = shape.written()
    kept = on_mesh(moved, shape, far)
    seeds = sp.farthest_points(kept, patches, [ITEM]).select(F.col("point_id").alias("seed"), F.col("point_id").alias("node"))
    grown = sp.ball_patches(kept, seeds, radius, size, [ITEM]).select(F.col("seed").alias("patch_id"), F.col("node").alias("point_id"))
    return label_patches(grown.join(kept, "point_id"), shape, most)


def annotate_scan_views(points: DataFrame, matrix: Sequence[float], shape: Shape, most: float, far: float, focal: float, sx: float, sy: float, width: int, height: int) -> DataFrame:
    """Scan points labelled in the mesh's frame, projected into their view's image and z-buffered.

    A pixel keeps its nearest point: view_id, pr, pc, depth, point_id, distance.
    """
    moved = points.withColumns(dict(zip("xyz", ge.transform_point(matrix, ("x", "y", "z")))))
    shape = shape.written()
    kept = on_mesh(moved, shape, far)
    labels = label_patches(kept.withColumn("patch_id", F.col(ITEM)), shape, most, "none").select(F.col("patch_id").alias(ITEM), "point_id", "distance")
    u, v, z = ge.project(focal, [F.col("x"), F.col("y"), F.col("z")])
    row, col, inside = ge.to_pixel(u, v, sx, sy, width, height)
    hits = points.join(labels, [ITEM, "point_id"]).withColumns({"pr": row, "pc": col, "inside": inside, "depth": z}).where("inside")
    from pointweave.operators.raster import z_buffer

    return z_buffer(hits.select(F.col(ITEM).alias("view_id"), "pr", "pc", "depth", "point_id", "distance"), tie="point_id")


def repair_patches(stored: DataFrame, shape: Shape, most: float, far: float, how: str = "edges") -> DataFrame:
    """Stored patch points with recomputed labels; all other columns kept, and the labels of points off the mesh."""
    shape = shape.written()
    labels = label_patches(on_mesh(stored.select(ITEM, "patch_id", "point_id", "x", "y", "z"), shape, far), shape, most, how)
    return tb.apply_fixes(stored, labels.select("patch_id", "point_id", "distance"), ["patch_id", "point_id"], ["distance"])


def mesh_patches(faces: DataFrame, patch_faces: DataFrame, curve_verts: DataFrame) -> DataFrame:
    """Clipped features of each patch, vertices renumbered densely inside it and nested per curve.

    patch_faces: item_id, patch_id, fid.
    """
    verts = patch_faces.join(ms.face_vertices(faces), [ITEM, "fid"]).select(ITEM, "patch_id", "vid").distinct()
    dense = verts.withColumn("dense", (F.row_number().over(Window.partitionBy(ITEM, "patch_id").orderBy("vid")) - 1).cast("long"))
    return dense.join(curve_verts, [ITEM, "vid"]).groupBy(ITEM, "patch_id", "curve_id").agg(F.array_sort(F.collect_list("dense")).alias("vert_indices"))


def align_scans(points: DataFrame, alignments: DataFrame, board: Sequence[float], intrinsics: DataFrame | None = None, scales: DataFrame | None = None) -> DataFrame:
    """Points through their scan's alignment and the board's frame; scans without an alignment are dropped.

    alignments: item_id, m (16 doubles); intrinsics: item_id and the camera's
    columns; scales: item_id, scale, by which the placed points are divided.
    """
    m = [F.element_at("m", i + 1) for i in range(16)]
    chain = ge.matmul4(board, m)
    placed = points.join(alignments, ITEM).withColumns(dict(zip("xyz", ge.transform_point(chain, ("x", "y", "z"))))).drop("m")
    if scales is not None:
        placed = placed.join(scales.select(ITEM, "scale"), ITEM).withColumns({c: F.col(c) / F.col("scale") for c in "xyz"})
    return placed if intrinsics is None else placed.join(intrinsics, ITEM)


def consistent_whole_labels(crops: DataFrame, labels: DataFrame, cap: float) -> DataFrame:
    """Per-crop labels of whole-shape points, the least of them per point, pushed back to every crop.

    crops: item_id, patch_id, global_idx; labels: the same key and value.
    """
    own = crops.join(labels, [ITEM, "patch_id", "global_idx"])
    return fu.push_back(own, fu.combine_ground_truth(own, cap))


def crop_members(points: DataFrame, shape: Shape, crops: DataFrame, bound: float) -> DataFrame:
    """Points nearer than ``bound`` to a crop's faces, with the nearest of them and how far it is off: a row for each point and crop.

    crops: item_id, patch_id, fid; a patch_id belongs to one item.
    """
    faces = crops.join(shape.faces, [ITEM, "fid"])
    return sp.faces_within(points, faces, bound, [ITEM], ["patch_id"]).select(ITEM, "patch_id", "point_id", "fid", F.col("distance").alias("off"), "x", "y", "z")


def label_crops(points: DataFrame, shape: Shape, crops: DataFrame, bound: float, most: float, how: str = "edges") -> DataFrame:
    """Whole-shape points labelled in every crop that holds them, the least label of each pushed back to its crops."""
    shape, crops = shape.written(), durable(crops, "crops")
    # members are written once: with their distances only where a surface of a crop goes on outside it
    around = crops.join(shape.surface_faces, [ITEM, "fid"]).select(ITEM, "patch_id", "surf_id").distinct().join(shape.surface_faces, [ITEM, "surf_id"])
    beyond = not around.join(crops, [ITEM, "patch_id", "fid"], "left_anti").isEmpty()
    members = crop_members(points.select(ITEM, "point_id", "x", "y", "z"), shape, crops, bound)
    members = durable(members if beyond else members.drop("off"), "crops")
    labels = label_patches(members, shape, most, how, crops, flagged=False).select("patch_id", F.col("point_id").alias("global_idx"), F.col("distance").alias("value"))
    own = durable(labels.join(crops.select(ITEM, "patch_id").distinct(), "patch_id").select(ITEM, "patch_id", "global_idx", "value"), "crops")
    release(members)
    return fu.push_back(own, durable(fu.combine_ground_truth(own, most), "crops"))


def mesh_vertex_patches(shape: Shape, vertices: DataFrame, seeds: DataFrame, size: int, short: int = 5, most_sharp: float = 0.6) -> DataFrame:
    """Vertex patches grown over mesh edges, their sharp vertices labelled, centred and scaled.

    Patches that touch a curve of under ``short`` vertices, or a surface of
    whose vertices more than ``most_sharp`` are sharp, are dropped.  seeds:
    seed, node; vertices: item_id, vid, x, y, z.
    """
    sharp = shape.curve_verts.join(shape.curves.where("sharp").select(ITEM, "curve_id"), [ITEM, "curve_id"]).select(ITEM, "vid").distinct().withColumn("sharp", F.lit(True))
    brief = shape.curve_verts.groupBy(ITEM, "curve_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < short)
    verts = ms.surface_vertices(shape.faces, shape.surface_faces).join(sharp, [ITEM, "vid"], "left").withColumn("sharp", F.coalesce("sharp", F.lit(False)))
    edgy = verts.groupBy(ITEM, "surf_id").agg(F.avg(F.col("sharp").cast("double")).alias("share")).where(F.col("share") > most_sharp)
    bad = shape.curve_verts.join(brief, [ITEM, "curve_id"], "left_semi").select("vid").unionAll(verts.join(edgy, [ITEM, "surf_id"], "left_semi").select("vid")).distinct()
    grown = durable(gr.bfs_patches(ms.edges(shape.faces).select("a", "b"), seeds, size), "patches")
    dropped = grown.join(bad.withColumnRenamed("vid", "node"), "node", "left_semi").select("seed").distinct()
    placed = grown.join(dropped, "seed", "left_anti").join(vertices.select(ITEM, F.col("vid").alias("node"), "x", "y", "z"), "node")
    placed = placed.join(sharp.withColumnRenamed("vid", "node"), [ITEM, "node"], "left").withColumn("sharp", F.coalesce("sharp", F.lit(False)))
    return ge.normalize_max(ge.center(placed, ["seed"], ("x", "y", "z")), ["seed"], ("x", "y", "z"))


def skeleton(field: DataFrame, corners: DataFrame, radius: float, snap: float) -> tuple[DataFrame, DataFrame]:
    """Nodes (item_id, node, corner, x, y, z, distance) and edges (item_id, a, b) of the curves that points lie along.

    field: item_id, point_id, component (of the corner cluster of a corner point, else
    null), x, y, z, distance; corners: item_id, component, x, y, z.  Curve points are covered by a
    spaced subset; each belongs to its nearest member, and a member within ``snap`` of a corner
    to that corner.  Nodes are linked where points of theirs are within the radius.  The longest
    link of each triangle goes, as do short branches of one link at a junction.  An open end
    is the farthest of the points that belong to it.
    """
    own = field.select(ITEM, "point_id", "x", "y", "z", "distance")
    curve = durable(own.join(field.where("component IS NULL").select(ITEM, "point_id"), [ITEM, "point_id"], "left_semi"), "curve")
    seeds = durable(sp.thin(curve, radius, [ITEM], 11), "seeds")
    met = sp.radius_join(seeds.select(ITEM, "point_id", "x", "y", "z"), corners.select(ITEM, "component", "x", "y", "z"), snap, [ITEM]).groupBy(ITEM, "point_id").agg(F.min(F.struct("d2", "p_component")).alias("to"))
    to = durable(seeds.select(ITEM, "point_id").join(met, [ITEM, "point_id"], "left").select(ITEM, F.col("point_id").alias("other"), F.coalesce("to.p_component", "point_id").alias("node")), "seeds")
    nearest = sp.knn(curve.select(ITEM, "point_id", "x", "y", "z"), seeds, 1, [ITEM]).select(ITEM, "point_id", "other").join(to, [ITEM, "other"]).select(ITEM, "point_id", "node")
    cells = durable(nearest.unionAll(field.where("component IS NOT NULL").select(ITEM, "point_id", F.col("component").alias("node"))), "cells")
    links = sp.touching_labels(own.join(cells, [ITEM, "point_id"]), "node", radius, [ITEM])
    places = seeds.join(to.where("node = other").select(ITEM, F.col("other").alias("point_id")), [ITEM, "point_id"], "left_semi").select(ITEM, F.col("point_id").alias("node"), F.lit(False).alias("corner"), "x", "y", "z", "distance")
    nodes = durable(places.unionAll(corners.select(ITEM, F.col("component").alias("node"), F.lit(True).alias("corner"), "x", "y", "z", F.lit(0.0).alias("distance"))), "nodes")
    at = lambda side: nodes.select(ITEM, F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in "xyz"))
    gap = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in "xyz"), F.lit(0.0))
    sized = durable(links.join(at("a"), [ITEM, "a"]).join(at("b"), [ITEM, "b"]).select(ITEM, "a", "b", F.struct(F.round(gap, 12).alias("d2"), "a", "b").alias("size")), "links")
    both = sized.unionAll(sized.select(ITEM, F.col("b").alias("a"), F.col("a").alias("b"), "size"))
    # of the three links of a triangle the greatest goes
    around = both.select(ITEM, "a", F.col("b").alias("c"), F.col("size").alias("ac")).join(both.select(ITEM, F.col("a").alias("c"), "b", F.col("size").alias("cb")), [ITEM, "c"]).where("a < b")
    longest = sized.join(around, [ITEM, "a", "b"]).where("size > ac AND size > cb").select(ITEM, "a", "b").distinct()
    edges = sized.join(longest, [ITEM, "a", "b"], "left_anti")
    # branches of one short link
    kind = durable(gr.degrees(edges, (ITEM,)), "degrees").join(nodes.select(ITEM, "node", "corner"), [ITEM, "node"])
    open_ = kind.where("degree = 1 AND NOT corner").select(ITEM, "node")
    junction = kind.where("degree > 2").select(ITEM, "node")
    spur = edges.select(ITEM, "a", "b", "size", F.explode(F.array(F.struct(F.col("a").alias("tip"), F.col("b").alias("root")), F.struct(F.col("b").alias("tip"), F.col("a").alias("root")))).alias("e")).select(ITEM, "a", "b", "size", "e.*")
    spur = spur.join(open_.withColumnRenamed("node", "tip"), [ITEM, "tip"], "left_semi")
    short = spur.join(junction.withColumnRenamed("node", "root"), [ITEM, "root"], "left_semi").where(F.col("size.d2") <= 2.25 * radius * radius).select(ITEM, "a", "b")
    edges = durable(edges.join(short, [ITEM, "a", "b"], "left_anti").select(ITEM, "a", "b"), "edges")
    # open ends reach as far as their points do
    tips = spur.join(edges, [ITEM, "a", "b"], "left_semi").select(ITEM, F.col("tip").alias("node"), F.col("root"))
    far = cells.join(tips, [ITEM, "node"]).join(own, [ITEM, "point_id"]).join(nodes.select(ITEM, F.col("node").alias("root"), *(F.col(c).alias(f"r_{c}") for c in "xyz")), [ITEM, "root"])
    reach = sum(((F.col(c) - F.col(f"r_{c}")) * (F.col(c) - F.col(f"r_{c}")) for c in "xyz"), F.lit(0.0))
    end = far.groupBy(ITEM, "node").agg(F.min(F.struct((-F.round(reach, 12)).alias("far"), "point_id", "x", "y", "z", "distance")).alias("end"))
    moved = nodes.join(end, [ITEM, "node"], "left").select(ITEM, "node", "corner", *(F.coalesce(f"end.{c}", c).alias(c) for c in ("x", "y", "z", "distance")))
    return durable(moved, "nodes"), edges


def straight_pieces(vertices: DataFrame, split: float) -> DataFrame:
    """Pieces of ordered polylines, split until each vertex fits: item_id, curve, lo, hi and end points.

    vertices: item_id, curve, pos (from 0), x, y, z, distance.  A piece is split at the vertex whose
    distance to it differs most from its own value, while that is at least ``split``.  A curve that
    ends where it starts is first split at the vertex farthest from there.
    """
    at = [ITEM, "curve"]
    last = vertices.groupBy(*at).agg(F.max("pos").alias("n"))
    ends = lambda pos, side: vertices.select(*at, F.col("pos").alias(pos), *(F.col(c).alias(f"{side}{c}") for c in "xyz"))
    own = durable(vertices.join(last, at).select(*vertices.columns, F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")), "pieces")
    d, _, _ = ge.segment_project(("x", "y", "z"), ("ax", "ay", "az"), ("bx", "by", "bz"))
    ring = F.expr("ax = bx AND ay = by AND az = bz")
    done = None
    while True:
        # interior vertices of the open pieces; pieces that are not split again are done
        placed = own.join(ends("lo", "a"), [*at, "lo"]).join(ends("hi", "b"), [*at, "hi"])
        inner = placed.where("pos > lo AND pos < hi").withColumns({"gap": F.round(F.abs(d - F.when(ring, 0.0).otherwise(F.col("distance"))), 9), "ring": ring})
        worst = inner.groupBy(*at, "lo", "hi").agg(F.min(F.struct((-F.col("gap")).alias("far"), "pos", "ring")).alias("w")).where((-F.col("w.far") >= split) | F.col("w.ring"))
        cut = durable(worst.select(*at, "lo", "hi", F.col("w.pos").alias("mid")), "pieces")
        ready = own.select(*at, "lo", "hi").distinct().join(cut, [*at, "lo", "hi"], "left_anti")
        done = ready if done is None else done.unionAll(ready)
        done = durable(done, "done")
        if cut.isEmpty():
            break
        halves = own.join(cut, [*at, "lo", "hi"]).select(*vertices.columns, F.explode(F.expr("filter(array(struct(lo AS lo, mid AS hi), struct(mid AS lo, hi AS hi)), h -> pos BETWEEN h.lo AND h.hi)")).alias("h"))
        before, own = own, durable(halves.select(*vertices.columns, "h.lo", "h.hi"), "pieces")
        release(before, cut)
    return done.join(ends("lo", "a"), [*at, "lo"]).join(ends("hi", "b"), [*at, "hi"]).withColumnRenamed("by", "by_")


def extract_wireframe(points: DataFrame, near: float, spacing: float, radius: float, k: int, thresholds: Sequence[float], level: float, snap: float, split: float) -> DataFrame:
    """Corners and curves of a distance field as straight pieces: item_id, curve, closed, seg_id, end points.

    Points near features are thinned and their values averaged over neighbours;
    where values vary most under the ``thresholds`` they are corners, which are
    clustered by the radius graph.  The :func:`skeleton` of the rest, with the corners as
    nodes, falls into chains between corners, junctions and open ends, and closed
    curves with a seam; each chain becomes as few pieces as fit (:func:`straight_pieces`).
    """
    kept = durable(sp.thin(points.where(F.col("distance") < near), spacing, [ITEM], 5), "wire")
    around = durable(sp.knn(kept, kept, k, [ITEM]), "wire")
    smooth = durable(sp.knn_mean(around, kept, "distance", [ITEM]), "wire")
    corner = sp.corner_probability(sp.variance_dynamics(smooth, around.where("rank > 1"), [ITEM], "distance"), thresholds, [ITEM])
    field = kept.drop("distance").join(smooth, [ITEM, "point_id"]).join(corner, [ITEM, "point_id"], "left").fillna(0.0, ["corner"])
    field = durable(field.select(ITEM, "point_id", "x", "y", "z", "distance", "corner"), "wire")
    labels = corner_curve_segmentation(field, F.col("corner"), level, radius).where("kind = 'corner'").select(F.col("node").alias("point_id"), "component")
    # a corner point without another near it is a cluster of its own
    told = field.join(labels, "point_id", "left").withColumn("component", F.when(F.col("corner") > level, F.coalesce("component", "point_id")))
    told = durable(told.select(ITEM, "point_id", "component", "x", "y", "z", "distance"), "wire")
    clusters = told.where("component IS NOT NULL")
    centres = None
    for c in "xyz":
        mid = tb.quantile(clusters, [ITEM, "component"], c, 0.5, c)
        centres = mid if centres is None else centres.join(mid, [ITEM, "component"])
    nodes, edges = skeleton(told, durable(centres, "wire"), radius, snap)
    chains = gr.chain_vertices(edges, (ITEM,), nodes.where("corner").select(ITEM, "node"))
    vertices = chains.withColumn("curve", F.xxhash64(ITEM, "first", "second")).join(nodes.drop("corner"), [ITEM, "node"])
    vertices = durable(vertices.select(ITEM, "curve", "closed", "pos", "x", "y", "z", "distance"), "wire")
    pieces = straight_pieces(vertices.drop("closed"), split).withColumn("seg_id", F.xxhash64("curve", "lo"))
    return pieces.join(vertices.where("pos = 0").select(ITEM, "curve", "closed"), [ITEM, "curve"]).select(ITEM, "curve", "closed", "seg_id", "ax", "ay", "az", "bx", "by_", "bz")
