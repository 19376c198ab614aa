"""Mesh and feature-annotation operators on vertex, face, curve and surface tables.

Tables: faces(item_id, fid, v0, v1, v2), curve_verts(item_id, curve_id, vid),
curves(item_id, curve_id, type, sharp), surface_faces(item_id, surf_id, fid),
surfaces(item_id, surf_id, type).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = "item_id"


def face_vertices(faces: DataFrame) -> DataFrame:
    return faces.select(ITEM, "fid", F.explode(F.array("v0", "v1", "v2")).alias("vid"))


def face_edges(faces: DataFrame) -> DataFrame:
    """Three rows per face: its edges with the lower vertex first."""
    pairs = F.array(*(F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    return faces.select(ITEM, "fid", F.explode(pairs).alias("e")).select(ITEM, "fid", "e.a", "e.b")


def edges(faces: DataFrame) -> DataFrame:
    """Unique edges and the number of faces at each."""
    return face_edges(faces).groupBy(ITEM, "a", "b").agg(F.count(F.lit(1)).alias("n_faces"))


def boundary_edges(faces: DataFrame) -> DataFrame:
    return edges(faces).where("n_faces = 1").select(ITEM, "a", "b")


def boundary_vertices(faces: DataFrame) -> DataFrame:
    return boundary_edges(faces).select(ITEM, F.explode(F.array("a", "b")).alias("vid")).distinct()


def surface_vertices(faces: DataFrame, surface_faces: DataFrame) -> DataFrame:
    return surface_faces.join(face_vertices(faces), [ITEM, "fid"]).select(ITEM, "surf_id", "vid").distinct()


def surface_curves(faces: DataFrame, surface_faces: DataFrame, curve_verts: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """(surface, curve) pairs that share a vertex; sharp curves only where ``curves`` is given."""
    verts = curve_verts if curves is None else curve_verts.join(curves.where("sharp").select(ITEM, "curve_id"), [ITEM, "curve_id"])
    return surface_vertices(faces, surface_faces).join(verts, [ITEM, "vid"]).select(ITEM, "surf_id", "curve_id").distinct()


def surface_neighbours(faces: DataFrame, surface_faces: DataFrame) -> DataFrame:
    """(surface, other surface) pairs that share a vertex."""
    one = surface_vertices(faces, surface_faces)
    two = one.select(ITEM, "vid", F.col("surf_id").alias("other"))
    return one.join(two, [ITEM, "vid"]).where("surf_id <> other").select(ITEM, "surf_id", "other").distinct()


def adjacent_curves(own: DataFrame, neighbours: DataFrame, surfaces: DataFrame, always: bool = False) -> DataFrame:
    """A surface's own curves; if it has none (or ``always``), its neighbours' curves too."""
    asking = surfaces.select(ITEM, "surf_id").distinct()
    if not always:
        asking = asking.join(own, [ITEM, "surf_id"], "left_anti")
    lent = asking.join(neighbours, [ITEM, "surf_id"]).join(own.select(ITEM, F.col("surf_id").alias("other"), "curve_id"), [ITEM, "other"])
    return own.unionByName(lent.select(ITEM, "surf_id", "curve_id")).distinct()


def restrict_curves(curve_verts: DataFrame, vertices: DataFrame) -> DataFrame:
    """Curves clipped to a vertex set; those left empty are gone."""
    return curve_verts.join(vertices.select(ITEM, "vid"), [ITEM, "vid"], "left_semi")


def hit_surface_faces(surface_faces: DataFrame, hits: DataFrame) -> DataFrame:
    """All faces of every surface that a hit face belongs to."""
    touched = surface_faces.join(hits.select(ITEM, "fid"), [ITEM, "fid"], "left_semi").select(ITEM, "surf_id").distinct()
    return surface_faces.join(touched, [ITEM, "surf_id"])


def surface_submesh(faces: DataFrame, surface_faces: DataFrame) -> DataFrame:
    """Faces of each surface with vertices renumbered densely inside it."""
    from pointweave.operators.tables import reindex_dense

    own = surface_faces.join(faces, [ITEM, "fid"])
    long = own.select(ITEM, "surf_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vid"))
    dense = reindex_dense(long, [ITEM, "surf_id"], "vid")
    return dense.groupBy(ITEM, "surf_id", "fid").agg(*(F.max(F.when(F.col("corner") == i, F.col("dense"))).alias(f"v{i}") for i in range(3)))


def edges_in_curve(faces: DataFrame, curve_verts: DataFrame) -> DataFrame:
    """Mesh edges with both ends in a curve."""
    e = edges(faces).select(ITEM, "a", "b")
    one = curve_verts.select(ITEM, "curve_id", F.col("vid").alias("a"))
    two = curve_verts.select(ITEM, "curve_id", F.col("vid").alias("b"))
    return e.join(one, [ITEM, "a"]).join(two, [ITEM, "curve_id", "b"]).select(ITEM, "curve_id", "a", "b")


def corner_vertices(curve_verts: DataFrame, most: int = 2) -> DataFrame:
    """Vertices on more than ``most`` curves."""
    return curve_verts.groupBy(ITEM, "vid").agg(F.count_distinct("curve_id").alias("n_curves")).where(F.col("n_curves") > most)


def curve_extents(curve_verts: DataFrame, vertices: DataFrame, curves: DataFrame | None = None, xyz: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Longest side of each curve's box (+ 1e-8)."""
    own = curve_verts if curves is None else curve_verts.join(curves.where("sharp").select(ITEM, "curve_id"), [ITEM, "curve_id"])
    return own.join(vertices, [ITEM, "vid"]).groupBy(ITEM, "curve_id").agg((F.greatest(*(F.max(c) - F.min(c) for c in xyz)) + 1e-8).alias("extent"))


def scale_factor(extents: DataFrame, vertices: DataFrame, extent: float, resolution: float, q: float, n: int, xyz: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """First factor: extent over the item's box; second: resolution n over the q-quantile of rescaled curve extents."""
    box = vertices.groupBy(ITEM).agg(F.greatest(*(F.max(c) - F.min(c) for c in xyz)).alias("box"))
    first = box.select(ITEM, (extent / F.col("box")).alias("first"))
    rescaled = extents.join(first, ITEM).groupBy(ITEM, "first").agg(F.percentile(F.col("extent") * F.col("first"), q).alias("cut"))
    return rescaled.select(ITEM, "first", (resolution * n / F.col("cut")).alias("second")).withColumn("scale", F.col("first") * F.col("second"))


def estimate_samples(areas: DataFrame, radius: float) -> DataFrame:
    return areas.groupBy(ITEM).agg(F.ceil(F.sum("area") / (F.pi() * radius * radius / 4)).alias("n_samples"))


def drop_boundary_features(curve_verts: DataFrame, faces: DataFrame, how: str) -> DataFrame:
    """Curves without boundary parts: ``none``, ``all_verts`` (curves wholly on
    the boundary go), ``verts`` (boundary vertices go) or ``edges`` (curves all
    of whose edges are boundary edges go)."""
    if how == "none":
        return curve_verts
    if how == "verts":
        return curve_verts.join(boundary_vertices(faces), [ITEM, "vid"], "left_anti")
    if how == "all_verts":
        inner = curve_verts.join(boundary_vertices(faces), [ITEM, "vid"], "left_anti").select(ITEM, "curve_id").distinct()
        return curve_verts.join(inner, [ITEM, "curve_id"], "left_semi")
    inner = edges_in_curve(faces, curve_verts).join(boundary_edges(faces), [ITEM, "a", "b"], "left_anti").select(ITEM, "curve_id").distinct()
    return curve_verts.join(inner, [ITEM, "curve_id"], "left_semi")


def flag_mismatched_surface(stored: DataFrame, faces: DataFrame, surface_faces: DataFrame) -> DataFrame:
    """Surfaces whose stored vertex list disagrees with their faces' vertices at every sorted place."""
    found = surface_vertices(faces, surface_faces).groupBy(ITEM, "surf_id").agg(F.array_sort(F.collect_list("vid")).alias("found"))
    given = stored.groupBy(ITEM, "surf_id").agg(F.array_sort(F.collect_list("vid")).alias("given"))
    differ = F.forall(F.zip_with("found", "given", lambda a, b: ~a.eqNullSafe(b)), lambda x: x)
    return found.join(given, [ITEM, "surf_id"]).select(ITEM, "surf_id", differ.alias("mismatched"))


def share_small_faces(faces: DataFrame, ratio: float, area: str = "area") -> DataFrame:
    """Share of an item's faces smaller than the mean area over ``ratio``."""
    mean = faces.groupBy(ITEM).agg(F.avg(area).alias("mean"))
    return faces.join(mean, ITEM).groupBy(ITEM).agg(F.avg((F.col(area) < F.col("mean") / ratio).cast("double")).alias("share"))


def share_thin_faces(faces: DataFrame, ratio: float) -> DataFrame:
    """Share of faces whose circumradius is at least ``ratio`` inradii."""
    return faces.groupBy(ITEM).agg(F.avg((F.col("circum") / F.col("inner") >= ratio).cast("double")).alias("share"))


def type_counts(items: DataFrame, typed: DataFrame, vocabulary: Sequence[str], prefix: str) -> DataFrame:
    """One count column per type of a fixed vocabulary, zero where absent."""
    counts = typed.groupBy(ITEM).pivot("type", list(vocabulary)).agg(F.count(F.lit(1)))
    named = counts.select(ITEM, *(F.col(t).alias(f"{prefix}_{t.lower()}") for t in vocabulary))
    return items.select(ITEM).distinct().join(named, ITEM, "left").fillna(0)


def fraction_covered(faces: DataFrame, samples: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Share of an item's faces with at least k samples, for each k."""
    hit = samples.groupBy(ITEM, "fid").agg(F.count(F.lit(1)).alias("n"))
    return faces.select(ITEM, "fid").join(hit, [ITEM, "fid"], "left").groupBy(ITEM).agg(*((F.avg((F.coalesce("n", F.lit(0)) >= k).cast("double"))).alias(f"covered_{k}") for k in ks))


def adjacent_faces(faces: DataFrame) -> DataFrame:
    """Pairs of faces that share an edge."""
    e = face_edges(faces)
    return e.join(e.withColumnRenamed("fid", "other"), [ITEM, "a", "b"]).where("fid < other").select(ITEM, "fid", "other").distinct()


def annotate_points(points: DataFrame, faces_xyz: DataFrame, surface_faces: DataFrame, segments: DataFrame, surface_curve: DataFrame, most: float, faced: DataFrame | None = None) -> DataFrame:
    """Distance of each point to the nearest sharp segment of the curves that touch its surface, cut at ``most``.

    Point -> nearest face -> its surface -> nearest segment among that
    surface's curves; ``segments`` has item_id, curve_id, seg_id and end points.
    ``faced`` (item_id, point_id, fid) tells the nearest faces where they are known; points may bring their ``fid`` themselves.
    """
    from pointweave.operators import spatial as sp

    if faced is None:
        faced = sp.nearest_face(points, faces_xyz, [ITEM]).select(ITEM, "point_id", "fid")
    placed = (points if "fid" in points.columns else points.join(faced, [ITEM, "point_id"])).join(surface_faces, [ITEM, "fid"])
    own = segments.join(surface_curve, [ITEM, "curve_id"])
    many = own.groupBy(ITEM, "surf_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (many or 0) <= sp.SEGMENTS:
        out = sp.nearest_of_few(placed, own, [ITEM, "surf_id"]).withColumnRenamed("distance", "d")
    else:
        near = sp.nearest_segment(placed.select(ITEM, "surf_id", "point_id", "x", "y", "z"), own, [ITEM, "surf_id"])
        out = placed.select(ITEM, "point_id", "surf_id").join(near.select(ITEM, "point_id", "surf_id", F.col("distance").alias("d"), "seg_id"), [ITEM, "surf_id", "point_id"], "left")
    return out.select(ITEM, "point_id", "surf_id", F.least(F.coalesce("d", F.lit(most)), F.lit(most)).alias("distance"), F.when(F.col("d") < most, F.col("seg_id")).alias("seg_id"))
