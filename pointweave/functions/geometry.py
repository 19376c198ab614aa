"""Geometry as column expressions: no joins, no Python on the executors.

Vectors are triples of columns (or of names); matrices are row-major lists of
16 columns or numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Vector = Sequence[Column | str | float]


def _c(v: Column | str | float) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v))


def vector(v: Vector) -> list[Column]:
    return [_c(x) for x in v]


def dot(a: Vector, b: Vector) -> Column:
    a, b = vector(a), vector(b)
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def minus(a: Vector, b: Vector) -> list[Column]:
    return [x - y for x, y in zip(vector(a), vector(b))]


def cross(a: Vector, b: Vector) -> list[Column]:
    (ax, ay, az), (bx, by, bz) = vector(a), vector(b)
    return [ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Vector, b: Vector) -> Column:
    d = minus(a, b)
    return dot(d, d)


def bounded_label(p: Vector, proj: Vector, most: float, scale: float = 1.0, eps: float = 1e-6) -> tuple[Column, list[Column]]:
    """Distance over ``scale``, cut at ``most``, and the unit direction to the projection (zero when far)."""
    gap = minus(proj, p)
    length = norm(gap)
    d = F.least(length / scale, F.lit(most))
    near = length / scale <= most
    return d, [F.when(near, g / (length + eps)).otherwise(0.0) for g in gap]


def segment_project(p: Vector, a: Vector, b: Vector) -> tuple[Column, list[Column], Column]:
    """Distance, projection and place t in [0, 1] of a point on a segment (a point if a = b)."""
    ab = minus(b, a)
    length2 = dot(ab, ab)
    t = F.when(length2 > 0, F.greatest(F.least(dot(minus(p, a), ab) / length2, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    proj = [x + t * d for x, d in zip(vector(a), ab)]
    return norm(minus(p, proj)), proj, t


def aabb(points: Sequence[Vector], eps: float = 0.0) -> tuple[list[Column], list[Column]]:
    """Low and high corner of a box around some points, ``eps`` wider on each side."""
    axes = list(zip(*(vector(p) for p in points)))
    return [F.least(*x) - eps for x in axes], [F.greatest(*x) + eps for x in axes]


def triangle_edges(a: Vector, b: Vector, c: Vector) -> list[Column]:
    return [norm(minus(b, a)), norm(minus(c, b)), norm(minus(a, c))]


def triangle_area(a: Vector, b: Vector, c: Vector) -> Column:
    return norm(cross(minus(b, a), minus(c, a))) / 2


def circumradius(edges: Sequence[Column], area: Column) -> Column:
    return edges[0] * edges[1] * edges[2] / F.nullif(4 * area, F.lit(0.0))


def inradius(edges: Sequence[Column], area: Column) -> Column:
    return 2 * area / F.nullif(edges[0] + edges[1] + edges[2], F.lit(0.0))


def unit(v: Vector) -> list[Column]:
    n = norm(v)
    return [F.when(n > 0, x / n).otherwise(0.0) for x in vector(v)]


def face_normal(a: Vector, b: Vector, c: Vector) -> list[Column]:
    return unit(cross(minus(b, a), minus(c, a)))


def cos_between(a: Vector, b: Vector) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def point_triangle(p: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """Squared distance of a point to a triangle: to its plane inside, else to the nearest edge."""
    ab, ac, ap = minus(b, a), minus(c, a), minus(p, a)
    n = cross(ab, ac)
    nn = dot(n, n)
    u = dot(cross(ab, ap), n) / nn
    v = dot(cross(ap, ac), n) / nn
    inside = (nn > 0) & (u >= 0) & (v >= 0) & (u + v <= 1)
    height = dot(ap, n)
    edges = [segment_project(p, x, y)[0] for x, y in ((a, b), (b, c), (c, a))]
    least = F.least(*edges)
    return F.when(inside, height * height / nn).otherwise(least * least)


# rigid transforms ------------------------------------------------------------------------------


def transform_point(m: Sequence, p: Vector, translate: bool = True) -> list[Column]:
    m, (x, y, z) = vector(m), vector(p)
    return [m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + (m[4 * r + 3] if translate else F.lit(0.0)) for r in range(3)]


def matmul4(a: Sequence, b: Sequence) -> list[Column]:
    a, b = vector(a), vector(b)
    return [a[4 * r] * b[c] + a[4 * r + 1] * b[4 + c] + a[4 * r + 2] * b[8 + c] + a[4 * r + 3] * b[12 + c] for r in range(4) for c in range(4)]


def rigid_inverse(m: Sequence) -> list[Column]:
    """Inverse of a rotation and translation: transposed rotation, turned translation."""
    m = vector(m)
    turned = [-(m[r] * m[3] + m[4 + r] * m[7] + m[8 + r] * m[11]) for r in range(3)]
    rows = [[m[r], m[4 + r], m[8 + r], turned[r]] for r in range(3)]
    return [x for row in rows for x in row] + [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]


def rotation(axis: str, angle: Column | float) -> list[Column]:
    c, s = F.cos(_c(angle)), F.sin(_c(angle))
    one, zero = F.lit(1.0), F.lit(0.0)
    rows = {"x": [[one, zero, zero], [zero, c, -s], [zero, s, c]], "y": [[c, zero, s], [zero, one, zero], [-s, zero, c]], "z": [[c, -s, zero], [s, c, zero], [zero, zero, one]]}[axis]
    return [x for row in rows for x in (*row, zero)] + [zero, zero, zero, one]


def scaling(k: float) -> list[float]:
    return [k, 0, 0, 0, 0, k, 0, 0, 0, 0, k, 0, 0, 0, 0, 1]


def translation(t: Vector) -> list:
    return [1.0, 0.0, 0.0, t[0], 0.0, 1.0, 0.0, t[1], 0.0, 0.0, 1.0, t[2], 0.0, 0.0, 0.0, 1.0]


# cameras ---------------------------------------------------------------------------------------


def project(focal: float, p: Vector) -> list[Column]:
    """Perspective image coordinates; depth is kept."""
    x, y, z = vector(p)
    return [focal * x / z, focal * y / z, z]


def unproject(focal: float, uvz: Vector) -> list[Column]:
    u, v, z = vector(uvz)
    return [u * z / focal, v * z / focal, z]


def to_pixel(u: Column, v: Column, sx: float, sy: float, width: int, height: int) -> tuple[Column, Column, Column]:
    """Row, column (rounded half to even) and whether the place is strictly inside the image."""
    col, row = F.rint(u / sx + width / 2), F.rint(v / sy + height / 2)
    return row.cast("long"), col.cast("long"), (col > 0) & (col < width) & (row > 0) & (row < height)


def from_pixel(row: Column, col: Column, sx: float, sy: float, width: int, height: int) -> tuple[Column, Column]:
    return (col - width / 2) * sx, (row - height / 2) * sy


def ortho_point(row: Column, col: Column, depth: Column, resolution: float, width: int, height: int) -> list[Column]:
    """Metric point of a grid pixel of an orthographic view."""
    return [(col - (width - 1) / 2) * resolution, (row - (height - 1) / 2) * resolution, depth]


# groups ----------------------------------------------------------------------------------------


def center(df: DataFrame, group: Sequence[str], xyz: Sequence[str]) -> DataFrame:
    """Coordinates relative to the group's mean."""
    mean = df.groupBy(*group).agg(*(F.avg(c).alias(f"mean_{c}") for c in xyz))
    return df.join(mean, list(group)).withColumns({c: F.col(c) - F.col(f"mean_{c}") for c in xyz}).drop(*(f"mean_{c}" for c in xyz))


def normalize_max(df: DataFrame, group: Sequence[str], xyz: Sequence[str]) -> DataFrame:
    """Coordinates over the group's largest vector length."""
    most = df.groupBy(*group).agg(F.max(norm(xyz)).alias("most"))
    return df.join(most, list(group)).withColumns({c: F.col(c) / F.nullif(F.col("most"), F.lit(0.0)) for c in xyz}).drop("most")


def normalize_depth(df: DataFrame, group: Sequence[str], depth: str, background: float, q: float | None = 0.95, constant: float = 1.0) -> DataFrame:
    """Foreground depth less its minimum, over its q-quantile (else its maximum, else 1) or a constant."""
    fore = F.col(depth) != background
    low = df.where(fore).groupBy(*group).agg(F.min(depth).alias("low"), F.max(depth).alias("high"), *([F.percentile(depth, q).alias("cut")] if q is not None else []))
    scale = F.coalesce(F.nullif(F.col("cut") - F.col("low"), F.lit(0.0)), F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(1.0)) if q is not None else F.lit(constant)
    return df.join(low, list(group), "left").withColumn(depth, F.when(fore, (F.col(depth) - F.col("low")) / scale).otherwise(F.col(depth))).drop("low", "high", "cut")


def histogram_expectation(logits: Column, low: float, high: float, margin: float = 0.0) -> Column:
    """Softmax of the logits times the centres of equal bins over [low - margin, high + margin]."""
    n = F.size(logits)
    a, width = low - margin, (high - low) + 2 * margin
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    centres = F.transform(weights, lambda w, i: w * (a + (i + 0.5) * width / n))
    return F.aggregate(centres, F.lit(0.0), lambda s, x: s + x) / total


def tangent_frame(n: Vector) -> tuple[list[Column], list[Column]]:
    """Tangent n x y (n x z where that vanishes) and bitangent n x t."""
    x, y, z = vector(n)
    first, second = [-z, F.lit(0.0), x], [y, -x, F.lit(0.0)]
    small = dot(first, first) < 1e-12
    t = unit([F.when(small, b).otherwise(a) for a, b in zip(first, second)])
    return t, cross([x, y, z], t)


def item_id_from_path(path: Column) -> Column:
    """``<dir>_<hash>_<number>`` of ``<dir>/<dir>_<hash>_<modality>_<number>.<ext>``."""
    p = r"([^/_]+)_([^/_]+)_([^/_]+)_([^/_.]+)\.[^/.]+$"
    return F.concat_ws("_", *(F.regexp_extract(path, p, g) for g in (1, 2, 4)))


def modality_from_path(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/_]+_[^/_]+_([^/_]+)_[^/_.]+\.[^/.]+$", 1)


def chunk_from_path(path: Column) -> Column:
    return F.regexp_extract(path, r"([0-9]{4})_[a-z0-9]+_v[0-9]+", 1)


def gaussian(seed: int, *key: str) -> Column:
    """A standard normal number that the key and the seed decide (Box-Muller)."""
    from pointweave.operators.tables import uniform

    return F.sqrt(-2 * F.ln(uniform(seed, *key))) * F.cos(2 * math.pi * uniform(seed + 1, *key))


def add_noise(df: DataFrame, kind: str, scale: float, seed: int, key: Sequence[str], xyz: Sequence[str] = ("x", "y", "z"), normal: Sequence[str] | None = None) -> DataFrame:
    """Isotropic noise, noise along the normal, or along z."""
    if kind == "isotropic":
        return df.withColumns({c: F.col(c) + scale * gaussian(seed + 10 * i, *key) for i, c in enumerate(xyz)})
    g = scale * gaussian(seed, *key)
    if kind == "z":
        return df.withColumn(xyz[2], F.col(xyz[2]) + g)
    return df.withColumns({c: F.col(c) + g * F.col(n) for c, n in zip(xyz, normal)})


def many_scales(df: DataFrame, kind: str, scales: Sequence[float], seed: int, key: Sequence[str], xyz: Sequence[str] = ("x", "y", "z"), normal: Sequence[str] | None = None) -> DataFrame:
    """One copy of the rows for each noise scale."""
    copies = df.withColumn("noise_scale", F.explode(F.array(*(F.lit(float(s)) for s in scales))))
    noise = add_noise(copies.withColumns({c: F.lit(0.0) for c in xyz}), kind, 1.0, seed, key, xyz, normal)
    originals = df.select(*key, *(F.col(c).alias(f"own_{c}") for c in xyz))
    return noise.join(originals, list(key)).withColumns({c: F.col(f"own_{c}") + F.col("noise_scale") * F.col(c) for c in xyz}).drop(*(f"own_{c}" for c in xyz))


def augment(df: DataFrame, seed: int, group: Sequence[str], row: str, col: str, depth: str, label: str, low: float, high: float, width: int, height: int) -> DataFrame:
    """Random scale and random flips, the same for all pixels of a view."""
    from pointweave.operators.tables import uniform

    k = low + (high - low) * uniform(seed, *group)
    return df.withColumns({
        row: F.when(uniform(seed + 1, *group) < 0.5, height - 1 - F.col(row)).otherwise(F.col(row)),
        col: F.when(uniform(seed + 2, *group) < 0.5, width - 1 - F.col(col)).otherwise(F.col(col)),
        depth: F.col(depth) * k,
        label: F.col(label) * k,
    })


# ordered curves --------------------------------------------------------------------------------


def _gap(w: Window, xyz: Sequence[str]) -> Column:
    return norm([F.col(c) - F.lag(c).over(w) for c in xyz])


def polyline_length(df: DataFrame, curve: Sequence[str], order: str, xyz: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    w = Window.partitionBy(*curve).orderBy(order)
    return df.withColumn("gap", _gap(w, xyz)).groupBy(*curve).agg(F.coalesce(F.sum("gap"), F.lit(0.0)).alias("length"))


def arc_parameter(df: DataFrame, curve: Sequence[str], order: str, xyz: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Chord length run so far over the whole, in [0, 1]."""
    w = Window.partitionBy(*curve).orderBy(order)
    run = df.withColumn("gap", F.coalesce(_gap(w, xyz), F.lit(0.0))).withColumn("run", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.withColumn("t", F.col("run") / F.nullif(F.max("run").over(Window.partitionBy(*curve)), F.lit(0.0))).drop("gap", "run")


def spacing_weights(df: DataFrame, curve: Sequence[str], order: str, xyz: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Half the sum of the gaps beside a point; end points have one gap."""
    w = Window.partitionBy(*curve).orderBy(order)
    after = norm([F.lead(c).over(w) - F.col(c) for c in xyz])
    return df.withColumn("weight", (F.coalesce(_gap(w, xyz), F.lit(0.0)) + F.coalesce(after, F.lit(0.0))) / 2)


def turn_cosines(df: DataFrame, curve: Sequence[str], order: str, xyz: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Cosine between the segments that meet at a point; null at the ends."""
    w = Window.partitionBy(*curve).orderBy(order)
    incoming = [F.col(c) - F.lag(c).over(w) for c in xyz]
    outgoing = [F.lead(c).over(w) - F.col(c) for c in xyz]
    return df.withColumn("turn", cos_between(incoming, outgoing))


def split_at_breakpoints(df: DataFrame, curve: Sequence[str], order: str, straight: float, xyz: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Number of the piece of each point; a piece ends where straight and sharp turns alternate."""
    w = Window.partitionBy(*curve).orderBy(order)
    turns = turn_cosines(df, curve, order, xyz).withColumn("is_straight", F.coalesce(F.col("turn") >= straight, F.lit(True)))
    flips = turns.withColumn("flip", F.coalesce((F.col("is_straight") != F.lag("is_straight").over(w)).cast("long"), F.lit(0)))
    return flips.withColumn("piece", F.sum("flip").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("flip")
