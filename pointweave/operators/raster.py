"""Raster operators on pixel tables (view, row, column, depth, signal...).

Windows over images become explode-and-join on (view, row, column): a view may
be of any size and never has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("view_id", "pr", "pc")


def z_buffer(hits: DataFrame, keep: str = "min", depth: str = "depth", tie: str = "event_id", key: Sequence[str] = KEY) -> DataFrame:
    """The nearest (or farthest) hit of each pixel with its signal; ties by the least ``tie``."""
    order = F.struct((F.col(depth) if keep == "min" else -F.col(depth)).alias("order"), F.col(tie).alias("tie"), *(F.col(c) for c in hits.columns if c not in (*key, tie)))
    rest = [c for c in hits.columns if c not in (*key, tie)]
    return hits.groupBy(*key).agg(F.min(order).alias("best")).select(*key, F.col("best.tie").alias(tie), *(F.col(f"best.{c}").alias(c) for c in rest))


def _spread(pixels: DataFrame, width: int, key: Sequence[str] = KEY) -> DataFrame:
    """Each pixel once for every pixel of the window around it, with its offset."""
    view, row, col = key
    steps = F.sequence(F.lit(-width), F.lit(width))
    return pixels.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps)).withColumns({row: F.col(row) + F.col("dr"), col: F.col(col) + F.col("dc")})


def erode(pixels: DataFrame, width: int, foreground: Column, key: Sequence[str] = KEY) -> DataFrame:
    """Foreground pixels whose (2 width + 1)^2 window holds no background pixel of the table."""
    near = _spread(pixels.where(~foreground).select(*key), width, key).select(*key).distinct()
    return pixels.where(foreground).join(near, list(key), "left_anti")


def sobel(pixels: DataFrame, foreground: Column, value: str = "depth", key: Sequence[str] = KEY) -> DataFrame:
    """Gradient magnitude at pixels with a complete foreground 3 x 3 window (kernels over 4, magnitude over sqrt 2)."""
    around = _spread(pixels.where(foreground).select(*key, value), 1, key)
    # a pixel at offset (dr, dc) reached this one; its own offset from here is the negative
    r, c = -F.col("dr"), -F.col("dc")
    weight = lambda along, across: along * (2 - F.abs(across)) / 4
    sums = around.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value) * weight(r, c)).alias("gr"), F.sum(F.col(value) * weight(c, r)).alias("gc"))
    return sums.where("n = 9").select(*key, (F.sqrt(F.col("gr") * F.col("gr") + F.col("gc") * F.col("gc")) / F.sqrt(F.lit(2.0))).alias("magnitude"))


def tiles(pixels: DataFrame, size: int, stride: int, canvas: int, foreground: Column, key: Sequence[str] = KEY) -> DataFrame:
    """Pixels of overlapping square tiles with origins 0, stride, ... < canvas - size; empty tiles removed."""
    view, row, col = key
    last = (canvas - size - 1) // stride

    def origins(c: str) -> Column:
        low = F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / stride)).cast("long")
        high = F.least(F.lit(last), F.floor(F.col(c) / stride)).cast("long")
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    placed = pixels.withColumn("tr", origins(row)).withColumn("tc", origins(col)).withColumns({"tr": F.col("tr") * stride, "tc": F.col("tc") * stride})
    full = placed.where(foreground).select(view, "tr", "tc").distinct()
    return placed.join(full, [view, "tr", "tc"], "left_semi").withColumns({"lr": F.col(row) - F.col("tr"), "lc": F.col(col) - F.col("tc")})


def crop_center(pixels: DataFrame, height: int, width: int, new_height: int, new_width: int, key: Sequence[str] = KEY) -> DataFrame:
    _, row, col = key
    top, left = (height - new_height) // 2, (width - new_width) // 2
    r, c = F.col(row) - top, F.col(col) - left
    return pixels.where((r >= 0) & (r < new_height) & (c >= 0) & (c < new_width)).withColumns({row: r, col: c})


def uncrop(pixels: DataFrame, height: int, width: int, new_height: int, new_width: int, key: Sequence[str] = KEY) -> DataFrame:
    """Inverse of :func:`crop_center`: places in the full image."""
    _, row, col = key
    return pixels.withColumns({row: F.col(row) + (height - new_height) // 2, col: F.col(col) + (width - new_width) // 2})


def pad(pixels: DataFrame, height: int, width: int, fill: dict[str, float], key: Sequence[str] = KEY) -> DataFrame:
    """Every pixel of the grid of every view; those without a row get ``fill``."""
    view, row, col = key
    grid = pixels.select(view).distinct().withColumn(row, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long")))).withColumn(col, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))))
    return grid.join(pixels, list(key), "left").fillna(fill)


def common_bbox(pixels: DataFrame, by: Sequence[str], foreground: Column, border: int = 0, key: Sequence[str] = KEY) -> DataFrame:
    _, row, col = key
    return pixels.where(foreground).groupBy(*by).agg((F.min(row) - border).alias("top"), (F.max(row) + border).alias("bottom"), (F.min(col) - border).alias("left"), (F.max(col) + border).alias("right"))


def snap_pow2(size: Column) -> Column:
    """The least power of two that is not under the size."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(size, F.lit(1))))).cast("long")


def snap_inside(start: Column, size: Column, limit: int) -> Column:
    """A start moved so that [start, start + size) lies in [0, limit)."""
    return F.greatest(F.least(start, F.lit(limit) - size), F.lit(0))


def tile_normalize(pixels: DataFrame, size: int, foreground: Column, constant: float, value: str = "depth", key: Sequence[str] = KEY) -> DataFrame:
    """Foreground less the minimum of its non-overlapping tile, over a constant."""
    view, row, col = key
    placed = pixels.withColumns({"tr": F.floor(F.col(row) / size), "tc": F.floor(F.col(col) / size)})
    low = placed.where(foreground).groupBy(view, "tr", "tc").agg(F.min(value).alias("low"))
    return placed.join(low, [view, "tr", "tc"], "left").withColumn(value, F.when(foreground, (F.col(value) - F.col("low")) / constant).otherwise(F.col(value))).drop("low")


def signal_on_foreground(pixels: DataFrame, signal: str, background: float, fill: float, depth: str = "depth") -> DataFrame:
    return pixels.withColumn(signal, F.when(F.col(depth) == background, F.lit(fill)).otherwise(F.col(signal)))


def fuse_views_plain(pixels: DataFrame, resolution: float, width: int, height: int, pose: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """World points of all views with one running index; ``pose`` has view_id and m (16 doubles)."""
    from pointweave.functions.geometry import ortho_point, transform_point
    from pointweave.operators.tables import global_index

    view, row, col = key
    m = [F.element_at("m", i + 1) for i in range(16)]
    world = transform_point(m, ortho_point(F.col(row), F.col(col), F.col("depth"), resolution, width, height))
    placed = pixels.join(pose, view).withColumns(dict(zip("xyz", world))).drop("m")
    return global_index(placed, [], view, [row, col])
