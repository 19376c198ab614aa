"""Fusion of repeated predictions per point.

Votes are rows (key columns..., value); every combiner is one grouped
aggregation with map-side combine, so a point that holds many votes is no hot
task.  Quantiles use Spark's mergeable ``percentile``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("item_id", "global_idx")


def combine(votes: DataFrame, how: str = "min", key: Sequence[str] = KEY, value: str = "value") -> DataFrame:
    """``min``, ``mean``, ``median`` or ``max`` of a point's votes, and their number."""
    agg = {"min": F.min(value), "max": F.max(value), "mean": F.avg(value), "median": F.percentile(value, 0.5)}[how]
    return votes.groupBy(*key).agg(agg.alias("distance"), F.count(value).alias("n_pred"))


def combine_vote(votes: DataFrame, threshold: float, key: Sequence[str] = KEY, value: str = "value") -> DataFrame:
    """1.0 where the mean vote exceeds the threshold, else 0.0."""
    return votes.groupBy(*key).agg(F.when(F.avg(value) > threshold, 1.0).otherwise(0.0).alias("distance"))


def hazen(ordered: Column, p: Column | float) -> Column:
    """Hazen quantile of a sorted array: place n p + 1/2, linear between neighbours."""
    n = F.size(ordered)
    place = F.least(F.greatest(n * F.lit(p) + 0.5, F.lit(1.0)), n.cast("double"))
    low = F.floor(place).cast("int")
    high = F.least(low + 1, n)
    return F.element_at(ordered, low) + (place - low) * (F.element_at(ordered, high) - F.element_at(ordered, low))


def linear_quantile(ordered: Column, p: Column | float) -> Column:
    """Quantile of a sorted array at place 1 + (n - 1) p, linear between neighbours."""
    n = F.size(ordered)
    place = 1.0 + (n - 1) * F.lit(p)
    low = F.floor(place).cast("int")
    return F.element_at(ordered, low) + (place - low) * (F.element_at(ordered, F.least(low + 1, n)) - F.element_at(ordered, low))


INNER: dict[str, Callable[[Column], Column]] = {
    "min": F.array_min,
    "max": F.array_max,
    "mean": lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a),
}


def combine_trimmed(votes: DataFrame, p: float = 0.6, inner: str = "mean", key: Sequence[str] = KEY, value: str = "value") -> DataFrame:
    """Votes inside the Hazen quantiles (1 - p)/2 and (1 + p)/2, then ``inner``; null if none is left."""
    lists = votes.groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias("votes"))
    low, high = hazen(F.col("votes"), (1 - p) / 2), hazen(F.col("votes"), (1 + p) / 2)
    kept = lists.withColumns({"low": low, "high": high}).withColumn("kept", F.filter("votes", lambda v: (v >= F.col("low")) & (v <= F.col("high"))))
    return kept.select(*key, F.when(F.size("kept") > 0, INNER[inner](F.col("kept"))).alias("distance"))


def with_default(points: DataFrame, fused: DataFrame, max_distance: float, key: Sequence[str] = KEY) -> DataFrame:
    """All points; those without a prediction get the upper bound."""
    return points.select(*key).distinct().join(fused, list(key), "left").withColumn("distance", F.coalesce("distance", F.lit(max_distance)))


def combine_mean_of_mins(votes: DataFrame, threshold: float = 0.9, key: Sequence[str] = KEY, value: str = "value") -> DataFrame:
    """Mean of the votes under the threshold, or of all where none is."""
    return votes.groupBy(*key).agg(F.coalesce(F.avg(F.when(F.col(value) < threshold, F.col(value))), F.avg(value)).alias("distance"))


def center_crop(votes: DataFrame, q: float, patch: Sequence[str] = ("item_id", "patch_id"), xyz: Sequence[str] = ("px", "py", "pz")) -> DataFrame:
    """Votes whose radius from their patch's centroid is strictly under the patch's q-quantile radius.

    Two grouped aggregations and joins instead of windows, so that a large
    patch is combined map-side.
    """
    centre = votes.groupBy(*patch).agg(*(F.avg(c).alias(f"c_{c}") for c in xyz))
    radius = F.sqrt(sum(((F.col(c) - F.col(f"c_{c}")) * (F.col(c) - F.col(f"c_{c}")) for c in xyz), F.lit(0.0)))
    far = votes.join(centre, list(patch)).withColumn("radius", radius)
    cut = far.groupBy(*patch).agg(F.percentile("radius", q).alias("cut"))
    return far.join(cut, list(patch)).where("radius < cut").select(*votes.columns)


def combine_ground_truth(votes: DataFrame, cap: float, key: Sequence[str] = KEY, value: str = "value") -> DataFrame:
    return votes.groupBy(*key).agg(F.least(F.min(value), F.lit(cap)).alias("distance"))


def argmin_carry(votes: DataFrame, carry: Sequence[str], key: Sequence[str] = KEY, value: str = "value", tie: str = "patch_id") -> DataFrame:
    """The least vote and the ``carry`` columns of the row that has it; ties by ``tie``, then the carried values."""
    best = F.min(F.struct(value, tie, *carry)).alias("best")
    return votes.groupBy(*key).agg(best).select(*key, F.col(f"best.{value}").alias("distance"), *(F.col(f"best.{c}").alias(c) for c in (tie, *carry)))


def push_back(votes: DataFrame, fused: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Every row of a patch with the fused value of its point."""
    return votes.join(fused.select(*key, F.col("distance").alias("fused")), list(key))


def collect_variants(votes: DataFrame, key: Sequence[str] = KEY, value: str = "value") -> DataFrame:
    """The sorted multiset of a point's votes and its size."""
    return votes.groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias("votes"), F.count(value).alias("n_pred"))


def export_variants(votes: DataFrame, key: Sequence[str] = KEY, value: str = "value") -> DataFrame:
    """One text line per point: index, tab, sorted votes joined by commas."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda v: F.format_string("%.3f", v)), ",")
    return votes.groupBy(*key).agg(text.alias("votes")).select(*key, F.concat_ws("\t", F.col(key[-1]).cast("string"), "votes").alias("line"))


def reduce_with(votes: DataFrame, reducer: Callable[[Column], Column], key: Sequence[str] = KEY, value: str = "value") -> DataFrame:
    """A caller's reducer over the sorted votes of each point (array column to column)."""
    return collect_variants(votes, key, value).select(*key, reducer(F.col("votes")).alias("distance"))


#: Elimination of u, v and w = u v from the normal equations of a + b u + c v + d w,
#: level by level; a direction without spread is left out.
_ELIMINATION = (
    {"iu": "CASE WHEN suu > 1e-12 THEN 1 / suu ELSE 0 END"},
    {
        "vv1": "svv - suv * suv * iu", "ww1": "sww - suw * suw * iu", "vw1": "svw - suv * suw * iu", "v1": "sv - su * suv * iu", "w1": "sw - su * suw * iu",
        "n1": "n - su * su * iu", "bv1": "bv - suv * bu * iu", "bw1": "bw - suw * bu * iu", "bd1": "bd - su * bu * iu",
    },
    {"iv": "CASE WHEN vv1 > 1e-12 THEN 1 / vv1 ELSE 0 END"},
    {"ww2": "ww1 - vw1 * vw1 * iv", "w2": "w1 - v1 * vw1 * iv", "n2": "n1 - v1 * v1 * iv", "bw2": "bw1 - vw1 * bv1 * iv", "bd2": "bd1 - v1 * bv1 * iv"},
    {"iw": "CASE WHEN ww2 > 1e-12 THEN 1 / ww2 ELSE 0 END"},
    {"n3": "n2 - w2 * w2 * iw", "bd3": "bd2 - w2 * bw2 * iw"},
)
_FITTED = "CASE WHEN lu > 0 OR hu < 0 OR lv > 0 OR hv < 0 THEN NULL WHEN n3 > 1e-9 THEN bd3 / n3 ELSE bd / n END"


def least_squares_fit(candidates: DataFrame, key: Sequence[str], u: str, v: str, d: str) -> DataFrame:
    """a + b u + c v + d u v fitted to each target's neighbours, evaluated at (0, 0).

    ``u`` and ``v`` are offsets from the target; a target outside its
    neighbours' box gets null.  The moments are sums that combine map-side, and
    the 4 x 4 system is eliminated in columns.
    """
    cu, cv, cd = F.col(u), F.col(v), F.col(d)
    cw = cu * cv
    sums = {"su": cu, "sv": cv, "sw": cw, "bd": cd, "suu": cu * cu, "svv": cv * cv, "sww": cw * cw, "suv": cu * cv, "suw": cu * cw, "svw": cv * cw, "bu": cu * cd, "bv": cv * cd, "bw": cw * cd}
    m = candidates.groupBy(*key).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *(F.sum(e).alias(a) for a, e in sums.items()),
        F.min(cu).alias("lu"), F.max(cu).alias("hu"), F.min(cv).alias("lv"), F.max(cv).alias("hv"),
    )
    for level in _ELIMINATION:
        m = m.withColumns({name: F.expr(e) for name, e in level.items()})
    return m.select(*key, F.expr(_FITTED).alias("distance"), "n")


def smooth(points: DataFrame, neighbours: DataFrame, alpha: float, power: int = 2, steps: int = 20, rate: float = 0.05, momentum: float = 0.9, every: int = 5) -> DataFrame:
    """Momentum descent on sum (f - f0)^2 + alpha sum |f - f_j|^power over a neighbour table.

    ``points`` has id and value; ``neighbours`` has id and other.  A row pulls
    its id alone; the slope of the sum over all rows has each row in both
    directions.  Each step is
    one join and one grouped sum; the state is written to the shared folder
    every ``every`` steps.
    """
    from pointweave.sources.durable import durable

    state = points.select("id", F.col("value").alias("f0"), F.lit(1.0).alias("f"), F.lit(0.0).alias("m"))
    for step in range(steps):
        other = state.select(F.col("id").alias("other"), F.col("f").alias("g"))
        gap = F.col("f") - F.col("g")
        slope = 2 * gap if power == 2 else F.signum(gap)
        pull = neighbours.join(other, "other").join(state.select("id", "f"), "id").groupBy("id").agg(F.sum(slope).alias("pull"))
        m = momentum * F.col("m") + 2 * (F.col("f") - F.col("f0")) + alpha * F.coalesce("pull", F.lit(0.0))
        state = state.join(pull, "id", "left").withColumn("m", m).select("id", "f0", (F.col("f") - rate * F.col("m")).alias("f"), "m")
        if (step + 1) % every == 0:
            state = durable(state, "smooth")
    return state.select("id", F.col("f").alias("value"))


def smooth_local_fit(votes: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Mean over the neighbourhoods that hold a point of their local bilinear fits.

    ``neighbours``: id, other, u, v (offsets); ``votes``: id, value.
    """
    local = neighbours.join(votes.select(F.col("id").alias("other"), "value"), "other")
    fits = least_squares_fit(local, ["id"], "u", "v", "value").where("distance is not null").select("id", "distance")
    spread = neighbours.select("id", "other").join(fits, "id")
    return spread.groupBy(F.col("other").alias("id")).agg(F.avg("distance").alias("value"))


def quantile_mask(rows: DataFrame, q: float, group: Sequence[str], value: str) -> DataFrame:
    """Rows with ``inside``: strictly under their group's q-quantile."""
    from pointweave.operators.tables import quantile

    cut = quantile(rows, group, value, q, "cut")
    return rows.join(cut, list(group)).withColumn("inside", F.col(value) < F.col("cut")).drop("cut")

