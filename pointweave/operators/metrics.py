"""Evaluation of predicted distance fields against ground truth.

Input rows: item_id, sample_id, true_d, pred_d.  All metrics are grouped sums
and mergeable quantiles; two-level metrics aggregate per instance first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.operators.tables import numbered, quantile
from pointweave.sources.durable import durable


def _sq() -> Column:
    return (F.col("true_d") - F.col("pred_d")) * (F.col("true_d") - F.col("pred_d"))


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def align_truth_pred(truth: DataFrame, pred: DataFrame, on: Sequence[str], strict: bool = True) -> DataFrame:
    """Truth joined to prediction; with ``strict``, a key on one side only is an error."""
    out = truth.join(pred, list(on), "full_outer" if strict else "inner")
    if not strict:
        return out
    lost = F.col("true_d").isNull() | F.col("pred_d").isNull()
    checked = F.when(lost, F.raise_error(F.lit("truth and prediction do not have the same keys")).cast("boolean")).otherwise(F.lit(True))
    return out.where(checked)


def rmse(pairs: DataFrame, by: Sequence[str] = (), scale: float = 1.0) -> DataFrame:
    return pairs.groupBy(*by).agg((F.sqrt(F.avg(_sq())) / scale).alias("rmse"))


def bad_points(pairs: DataFrame, threshold: float, by: Sequence[str] = (), normalize: bool = True) -> DataFrame:
    """Number, or share, of samples whose squared error exceeds the squared threshold."""
    n = _count(_sq() > threshold * threshold)
    return pairs.groupBy(*by).agg((n / F.count(F.lit(1)) if normalize else n).alias("bad"))


def sqerr_quantile(pairs: DataFrame, q: float, by: Sequence[str] = ()) -> DataFrame:
    """Linear quantile of the squared error."""
    from pointweave.operators.tables import quantile

    return quantile(pairs, by, _sq(), q)


def iou(pairs: DataFrame, true_t: float, pred_t: float, by: Sequence[str] = ()) -> DataFrame:
    t, p = F.col("true_d") < true_t, F.col("pred_d") < pred_t
    return pairs.groupBy(*by).agg((_count(t & p) / F.nullif(_count(t | p), F.lit(0))).alias("iou"))


def average_precision(pairs: DataFrame, threshold: float, by: Sequence[str] = (), invert: bool = False) -> DataFrame:
    """Sum over distinct scores, best first, of recall gained times precision.

    The score is the predicted distance itself, or its negative with
    ``invert``.  Samples are counted per score before any window runs.
    """
    score = -F.col("pred_d") if invert else F.col("pred_d")
    counts = pairs.groupBy(*by, score.alias("score")).agg(_count(F.col("true_d") < threshold).alias("hits"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by)
    down = group.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumns({"tp": F.sum("hits").over(down), "seen": F.sum("n").over(down), "all": F.sum("hits").over(group)})
    gain = F.col("hits") / F.nullif(F.col("all"), F.lit(0)) * F.col("tp") / F.col("seen")
    return run.groupBy(*by).agg(F.sum(gain).alias("ap"))


def fpr(pairs: DataFrame, true_t: float, pred_t: float, by: Sequence[str] = ()) -> DataFrame:
    fp, tn = _count((F.col("true_d") >= true_t) & (F.col("pred_d") < pred_t)), _count((F.col("true_d") >= true_t) & (F.col("pred_d") >= pred_t))
    return pairs.groupBy(*by).agg((fp / (fp + tn + F.lit(1e-6))).alias("fpr"))


def masked(pairs: DataFrame, predicate: Column, metric, **kwargs) -> DataFrame:
    """A metric over the samples that meet a predicate; groups without any are absent."""
    return metric(pairs.where(predicate), **kwargs)


def rescaled(values: DataFrame, column: str, k: float) -> DataFrame:
    return values.withColumn(column, F.col(column) * k)


def instances(pairs: DataFrame, threshold: float, instance: Sequence[str] = ("item_id",)) -> DataFrame:
    """Sums of each instance, from which all dataset metrics follow."""
    t, p = F.col("true_d") < threshold, F.col("pred_d") < threshold
    return pairs.groupBy(*instance).agg(
        F.sqrt(F.avg(_sq())).alias("rmse"), _count(t & p).alias("tp"), _count(t & ~p).alias("fn"), _count(~t & p).alias("fp"), _count(~t & ~p).alias("tn")
    )


def _dataset(strict: bool = False) -> dict[str, Column]:
    positives, negatives = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    has = _count(negatives > 0)
    rate = F.sum(F.when(negatives > 0, F.col("fp") / negatives).otherwise(1.0 if strict else 0.0))
    return {
        "mean_rmse": F.avg("rmse"),
        "mean_recall": F.avg(F.when(positives > 0, F.col("tp") / positives)),
        "mean_fpr": rate / F.nullif(has, F.lit(0)),
    }


def dataset_summary(own: DataFrame, by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Dataset metrics of the instances of each group; the quantile needs no buffer of a group's values."""
    sums = own.groupBy(*by).agg(*(c.alias(n) for n, c in _dataset(strict).items()))
    cut = quantile(own, by, "rmse", 0.95, "q95_rmse")
    met = sums.join(cut, list(by), "left") if by else sums.join(F.broadcast(cut), F.lit(True), "left")
    return met.select(*by, "mean_rmse", "q95_rmse", "mean_recall", "mean_fpr")


def dataset_metrics(pairs: DataFrame, threshold: float, instance: Sequence[str] = ("item_id",), by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Mean and 0.95-quantile RMSE, mean recall and mean false positive rate over instances."""
    own = instances(pairs, threshold, [*by, *instance])
    return dataset_summary(own, by, strict)


def metric_suite(pairs: DataFrame, r: float, multiples: Sequence[float] = (1.0, 4.0), instance: Sequence[str] = ("item_id",), by: Sequence[str] = ()) -> DataFrame:
    """:func:`dataset_metrics` for several thresholds in one pass over the samples."""
    t = F.explode(F.array(*(F.lit(float(m * r)) for m in multiples)))
    sq = pairs.select(*by, *instance, "true_d", "pred_d", t.alias("threshold"))
    a, p = F.col("true_d") < F.col("threshold"), F.col("pred_d") < F.col("threshold")
    own = sq.groupBy(*by, *instance, "threshold").agg(
        F.sqrt(F.avg(_sq())).alias("rmse"), _count(a & p).alias("tp"), _count(a & ~p).alias("fn"), _count(~a & p).alias("fp"), _count(~a & ~p).alias("tn")
    )
    return dataset_summary(own, [*by, "threshold"])


def paper_metrics(pairs: DataFrame, r: float, by: Sequence[str] = ("item_id",)) -> DataFrame:
    """One row of named metrics per instance."""
    t, p = F.col("true_d") < r, F.col("pred_d") < r
    rest = pairs.groupBy(*by).agg(
        F.sqrt(F.avg(_sq())).alias("rmse"),
        (_count(_sq() > r * r) / F.count(F.lit(1))).alias("bad_r"),
        (_count(_sq() > 16 * r * r) / F.count(F.lit(1))).alias("bad_4r"),
        (_count(t & p) / F.nullif(_count(t | p), F.lit(0))).alias("iou"),
        (_count(~t & p) / (_count(~t) + F.lit(1e-6))).alias("fpr"),
        F.count(F.lit(1)).alias("n"),
    )
    return rest.join(quantile(pairs, by, _sq(), 0.95, "q95"), list(by), "left").select(*by, "rmse", "q95", "bad_r", "bad_4r", "iou", "fpr", "n")


def mean_by_config(rows: DataFrame, config: Sequence[str], values: Sequence[str]) -> DataFrame:
    return rows.groupBy(*config).agg(F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(v) for v in values))


def metric_by_split(pairs: DataFrame, split: str) -> DataFrame:
    """RMSE and sample count overall (null split) and per value of the split column."""
    return pairs.rollup(split).agg(F.sqrt(F.avg(_sq())).alias("rmse"), F.count(F.lit(1)).alias("n"), F.grouping(split).cast("long").alias("overall"))


def histogram(rows: DataFrame, value: str, bins: int, low: float, high: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts of equal-width bins over [low, high]; the right edge belongs to the last bin."""
    v = F.col(value)
    place = F.least(F.floor((v - low) * bins / (high - low)), F.lit(bins - 1)).cast("long")
    return rows.where((v >= low) & (v <= high)).groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def alignment_quantiles(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    out = None
    for name, q in (("q50", 0.5), ("q95", 0.95), ("q99", 0.99)):
        cut = quantile(rows, by, value, q, name)
        out = cut if out is None else out.join(cut, list(by))
    return out


def metric_matrix(rows: DataFrame, method: str, metric: str, value: str, names: dict[str, str]) -> DataFrame:
    """Method x metric table under display names, methods in the order of their names."""
    return rows.groupBy(method).pivot(metric, list(names)).agg(F.first(value)).select(method, *(F.col(k).alias(v) for k, v in names.items()))


def softmax_prob(scores: Column, k: int) -> Column:
    """Probability of class k (from 0) of an array of scores."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    return F.element_at(e, k + 1) / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)


def crop_metrics(votes: DataFrame, truth: Column, probability: Column, q: float, level: float = 0.7, patch: Sequence[str] = ("item_id", "patch_id"), xyz: Sequence[str] = ("px", "py", "pz")) -> DataFrame:
    """Mean recall and FPR of thresholded class scores on the central part of each patch."""
    from pointweave.operators.fusion import center_crop

    inner = center_crop(votes, q, patch, xyz).withColumns({"t": truth, "p": probability >= level})
    t, p = F.col("t"), F.col("p")
    own = inner.groupBy(*patch).agg(_count(t & p).alias("tp"), _count(t & ~p).alias("fn"), _count(~t & p).alias("fp"), _count(~t & ~p).alias("tn"), F.lit(0.0).alias("rmse"))
    m = _dataset()
    return own.agg(m["mean_recall"].alias("mean_recall"), m["mean_fpr"].alias("mean_fpr"), F.count(F.lit(1)).alias("n_patches"))


#: Points of a tile, whose pairs a task sums up at a time.
TILE = 256


def kernel_distance(a: DataFrame, b: DataFrame, kind: str, xyz: Sequence[str], by: Sequence[str], most: int | None = 10_000, scale: float = 1.0) -> DataFrame:
    """Kernel discrepancy of two samples per group: mean k(a,a) + mean k(b,b) - 2 mean k(a,b).

    A sample has at most ``most`` points a group (those of the least hash), as
    the measure is defined on samples; with None it has all of them.  Points are
    numbered and gathered in tiles of ``TILE``; a pair of tiles becomes one number inside a task, so a
    group of n points costs n * n kernel values but (n / TILE)^2 rows.
    """
    by = list(by)

    def tiles(df: DataFrame, tag: str) -> DataFrame:
        keyed = df.select(*by, F.xxhash64(*xyz).alias("place"), *(F.col(c).cast("double").alias(c) for c in xyz))
        nth = numbered(keyed, "place", *xyz, by=by, name="nth")
        own = nth if most is None else nth.where(F.col("nth") < most)
        return durable(own.groupBy(*by, F.expr(f"nth div {TILE}").alias("tile")).agg(F.flatten(F.collect_list(F.array(*xyz))).alias(f"{tag}_at"), F.count(F.lit(1)).alias(f"{tag}_n")).drop("tile"), "tiles")

    @F.pandas_udf("double")
    def summed(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            d2 = ((x.reshape(-1, 1, len(xyz)) - y.reshape(1, -1, len(xyz))) ** 2).sum(axis=2)
            out.append({"energy": lambda: -np.sqrt(d2), "gaussian": lambda: np.exp(-d2 / (2 * scale * scale)), "laplacian": lambda: np.exp(-np.sqrt(d2) / scale)}[kind]().sum())
        return pd.Series(out)

    def mean(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        met = x.select(*by, F.col("s_at").alias("l_at"), F.col("s_n").alias("l_n")).join(y.select(*by, F.col("s_at").alias("r_at"), F.col("s_n").alias("r_n")), by)
        return met.select(*by, summed("l_at", "r_at").alias("k"), (F.col("l_n") * F.col("r_n")).alias("n")).groupBy(*by).agg((F.sum("k") / F.sum("n")).alias(name))

    one, two = tiles(a, "s"), tiles(b, "s")
    out = mean(one, one, "aa").join(mean(two, two, "bb"), by).join(mean(one, two, "ab"), by)
    return out.select(*by, (F.col("aa") + F.col("bb") - 2 * F.col("ab")).alias("distance"))
