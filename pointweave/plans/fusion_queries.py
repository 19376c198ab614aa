"""Queries of fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointweave.operators import fusion as fu
from pointweave.operators import metrics as me
from pointweave.plans.registry import add

_G = "GROUP BY item_id, global_idx"
for how, agg in {"min": "MIN(value)", "mean": "AVG(value)", "median": "QUANTILE_CONT(value, 0.5)"}.items():
    add(f"a1_combine_{how}", lambda v, how=how: fu.combine(v("fx_votes"), how), f"SELECT item_id, global_idx, {agg} AS distance, COUNT(*) AS n_pred FROM fx_votes {_G}", "distance")
add("a2_combine_vote", lambda v: fu.combine_vote(v("fx_votes"), 0.4875), f"SELECT item_id, global_idx, CASE WHEN AVG(value) > 0.4875 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS distance FROM fx_votes {_G}")

_HAZEN = """
  WITH l AS (SELECT item_id, global_idx, list_sort(list(value)) AS a FROM fx_votes GROUP BY item_id, global_idx),
  h AS (SELECT *, len(a) AS n, LEAST(GREATEST(len(a) * 0.2::DOUBLE + 0.5, 1.0), len(a)) AS p1, LEAST(GREATEST(len(a) * 0.8::DOUBLE + 0.5, 1.0), len(a)) AS p2 FROM l),
  q AS (SELECT *, a[FLOOR(p1)::INT] + (p1 - FLOOR(p1)) * (a[LEAST(FLOOR(p1)::INT + 1, n)] - a[FLOOR(p1)::INT]) AS q1,
                  a[FLOOR(p2)::INT] + (p2 - FLOOR(p2)) * (a[LEAST(FLOOR(p2)::INT + 1, n)] - a[FLOOR(p2)::INT]) AS q2 FROM h),
  u AS (SELECT item_id, global_idx, q1, q2, UNNEST(a) AS v FROM q)
"""
# votes are multiples of 0.1 and the cuts sit on or between them: a slack keeps both engines on one side
for inner, agg in {"min": "MIN", "mean": "AVG"}.items():
    add(
        f"a3_combine_trimmed_{inner}",
        lambda v, inner=inner: fu.combine_trimmed(v("fx_votes").withColumn("value", F.round("value", 3)), 0.6, inner),
        _HAZEN.replace("list(value)", "list(ROUND(value, 3))") + f"SELECT item_id, global_idx, {agg}(v) FILTER (v >= q1 AND v <= q2) AS distance FROM u GROUP BY item_id, global_idx",
        "distance",
    )
add(
    "a4_with_default",
    lambda v: fu.with_default(v("fx_votes"), fu.combine(v("fx_votes").where("value > 0.85"), "min"), 1.0).select("item_id", "global_idx", "distance"),
    "SELECT p.item_id, p.global_idx, COALESCE(f.d, 1.0::DOUBLE) AS distance FROM (SELECT DISTINCT item_id, global_idx FROM fx_votes) p LEFT JOIN (SELECT item_id, global_idx, MIN(value) AS d FROM fx_votes WHERE value > 0.85 GROUP BY 1, 2) f USING (item_id, global_idx)",
    "distance",
)
add("a5_mean_of_mins", lambda v: fu.combine_mean_of_mins(v("fx_votes"), 0.45), f"SELECT item_id, global_idx, COALESCE(AVG(value) FILTER (value < 0.45), AVG(value)) AS distance FROM fx_votes {_G}", "distance")
_CROP = """
  WITH c AS (SELECT item_id, patch_id, AVG(px) AS cx, AVG(py) AS cy, AVG(pz) AS cz FROM fx_votes GROUP BY 1, 2),
  r AS (SELECT v.*, SQRT((px - cx) * (px - cx) + (py - cy) * (py - cy) + (pz - cz) * (pz - cz)) AS radius FROM fx_votes v JOIN c USING (item_id, patch_id)),
  k AS (SELECT item_id, patch_id, QUANTILE_CONT(radius, 0.9) AS cut FROM r GROUP BY 1, 2),
  inner_v AS (SELECT r.* FROM r JOIN k USING (item_id, patch_id) WHERE radius < cut)
"""
add("a6_center_crop", lambda v: fu.combine(fu.center_crop(v("fx_votes"), 0.9), "min"), _CROP + "SELECT item_id, global_idx, MIN(value) AS distance, COUNT(*) AS n_pred FROM inner_v GROUP BY 1, 2", "distance")
add("a7_combine_ground_truth", lambda v: fu.combine_ground_truth(v("fx_votes"), 0.25), f"SELECT item_id, global_idx, LEAST(MIN(value), 0.25) AS distance FROM fx_votes {_G}", "distance")
add(
    "a8_argmin_carry",
    lambda v: fu.argmin_carry(v("fx_votes"), ["px", "py", "pz"]),
    "SELECT item_id, global_idx, value AS distance, patch_id, px, py, pz FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id, global_idx ORDER BY value, patch_id, px, py, pz) AS n FROM fx_votes) WHERE n = 1",
    "distance", "px", "py", "pz",
)
add(
    "a9_push_back",
    lambda v: fu.push_back(v("fx_votes"), fu.combine(v("fx_votes"), "mean")).select("item_id", "global_idx", "patch_id", "vote_id", "fused"),
    "SELECT item_id, global_idx, patch_id, vote_id, AVG(value) OVER (PARTITION BY item_id, global_idx) AS fused FROM fx_votes", "fused",
)
add(
    "a10_collect_variants",
    lambda v: fu.collect_variants(v("fx_votes")).select("item_id", "global_idx", "n_pred", F.array_join(F.transform("votes", lambda x: F.format_string("%.3f", x)), ",").alias("votes")),
    f"SELECT item_id, global_idx, COUNT(*) AS n_pred, array_to_string(list_transform(list_sort(list(value)), lambda x: printf('%.3f', x)), ',') AS votes FROM fx_votes {_G}",
)
add(
    "s10_export_variants",
    lambda v: fu.export_variants(v("fx_votes")),
    f"SELECT item_id, global_idx, global_idx::VARCHAR || chr(9) || array_to_string(list_transform(list_sort(list(value)), lambda x: printf('%.3f', x)), ',') AS line FROM fx_votes {_G}",
)
add("v2_user_reducer", lambda v: fu.reduce_with(v("fx_votes"), lambda a: F.element_at(a, -1) - F.element_at(a, 1)), f"SELECT item_id, global_idx, MAX(value) - MIN(value) AS distance FROM fx_votes {_G}", "distance")
add("v3_transform_chain", lambda v: v("fx_votes").transform(lambda d: d.where("value < 0.85")).transform(fu.combine, "mean"), f"SELECT item_id, global_idx, AVG(value) AS distance, COUNT(*) AS n_pred FROM fx_votes WHERE value < 0.85 {_G}", "distance")
add(
    "v4_composed_combiners",
    lambda v: fu.combine(fu.center_crop(v("fx_votes"), 0.9), "mean").select("item_id", "global_idx", "distance", F.lit("crop90+mean").alias("tag")),
    _CROP + "SELECT item_id, global_idx, AVG(value) AS distance, 'crop90+mean' AS tag FROM inner_v GROUP BY 1, 2", "distance",
)
add("w12_quantile_mask", lambda v: fu.quantile_mask(v("fx_votes"), 0.9, ["item_id", "patch_id"], "px").groupBy("item_id", "patch_id").agg(F.sum(F.col("inside").cast("long")).alias("n_inside")),
    "SELECT item_id, patch_id, SUM(CASE WHEN px < cut THEN 1 ELSE 0 END)::BIGINT AS n_inside FROM (SELECT *, QUANTILE_CONT(px, 0.9) OVER (PARTITION BY item_id, patch_id) AS cut FROM fx_votes) GROUP BY 1, 2")
add(
    "f18_quantiles",
    lambda v: v("fx_votes").groupBy("item_id", "global_idx").agg(F.array_sort(F.collect_list(F.round("value", 3))).alias("a")).select("item_id", "global_idx", fu.hazen(F.col("a"), 0.2).alias("hazen"), fu.linear_quantile(F.col("a"), 0.95).alias("linear")),
    _HAZEN.replace("list(value)", "list(ROUND(value, 3))").replace("u AS (", "u AS (SELECT 1), w AS (").rsplit(", w AS", 1)[0] + " SELECT item_id, global_idx, q1 AS hazen, list_aggregate(a, 'quantile_cont', 0.95) AS linear FROM q",
    "hazen", "linear",
)

# evaluation ------------------------------------------------------------------------------------
_SQ = "(true_d - pred_d) * (true_d - pred_d)"
_I = "item_id"


def _inst(t: float, g: str = "item_id") -> str:
    return f"""inst AS (SELECT {g}, SQRT(AVG({_SQ})) AS rmse, SUM(CASE WHEN true_d < {t} AND pred_d < {t} THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN true_d < {t} AND pred_d >= {t} THEN 1 ELSE 0 END) AS fn,
      SUM(CASE WHEN true_d >= {t} AND pred_d < {t} THEN 1 ELSE 0 END) AS fp, SUM(CASE WHEN true_d >= {t} AND pred_d >= {t} THEN 1 ELSE 0 END) AS tn FROM fx_pairs GROUP BY {g})"""


_SET = """AVG(rmse) AS mean_rmse, QUANTILE_CONT(rmse, 0.95) AS q95_rmse, AVG(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END) AS mean_recall,
  SUM(CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE {s} END) / NULLIF(SUM(CASE WHEN fp + tn > 0 THEN 1 ELSE 0 END), 0) AS mean_fpr"""
add("j1_align_truth_pred", lambda v: me.align_truth_pred(v("fx_pairs").select("item_id", "sample_id", "true_d"), v("fx_pairs").select("item_id", "sample_id", "pred_d"), ["item_id", "sample_id"]), "SELECT item_id, sample_id, true_d, pred_d FROM fx_pairs", "true_d", "pred_d")
add("p3_drop_background", lambda v: v("fx_pairs").where("true_d <> 0.1").groupBy(_I).agg(F.count(F.lit(1)).alias("n")), "SELECT item_id, COUNT(*) AS n FROM fx_pairs WHERE true_d <> 0.1 GROUP BY 1")
add("p4_distance_range", lambda v: v("fx_pairs").where("true_d < 0.085 and true_d > 0.025"), "SELECT * FROM fx_pairs WHERE true_d < 0.085 AND true_d > 0.025", "true_d", "pred_d")
add("p13_abs_diff", lambda v: v("fx_pairs").select("item_id", "sample_id", F.abs(F.col("true_d") - F.col("pred_d")).alias("error")), "SELECT item_id, sample_id, ABS(true_d - pred_d) AS error FROM fx_pairs", "error")
add("a20_rmse", lambda v: me.rmse(v("fx_pairs"), [_I]), f"SELECT item_id, SQRT(AVG({_SQ})) AS rmse FROM fx_pairs GROUP BY 1", "rmse")
add("a21_bad_points", lambda v: me.bad_points(v("fx_pairs"), 0.025, [_I]), f"SELECT item_id, SUM(CASE WHEN {_SQ} > 0.025 * 0.025 THEN 1 ELSE 0 END)::DOUBLE / COUNT(*) AS bad FROM fx_pairs GROUP BY 1", "bad")
add("a22_sqerr_quantile", lambda v: me.sqerr_quantile(v("fx_pairs"), 0.95, [_I]), f"SELECT item_id, QUANTILE_CONT({_SQ}, 0.95) AS q FROM fx_pairs GROUP BY 1", "q")
add("a23_iou", lambda v: me.iou(v("fx_pairs"), 0.025, 0.025, [_I]), "SELECT item_id, SUM(CASE WHEN true_d < 0.025 AND pred_d < 0.025 THEN 1 ELSE 0 END)::DOUBLE / NULLIF(SUM(CASE WHEN true_d < 0.025 OR pred_d < 0.025 THEN 1 ELSE 0 END), 0) AS iou FROM fx_pairs GROUP BY 1", "iou")
add(
    "a24_average_precision",
    lambda v: me.average_precision(v("fx_pairs"), 0.025, [_I]),
    """WITH c AS (SELECT item_id, pred_d AS s, SUM(CASE WHEN true_d < 0.025 THEN 1 ELSE 0 END) AS hits, COUNT(*) AS n FROM fx_pairs GROUP BY 1, 2),
    r AS (SELECT *, SUM(hits) OVER w AS tp, SUM(n) OVER w AS seen, SUM(hits) OVER (PARTITION BY item_id) AS al FROM c WINDOW w AS (PARTITION BY item_id ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
    SELECT item_id, SUM(hits::DOUBLE / NULLIF(al, 0) * tp / seen) AS ap FROM r GROUP BY 1""",
    "ap",
)
add("a25_fpr", lambda v: me.fpr(v("fx_pairs"), 0.025, 0.025, [_I]), "SELECT item_id, SUM(CASE WHEN true_d >= 0.025 AND pred_d < 0.025 THEN 1 ELSE 0 END) / (SUM(CASE WHEN true_d >= 0.025 THEN 1 ELSE 0 END) + 0.000001) AS fpr FROM fx_pairs GROUP BY 1", "fpr")
add("a26_masked_rescaled", lambda v: me.rescaled(me.masked(v("fx_pairs"), F.col("true_d") < 0.085, me.rmse, by=[_I]), "rmse", 1000.0), f"SELECT item_id, SQRT(AVG({_SQ})) * 1000 AS rmse FROM fx_pairs WHERE true_d < 0.085 GROUP BY 1", "rmse")
for key, col in {"a27_mean_rmse": "mean_rmse", "a28_q95_rmse": "q95_rmse", "a29_mean_recall": "mean_recall"}.items():
    add(key, lambda v, col=col: me.dataset_metrics(v("fx_pairs"), 0.025).select(col), f"WITH {_inst(0.025)} SELECT {col} FROM (SELECT {_SET.format(s='0.0')} FROM inst) z", col)
for strict, s in ((False, "0.0"), (True, "1.0")):
    add("a30_mean_fpr" + "_strict" * strict, lambda v, strict=strict: me.dataset_metrics(v("fx_pairs").where("true_d > 0.005"), 0.085, ["item_id", "sample_id"], strict=strict).select("mean_fpr"),
        f"WITH {_inst(0.085, 'item_id, sample_id').replace('FROM fx_pairs', 'FROM fx_pairs WHERE true_d > 0.005')} SELECT mean_fpr FROM (SELECT {_SET.format(s=s)} FROM inst) z", "mean_fpr")
add(
    "a31_metric_suite",
    lambda v: me.metric_suite(v("fx_pairs"), 0.0125, (2.0, 6.0)),
    f"WITH {_inst(0.025)}, i2 AS (WITH {_inst(0.075)} SELECT * FROM inst) SELECT 0.025::DOUBLE AS threshold, {_SET.format(s='0.0')} FROM inst UNION ALL SELECT 0.075::DOUBLE AS threshold, {_SET.format(s='0.0')} FROM i2",
    "threshold", "mean_rmse", "q95_rmse", "mean_recall", "mean_fpr",
)
add(
    "a32_paper_metrics",
    lambda v: me.paper_metrics(v("fx_pairs"), 0.0135),
    f"""SELECT item_id, SQRT(AVG({_SQ})) AS rmse, QUANTILE_CONT({_SQ}, 0.95) AS q95, SUM(CASE WHEN {_SQ} > 0.0135 * 0.0135 THEN 1 ELSE 0 END)::DOUBLE / COUNT(*) AS bad_r,
    SUM(CASE WHEN {_SQ} > 16 * 0.0135 * 0.0135 THEN 1 ELSE 0 END)::DOUBLE / COUNT(*) AS bad_4r, SUM(CASE WHEN true_d < 0.0135 AND pred_d < 0.0135 THEN 1 ELSE 0 END)::DOUBLE / NULLIF(SUM(CASE WHEN true_d < 0.0135 OR pred_d < 0.0135 THEN 1 ELSE 0 END), 0) AS iou,
    SUM(CASE WHEN true_d >= 0.0135 AND pred_d < 0.0135 THEN 1 ELSE 0 END) / (SUM(CASE WHEN true_d >= 0.0135 THEN 1 ELSE 0 END) + 0.000001) AS fpr, COUNT(*) AS n FROM fx_pairs GROUP BY 1""",
    "rmse", "q95", "bad_r", "bad_4r", "iou", "fpr",
)
_PROB = "1 / (1 + EXP(-(value - 0.5) * 4))"
add(
    "a33_crop_metrics",
    lambda v: me.crop_metrics(v("fx_votes"), F.col("value") < 0.45, me.softmax_prob(F.array(F.lit(0.0), F.lit(4.0) * (F.col("value") - 0.5)), 1), 0.9),
    _CROP + f""", b AS (SELECT item_id, patch_id, value < 0.45 AS t, {_PROB} >= 0.7 AS p FROM inner_v),
    inst AS (SELECT item_id, patch_id, SUM(CASE WHEN t AND p THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN t AND NOT p THEN 1 ELSE 0 END) AS fn, SUM(CASE WHEN NOT t AND p THEN 1 ELSE 0 END) AS fp, SUM(CASE WHEN NOT t AND NOT p THEN 1 ELSE 0 END) AS tn FROM b GROUP BY 1, 2)
    SELECT AVG(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END) AS mean_recall, SUM(CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END) / NULLIF(SUM(CASE WHEN fp + tn > 0 THEN 1 ELSE 0 END), 0) AS mean_fpr, COUNT(*) AS n_patches FROM inst""",
    "mean_recall", "mean_fpr",
)
add(
    "a34_mean_by_config",
    lambda v: me.mean_by_config(me.rmse(v("fx_pairs"), [_I]).withColumn("config", F.col("item_id") % 3), ["config"], ["rmse"]),
    f"SELECT item_id % 3 AS config, COUNT(*) AS n, AVG(r) AS rmse FROM (SELECT item_id, SQRT(AVG({_SQ})) AS r FROM fx_pairs GROUP BY 1) GROUP BY 1", "rmse",
)
add("a35_metric_by_split", lambda v: me.metric_by_split(v("fx_pairs"), "item_id"), f"SELECT item_id, SQRT(AVG({_SQ})) AS rmse, COUNT(*) AS n, GROUPING(item_id)::BIGINT AS overall FROM fx_pairs GROUP BY ROLLUP (item_id)", "rmse")
add("a36_histogram", lambda v: me.histogram(v("fx_votes").where("px is not null"), "px", 7, 0.5, 50.5), "SELECT LEAST(FLOOR((px - 0.5) * 7 / 50.0), 6)::BIGINT AS bin, COUNT(*) AS n FROM fx_votes WHERE px >= 0.5 AND px <= 50.5 GROUP BY 1")
add("a40_alignment_quantiles", lambda v: me.alignment_quantiles(v("fx_votes"), "px", [_I]), "SELECT item_id, QUANTILE_CONT(px, 0.5) AS q50, QUANTILE_CONT(px, 0.95) AS q95, QUANTILE_CONT(px, 0.99) AS q99 FROM fx_votes GROUP BY 1", "q50", "q95", "q99")
add(
    "a41_metric_matrix",
    lambda v: me.metric_matrix(me.paper_metrics(v("fx_pairs"), 0.0125).unpivot(["item_id"], ["rmse", "bad_r"], "metric", "value"), "item_id", "metric", "value", {"rmse": "RMSE", "bad_r": "Bad"}),
    f"SELECT item_id, SQRT(AVG({_SQ})) AS \"RMSE\", SUM(CASE WHEN {_SQ} > 0.0125 * 0.0125 THEN 1 ELSE 0 END)::DOUBLE / COUNT(*) AS \"Bad\" FROM fx_pairs GROUP BY 1", '"RMSE"', '"Bad"',
)
add("f13_softmax_prob", lambda v: v("fx_votes").select("item_id", "global_idx", "vote_id", me.softmax_prob(F.array("value", "py"), 1).alias("p")), "SELECT item_id, global_idx, vote_id, EXP(py - GREATEST(value, py)) / (EXP(value - GREATEST(value, py)) + EXP(py - GREATEST(value, py))) AS p FROM fx_votes", "p")
for kind, k in {"energy": "-SQRT({d})", "gaussian": "EXP(-({d}) / 2)", "laplacian": "EXP(-SQRT({d}))"}.items():
    d = "(l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) + (l.z - r.z) * (l.z - r.z)"
    term = lambda a, b, k=k: f"(SELECT l.item_id, AVG({k.format(d=d)}) AS m FROM {a} l JOIN {b} r USING (item_id) GROUP BY 1)"
    add(
        f"a39_kernel_{kind}",
        lambda v, kind=kind: me.kernel_distance(v("fx_points").where("point_id % 2 = 0"), v("fx_points").where("point_id % 2 = 1"), kind, ["x", "y", "z"], ["item_id"]),
        f"WITH a AS (SELECT * FROM fx_points WHERE point_id % 2 = 0), b AS (SELECT * FROM fx_points WHERE point_id % 2 = 1) SELECT p.item_id, p.m + q.m - 2 * s.m AS distance FROM {term('a', 'a')} p JOIN {term('b', 'b')} q USING (item_id) JOIN {term('a', 'b')} s USING (item_id)",
        "distance",
    )
add(
    "l5_fuse_points",
    lambda v: (lambda t, p: t.join(p, ["item_id", "global_idx"]).select("item_id", "global_idx", "truth", "pred", F.abs(F.col("truth") - F.col("pred")).alias("error")))(
        fu.combine_ground_truth(v("fx_votes").select("item_id", "global_idx", (F.col("py") / 10).alias("value")), 1.0).withColumnRenamed("distance", "truth"),
        fu.combine(v("fx_votes"), "median").select("item_id", "global_idx", F.col("distance").alias("pred")),
    ),
    f"SELECT item_id, global_idx, LEAST(MIN(py / 10), 1.0) AS truth, QUANTILE_CONT(value, 0.5) AS pred, ABS(LEAST(MIN(py / 10), 1.0) - QUANTILE_CONT(value, 0.5)) AS error FROM fx_votes {_G}", "truth", "pred", "error",
)
add(
    "l6_evaluate",
    lambda v: me.metric_suite(me.align_truth_pred(v("fx_pairs").select("item_id", "sample_id", "true_d"), v("fx_pairs").select("item_id", "sample_id", "pred_d"), ["item_id", "sample_id"]).where("true_d <> 0.1"), 0.0125, (2.0,)),
    f"WITH {_inst(0.025).replace('FROM fx_pairs', 'FROM fx_pairs WHERE true_d <> 0.1')} SELECT 0.025::DOUBLE AS threshold, {_SET.format(s='0.0')} FROM inst", "threshold", "mean_rmse", "q95_rmse", "mean_recall", "mean_fpr",
)
