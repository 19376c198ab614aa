"""Queries of filters, key joins, windows, orders and sets (P, J, W, K, U, S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointweave.operators import tables as tb
from pointweave.plans.registry import add
from pointweave.sources import tables as so

add("s1_read_table", lambda v: so.through(v("orders"), "orders", lambda d, p: d.write.parquet(p), lambda p: so.read_table(v("orders").sparkSession, p, ["o_orderkey", "o_totalprice"], v("orders").schema)), "SELECT o_orderkey, o_totalprice FROM orders", "o_totalprice")
add(
    "s3_join_modalities",
    lambda v: tb.join_modalities({"doc": v("documents").select("doc_id", "lang", "n_chars"), "label": v("labels"), "vec": v("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cls"))}, "doc_id"),
    "SELECT d.doc_id, lang AS doc_lang, n_chars AS doc_n_chars, quality AS label_quality, toxic AS label_toxic, e.label AS vec_cls FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = d.doc_id",
)
add(
    "s13_shard_counts",
    lambda v: v("fx_shards").withColumn("good", F.col("payload") > 150000.5).rollup("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("n_good"), F.grouping("shard").cast("long").alias("total")),
    "SELECT shard, COUNT(*) AS n, SUM(CASE WHEN payload > 150000.5 THEN 1 ELSE 0 END)::BIGINT AS n_good, GROUPING(shard)::BIGINT AS total FROM fx_shards GROUP BY ROLLUP (shard)",
)
add("p1_filter_by_flags", lambda v: tb.filter_by_flags(v("fx_flags"), ["has_sharp"], ["has_smell_a", "has_smell_b"]), "SELECT * FROM fx_flags WHERE has_sharp AND NOT has_smell_a AND NOT has_smell_b")
add("p2_filter_by_ids", lambda v: tb.filter_by_ids(v("documents").select("doc_id", "lang"), v("labels").where("quality = 1"), "doc_id"), "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
add("p5_select_shapes", lambda v: tb.select_where(v("part").select("p_partkey", "p_size", "p_retailprice"), {"p_size": "< 30", "p_retailprice": ">= 1000.005"}), "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size < 30 AND p_retailprice >= 1000.005", "p_retailprice")
add("p6_near_feature", lambda v: v("fx_points").where("distance < 0.05"), "SELECT * FROM fx_points WHERE distance < 0.05", "x", "y", "z", "distance")
add("p7_chain_masks", lambda v: tb.chain_masks(v("fx_pairs"), F.col("true_d") < 0.085, F.col("pred_d") > 0.025, F.col("sample_id") % 2 == 0), "SELECT * FROM fx_pairs WHERE true_d < 0.085 AND pred_d > 0.025 AND sample_id % 2 = 0", "true_d", "pred_d")
add(
    "p8_concat_features",
    lambda v: tb.concat_features(v("fx_points").drop("distance").withColumnsRenamed({"point_id": "vid"}), ["x", "y", "z"], "xyz").select("item_id", "vid", F.size("xyz").cast("long").alias("n"), F.expr("xyz[0] + xyz[1] + xyz[2]").alias("s")),
    "SELECT item_id, point_id AS vid, 3::BIGINT AS n, x + y + z AS s FROM fx_points", "s",
)
add("p9_clamp_scale_sharp", lambda v: v("fx_points").select("point_id", tb.clamp(F.col("x"), -0.1, 0.1).alias("cx"), (F.col("x") * 2.5).alias("sx"), tb.target_sharp(F.col("distance"), 0.05).alias("sharp")),
    "SELECT point_id, GREATEST(LEAST(x, 0.1), -0.1) AS cx, x * 2.5 AS sx, CASE WHEN distance < 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sharp FROM fx_points", "cx", "sx")
add("p10_fill_background", lambda v: v("fx_pixels").select("view_id", "pr", "pc", tb.fill_background(F.col("depth"), F.col("depth") < 20).alias("depth")), "SELECT view_id, pr, pc, CASE WHEN depth < 20 THEN 1.0 ELSE depth END AS depth FROM fx_pixels", "depth")
add(
    "p11_route_config",
    lambda v: v("pages").select("page_id", tb.route(F.col("url"), [("https", "high"), ("1", "med"), ("/", "low")], "none").alias("config")),
    "SELECT page_id, CASE WHEN contains(url, 'https') THEN 'high' WHEN contains(url, '1') THEN 'med' WHEN contains(url, '/') THEN 'low' ELSE 'none' END AS config FROM pages",
)
add("p12_melt_methods", lambda v: tb.melt(v("fx_votes").select("item_id", "vote_id", "global_idx", "px", "py"), ["item_id", "global_idx", "vote_id"], ["px", "py"]),
    "SELECT item_id, global_idx, vote_id, 'px' AS method, px AS value FROM fx_votes UNION ALL SELECT item_id, global_idx, vote_id, 'py' AS method, py AS value FROM fx_votes", "value")
add("j2_missing_items", lambda v: tb.missing_items(v("documents").select("doc_id"), v("labels"), "doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
add("j19_faces_in_set", lambda v: v("fx_faces").join(v("fx_faces").where("fid % 3 = 0").select("v0", "v1", "v2"), ["v0", "v1", "v2"], "left_semi"), "SELECT * FROM fx_faces WHERE (v0, v1, v2) IN (SELECT (v0, v1, v2) FROM fx_faces WHERE fid % 3 = 0)")
add("j20_view_pairs", lambda v: tb.view_pairs(v("fx_votes"), "item_id", "patch_id"), "SELECT DISTINCT a.item_id, a.patch_id AS i, b.patch_id AS j FROM (SELECT DISTINCT item_id, patch_id FROM fx_votes) a JOIN (SELECT DISTINCT item_id, patch_id FROM fx_votes) b USING (item_id)")
add(
    "j24_apply_fixes",
    lambda v: tb.apply_fixes(v("fx_pairs"), v("fx_pairs").where("sample_id % 4 = 0").select("item_id", "sample_id", (F.col("true_d") + 1).alias("pred_d")), ["item_id", "sample_id"], ["pred_d"]),
    "SELECT item_id, sample_id, true_d, CASE WHEN sample_id % 4 = 0 THEN true_d + 1 ELSE pred_d END AS pred_d FROM fx_pairs", "true_d", "pred_d",
)
add(
    "j25_diff_datasets",
    lambda v: tb.diff_datasets(v("fx_pairs").where("sample_id % 7 <> 0"), v("fx_pairs").where("sample_id % 5 <> 0").withColumn("pred_d", F.expr("pred_d + IF(sample_id % 3 = 0, 0.5D, 0D)")), ["item_id", "sample_id"], ["true_d", "pred_d"], 0.1),
    """WITH a AS (SELECT * FROM fx_pairs WHERE sample_id % 7 <> 0), b AS (SELECT * FROM fx_pairs WHERE sample_id % 5 <> 0), one AS (SELECT item_id, sample_id, sample_id % 3 = 0 AS moved, a.true_d IS NULL OR b.true_d IS NULL AS lone FROM a FULL JOIN b USING (item_id, sample_id))
    SELECT item_id, sample_id, 'true_d' AS differs FROM one WHERE lone UNION ALL SELECT item_id, sample_id, 'pred_d' AS differs FROM one WHERE lone OR moved""",
)
add(
    "j10_group_by_index",
    lambda v: tb.gather(v("fx_faces").select("item_id", "fid", F.array("v0", "v1", "v2").alias("idx")), v("fx_points").select("point_id", "x", "distance"), "idx", "point_id").withColumn("pos", F.col("pos").cast("long")),
    "SELECT f.item_id, fid, pos, p.point_id, x, distance FROM (SELECT item_id, fid, 0::BIGINT AS pos, v0 AS point_id FROM fx_faces UNION ALL SELECT item_id, fid, 1, v1 FROM fx_faces UNION ALL SELECT item_id, fid, 2, v2 FROM fx_faces) f JOIN (SELECT point_id, x, distance FROM fx_points) p USING (point_id)",
    "x", "distance",
)
add("j27_match_by_coordinates", lambda v: (lambda sub, p: p.join(sub, ["x", "y", "z"]).select("point_id", "sub_id"))(v("fx_points").where("point_id % 3 = 0").select("x", "y", "z", (F.col("point_id") * 10).alias("sub_id")), v("fx_points")),
    "SELECT p.point_id, s.point_id * 10 AS sub_id FROM fx_points p JOIN fx_points s ON p.x = s.x AND p.y = s.y AND p.z = s.z WHERE s.point_id % 3 = 0")
# windows
add("w3_global_index", lambda v: tb.global_index(v("fx_pixels").select("view_id", "pr", "pc"), [], "view_id", ["pr", "pc"]), "SELECT view_id, pr, pc, ROW_NUMBER() OVER (ORDER BY view_id, pr, pc) - 1 AS global_idx FROM fx_pixels")
add("w4_reindex_dense", lambda v: tb.reindex_dense(v("fx_faces").select("item_id", "fid", "v0"), ["item_id"], "v0"), "SELECT item_id, fid, v0, DENSE_RANK() OVER (PARTITION BY item_id ORDER BY v0) - 1 AS dense FROM fx_faces")
add(
    "w5_locate_in_shards",
    lambda v: tb.locate_in_shards(v("orders").select(F.expr("o_orderkey div 3").alias("ordinal")).distinct(), v("fx_shards").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))),
    """WITH s AS (SELECT shard, n, COALESCE(SUM(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT shard, COUNT(*) AS n FROM fx_shards GROUP BY 1))
    SELECT ordinal, shard, ordinal - start AS place FROM (SELECT DISTINCT o_orderkey // 3 AS ordinal FROM orders) o JOIN s ON ordinal >= start AND ordinal < start + n""",
)
add(
    "w6_best_worst_typical",
    lambda v: tb.best_worst_typical(v("fx_pairs").withColumn("error", F.round(F.abs(F.col("true_d") - F.col("pred_d")), 3)), ["item_id"], "error", "sample_id", 4).select("item_id", "sample_id", "rank", "kind"),
    """SELECT item_id, sample_id, rank, CASE WHEN rank <= 4 THEN 'best' WHEN rank > n - 4 THEN 'worst' ELSE 'typical' END AS kind FROM (SELECT item_id, sample_id, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY ROUND(ABS(true_d - pred_d), 3), sample_id) AS rank, COUNT(*) OVER (PARTITION BY item_id) AS n FROM fx_pairs)
    WHERE rank <= 4 OR rank > n - 4 OR (rank > FLOOR(n / 2) - 2 AND rank <= FLOOR(n / 2) + 2)""",
)
add("w7_split_by_fraction", lambda v: tb.split_by_fraction(v("orders").select("o_orderkey"), ["o_orderkey"], 0.8, 64), "SELECT o_orderkey, o - 0 AS ordinal, CASE WHEN (o // 64) * 64 <= 0.8 * n THEN 'train' ELSE 'val' END AS split FROM (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS o, COUNT(*) OVER () AS n FROM orders)")
add("w13_slices", lambda v: tb.slices(v("orders").select("o_orderkey"), ["o_orderkey"], 4), "SELECT o_orderkey, o AS ordinal, o // GREATEST(1, n // 40) AS slice FROM (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS o, COUNT(*) OVER () AS n FROM orders)")
add(
    "w14_gap_profile",
    lambda v: tb.gap_profile(v("events"), ["event_type"], "ts", "event_id"),
    "SELECT event_type, QUANTILE_CONT(gap, 0.95) AS p95_ms, AVG(gap) AS mean_ms, SUM(gap) / 3.6e6 AS hours FROM (SELECT event_type, (epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id))) / 1000 AS gap FROM events) GROUP BY 1",
    "p95_ms", "mean_ms", "hours",
)
# orders
add("k1_take_closest", lambda v: tb.top_k(v("fx_points").withColumn("d2", F.expr("(x - 0.1) * (x - 0.1) + (y + 0.1) * (y + 0.1) + z * z")), ["item_id"], ["d2", "point_id"], 7).select("item_id", "point_id", "rank"),
    "SELECT * FROM (SELECT item_id, point_id, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY (x - 0.1) * (x - 0.1) + (y + 0.1) * (y + 0.1) + z * z, point_id) AS rank FROM fx_points) WHERE rank <= 7")
add("k2_top_k", lambda v: tb.top_k(v("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3), "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3", "o_totalprice")
add("k3_slice", lambda v: tb.take_slice(v("orders").select("o_orderkey"), ["o_orderkey"], 10, -20, 3), "SELECT o_orderkey, o AS ordinal FROM (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS o, COUNT(*) OVER () AS n FROM orders) WHERE o >= 10 AND o < n - 20 AND (o - 10) % 3 = 0")
add("k4_cap_items", lambda v: tb.cap_items(v("orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 1000), "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 1000")
add(
    "k5_natural_sort",
    lambda v: v("part").select("p_partkey", F.concat(F.lit("test_"), F.col("p_partkey").cast("string"), F.lit(".npy")).alias("name")).withColumn("place", F.array_join(tb.natural_key(F.col("name")), "/")),
    "SELECT p_partkey, 'test_' || p_partkey || '.npy' AS name, 'test_/' || lpad(p_partkey::VARCHAR, 20, '0') || '/.npy' AS place FROM part",
)
add("k6_shuffle", lambda v: tb.numbered(v("orders").select("o_orderkey", tb.shuffle_key(7, "o_orderkey").alias("k")), "k").drop("k"), "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY md5('7|' || o_orderkey)) - 1 AS ordinal FROM orders")
add(
    "k7_block_shuffle",
    lambda v: tb.block_shuffle(v("fx_shards").select("shard", "row_id"), 3, "shard", "row_id", 1, 4),
    "SELECT shard, row_id, o AS ordinal FROM (SELECT shard, row_id, ROW_NUMBER() OVER (ORDER BY md5('3|' || shard), md5('4|' || row_id)) - 1 AS o FROM fx_shards) WHERE o % 4 = 1",
)
_U = "((('0x' || substr(md5('5|' || point_id), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0"
add("k10_weighted_subsample", lambda v: tb.weighted_subsample(v("fx_points"), ["item_id"], 9, 8.0, "distance", ["point_id"], 5).select("item_id", "point_id", "rank"),
    f"SELECT item_id, point_id, rank FROM (SELECT item_id, point_id, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY -LN({_U}) / EXP(-8.0 * distance), point_id) AS rank FROM fx_points) WHERE rank <= 9")
add("k11_subsample", lambda v: v("fx_points").where(tb.uniform(5, "point_id") < 0.3).select("item_id", "point_id"), f"SELECT item_id, point_id FROM fx_points WHERE {_U} < 0.3")
# sets
add("u1_common_ids", lambda v: v("documents").select("doc_id").intersect(v("labels").select("doc_id")).intersect(v("embeddings").select(F.col("vec_id").alias("doc_id"))), "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings")
add("u2_except_ids", lambda v: v("documents").select("doc_id").subtract(v("labels").where("toxic = 0").select("doc_id")), "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE toxic = 0")
add("u3_union_points", lambda v: v("fx_points").select("item_id", "x", "y").unionByName(v("fx_segments").select("item_id", F.col("ax").alias("x"), F.col("ay").alias("y"))), "SELECT item_id, x, y FROM fx_points UNION ALL SELECT item_id, ax AS x, ay AS y FROM fx_segments", "x", "y")
add("u4_unique_rows", lambda v: v("fx_votes").groupBy("px", "py", "pz").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("rows")), "SELECT n, COUNT(*) AS rows FROM (SELECT COUNT(*) AS n FROM fx_votes GROUP BY px, py, pz) GROUP BY n")
