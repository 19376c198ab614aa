"""Queries of streaming, sources and pipelines (T, S, L, V1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.operators import fusion as fu
from pointweave.operators import mesh as ms
from pointweave.operators import metrics as me
from pointweave.operators import raster as ra
from pointweave.operators import tables as tb
from pointweave.plans.fusion_queries import _SET, _inst
from pointweave.plans.mesh_queries import VOC
from pointweave.plans.registry import add, catalog
from pointweave.sources import fixtures
from pointweave.sources import tables as so
from pointweave.streaming import streams as st


#: Micro-batches that a table is replayed in.
BATCHES = 3


def _stream(name: str, order: str, table: str, build, sql: str, *doubles: str) -> None:
    """Register a query whose builder gets the table as a stream of several micro-batches, by rising ``order``."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        if table == "events":
            rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
        return fixtures.rounded(build(st.replay(rows, order, BATCHES)))

    catalog.queries[name] = query
    catalog.oracles[name] = fixtures.duck(sql, *doubles)


pairs = lambda s: s.select(F.col("l_suppkey").alias("item_id"), F.col("l_discount").alias("true_d"), F.col("l_tax").alias("pred_d"))
_stream("t1_stream_metrics", "l_orderkey", "lineitem", lambda s: me.dataset_summary(st.settle(st.stream_instances(pairs(s), 0.025), key=["item_id"])), f"WITH {_inst(0.025)} SELECT {_SET.format(s='0.0')} FROM inst", "mean_rmse", "q95_rmse", "mean_recall", "mean_fpr")
# append mode: a window is emitted when the watermark, the greatest time less the lateness, has passed its end
_stream("t2_stream_flag_rates", "ts", "events", lambda s: st.settle(st.stream_flag_rates(s.withColumn("flag", F.col("value") > 50.05), "ts", "flag", "1 hour", "1 hour", ["event_type"]), "append"),
        "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, COUNT(*) AS n, AVG(CASE WHEN value > 50.05 THEN 1.0 ELSE 0 END) AS rate FROM events GROUP BY 1, 2 HAVING epoch_us(MIN(time_bucket(INTERVAL 1 HOUR, ts))) + 3600000000 <= (SELECT epoch_ms(MAX(ts)) FROM events) * 1000 - 3600000000", "rate")
_stream("t3_stream_fusion", "l_orderkey", "lineitem", lambda s: st.settle(st.stream_fusion(s.select("l_partkey", (F.col("l_discount") * 10).alias("value")), ["l_partkey"]), key=["l_partkey"]), "SELECT l_partkey, MIN(l_discount * 10) AS low, AVG(l_discount * 10) AS mean, COUNT(*) AS n FROM lineitem GROUP BY 1", "low", "mean")
_stream("t4_stream_apply_fixes", "ts", "events", lambda s: st.stream_apply_fixes(s.select("user_id", "event_id", "value", "ts"), ["user_id"], "ts", "event_id", "1 day").select("user_id", "event_id", "value"), "SELECT user_id, MAX(event_id) AS event_id, ARG_MAX(value, event_id) AS value FROM events GROUP BY 1", "value")
_stream("t5_stream_gap_sessions", "ts", "events", lambda s: st.settle(st.stream_gap_sessions(s, "ts", "6 hours", "1 day", ["user_id"]), "append"),
        "WITH g AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), n AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(MIN(ts)) AS start, COUNT(*) AS n FROM n GROUP BY user_id, k HAVING epoch_us(MAX(ts)) + 21600000000 <= (SELECT epoch_ms(MAX(ts)) FROM events) * 1000 - 86400000000")
_stream("t6_stream_shards", "o_orderkey", "orders", lambda s: st.stream_shards(s.select("o_orderkey", "o_totalprice"), 300).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")).agg(F.sum("n").alias("rows"), F.sum("keys").alias("keys"), (F.max("n") <= 300).alias("bounded"), (F.count(F.lit(1)) >= BATCHES).alias("several")),
        "SELECT COUNT(*) AS rows, SUM(o_orderkey)::BIGINT AS keys, TRUE AS bounded, TRUE AS several FROM orders")

# sources and sinks
_LINE = "concat_ws(' ', cast(p_partkey AS string), concat('shape_', cast(p_partkey AS string)), concat('size=', cast(p_size AS string)), concat('half=', cast(p_partkey * 2 AS string)))"
add("s7_parse_stat_lines", lambda v: so.parse_stat_lines(v("part").select(F.expr(_LINE).alias("line"))), "SELECT p_partkey AS idx, 'shape_' || p_partkey AS item_id, 'size' AS key, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'shape_' || p_partkey, 'half', (p_partkey * 2)::DOUBLE FROM part")
_MESH = "concat(array_join(transform(vs, p -> concat('v ', cast(p.x AS string), ' ', cast(p.y AS string), ' ', cast(p.z AS string))), '\n'), '\nvn 0 0 1\n', array_join(transform(sequence(1, size(vs) - 2), i -> concat('f ', i, '//1 ', i + 1, '//1 ', i + 2, '//1')), '\n'))"


def _mesh(v):
    vs = v("fx_points").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("point_id", "x", "y", "z"))).alias("vs"))
    return so.mesh_text_to_tables(vs.select("item_id", F.expr(_MESH).alias("text")))


add("s4_mesh_text_vertices", lambda v: _mesh(v)[0], "SELECT item_id, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY point_id) - 1 AS vid, x, y, z FROM fx_points", "x", "y", "z")
add("s4_mesh_text_faces", lambda v: _mesh(v)[1], "SELECT item_id, fid, fid AS v0, fid + 1 AS v1, fid + 2 AS v2 FROM fx_faces")


def _json(v):
    c = v("fx_curve_verts").groupBy("item_id", "curve_id").agg(F.array_sort(F.collect_list("vid")).alias("vert_indices")).join(v("fx_curves"), ["item_id", "curve_id"])
    blob = c.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("curve_id", "type", "sharp", "vert_indices"))).alias("curves"))
    return so.features_from_json(blob.select("item_id", F.to_json(F.struct("curves", F.array().cast("array<struct<type:string,face_indices:array<bigint>,vert_indices:array<bigint>>>").alias("surfaces"))).alias("json")))[0]


add("s5_features_from_json", lambda v: _json(v).select("item_id", "curve_id", "type", "sharp", F.size("vert_indices").cast("long").alias("n")), "SELECT item_id, curve_id, type, sharp, n FROM fx_curves JOIN (SELECT item_id, curve_id, COUNT(*) AS n FROM fx_curve_verts GROUP BY 1, 2) USING (item_id, curve_id)")
add("s2_read_many", lambda v: (lambda d: so.through(d, "many", lambda x, p: x.write.parquet(p), lambda p: so.read_many(d.sparkSession, p, d.schema).drop("shard_file")))(v("fx_shards")), "SELECT * FROM fx_shards", "payload")


def _with_broken(v):
    """Shards beside a file that is no Parquet: what is read, and how many files are not."""
    d = v("fx_shards")

    def write(df, path):
        df.write.parquet(path)
        df.limit(1).select(F.lit("no parquet").alias("value")).write.mode("append").text(path)

    def read(path):
        skipped = so.unread_files(d.sparkSession, path, d.schema).agg(F.count(F.lit(1)).alias("skipped"))
        return so.read_many(d.sparkSession, path, d.schema).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("row_id").alias("ids")).join(F.broadcast(skipped))

    return so.through(d, "broken", write, read)


add("s2_skip_unreadable", _with_broken, "SELECT COUNT(*) AS rows, COUNT(DISTINCT row_id) AS ids, 1::BIGINT AS skipped FROM fx_shards")
add("s8_write_shards", lambda v: (lambda d: so.through(d, "shards", lambda x, p: so.write_shards(x, p, 512), lambda p: so.read_many(d.sparkSession, p, d.schema).groupBy("shard_file").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), (F.max("n") <= 512).alias("bounded"))))(v("fx_shards")), "SELECT COUNT(*) AS rows, TRUE AS bounded FROM fx_shards")
add("s9_write_ordered_shards", lambda v: (lambda d: so.through(d, "ordered", lambda x, p: so.write_ordered_shards(x, p, "row_id", 8), lambda p: (lambda f: f.withColumn("next", F.lead("low").over(__import__("pyspark").sql.Window.orderBy("low"))).agg(F.sum("n").alias("rows"), F.bool_and(F.coalesce(F.col("high") < F.col("next"), F.lit(True))).alias("apart")))(so.read_many(d.sparkSession, p, d.schema).groupBy("shard_file").agg(F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.count(F.lit(1)).alias("n")))))(v("fx_shards")), "SELECT COUNT(*) AS rows, TRUE AS apart FROM fx_shards")
add("s11_append_metrics_csv", lambda v: (lambda d: so.through(d, "csv", lambda x, p: (so.append_metrics_csv(x.where("item_id % 2 = 0"), p), so.append_metrics_csv(x.where("item_id % 2 = 1"), p)), lambda p: d.sparkSession.read.schema(d.schema).option("header", "true").csv(p)))(me.rmse(v("fx_pairs"), ["item_id"])), "SELECT item_id, SQRT(AVG((true_d - pred_d) * (true_d - pred_d))) AS rmse FROM fx_pairs GROUP BY 1", "rmse")
add("s12_split_by_item", lambda v: (lambda d: so.through(d, "items", so.split_by_item).withColumn("item_id", F.col("item_id").cast("long")))(v("fx_points")), "SELECT * FROM fx_points", "x", "y", "z", "distance")


def _numbered(v, read):
    """Each item's distances as a text of its own named ``test_<item>``, read back by ``read``."""
    rows = v("fx_points").select(F.concat(F.lit("test_"), F.col("item_id").cast("string")).alias("part"), F.col("distance").cast("string").alias("value"), "point_id")

    def write(df, path):
        df.repartition("part").sortWithinPartitions("part", "point_id").drop("point_id").write.partitionBy("part").text(path)

    return so.through(rows, "numbered", write, lambda p: read(rows.sparkSession, p))


add("s6_numbered_files", lambda v: _numbered(v, so.predictions_from_numbered_files), "SELECT item_id AS patch_id, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY point_id) - 1 AS point_pos, distance AS value FROM fx_points", "value")
add("s12_merge_numbered_vectors", lambda v: _numbered(v, so.merge_numbered_vectors).select("number", F.size("vector").cast("long").alias("n"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"), F.element_at("vector", 2).alias("second")),
    "SELECT item_id AS number, COUNT(*) AS n, SUM(distance) AS total, MAX(CASE WHEN nth = 2 THEN distance END) AS second FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY point_id) AS nth FROM fx_points) GROUP BY 1", "total", "second")
# pipelines
add("l1_profile_and_select", lambda v: tb.select_where(ms.type_counts(v("fx_curves"), v("fx_curves").where("sharp"), VOC, "sharp"), {"sharp_ellipse": "< 2", "sharp_line": "> 0"}).select("item_id", "sharp_line", "sharp_ellipse"),
    "SELECT * FROM (SELECT item_id, COUNT(*) FILTER (sharp AND type = 'Line') AS sharp_line, COUNT(*) FILTER (sharp AND type = 'Ellipse') AS sharp_ellipse FROM fx_curves GROUP BY 1) WHERE sharp_ellipse < 2 AND sharp_line > 0")


def _training(v):
    kept = tb.filter_by_flags(v("fx_flags"), ["has_sharp"], ["has_smell_a"])
    mixed = tb.numbered(kept.select("patch_id", tb.shuffle_key(7, "patch_id").alias("k")), "k", name="place")
    split = tb.split_by_fraction(mixed.drop("k"), ["place"], 0.8, 64)
    return split.where("place < 2000").select("patch_id", "place", "split")


add("l2_prepare_training_set", _training, "SELECT patch_id, o AS place, CASE WHEN (o // 64) * 64 <= 0.8 * n THEN 'train' ELSE 'val' END AS split FROM (SELECT patch_id, ROW_NUMBER() OVER (ORDER BY md5('7|' || patch_id)) - 1 AS o, COUNT(*) OVER () AS n FROM fx_flags WHERE has_sharp AND NOT has_smell_a) WHERE o < 2000")
add("l5_fuse_views", lambda v: ra.z_buffer(v("fx_pixel_hits")).groupBy("pr", "pc").agg(F.min("depth").alias("fused"), F.count(F.lit(1)).alias("n_views")), "SELECT pr, pc, MIN(depth) AS fused, COUNT(*) AS n_views FROM fx_pixels GROUP BY 1, 2", "fused")
add("l13_check_shapes", lambda v: (lambda m, s: m.join(s, "item_id").select("item_id", F.ceil(F.col("area") * F.col("first") * F.col("first") / 0.05).alias("n_samples")).withColumn("passes", F.col("n_samples") < 1000000))(
    __import__("pointweave.plans.geometry_queries", fromlist=["measured"]).measured(v).groupBy("item_id").agg(F.sum("area").alias("area")), v("fx_points").groupBy("item_id").agg((10.0 / F.greatest(*(F.max(c) - F.min(c) for c in "xyz"))).alias("first"))),
    __import__("pointweave.plans.geometry_queries", fromlist=["_TRI"])._TRI + " SELECT item_id, CEIL(SUM(area) * (10 / box) * (10 / box) / 0.05)::BIGINT AS n_samples, CEIL(SUM(area) * (10 / box) * (10 / box) / 0.05) < 1000000 AS passes FROM tri JOIN (SELECT item_id, GREATEST(MAX(x) - MIN(x), MAX(y) - MIN(y), MAX(z) - MIN(z)) AS box FROM fx_points GROUP BY 1) USING (item_id) GROUP BY item_id, box")

#: Combiners and filters by name, as configurations choose them.
COMBINERS = {"min": lambda d, **k: fu.combine(d, "min", **k), "mean": lambda d, **k: fu.combine(d, "mean", **k), "median": lambda d, **k: fu.combine(d, "median", **k), "vote": fu.combine_vote, "trimmed": fu.combine_trimmed, "mean_of_mins": fu.combine_mean_of_mins}


def combiner(config: dict):
    """The combiner that ``config['type']`` names, with the rest as arguments."""
    rest = {k: x for k, x in config.items() if k != "type"}
    return lambda df: COMBINERS[config["type"]](df, **rest)


add("v1_combiner_from_config", lambda v: v("fx_votes").transform(combiner({"type": "vote", "threshold": 0.4875})), "SELECT item_id, global_idx, CASE WHEN AVG(value) > 0.4875 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS distance FROM fx_votes GROUP BY 1, 2")
