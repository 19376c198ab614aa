"""Keyed tables that streams keep up to date: what they hold, what stays on disk, and restarts."""

import os
import random

from pyspark.sql import functions as F

from pointweave.streaming import streams as st

SCHEMA = "id long, value long"


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_folds_keep_the_last_row_of_each_key(spark, tmp_path):
    rng = random.Random(4)
    path, want = f"{tmp_path}/t", {}
    df = spark.createDataFrame([], SCHEMA)
    for number in range(24):
        rows = [(k, rng.randrange(1000)) for k in rng.sample(range(400), 300 if number == 0 else 20)]
        st.KeyedTable(spark, path, df.schema, ["id"]).fold(spark.createDataFrame(rows, SCHEMA).coalesce(1), number)
        want |= dict(rows)
        parts = st.KeyedTable(spark, path, df.schema, ["id"]).parts()
        assert len(parts) <= st.KeyedTable.MOST and sum(n for _, n in parts) <= 1.5 * len(want) + 20
        if number == 10:  # the same batch once more, as after a failure
            st.KeyedTable(spark, path, df.schema, ["id"]).fold(spark.createDataFrame(rows, SCHEMA).coalesce(1), number)
    assert {r.id: r.value for r in st.KeyedTable(spark, path, df.schema, ["id"]).read().collect()} == want
    # two manifests, and the folders that they name
    assert len(os.listdir(f"{path}/manifest")) == 2 and len(os.listdir(f"{path}/data")) <= 2 * st.KeyedTable.MOST


def test_aggregation_in_update_mode_goes_on_after_a_restart(spark, tmp_path):
    source, sink = f"{tmp_path}/in", f"{tmp_path}/sink"
    total = {}

    def more(n):
        for i in range(n):
            rows = [(k % 50, k) for k in range(i, i + 30)]
            for k, v in rows:
                low, count = total.get(k, (v, 0))
                total[k] = min(low, v), count + 1
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        return st.settle(stream.groupBy("id").agg(F.min("value").alias("low"), F.count(F.lit(1)).alias("n")), key=["id"], path=sink)

    for n in (3, 2):
        assert {r.id: (r.low, r.n) for r in more(n).collect()} == total
    assert size(f"{sink}/out") < 60_000
