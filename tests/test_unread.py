"""Files that a folder's reader skips."""

from pointweave.sources import tables as so


def test_an_empty_table_is_not_unreadable(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = spark.range(20).selectExpr("id AS row_id")
    rows.repartition(3).write.parquet(path)
    rows.where("row_id < 0").write.mode("append").parquet(path)  # a file without rows
    assert so.unread_files(spark, path, rows.schema).count() == 0
    spark.createDataFrame([("no parquet",)], "value string").coalesce(1).write.mode("append").text(path)
    assert [r["shard_file"].endswith(".txt") for r in so.unread_files(spark, path, rows.schema).collect()] == [True]
    assert so.read_many(spark, path, rows.schema).count() == 20
