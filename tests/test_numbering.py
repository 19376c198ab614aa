"""Numbers of rows in a total order, where one value or one group fills a third of the rows."""

from pyspark.sql import functions as F

from pointweave.operators import tables as tb


def test_a_hot_value_is_dealt_to_many_tasks(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(None).cast("long")).otherwise(F.col("id") % 7).alias("v"), "id")
    got = tb.numbered(rows, "v")
    assert sorted(r[0] for r in got.select("ordinal").collect()) == list(range(30_000))
    # nulls first, then by value
    ordered = [r[0] for r in got.orderBy("ordinal").select("v").collect()]
    assert ordered[:10_000] == [None] * 10_000 and ordered[10_000:] == sorted(ordered[10_000:])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan or "row_number" not in plan


def test_numbers_of_groups_with_null_names(spark):
    rows = [(None, 3), (None, 1), ("a", 5), ("a", 5), ("b", 2), (None, None)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = sorted((r.g or "", r.v if r.v is not None else -1, r.ordinal) for r in tb.numbered(df, "v", by=["g"]).collect())
    assert got == [("", -1, 0), ("", 1, 1), ("", 3, 2), ("a", 5, 0), ("a", 5, 1), ("b", 2, 0)]


def test_empty_table(spark):
    assert tb.numbered(spark.range(0), "id").count() == 0


def test_gaps_meet_the_event_before(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:02", 2), ("a", "2024-01-01 00:00:05", 3), ("b", "2024-01-01 00:00:00", 4)], "g string, ts string, id int")
    got = {r.g: r for r in tb.gap_profile(df, ["g"], "ts", "id").collect()}
    assert got["a"].mean_ms == 2500 and abs(got["a"].p95_ms - 2950) < 1e-6 and got["b"].p95_ms is None
