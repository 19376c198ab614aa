"""Lookups with hot keys, and tables that are deleted once used up."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import tables as tb
from pointweave.sources.durable import durable, release


def test_hot_and_rare_keys_find_their_values(spark, monkeypatch):
    monkeypatch.setattr(tb, "HOT", 4)
    rows = [(k, i) for i, k in enumerate([1] * 50 + [2] * 30 + list(range(3, 23)) + [None] * 5)]
    df = spark.createDataFrame(rows, "key long, row long")
    found = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("high")).where("key is not null and key <> 7")
    out = tb.looked_up(df, found, "key", "n", df.count()).collect()
    high = {}
    for k, i in rows:
        high[k] = i
    assert sorted((r["row"], r["high"]) for r in out if r["high"] is not None) == [(i, high[k]) for k, i in rows if k not in (None, 7)]
    assert len(out) == len(rows)


def test_quantiles_are_exact_however_large_the_group(spark):
    rng = np.random.default_rng(9)
    groups = {0: rng.normal(size=5000), 1: rng.integers(0, 3, 4000).astype(float), 2: np.array([7.0]), 3: np.r_[np.zeros(3000), 1e6], 4: rng.normal(size=30)}
    df = spark.createDataFrame([(g, float(x)) for g, own in groups.items() for x in own] + [(1, None)], "g long, x double").repartition(4)
    for q in (0.0, 0.05, 0.5, 0.95, 0.999, 1.0):
        # brackets of a tenth of the usual accuracy, so that large groups need them
        out = {r["g"]: r["q"] for r in tb.quantile(df, ["g"], "x", q, accuracy=300).collect()}
        assert out == pytest.approx({g: float(np.quantile(own, q)) for g, own in groups.items()})
    assert tb.quantile(df, [], "x", 0.25, accuracy=300).first()["q"] == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.25))


def test_released_tables_are_gone(spark):
    first = durable(spark.range(10), "first")
    second = durable(first.where("id > 3"), "second")
    path = first._durable_path
    assert os.path.isdir(path)
    release(first, spark.range(3))
    assert not os.path.exists(path) and second.count() == 6
