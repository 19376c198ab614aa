"""Replayed micro-batches of several files."""

import glob
import os
from collections import Counter

from pointweave.streaming import streams as st


def test_batches_have_as_many_files_and_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(st, "FILE_ROWS", 10)
    for rows, order in (([(i, i) for i in range(90)], 3), ([(0, i) for i in range(90)], 1)):
        df = spark.createDataFrame(rows, "k long, v long")
        seen = {}

        def keep(batch, number):
            seen[number] = batch.select("k", "v").collect()

        st._run(st.replay(df, "k", 3), f"{st.shared_dir(spark)}/replayed-{order}", "append", keep)
        assert sorted((r["k"], r["v"]) for got in seen.values() for r in got) == rows
        batches = [[r["k"] for r in seen[n]] for n in sorted(seen)]
        assert len(batches) == 3 and all(max(a) <= min(b) for a, b in zip(batches, batches[1:]) if a and b)
    counts = Counter(os.path.dirname(f) for f in glob.glob(f"{st.shared_dir(spark)}/replay-*/part-*"))
    assert list(counts.values()) == [9, 9]
