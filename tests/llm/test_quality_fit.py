"""The fit of operator 5 over chunks of all labelled documents."""

import numpy as np
import pytest

from pointweave.llm import quality
from pointweave.llm.common import held_out


def test_every_label_counts_however_many_chunks(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(quality, "CHUNK", 1 << 20)
    whole = quality.train(docs, labels)
    known = docs.join(labels.where("quality in (0, 1)"), "doc_id").where(~held_out()).select("doc_id", "quality", "text").collect()
    data = [r["text"].encode() if r["text"] else b"" for r in known]
    x, label = quality.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])), np.array([r["quality"] for r in known])
    order = np.lexsort((*x.T[:-1], x.T[-1], label))
    plain = quality.fit(x[order], label[order], (label == 0).mean())
    assert whole.mean == pytest.approx(x.mean(0)) and whole.scale == pytest.approx(x.std(0) + 1e-9)
    assert whole.weights == pytest.approx(plain.weights, rel=1e-3, abs=1e-3)
    # one chunk of each label is the plain fit; small chunks give other pairs, but mean, scale and the share below the threshold are of all
    monkeypatch.setattr(quality, "CHUNK", 7)
    many = quality.train(docs, labels)
    assert many.mean == pytest.approx(whole.mean) and many.scale == pytest.approx(whole.scale)
    for merit in (whole, many):
        assert (merit.merits(x) < merit.threshold).mean() == pytest.approx((label == 0).mean(), abs=1.5 / len(x))
