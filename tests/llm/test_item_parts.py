"""Items in several index parts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rankwell.llm import decontam


@pytest.mark.parametrize("size", [64, 2 << 20])
def test_texts_of_an_item_stay_together(spark, monkeypatch, size):
    monkeypatch.setattr(decontam, "INDEX_BYTES", size)
    texts = [" ".join(f"t{k}w{i}" for i in range(12)) for k in range(6)]
    items = spark.createDataFrame([(1, t, "") for t in texts], "item_id long, q string, a string")
    docs = spark.createDataFrame([(5, " and then ".join(texts))], "doc_id long, text string")
    got = decontam.contaminated(docs, items, F.col("q"), F.col("a")).collect()
    assert [(r.doc_id, r.item_id, r.overlap) for r in got] == [(5, 1, 1.0)]
