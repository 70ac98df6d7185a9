"""Runs of texts keep to the size they are given and lose no text."""

from __future__ import annotations

import pyarrow as pa

from glyphmill.llm import jaccard
from glyphmill.llm.common import BATCH_BYTES
from glyphmill.llm.flattext import slices


def test_slices_keep_to_the_given_size():
    texts = pa.array(["x" * n for n in (10, 700, 700, 5, 3000, 1)] + [None, ""])
    runs = list(slices(texts, 1000))
    assert [t for _, run in runs for t in run.to_pylist()] == texts.to_pylist()
    assert [at for at, _ in runs] == [0, 2, 4, 5]
    assert all(len(run) == 1 or sum(map(len, filter(None, run.to_pylist()))) <= 1000 for _, run in runs)


def test_jaccard_join_takes_small_batches(spark):
    before = spark.conf.get(BATCH_BYTES)
    try:
        docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, None)], "doc_id long, text string")
        rows = {tuple(r) for r in jaccard.near_duplicates(docs).collect()}
        assert rows == {(1, 2, 1), (2, 2, 1), (3, 0, 3)}
        assert int(spark.conf.get(BATCH_BYTES)) <= 4 << 20
    finally:
        spark.conf.set(BATCH_BYTES, before)
