"""Packing holds short runs of texts at a time."""

import pyarrow as pa

from glyphmill.llm import slackpack


def test_runs_of_texts_stay_under_a_megabyte():
    texts = pa.array(["word " * 40_000] * 20 + [None, ""])
    runs = list(slackpack._slices(texts))
    assert [i for a, b in runs for i in range(a, b)] == list(range(len(texts)))
    assert all(sum(len(t or "") for t in texts.slice(a, b - a).to_pylist()) <= 1 << 20 for a, b in runs)
