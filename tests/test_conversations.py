"""Conversations longer than an example, read whole."""

from __future__ import annotations

import hashlib

import __spark_entry__ as driver
from glyphmill.operators import bpe as bp
from glyphmill.plans import inputs, registry


def _md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_conversations_are_encoded_to_their_end(spark, tmp_path, monkeypatch):
    """What is said and scored far beyond the first 512 ids counts."""
    rows = [
        (conv, turn, role, f"{role} {turn} says {ending if turn == 899 else 'more'} ")
        for conv, ending in ((1, "this"), (2, "that"))
        for turn, role in ((t, "assistant" if t % 2 else "user") for t in range(900))
    ]
    rows += [(3, 0, "user", None), (3, 1, "assistant", "yes")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    monkeypatch.setattr(inputs, "vocabulary", lambda *_: bp.Bpe(()))
    got = {r["conv_id"]: r for r in registry.QUERIES["conversation_encode"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3}
    for conv, r in got.items():
        said = {
            kind: "".join(text or "" for c, _, role, text in rows if c == conv and (role == "assistant") == kind)
            for kind in (True, False)
        }
        assert r["replies_md5"] == _md5(said[True]) and r["asked_md5"] == _md5(said[False])
    assert got[1]["replies_md5"] != got[2]["replies_md5"]
    assert "conversation_encode" in driver.oracle_sql()
