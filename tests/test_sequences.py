"""Packing, batching, masking and padding."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import bytelevel as bl
from glyphmill.operators import bpe as bp
from glyphmill.operators import instruct, packing

TOKENS = "doc_id long, split string, ids array<int>"


def in_order(spark, docs, seed=packing.DOC_SEED):
    """All tokens of the documents in the packing order of their split."""
    from glyphmill.functions import draw

    h = draw.digest(seed, F.col("doc_id"), "order")
    rows = spark.createDataFrame(docs, TOKENS).orderBy("split", h, "doc_id").collect()
    streams = {}
    for r in rows:
        streams.setdefault(r["split"], []).extend(r["ids"])
    return streams


def expected(streams, length):
    return {
        (split, b): s[b * length : (b + 1) * length + 1]
        for split, s in streams.items()
        for b in range((len(s) - 1) // length)
    }


def packed(spark, docs, length, **kw):
    df = spark.createDataFrame(docs, TOKENS).repartition(3)
    return {(r["split"], r["block_id"]): r["tokens"] for r in packing.pack_blocks(df, length, **kw).collect()}


def test_nine_tokens_make_two_overlapping_blocks(spark):
    docs = [(1, "train", [1, 2, 3, 0]), (2, "train", [4, 5, 0]), (3, "train", [6, 0])]
    blocks = packed(spark, docs, 4)
    stream = in_order(spark, docs)["train"]
    assert blocks == {("train", 0): stream[:5], ("train", 1): stream[4:9]}


def test_eight_tokens_make_one_block(spark):
    assert len(packed(spark, [(1, "train", list(range(8)))], 4)) == 1


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 4))
def test_blocks_equal_a_plain_concatenation(spark, seed, length, digits):
    rng = random.Random(seed)
    docs = [
        (i, rng.choice(["train", "train", "val"]), [rng.randrange(99) for _ in range(rng.randrange(0, 25))])
        for i in range(40)
    ]
    assert packed(spark, docs, length, digits=digits) == expected(in_order(spark, docs), length)


def test_one_document_with_a_third_of_all_tokens(spark):
    docs = [(i, "train", [i] * 20) for i in range(100)] + [(999, "train", [7] * 1000)]
    assert packed(spark, docs, 16) == expected(in_order(spark, docs), 16)


def test_next_token_pairs_shift_by_one(spark):
    blocks = spark.createDataFrame([("train", 0, [1, 2, 3, 4, 5])], "split string, block_id long, tokens array<int>")
    row = packing.next_token_pairs(blocks, 4).first()
    assert (row["x"], row["y"]) == ([1, 2, 3, 4], [2, 3, 4, 5])


def test_epoch_batches(spark):
    rows = [("train", i, [0]) for i in range(37)] + [("val", i, [0]) for i in range(9)]
    blocks = spark.createDataFrame(rows, "split string, block_id long, tokens array<int>")
    first = packing.epoch_batches(blocks, batch=4, epoch=0).collect()
    second = packing.epoch_batches(blocks, batch=4, epoch=1).collect()

    def place(rows, split):
        return {(r["batch_id"], r["row"]): r["block_id"] for r in rows if r["split"] == split}

    assert sorted(place(first, "train")) == [(b, r) for b in range(9) for r in range(4)]
    assert place(first, "train") != place(second, "train")
    assert place(first, "val") == {(b, r): b * 4 + r for b in range(2) for r in range(4)}
    assert packing.epoch_batches(blocks, batch=4, drop_last=False).count() == 46


def test_document_split_share_and_stability(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    a = packing.split_docs(docs).filter("split = 'val'")
    b = packing.split_docs(docs.repartition(13)).filter("split = 'val'")
    assert 800 < a.count() < 1200
    assert a.exceptAll(b).count() == 0


def test_pair_framing(spark):
    df = spark.createDataFrame([([11, 12], [21, 22])], "p_ids array<int>, m_ids array<int>")
    row = instruct.frame_pairs(df).first()
    assert row["x"] == [bl.DIAGRAM, 11, 12, bl.PROMPT, 21, 22]
    assert row["y"] == [-1, -1, -1, 21, 22, bl.EOT]


@pytest.mark.parametrize("max_len", [2, 3, 4, 5, 6, 7, 50])
def test_cut_comes_before_the_shift(spark, max_len):
    p, m = [11, 12], [21, 22]
    df = spark.createDataFrame([(p, m)], "p_ids array<int>, m_ids array<int>")
    full = [bl.DIAGRAM, *p, bl.PROMPT, *m, bl.EOT][:max_len]
    y = full[1:]
    y[: len(p) + 1] = [-1] * len(y[: len(p) + 1])
    row = instruct.frame_pairs(df, max_len).first()
    assert (row["x"], row["y"], row["n"]) == (full[:-1], y, len(y))


def test_padding_to_the_batch_maximum(spark):
    rows = [(0, 1, [5, 6], [-1, 6], 2), (1, 1, [5, 6, 7, 8], [-1, 6, 7, 8], 4), (2, 2, [9], [9], 1)]
    df = spark.createDataFrame(rows, "pair_id long, batch_id long, x array<int>, y array<int>, n long")
    got = {r["pair_id"]: r for r in instruct.pad_batches(df).collect()}
    assert got[0]["x"] == [5, 6, 0, 0] and got[0]["y"] == [-1, 6, -1, -1]
    assert got[1]["x"] == [5, 6, 7, 8] and got[2]["x"] == [9]


def test_padding_report(spark):
    df = spark.createDataFrame([(0, 2), (0, 4), (1, 1)], "batch_id long, n long")
    row = instruct.padding_report(df, fixed=10).first()
    assert (row["used_cells"], row["dynamic_cells"], row["fixed_cells"]) == (7, 9, 30)
    assert row["saved_share"] == 0.7


def chat(spark, turns, max_len):
    bpe = bp.Bpe(())
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    return {r["conv_id"]: r for r in instruct.encode_conversations(df, bpe, max_len).collect()}


def plain_chat(turns, max_len):
    first = [bl.FIRST_BYTE + o for o in bl.byte_offsets()]
    ids, flags = [], []
    for _, _, role, text in sorted(turns):
        body = [first[b] for b in text.encode()]
        scored = role == "assistant"
        ids += [bl.RESPONSE if scored else bl.PROMPT, *body, bl.EOT]
        flags += [False] + [scored] * (len(body) + 1)
    ids, flags = ids[:max_len], flags[:max_len]
    return ids[:-1], [i if f else -1 for i, f in zip(ids[1:], flags[1:])]


def test_conversations_score_the_assistant_only(spark):
    turns = [(1, 0, "system", "Be kind"), (1, 1, "user", "Hi"), (1, 2, "assistant", "Yes"), (2, 0, "user", "Only me")]
    got = chat(spark, turns, 512)
    for conv in (1, 2):
        mine = [t for t in turns if t[0] == conv]
        assert (got[conv]["x"], got[conv]["y"]) == plain_chat(mine, 512)


def test_conversation_with_a_third_of_all_turns(spark):
    rng = random.Random(1)
    roles = ["user", "assistant"]
    hot = [(7, t, roles[t % 2], "w" * rng.randrange(0, 3)) for t in range(3000)]
    rest = [(100 + t // 4, t % 4, roles[t % 2], "abc") for t in range(6000)]
    got = chat(spark, hot + rest, 64)
    assert len(got) == 1501
    assert (got[7]["x"], got[7]["y"]) == plain_chat(hot, 64)


def test_long_conversations_are_trimmed_before_the_shuffle(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plan = instruct.encode_conversations(turns, bp.Bpe(()))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_a_null_turn_is_an_empty_one(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", None), (1, 3, "assistant", "ok")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rules = bp.Bpe(())
    got, same = (
        instruct.encode_conversations(d, rules).first() for d in (df, df.withColumn("text", F.coalesce("text", F.lit(""))))
    )
    assert got["x"] == same["x"] and got["y"] == same["y"]
    assert got["n"] == len(got["x"]) == len(got["y"]) == 11


def test_a_null_document_is_a_lone_end_mark(spark):
    df = spark.createDataFrame([(0, "train", [5]), (1, "train", None)], TOKENS)
    assert [r["ids"] for r in packing.with_eot(df).orderBy("doc_id").collect()] == [[5, bl.EOT], [bl.EOT]]


@pytest.mark.parametrize("length", [1, 2, 3, 7, 50])
def test_unpacking_gives_back_every_document(spark, length):
    docs = [[11, 12, 13], [], [14], [15] * 20, [16, 17], [], [18]]
    rows = [(i, ["train", "val"][i % 3 == 0], ids + [packing.EOT]) for i, ids in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, split string, ids array<int>")
    back = packing.unpack_blocks(packing.pack_blocks(df, length, keep_tail=True), length).collect()
    assert sorted((r["split"], r["ids"]) for r in back) == sorted((s, ids[:-1]) for _, s, ids in rows)
    cut = packing.unpack_blocks(packing.pack_blocks(df, length), length).collect()
    whole = Counter((r["split"], tuple(r["ids"])) for r in back)
    assert not Counter((r["split"], tuple(r["ids"])) for r in cut) - whole
