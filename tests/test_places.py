"""Documents and blocks find their places without being moved; every text is encoded once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import bytelevel as bl
from glyphmill.operators import bpe as bp
from glyphmill.operators import packing
from glyphmill.plans import sizing
from glyphmill.session import work_path, written
from glyphmill.sources import tokenfile as tf

SCHEMA = "doc_id bigint, split string, ids array<int>"


@pytest.fixture(scope="module")
def tokens(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["train", "val"]), [rng.randrange(4, 9000) for _ in range(rng.randint(0, 90))] + [3]) for i in range(400)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def counted(spark, tokens):
    """``tokens`` whose ids are made by a function, and how often it was called."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def made(ids):
        calls.add(1)
        return ids

    return tokens.withColumn("ids", made("ids")), calls


def test_a_token_file_encodes_every_document_once(spark, tokens):
    source, calls = counted(spark, tokens)
    path = work_path(spark, "counted")
    tf.write_token_file(source, path)
    assert calls.value == tokens.count()
    want = {(r["split"], r["block_id"]): r["tokens"] for r in packing.pack_blocks(tokens, 16, keep_tail=True).collect()}
    assert {(r["split"], r["block_id"]): r["tokens"] for r in tf.read_token_file(spark, path, 16).collect()} == want


def test_places_are_those_of_moved_documents(spark, tokens, monkeypatch):
    found = {r["doc_id"]: (r["st"], r["total"], r["ids"]) for r in packing.place(tokens).collect()}
    monkeypatch.setattr(sizing, "LOOKED_UP_ROWS", 10)
    moved = {r["doc_id"]: (r["st"], r["total"], r["ids"]) for r in packing.place(tokens).collect()}
    assert found == moved and len(found) == 400


def test_ids_are_not_shuffled_to_be_placed(spark, tokens):
    table = written(tokens.withColumn("n", F.size("ids")), "tokens")
    placed = packing.place(table).select("st", "ids")
    plan = placed._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    wide = [line for line in plan.splitlines() if "Window" in line and "ids" in line]
    assert not wide and "Exchange hashpartitioning(split" not in plan.split("BroadcastExchange")[0], exchanges


def test_documents_of_one_key_keep_all_their_ids(spark):
    rows = [(1, "train", [9, 9, 3]), (1, "train", [8, 3]), (2, "train", [7, 3]), (1, "val", [6, 3])]
    df = spark.createDataFrame(rows, SCHEMA)
    key = F.col("doc_id")
    assert sizing.looked_up_total(df, ["split"], F.lit("0"), key, F.size("ids"), "st", "total") is None
    blocks = packing.pack_blocks(df, 4, keep_tail=True)
    back = packing.unpack_blocks(blocks, 4).collect()
    assert sorted((r["split"], r["ids"]) for r in back) == sorted((s, ids[:-1]) for _, s, ids in rows)


@pytest.mark.parametrize("most", [4_000_000, 3])
def test_documents_come_back_by_either_way(spark, tokens, monkeypatch, most):
    monkeypatch.setattr(sizing, "LOOKED_UP_ROWS", most)
    blocks = packing.pack_blocks(tokens, 16, keep_tail=True, id_type="smallint")
    back = packing.unpack_blocks(blocks, 16, id_type="smallint").collect()
    assert sorted((r["split"], r["ids"]) for r in back) == sorted((r["split"], r["ids"][:-1]) for r in tokens.collect())
    assert blocks.schema["tokens"].dataType.simpleString() == "array<int>"


def test_ids_beyond_their_type_are_an_error(spark):
    df = spark.createDataFrame([(1, "train", [40_000, 3])], SCHEMA)
    with pytest.raises(Exception, match="(?i)overflow"):
        packing.pack_blocks(df, 4, keep_tail=True, id_type="smallint").collect()
    assert packing.pack_blocks(df, 4, keep_tail=True).first()["tokens"] == [40_000, 3]


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).getName().startswith("shuffle_") for k in range(files.size()))


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    table = written(spark.range(2000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "sums")
    assert {r["n"] for r in table.collect()} == {285, 286}
    assert shuffle_files(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting


TEXTS = ["a the theme", None, "", "x <|pad|> y<|endoftext|>", "<|", " <|mermaid|>the", "ab" * 400, "é\n\n  ü 12's"]


@pytest.mark.parametrize("texts", [TEXTS, [t for t in TEXTS if not t or "<|" not in t]])
def test_both_ids_are_those_of_either_vocabulary(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1)
    long_ = spark.createDataFrame([(t, 3) for t in ("the", " the", "theme", "abab", " <|")], "pretoken string, n long")
    full, plain = bp.train_bpe(long_, bl.FIRST_MERGE + 9), bp.train_bpe(long_, bl.FIRST_MERGE + 3)
    both = bp.encode_both(F.col("text"), full, plain)
    rows = df.select(
        both.alias("b"), bp.encode(F.col("text"), full).alias("ids"), bp.encode(F.col("text"), plain, specials=False).alias("p")
    ).collect()
    assert [(r["b"]["ids"], r["b"]["plain_ids"]) for r in rows] == [(r["ids"], r["p"]) for r in rows]


def test_words_merged_at_once_are_those_merged_alone():
    import pyarrow as pa

    rng = random.Random(4)
    merges, symbols = [], list(range(bl.FIRST_BYTE, bl.FIRST_BYTE + 5))
    while len(merges) < 300:
        pair = rng.choice(symbols), rng.choice(symbols)
        if pair not in merges:
            merges.append(pair)
            symbols.append(bl.FIRST_MERGE + len(merges) - 1)
    bpe, by_pair = bp.Bpe(tuple(merges)), {p: k for k, p in enumerate(merges)}
    first = [bl.FIRST_BYTE + o for o in bl.byte_offsets()]
    letters = [chr(33 + k) for k in range(5)]
    words = ["", "!", "<|pad|>", "é" * 40] + ["".join(rng.choices(letters, k=rng.randint(0, 90))) for _ in range(3000)]
    want = [bp._merge_word([first[b] for b in w.encode()], by_pair) for w in words]
    got = bp._word_ids(pa.array(words), bpe, bp._Ranks(bpe.merges), False).to_pylist()
    assert got == want
    assert bp._word_ids(pa.array(words), bpe, bp._Ranks(bpe.merges), True).to_pylist()[2] == [bl.PAD]
    assert bp._word_ids(pa.array(words).slice(2), bpe, bp._Ranks(bpe.merges), False).to_pylist() == want[2:]


def test_token_tables_are_made_in_modest_batches(spark, monkeypatch):
    import pyarrow as pa

    from glyphmill import session

    before = spark.conf.get(session._BATCH_BYTES)
    try:
        spark.conf.set(session._BATCH_BYTES, str(64 << 20))
        session.modest_batches(spark)
        assert spark.conf.get(session._BATCH_BYTES) == str(8 << 20)
        session.modest_batches(spark, 9 << 20)
        assert spark.conf.get(session._BATCH_BYTES) == str(8 << 20)
    finally:
        spark.conf.set(session._BATCH_BYTES, before)
    bpe = bp.Bpe(((bl.FIRST_BYTE, bl.FIRST_BYTE + 1), (bl.FIRST_MERGE, bl.FIRST_BYTE)))
    words, ranks = pa.array(['!"!', "", '"!"!', "!!", '!"' * 40, '"']), bp._Ranks(bpe.merges)
    whole = bp._word_ids(words, bpe, ranks, False).to_pylist()
    monkeypatch.setattr(bp, "WORDS_AT_ONCE", 2)
    assert bp._word_ids(words, bpe, ranks, False).to_pylist() == whole
