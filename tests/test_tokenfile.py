"""Flat 16-bit token files: round trip, random access, commits."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import packing
from glyphmill.session import work_path
from glyphmill.sources import tokenfile as tf


@pytest.fixture(scope="module")
def tokens(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["train", "val"]), [rng.randrange(4, 65_536) for _ in range(rng.randint(0, 60))] + [3]) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id bigint, split string, ids array<int>").repartition(5).cache()


@pytest.fixture(scope="module")
def path(spark, tokens):
    out = work_path(spark, "token-file")
    tf.write_token_file(tokens, out, part_ids=700)
    return out


def blocks_of(df):
    return {(r["split"], r["block_id"]): r["tokens"] for r in df.collect()}


def test_blocks_equal_those_packed_in_memory(spark, tokens, path):
    want = blocks_of(packing.pack_blocks(tokens, 16, keep_tail=True))
    assert blocks_of(tf.read_token_file(spark, path, 16)) == want
    assert len(tf.parts_of(path)["train"]) > 3


def test_documents_come_back(spark, tokens, path):
    back = packing.unpack_blocks(tf.read_token_file(spark, path, 50), 50)
    assert sorted((r["split"], r["ids"]) for r in back.collect()) == sorted((r["split"], r["ids"][:-1]) for r in tokens.collect())


def test_one_block_by_offset(spark, tokens, path):
    want = blocks_of(packing.pack_blocks(tokens, 16, keep_tail=True))
    for (split, block), ids in random.Random(2).sample(sorted(want.items()), 20):
        assert tf.read_block(path, split, block, 16).tolist() == ids
    assert tf.read_block(path, "train", 10**6, 16).size == 0 and tf.read_block(path, "none", 0, 16).size == 0


def test_filters_choose_the_blocks_that_are_read(spark, path):
    reader = tf.FilteredReader(path, 16)
    assert list(reader.pushFilters([tf.EqualTo(("split",), "val"), tf.In(("block_id",), (2, 5, 10**9))])) == []
    assert [p.value for p in reader.partitions()] == [("val", 2, 3), ("val", 5, 6)]
    wanted = "split = 'val' and block_id in (2, 5)"
    for setting in ("false", "true"):
        spark.conf.set(tf.PUSHDOWN, setting)
        try:
            assert sorted(blocks_of(tf.read_token_file(spark, path, 16).filter(wanted))) == [("val", 2), ("val", 5)]
        finally:
            spark.conf.unset(tf.PUSHDOWN)


def test_a_failed_attempt_leaves_the_stream_as_it_was(spark, tokens, path):
    before = tf.parts_of(path)
    writer = tf.TokenFileWriter(path, 700, True)
    rows = [{"split": "train", "start": 0, "ids": [9, 9, 9]}]
    writer.write(iter(pa.Table.from_pylist(rows).to_batches()))  # never committed
    writer.abort([])
    assert tf.parts_of(path) == before
    bad = tokens.withColumn("ids", F.array(F.lit(70_000)))
    with pytest.raises(Exception, match="16 bits"):
        tf.write_token_file(bad, path, overwrite=True)
    assert tf.parts_of(path) == before


def test_a_written_file_is_kept_unless_overwritten(spark, tokens, tmp_path):
    out = str(tmp_path / "f")
    one = tokens.filter("doc_id < 50")
    tf.write_token_file(one, out)
    with pytest.raises(Exception, match="overwrite"):
        tf.write_token_file(tokens, out)
    assert blocks_of(tf.read_token_file(spark, out, 16)) == blocks_of(packing.pack_blocks(one, 16, keep_tail=True))
    tf.write_token_file(tokens, out, overwrite=True)
    assert blocks_of(tf.read_token_file(spark, out, 16)) == blocks_of(packing.pack_blocks(tokens, 16, keep_tail=True))


def test_a_stream_appends_each_batch_once(spark, tmp_path):
    schema = tf.PLACED
    source, out, state = (str(tmp_path / n) for n in ("source", "out", "state"))
    tf.register(spark)
    for k in range(3):
        rows = [("train", 0, [k * 10 + 4] * 3), ("train", 3, [k * 10 + 5])]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).writeStream.format(tf.FORMAT)
        stream.option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert tf.read_ids(out, tf.parts_of(out)["train"], 0, 99).tolist() == [4, 4, 4, 5, 14, 14, 14, 15, 24, 24, 24, 25]
    # The same batch again replaces itself.
    last = max(tf._manifests(out))
    parts = tf._manifests(out)[last]
    tf.TokenFileStreamWriter(out, 99).commit([tf.Written(parts)], int(last[9:21]))
    assert tf.read_ids(out, tf.parts_of(out)["train"], 0, 99).size == 12


def test_an_empty_table_and_a_gap(spark, tokens, tmp_path):
    out = str(tmp_path / "empty")
    tf.write_token_file(tokens.limit(0), out)
    assert tf.read_token_file(spark, out).count() == 0
    tf._publish(out, 0, [tf.Written([tf.Part("train", 5, 1, "x")])])
    with pytest.raises(ValueError, match="gap"):
        tf.parts_of(out)


def test_ids_keep_their_sixteen_bits(path):
    files = tf.parts_of(path)["train"]
    assert all(2 * p.size == tf._open(path)[0].get_file_info(f"{path}/{p.file}").size for p in files)
