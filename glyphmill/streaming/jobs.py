"""Endless pairs and incremental tokenization as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphmill.operators import packing, pairs
from glyphmill.operators.bpe import Bpe, encode

# How long a pair is remembered; a bound of ours, since state must not grow
# for ever.
REMEMBER = "1 day"


def stream_keys(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """Endless keys ``(pair_id, arrived)``."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(F.col("value").alias("pair_id"), F.col("timestamp").alias("arrived"))


def stream_pairs(
    keys: DataFrame,
    kit: pairs.PairKit,
    seed: int = pairs.PAIR_SEED,
    novel_share: float = pairs.STREAM_NOVEL_SHARE,
    remember: str = REMEMBER,
) -> DataFrame:
    """Fresh training pairs of a stream of keys, distinct on (prompt, diagram).

    The draws are stateless lookups; only a 128-bit digest of a pair is kept as
    state, until the watermark passes ``remember``.
    """
    drawn = keys.select(
        "pair_id",
        "arrived",
        F.lit("train").alias("value_split"),
        F.lit("train").alias("phrase_split"),
        pairs.draw.below(pairs.draw.digest(seed, F.col("pair_id"), "side"), novel_share, 1).alias("novel"),
    )
    text = ("prompt", "diagram")
    marks = {"_a": F.xxhash64(*text), "_b": F.xxhash64(F.lit("second"), *text)}
    return (
        pairs.draw_pairs(drawn, kit, seed)
        .withColumns(marks)
        .withWatermark("arrived", remember)
        .dropDuplicatesWithinWatermark(["_a", "_b"])
        .drop("_a", "_b")
    )


def append_parquet(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to Parquet, each row exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def tokenized(docs: DataFrame, bpe: Bpe) -> DataFrame:
    """Documents -> ``(doc_id, split, ids)`` with the end-of-text id; map-only."""
    encoded = packing.split_docs(docs).select("doc_id", "split", encode(F.col("text"), bpe).alias("ids"))
    return packing.with_eot(encoded)


def stream_tokenize(docs: DataFrame, bpe: Bpe, sink: str, checkpoint: str) -> StreamingQuery:
    """Tokenize documents as they arrive and append shards.

    Tokenizing needs no state, so the file sink alone makes a restart neither
    lose nor repeat a shard.
    """
    return append_parquet(tokenized(docs, bpe), sink, checkpoint)
