"""Written tables: pair files, token shards, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.operators.pairs import PAIR_SCHEMA
from glyphmill.session import shuffles_removed


def write_pairs(pairs: DataFrame, path: str) -> None:
    """JSON lines, one pair per line."""
    pairs.write.mode("overwrite").json(path)


def read_pairs(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """Pairs from JSON lines, or from one JSON array per file."""
    return spark.read.schema(PAIR_SCHEMA).option("multiLine", array_file).json(path)


def write_blocks(blocks: DataFrame, path: str, force: bool = False) -> None:
    """Token blocks, one folder per split; a folder whose write was finished is kept unless forced."""
    if force or not _finished(blocks.sparkSession, path):
        with shuffles_removed(blocks.sparkSession):
            blocks.write.mode("overwrite").partitionBy("split").parquet(path)


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` came to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Reading one split touches only its folder."""
    return spark.read.schema("block_id bigint, tokens array<int>, split string").parquet(path)


def write_vocab(vocab: DataFrame, merges: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    merges.write.mode("overwrite").parquet(f"{path}/merges")


def read_vocab(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges")
