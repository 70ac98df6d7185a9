"""A training corpus from raw documents: score, deduplicate lines and documents, mix, pack.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the next stage's documents.  All stages but the last return
the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import jaccard, linededup, mixing, neighbours, slackpack
from glyphmill.session import written
from glyphmill.sources.tables import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return neighbours.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that it shares with others; ``n_chars`` follows the text."""
    # All columns travel in one, so that none can be taken for a column the operator adds.
    found = linededup.drop_shared_lines(docs.select(F.struct("*").alias("row_"), "doc_id", "text"))
    changed = F.col("n_dropped") > 0
    new = {
        "text": F.when(changed, F.col("kept_text")).otherwise(F.col("row_.text")),
        "n_chars": F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("row_.n_chars")),
    }
    return found.select(*[new.get(c, F.col("row_")[c]).alias(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics approach their target weights."""
    drawn = mixing.draw(docs.select(F.struct("*").alias("row_"), "doc_id", "text", "lang", "source"))
    return drawn.filter("drawn").select("row_.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents as pieces of full sequences."""
    return slackpack.pack(docs, slackpack.Params(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_shared_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("mixing to target weights", mix),
    ("packing", pack),
]

# The classifier is fitted numerically, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
