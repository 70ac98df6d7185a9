"""Line dedup: lines that many documents share stay in one document only.

Lines are normalised, exploded and hashed; a hash found in enough documents
loses its lines everywhere but in the largest ``doc_id`` that holds it, and the
documents are put together again by line position.

* A null or empty text is one empty line.
* A null ``doc_id`` counts as no document and never keeps a shared line.
* Repeated rows are one document for the count and lose the same lines.
* Lines repeated within a document count once and are dropped (or kept) all.
* An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import SPACES, ascii_lower, body, boxed, hash128, let, unboxed
from glyphmill.session import written

MIN_CHARS = 20
MIN_DOCS = 3


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line long enough to count: document, position, 128-bit key hash."""
    lines = docs.select(
        F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("version"),
        F.posexplode(F.split(body("text"), "\n")).alias("pos", "line"),
    )
    keyed = lines.select("id", "version", "pos", ascii_lower(F.btrim("line", F.lit(SPACES))).alias("key"))
    h1, h2 = hash128(F.col("key"))
    return keyed.filter(F.length("key") >= min_chars).select("id", "version", "pos", h1.alias("h1"), h2.alias("h2"))


def shared_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Key hashes found in at least ``min_docs`` documents, and the document that keeps them."""
    spread = lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"))
    return spread.filter(F.col("n") >= min_docs).drop("n")


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    The counting aggregate combines map-side, so a line that a third of all
    documents hold is one row per task; the join that finds the lines to drop
    is a plain equi-join whose skewed partitions adaptive execution can split.
    """
    lines = line_keys(docs, min_chars)
    # Written, so that both sides of the join are plain shuffles that can be split.
    shared = written(shared_lines(lines, min_docs), "shared-lines")
    dropped = (
        lines.join(shared, ["h1", "h2"])
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "version")
        .agg(F.collect_set("pos").alias("drop"))
    )
    rows = boxed(docs).withColumn("version_", F.xxhash64("row.text")).withColumn("id_", F.col("row.doc_id"))
    joined = rows.join(
        dropped, F.col("id_").eqNullSafe(F.col("id")) & (F.col("version_") == F.col("version")), "left"
    )
    text = body("row.text")
    kept = let(
        F.split(text, "\n"),
        lambda all_: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("drop")), lambda i: F.get(all_, i)
            ),
            "\n",
        ),
    )
    return unboxed(
        joined,
        docs.columns,
        n_lines=(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint"),
        n_dropped=F.coalesce(F.size("drop"), F.lit(0)).cast("bigint"),
        kept_text=F.when(F.col("drop").isNull(), text).otherwise(kept),
    )
