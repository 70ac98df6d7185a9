"""Pairs and conversations to masked training examples and padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions import bytelevel as bl
from glyphmill.functions import draw
from glyphmill.operators.bpe import Bpe, encode
from glyphmill.plans.sizing import BUCKET_DIGITS, global_rank

# Fixed values.
MAX_LEN = 512
IGNORE = -1
BATCH = 32
BATCH_SEED = 7


def _shift(df: DataFrame, ids: Column, labels: Column, max_len: int) -> DataFrame:
    """Cut to ``max_len`` ids, then ``x``, ``y`` and ``n``; labels are ids or -1."""
    rest = F.greatest(F.least(F.size("_ids"), F.lit(max_len)) - 1, F.lit(0))
    return (
        df.withColumn("_ids", ids)
        .withColumn("_labels", labels)
        .withColumn("x", F.slice("_ids", F.lit(1), rest))
        .withColumn("y", F.slice("_labels", F.lit(2), rest))
        .withColumn("n", rest.cast("bigint"))
        .drop("_ids", "_labels")
    )


def frame_pairs(df: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """``p_ids, m_ids`` -> ``x, y, n``.

    The sequence is diagram marker, prompt, prompt marker, diagram, end; the
    first scored target is the first diagram token, and the end is scored.
    """
    ids = F.concat(
        F.array(F.lit(bl.DIAGRAM)), "p_ids", F.array(F.lit(bl.PROMPT)), "m_ids", F.array(F.lit(bl.EOT))
    )
    labels = F.concat(
        F.array_repeat(F.lit(IGNORE), F.size("p_ids") + 2), "m_ids", F.array(F.lit(bl.EOT))
    )
    return _shift(df, ids, labels, max_len).drop("p_ids", "m_ids")


def encode_pairs(pairs: DataFrame, bpe: Bpe, max_len: int = MAX_LEN) -> DataFrame:
    """Pairs -> masked examples ``(pair_id, ..., x, y, n)``; map-only."""
    empty = F.array().cast("array<int>")
    ids = pairs.withColumn("p_ids", F.coalesce(encode(F.col("prompt"), bpe), empty)).withColumn(
        "m_ids", F.coalesce(encode(F.col("diagram"), bpe), empty)
    )
    return frame_pairs(ids, max_len)


def encode_conversations(turns: DataFrame, bpe: Bpe, max_len: int = MAX_LEN) -> DataFrame:
    """Conversations -> masked examples: assistant turns are scored.

    Each turn is a role marker, its text and an end marker, so a turn takes at
    least two ids (a null text is an empty one) and only the first ``max_len`` turns can matter.  The rank
    filter trims longer conversations map-side, before the shuffle, and only
    these turns are tokenized and gathered.
    """
    order = W.partitionBy("conv_id").orderBy("turn")
    kept = turns.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= max_len).drop("_at")
    assistant = F.col("role") == "assistant"
    marker = F.when(assistant, F.lit(bl.RESPONSE)).otherwise(F.lit(bl.PROMPT))
    ids = F.coalesce(encode(F.col("text"), bpe), F.array().cast("array<int>"))
    end = F.array(F.lit(bl.EOT))
    turn = kept.select("conv_id", "turn", "role", marker.alias("marker"), ids.alias("body")).withColumn(
        "ids", F.concat(F.array("marker"), "body", end)
    )
    labels = F.when(assistant, F.concat(F.array(F.lit(IGNORE)), "body", end)).otherwise(
        F.array_repeat(F.lit(IGNORE), F.size("ids"))
    )
    # No turn can contribute more than max_len ids.
    cut = turn.select(
        "conv_id",
        F.struct("turn", F.slice("ids", 1, max_len).alias("ids"), F.slice(labels, 1, max_len).alias("labels")).alias("t"),
    )
    gathered = cut.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return _shift(
        gathered,
        F.flatten(F.transform("ts", lambda t: t["ids"])),
        F.flatten(F.transform("ts", lambda t: t["labels"])),
        max_len,
    ).drop("ts")


def assign_batches(
    examples: DataFrame, batch: int = BATCH, seed: int = BATCH_SEED, key: str = "pair_id"
) -> DataFrame:
    """Shuffle examples into batches of ``batch`` rows: adds ``batch_id``."""
    hashed = examples.withColumn("_h", draw.digest(seed, F.col(key), "batch"))
    ranked = global_rank(hashed.withColumn("_all", F.lit(1)), ["_all"], "_h", [key], "_at", "_n", BUCKET_DIGITS)
    return ranked.withColumn("batch_id", F.floor(F.col("_at") / batch).cast("bigint")).drop(
        "_h", "_all", "_at", "_n"
    )


def pad_batches(examples: DataFrame, pad_id: int = bl.PAD) -> DataFrame:
    """Pad ``x`` with the pad id and ``y`` with -1 to the batch's longest row.

    A batch is small, so the window moves each row once.
    """
    wide = examples.withColumn("max_n", F.max("n").over(W.partitionBy("batch_id")))
    missing = (F.col("max_n") - F.col("n")).cast("int")
    return wide.withColumn("x", F.concat("x", F.array_repeat(F.lit(pad_id), missing))).withColumn(
        "y", F.concat("y", F.array_repeat(F.lit(IGNORE), missing))
    )


def padding_report(examples: DataFrame, fixed: int = MAX_LEN - 1) -> DataFrame:
    """Useful, dynamically padded and fixed-length cells over all batches."""
    batches = examples.groupBy("batch_id").agg(
        F.count("*").alias("rows"), F.sum("n").alias("used"), F.max("n").alias("max_n")
    )
    cells = F.sum(F.col("rows") * F.col("max_n"))
    return batches.agg(
        F.count("*").alias("n_batches"),
        F.sum("used").alias("used_cells"),
        cells.alias("dynamic_cells"),
        (F.sum("rows") * fixed).alias("fixed_cells"),
        F.round(cells / F.sum("rows"), 6).alias("mean_padded_length"),
        F.round(1 - cells / (F.sum("rows") * fixed), 6).alias("saved_share"),
    )


def scored_tokens(y: Column) -> Column:
    """How many targets of a row carry loss."""
    return F.size(F.array_remove(y, IGNORE)).cast("bigint")


def loss_share(examples: DataFrame) -> DataFrame:
    """Share of targets that carry loss, over all rows."""
    scored = F.sum(scored_tokens(F.col("y")))
    total = F.sum(F.size("y"))
    return examples.agg(
        F.count("*").alias("n_rows"),
        scored.alias("n_scored"),
        total.alias("n_targets"),
        F.round(scored / F.greatest(F.lit(1), total), 6).alias("scored_share"),
    )
