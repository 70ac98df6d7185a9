"""Grammar: shapes, paraphrase expansion, splits, reports and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.functions.draw import digest
from glyphmill.plans.sizing import global_rank

# Fixed values.
VAL_SHARE = 0.15
PARAPHRASE_SEED = 99


def shape_slots(shapes: DataFrame) -> DataFrame:
    """``(shape, slot, category)``: one row per slot of each shape."""
    return shapes.select("shape", F.explode(tx.slot_names(F.col("pattern"))).alias("slot")).withColumn(
        "category", tx.slot_category(F.col("slot"))
    )


def expand(frames: DataFrame, connectives: DataFrame) -> DataFrame:
    """Every distinct cleaned ``(shape, paraphrase)`` of frames x options.

    One equi-join on (shape, key) per distinct key of a frame, taken in key
    order: all mentions of a key in a frame get the same option.  The loop runs
    as often as the longest key list of any frame.
    """
    keyed = frames.select(
        "shape",
        "frame",
        F.array_sort(F.array_distinct(F.regexp_extract_all("frame", F.lit(tx.WORD_HOLE), F.lit(1)))).alias("keys"),
    )
    rounds = keyed.agg(F.max(F.size("keys"))).first()[0] or 0
    for i in range(rounds):
        slot = keyed.withColumn("key", F.get(F.col("keys"), F.lit(i)))
        filled = slot.join(connectives, ["shape", "key"], "left").withColumn(
            "frame",
            F.when(F.col("key").isNull(), F.col("frame")).otherwise(
                F.replace(F.col("frame"), F.concat(F.lit("{"), "key", F.lit("}")), F.col("option"))
            ),
        )
        keyed = filled.select("shape", "frame", "keys")
    return keyed.select("shape", tx.clean_paraphrase(F.col("frame")).alias("paraphrase")).distinct()


def split_paraphrases(
    paraphrases: DataFrame, share: float = VAL_SHARE, seed: int = PARAPHRASE_SEED
) -> DataFrame:
    """``(shape, split, idx, paraphrase)`` with an exact held-out share per shape."""
    hashed = paraphrases.withColumn("_h", digest(seed, F.col("paraphrase")))
    ranked = global_rank(hashed, ["shape"], "_h", ["paraphrase"], "_rank", "_n", digits=1)
    n_val = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share))).cast("bigint")
    is_val = F.col("_rank") < n_val
    return ranked.select(
        "shape",
        F.when(is_val, F.lit("val")).otherwise(F.lit("train")).alias("split"),
        F.when(is_val, F.col("_rank")).otherwise(F.col("_rank") - n_val).cast("bigint").alias("idx"),
        "paraphrase",
    )


def paraphrase_report(paraphrases: DataFrame) -> DataFrame:
    """Counts per shape and in total (shape ``TOTAL``)."""
    return (
        paraphrases.rollup("shape")
        .agg(
            F.count("*").alias("n_total"),
            F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).alias("n_train"),
            F.sum(F.when(F.col("split") == "val", 1).otherwise(0)).alias("n_val"),
        )
        .withColumn("shape", F.coalesce("shape", F.lit("TOTAL")))
    )


def sentence_skeleton(paraphrase, hole: str = "#"):
    """A paraphrase with every slot hole masked."""
    return F.regexp_replace(paraphrase, tx.SLOT_HOLE, hole)


def skeleton_shapes(sentences: DataFrame) -> DataFrame:
    """``(skeleton, n_shapes, n)`` of ``(shape, paraphrase)`` sentences.

    Shapes are few, so the set per skeleton stays small however often a
    skeleton occurs.
    """
    return (
        sentences.select("shape", sentence_skeleton(F.col("paraphrase")).alias("skeleton"))
        .groupBy("skeleton")
        .agg(F.size(F.collect_set("shape")).cast("bigint").alias("n_shapes"), F.count("*").alias("n"))
    )


def ambiguity(sentences: DataFrame) -> DataFrame:
    """Masked sentences that more than one shape can produce."""
    return skeleton_shapes(sentences).filter("n_shapes > 1")


def openers(diagrams: DataFrame, column: str = "pattern") -> DataFrame:
    """Distinct forced prefixes: header line, indent and first node letter."""
    lines = F.split(F.col(column), "\n")
    head = F.regexp_replace(F.get(lines, F.lit(0)), r"\s+$", "")
    opening = F.regexp_extract(F.get(lines, F.lit(1)), r"^(\s*\S?)", 1)
    return diagrams.select(
        F.when(F.size(lines) < 2, F.concat(head, F.lit("\n")))
        .otherwise(F.concat(head, F.lit("\n"), opening))
        .alias("opener")
    ).distinct()
