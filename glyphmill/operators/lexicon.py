"""Lexicon: word groups, label pools, train / val values, novel-span fragments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.draw import digest
from glyphmill.plans.sizing import global_rank, small_side

# Fixed values.
CLOSED_CATEGORIES = ("label",)
VAL_SHARE = 0.15
VALUE_SEED = 1234
FLOOR = 8
SHOWN_WORD = r"""^\p{L}[^\s{}\[\]<>|"]*$"""
MAX_WORD_TOKENS = 2
MAX_WORDS = 65_536


def _candidates(word_tables: Sequence[DataFrame]) -> DataFrame:
    merged = word_tables[0].select("kind", "word")
    for words in word_tables[1:]:
        merged = merged.unionByName(words.select("kind", "word"))
    return merged.filter(F.col("word").isNotNull()).distinct()


def merge_words(*word_tables: DataFrame) -> DataFrame:
    """Distinct candidate words ``(kind, word)`` of several sources that a diagram can show.

    A word begins with a letter and may hold digits, hyphens and the like, but
    nothing that would end a label: blanks, brackets, braces, quotes or bars.
    ``distinct`` combines map-side, so a word held by a third of all rows costs
    one row per task in the shuffle.  What is asked of words stays above it, inside
    an array: a filter would be pushed down to all rows, and those after it as well.
    """
    shown = F.filter(F.array(F.struct("kind", "word")), lambda w: w["word"].rlike(SHOWN_WORD))
    return _candidates(word_tables).select(F.inline(shown))


def dropped_words(*word_tables: DataFrame) -> DataFrame:
    """The distinct candidate words that ``merge_words`` leaves out."""
    return _candidates(word_tables).filter(~F.col("word").rlike(SHOWN_WORD))


def check_floor(words: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Words per open group and whether the group is large enough."""
    return (
        words.filter(F.col("kind").isin("action", "object", "condition"))
        .groupBy("kind")
        .agg(F.count("*").alias("n_words"))
        .withColumn("enough", F.col("n_words") >= floor)
    )


def require_words(words: DataFrame, floor: int = FLOOR) -> None:
    """Raise when an open group is too small."""
    counts = {r["kind"]: r["count"] for r in words.groupBy("kind").count().collect()}
    short = [k for k in ("action", "condition", "object") if counts.get(k, 0) < floor]
    if short:
        raise ValueError(f"too few cheap words in: {', '.join(short)}; raise the token limit")


def label_pools(words: DataFrame) -> DataFrame:
    """Pools ``(category, value)``: act, cond and the closed label list.

    act is every action with every object; cond is every condition alone and
    with every object.  A word names the kind it combines with, so the product
    is an equi-join on that kind; up to ``MAX_WORDS`` counted words are broadcast.
    """
    heads = words.filter(F.col("kind").isin("action", "object")).select(
        F.col("word").alias("head"),
        F.when(F.col("kind") == "action", "act").otherwise("cond").alias("category"),
        F.when(F.col("kind") == "action", "object").otherwise("condition").alias("kind"),
    )
    two_words = heads.join(small_side(words, max_rows=MAX_WORDS), "kind").select(
        "category", F.concat_ws(" ", "head", "word").alias("value")
    )
    one_word = words.filter(F.col("kind").isin("condition", "label")).select(
        F.when(F.col("kind") == "condition", "cond").otherwise("label").alias("category"),
        F.col("word").alias("value"),
    )
    return two_words.unionByName(one_word).distinct()


def split_pools(pools: DataFrame, share: float = VAL_SHARE, seed: int = VALUE_SEED) -> DataFrame:
    """``(category, split, idx, value)`` with an exact held-out share per category.

    Values are ranked by a seeded hash; the first ``max(1, floor(n * share))``
    are val.  Closed categories appear in both splits.  ``idx`` is dense per
    (category, split).
    """
    hashed = pools.withColumn("_h", digest(seed, F.col("value")))
    ranked = global_rank(hashed, ["category"], "_h", ["value"], "_rank", "_n")
    n_val = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share))).cast("bigint")
    closed = F.col("category").isin(*CLOSED_CATEGORIES)
    is_val = F.col("_rank") < n_val
    placed = F.when(
        closed,
        F.array(
            F.struct(F.lit("train").alias("split"), F.col("_rank").alias("idx")),
            F.struct(F.lit("val").alias("split"), F.col("_rank").alias("idx")),
        ),
    ).otherwise(
        F.array(
            F.struct(
                F.when(is_val, F.lit("val")).otherwise(F.lit("train")).alias("split"),
                F.when(is_val, F.col("_rank")).otherwise(F.col("_rank") - n_val).alias("idx"),
            )
        )
    )
    return ranked.select("category", "value", F.explode(placed).alias("p")).select(
        "category", F.col("p.split").alias("split"), F.col("p.idx").cast("bigint").alias("idx"), "value"
    )


def lexicon_report(pool: DataFrame, n_dropped: int = 0) -> DataFrame:
    """Values per category: total, train, val, whether the set is closed; and the candidate words left out of all."""
    train = F.sum(F.when(F.col("split") == "train", 1).otherwise(0))
    val = F.sum(F.when(F.col("split") == "val", 1).otherwise(0))
    closed = F.col("category").isin(*CLOSED_CATEGORIES)
    counts = pool.groupBy("category").agg(train.alias("n_train"), val.alias("n_val"))
    return counts.select(
        "category",
        F.when(closed, F.col("n_train")).otherwise(F.col("n_train") + F.col("n_val")).alias("n_values"),
        "n_train",
        "n_val",
        closed.alias("closed"),
        F.lit(n_dropped).cast("bigint").alias("n_dropped"),
    )


def vocab_fragments(tokens: DataFrame, column: str = "token", low: int = 2, high: int = 9) -> DataFrame:
    """Distinct lower-case alphabetic pieces of 2-9 characters.

    ``tokens`` holds byte-level vocabulary entries (or plain words): the space
    marker is removed before the test.
    """
    piece = F.regexp_replace(F.col(column), "Ġ", "")
    return (
        tokens.select(piece.alias("piece"))
        .filter(F.col("piece").rlike(rf"^\p{{L}}{{{low},{high}}}$"))
        .select(F.lower("piece").alias("fragment"))
        .distinct()
    )


def leakage(labelled: DataFrame, what: str, value: str) -> DataFrame:
    """Values of one kind in train, in val, and in both (must be 0).

    One partial aggregation per value replaces an intersect of the two sides.
    """
    sides = labelled.groupBy(value).agg(
        F.max(F.when(F.col("split") == "train", 1).otherwise(0)).alias("t"),
        F.max(F.when(F.col("split") == "val", 1).otherwise(0)).alias("v"),
    )
    return sides.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("n_val"),
        F.coalesce(F.sum(F.col("t") * F.col("v")), F.lit(0)).alias("n_shared"),
    ).select(F.lit(what).alias("kind"), "n_train", "n_val", "n_shared")
