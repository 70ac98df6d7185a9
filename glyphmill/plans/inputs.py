"""How the registered queries use the given tables.

orders      one pair per order key
part        adjectives become conditions, nouns become objects of the lexicon
events      event types become actions; users and days become run logs
documents   the corpus: tokenizer, packing
conversations  chat turns, and free text that matches no diagram
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import bytelevel as bl
from glyphmill.functions import draw
from glyphmill.operators import bpe as bp
from glyphmill.operators import evaluate, lexicon, packing, pairs
from glyphmill.plans.sizing import spread
from glyphmill.session import modest_batches
from glyphmill.sources.grammar import grammar
from glyphmill.sources.tables import table

# Merges that SQL learns as well, one by one: its twins check the ids themselves by them.
PLAIN_MERGES = 16

_memo: dict[tuple, object] = {}

# Whether the kit is built with the vocabulary; see ``full_size``.
_full: ContextVar[bool] = ContextVar("full", default=False)


@contextmanager
def full_size():
    """Queries built inside use a kit of the words the vocabulary handles cheaply, and of its fragments."""
    before = _full.set(True)
    try:
        yield
    finally:
        _full.reset(before)


def _once(spark: SparkSession, sf_dir: str, name: str, build):
    """Lexicon tables and vocabulary are built once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _memo:
        _memo[key] = build()
    return _memo[key]


def lexicon_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Packaged words, the words of part names, and event types."""
    name = F.split("p_name", " ")
    part = table(spark, sf_dir, "part").select(
        F.explode(
            F.array(
                F.struct(F.lit("condition").alias("kind"), F.initcap(name[0]).alias("word")),
                F.struct(F.lit("object").alias("kind"), F.initcap(name[1]).alias("word")),
            )
        ).alias("w")
    )
    events = table(spark, sf_dir, "events").select(
        F.lit("action").alias("kind"), F.initcap("event_type").alias("word")
    )
    return [grammar(spark)["words"], part.select("w.kind", "w.word"), events]


def lexicon_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.merge_words(*lexicon_sources(spark, sf_dir))


def kit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that fill slots: at full size only those the vocabulary handles cheaply."""
    words = lexicon_words(spark, sf_dir)
    return bp.filter_by_cost(words, vocabulary(spark, sf_dir)) if _full.get() else words


def kit(spark: SparkSession, sf_dir: str) -> pairs.PairKit:
    """At full size, from cheap words and with fragments of the vocabulary."""
    if not _full.get():
        return candidate_kit(spark, sf_dir)

    def build():
        vocab, _ = bp.vocab_tables(spark, vocabulary(spark, sf_dir))
        fragments = lexicon.vocab_fragments(vocab.filter(F.col("kind") != "special"))
        return pairs.build_kit(kit_words(spark, sf_dir), grammar(spark), fragments)

    return _once(spark, sf_dir, "full kit", build)


def candidate_kit(spark: SparkSession, sf_dir: str) -> pairs.PairKit:
    """From all candidate words, with packaged fragments."""
    return _once(
        spark, sf_dir, "kit", lambda: pairs.build_kit(lexicon_words(spark, sf_dir), grammar(spark))
    )


def order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key per order; order keys are unique."""
    return spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id")))


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair per order, copies included."""
    return pairs.draw_pairs(pairs.split_keys(order_ids(spark, sf_dir)), kit(spark, sf_dir))


def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.generate_pairs(order_ids(spark, sf_dir), kit(spark, sf_dir))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a deterministic, partly faulty output each."""
    return evaluate.corrupt(distinct(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def vocabulary(spark: SparkSession, sf_dir: str) -> bp.Bpe:
    """``VOCAB_SIZE`` entries trained on the tokenizer lines of all candidate words and the documents."""
    return _once(spark, sf_dir, "bpe", lambda: bp.train_bpe(bp.pretoken_frequencies(tokenizer_input(spark, sf_dir))))


def tokenizer_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = candidate_kit(spark, sf_dir)
    # The lines are those of the training side.
    made = pairs.generate_pairs(order_ids(spark, sf_dir), candidates, side="train")
    return pairs.mixed_corpus(pairs.tokenizer_lines(candidates.pool, made), documents(spark, sf_dir))


def plain_vocabulary(spark: SparkSession, sf_dir: str) -> bp.Bpe:
    """The first ``PLAIN_MERGES`` merges of the documents alone."""
    size = bl.FIRST_MERGE + PLAIN_MERGES
    return _once(
        spark, sf_dir, "plain bpe", lambda: bp.train_bpe(bp.pretoken_frequencies(documents(spark, sf_dir)), size)
    )


def plain_ids(spark: SparkSession, sf_dir: str) -> Column:
    """A text's ids by ``plain_vocabulary``; names of special tokens are cut like any text."""
    return bp.encode(F.coalesce("text", F.lit("")), plain_vocabulary(spark, sf_dir), specials=False)


def token_table(spark: SparkSession, sf_dir: str, plain: bool = False) -> DataFrame:
    """``(doc_id, split, ids)`` with the end-of-text id; ``plain`` adds ``plain_ids`` likewise."""
    modest_batches(spark, 4 << 20)
    names = ["ids", "plain_ids"] if plain else ["ids"]
    docs = packing.split_docs(documents(spark, sf_dir))
    if plain:
        both = bp.encode_both(F.col("text"), vocabulary(spark, sf_dir), plain_vocabulary(spark, sf_dir))
        tokens = docs.select("doc_id", "split", both.alias("both")).select("doc_id", "split", "both.*")
    else:
        tokens = docs.select("doc_id", "split", bp.encode(F.col("text"), vocabulary(spark, sf_dir)).alias("ids"))
    for name in names:
        tokens = packing.with_eot(tokens, name)
    return tokens


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct alphabetic words of the corpus, as lexicon candidates."""
    words = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    return (
        documents(spark, sf_dir)
        .select(F.lit("corpus").alias("kind"), F.explode(words).alias("word"))
        .distinct()
    )


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training batches: user = run, days since its first event = epoch, event type = phase."""
    events = table(spark, sf_dir, "events")
    first = events.groupBy("user_id").agg(F.min("ts").alias("first"))
    return events.join(first, "user_id").select(
        F.col("user_id").alias("run"),
        (F.datediff("ts", "first") + 1).cast("bigint").alias("epoch"),
        F.when(F.col("event_type").isin("view", "click", "signup"), "train").otherwise("val").alias("phase"),
        F.col("event_id").alias("batch"),
        F.col("value").alias("loss"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run and epoch, from the batch log; an epoch without val batches has no val loss.

    Losses that are at most zero have no finite ratio, as in IEEE division: 0 / 0 is NaN.
    """
    log = batch_log(spark, sf_dir)
    low, top = F.col("low"), F.col("top")
    by_zero = F.when(low == 0, float("nan")).otherwise(low * float("inf"))
    val = F.max(F.when(F.col("phase") == "val", F.col("loss")))
    train = F.max(F.when(F.col("phase") == "train", F.col("loss")))
    return (
        log.groupBy("run", "epoch")
        .agg(train.alias("train_loss"), val.alias("val_loss"), F.max("loss").alias("top"), F.min("loss").alias("low"))
        .select(
            "run",
            "epoch",
            "train_loss",
            "val_loss",
            F.round(F.when(top == 0, by_zero).otherwise(low / top), 6).alias("sample_acc"),
        )
    )


def free_prompts(
    spark: SparkSession, sf_dir: str, made: DataFrame | None = None, also: Sequence[Column] = ()
) -> DataFrame:
    """Free text as prompts: all turns, and pair prompts in lower case.

    ``also`` makes further ``struct<key, prompt>`` of the same pairs, ``made``: each pair is drawn once for all.
    """
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("key"), F.col("text").alias("prompt")
    )
    lowered = F.struct(F.concat_ws("-", F.lit("order"), "pair_id").alias("key"), F.lower("prompt").alias("prompt"))
    pairs_ = drawn(spark, sf_dir) if made is None else made
    return turns.unionByName(pairs_.select(F.inline(F.array(lowered, *also))))


def slot_text(slots) -> Column:
    """A slot map as ``act_1=...;act_2=...`` for flat results."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(slots)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"
    )


def opener_flag(key):
    return draw.pick(draw.digest(5, key, "header"), 3)
