"""Documents to fixed-length training blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions import draw
from glyphmill.functions.bytelevel import EOT
from glyphmill.plans.sizing import BUCKET_DIGITS, bucket_totals, global_rank, looked_up_total, running_total, small_side
from glyphmill.session import written

# Fixed values.
DOC_SEED = 42
DOC_VAL_SHARE = 0.05
BLOCK = 512
BATCH = 16

# Blocks whose ends of text are counted together when a stream is unpacked.
UNPACK_BUCKET = 4096


def split_docs(
    docs: DataFrame, share: float = DOC_VAL_SHARE, seed: int = DOC_SEED, key: str = "doc_id"
) -> DataFrame:
    """Add ``split``; about ``share`` of all documents are val.

    A threshold on a hash of the key needs no sort and no driver state; the
    share is met in expectation, not to the document.
    """
    h = draw.digest(seed, F.col(key), "side")
    return docs.withColumn(
        "split", F.when(draw.below(h, share), F.lit("val")).otherwise(F.lit("train"))
    )


def with_eot(encoded: DataFrame, ids: str = "ids", eot: int = EOT) -> DataFrame:
    """Append the end-of-text id to every document, also the last; without ids it stands alone."""
    return encoded.withColumn(ids, F.concat(F.coalesce(F.col(ids), F.array().cast("array<int>")), F.array(F.lit(eot))))


# Hex digits of a digest after those of the bucket, as a number that tells the documents of a bucket apart.
KEY_DIGITS = 15


def place(encoded: DataFrame, seed: int = DOC_SEED, digits: int = BUCKET_DIGITS) -> DataFrame:
    """``doc_id, split, ids, n, st, total``: where each document begins in its split's shuffled stream.

    ``encoded`` is ``doc_id, split, ids`` and, if it is a written table, the
    length ``n``; without it the table is written here, so no text is encoded
    twice.  Documents are not moved, unless they are too many to look their places up.
    """
    if "n" not in encoded.columns:
        encoded = written(encoded.select("doc_id", "split", "ids", F.size("ids").alias("n")), "tokens")
    sized = encoded.select(
        "doc_id", "split", "ids", F.col("n").cast("bigint").alias("n"), draw.digest(seed, F.col("doc_id"), "order").alias("_h")
    ).filter("n > 0")
    bucket = F.substring("_h", 1, digits)
    key = F.conv(F.substring("_h", digits + 1, KEY_DIGITS), 16, 10).cast("bigint")
    placed = looked_up_total(sized, ["split"], bucket, key, F.col("n"), "st", "total")
    if placed is None:
        placed = running_total(sized, ["split"], "_h", ["doc_id"], F.col("n"), "st", "total", digits)
    return placed.drop("_h")


def pack_blocks(
    encoded: DataFrame,
    length: int = BLOCK,
    seed: int = DOC_SEED,
    digits: int = BUCKET_DIGITS,
    keep_tail: bool = False,
    id_type: str = "int",
) -> DataFrame:
    """Concatenate each split's documents in shuffled order and cut blocks.

    ``encoded`` is ``(doc_id, split, ids)`` and, of a written table, the length ``n``
    (see ``place``).  Block i holds tokens ``i*length`` to
    ``(i+1)*length`` inclusive, so neighbours share one token; the tail that
    fills no block is dropped, or is a shorter last block if ``keep_tail``.  Every document hands each block it touches its
    slice, and a block never gathers more than ``length + 1`` tokens.  Slices travel as
    ``id_type``: ``smallint`` halves them; an id that does not fit it is an error.
    """
    placed = place(encoded, seed, digits)
    size = F.lit(length).cast("bigint")
    n_blocks = (F.ceil(F.col("total") / size) if keep_tail else F.floor((F.col("total") - 1) / size)).cast("bigint")
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("st") - 1) / size).cast("bigint"))
    last = F.least(F.floor((F.col("st") + F.col("n") - 1) / size).cast("bigint"), n_blocks - 1)

    def piece(block):
        low = F.greatest(F.col("st"), block * size)
        high = F.least(F.col("st") + F.col("n") - 1, (block + 1) * size)
        return F.struct(
            block.alias("block_id"),
            low.alias("at"),
            F.slice("ids", (low - F.col("st") + 1).cast("int"), (high - low + 1).cast("int")).cast(f"array<{id_type}>").alias("part"),
        )

    pieces = (
        placed.withColumn("_first", first)
        .withColumn("_last", last)
        .filter(F.col("_first") <= F.col("_last"))
        .select("split", F.explode(F.transform(F.sequence("_first", "_last"), piece)).alias("p"))
    )
    gathered = pieces.groupBy("split", F.col("p.block_id").alias("block_id")).agg(
        F.sort_array(F.collect_list(F.struct("p.at", "p.part"))).alias("parts")
    )
    return gathered.select(
        "split", "block_id", F.flatten(F.col("parts")["part"]).cast("array<int>").alias("tokens")
    )


def unpack_blocks(blocks: DataFrame, length: int = BLOCK, eot: int = EOT, id_type: str = "int") -> DataFrame:
    """The documents a token stream was packed from: ``split, doc_no, ids`` without the end-of-text id.

    The first ``length`` tokens of a split's blocks tile its stream.  A block
    cuts its own tokens at every end-of-text id and numbers the pieces by the
    ends before it, so only pieces of one document meet.  Documents whose end
    was dropped with the tail are left out.
    """
    own = F.slice("tokens", F.lit(1), F.least(F.lit(length), F.size("tokens")))
    ends = F.filter(F.transform("own", lambda t, i: F.when(t == eot, i)), lambda i: i.isNotNull())
    cut = blocks.select("split", "block_id", own.alias("own")).withColumn("ends", ends)
    cut = cut.withColumn("n_ends", F.size("ends").cast("bigint"))
    bucket = F.floor(F.col("block_id") / UNPACK_BUCKET).cast("bigint")
    # Blocks are not moved to be numbered, unless they are too many to look their numbers up.
    numbered = looked_up_total(cut, ["split"], bucket, F.col("block_id"), F.col("n_ends"), "before", "_total")
    if numbered is None:
        totals = bucket_totals(cut, ["split"], bucket, F.col("n_ends")).drop("_total")
        local = W.partitionBy("split", "_bucket").orderBy("block_id").rowsBetween(W.unboundedPreceding, -1)
        before = F.col("_before") + F.coalesce(F.sum("n_ends").over(local), F.lit(0))
        numbered = cut.withColumn("_bucket", bucket).join(small_side(totals), ["split", "_bucket"]).withColumn("before", before)
    limits = F.concat(F.array(F.lit(-1)), "ends", F.array(F.size("own")))
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("ends")),
        lambda j: F.struct(
            (F.col("before") + j).alias("doc_no"),
            F.slice("own", F.get(limits, j) + 2, F.get(limits, j + 1) - F.get(limits, j) - 1)
            .cast(f"array<{id_type}>")
            .alias("part"),
            (j < F.size("ends")).alias("closed"),
        ),
    )
    rows = numbered.select("split", "block_id", F.explode(pieces).alias("p")).select("split", "block_id", "p.*")
    gathered = rows.groupBy("split", "doc_no").agg(
        F.sort_array(F.collect_list(F.struct("block_id", "part"))).alias("parts"), F.max("closed").alias("closed")
    )
    return gathered.filter("closed").select(
        "split", "doc_no", F.flatten(F.col("parts")["part"]).cast("array<int>").alias("ids")
    )


def next_token_pairs(blocks: DataFrame, length: int = BLOCK) -> DataFrame:
    """Block -> ``x`` and ``y``, the block shifted by one."""
    return blocks.select(
        "split",
        "block_id",
        F.slice("tokens", 1, length).alias("x"),
        F.slice("tokens", 2, length).alias("y"),
    )


def epoch_batches(
    blocks: DataFrame,
    batch: int = BATCH,
    epoch: int = 0,
    seed: int = DOC_SEED,
    drop_last: bool = True,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add ``batch_id`` and ``row``: train shuffled per epoch, val in block order.

    Val blocks are already numbered densely, so only train blocks are ranked.
    """
    shuffled = blocks.filter(F.col("split") == "train").withColumn(
        "_h", draw.digest(seed, F.col("block_id"), f"epoch{epoch}")
    )
    train = global_rank(shuffled, ["split"], "_h", ["block_id"], "_at", "_n", digits).drop("_h")
    rest = blocks.filter(F.col("split") != "train")
    counts = rest.groupBy("split").agg(F.count("*").cast("bigint").alias("_n"))
    ordered = rest.withColumn("_at", F.col("block_id")).join(small_side(counts), "split")
    numbered = train.unionByName(ordered.select(*train.columns))
    full = F.floor(F.col("_n") / batch) * batch
    if drop_last:
        numbered = numbered.filter(F.col("_at") < full)
    return (
        numbered.withColumn("batch_id", F.floor(F.col("_at") / batch).cast("bigint"))
        .withColumn("row", (F.col("_at") % batch).cast("bigint"))
        .drop("_at", "_n")
    )
