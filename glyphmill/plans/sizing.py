"""Join sides and ranks that hold up at scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.session import written

# A broadcast side may have this many (short) rows; larger sides are joined by
# a shuffle, where adaptive execution splits skewed partitions.
BROADCAST_ROWS = 500_000

# Corpus-sized tables are cut into 16**4 = 65,536 buckets per group: 100 TB of
# text is about 1.5 GB a bucket, and the table of bucket totals stays small.
BUCKET_DIGITS = 4


# Rows that find their running total in a broadcast table of 12 bytes each; with more of them the rows are moved.
LOOKED_UP_ROWS = 4_000_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than needed."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, rows: int | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its size is proven small, else unchanged."""
    small = rows <= max_rows if rows is not None else fits(df, max_rows)
    return F.broadcast(df) if small else df


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with at least one partition per core.

    Generating a pair costs far more than reading its key, so a scan of few
    row groups is split up; a scan that already has enough partitions is left
    alone.
    """
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() < wanted else scan


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt by hash over at least one partition per core.

    For short rows that cost far more than they weigh: adaptive execution goes
    by bytes and would put millions of keys into one task; it leaves a given
    number of partitions alone.
    """
    spark = df.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(wanted, *columns)


def bucket_totals(
    df: DataFrame, group: Sequence[str], bucket: Column, weight: Column
) -> DataFrame:
    """Per (group, bucket): the weight before it in its group, and the group's total.

    The weights are summed map-side first, so only ``buckets x groups`` rows
    reach the window over the bucket order.
    """
    sums = df.groupBy(*group, bucket.alias("_bucket")).agg(F.sum(weight).alias("_weight"))
    ordered = W.partitionBy(*group).orderBy("_bucket")
    return sums.select(
        *group,
        "_bucket",
        F.coalesce(
            F.sum("_weight").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_weight").over(W.partitionBy(*group)).alias("_total"),
    )


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order_hex: str,
    ties: Sequence[str],
    weight: Column,
    start: str,
    total: str,
    digits: int = 2,
) -> DataFrame:
    """Global running weight before each row of its group, without one big window.

    ``order_hex`` is an md5 of the row's unique key, so its first ``digits`` hex
    digits cut every group into ``16**digits`` even, ordered buckets.  Bucket
    totals are summed first; each bucket then needs only a local running sum.
    Both passes compute the same values whatever the partitioning, so a retry
    cannot shift an offset.
    """
    bucket = F.substring(F.col(order_hex), 1, digits)
    totals = bucket_totals(df, group, bucket, weight)
    # Proven bound: 16**digits rows per group; groups are split names (two),
    # or categories and shapes with far fewer digits.
    totals = small_side(totals, rows=2 * 16**digits)
    local = (
        W.partitionBy(*group, "_bucket").orderBy(order_hex, *ties).rowsBetween(W.unboundedPreceding, -1)
    )
    joined = df.withColumn("_bucket", bucket).join(totals, [*group, "_bucket"])
    return (
        joined.withColumn(start, F.col("_before") + F.coalesce(F.sum(weight).over(local), F.lit(0)))
        .withColumnRenamed("_total", total)
        .drop("_bucket", "_before")
    )


def looked_up_total(
    df: DataFrame, group: Sequence[str], bucket: Column, key: Column, weight: Column, start: str, total: str
) -> DataFrame | None:
    """As ``running_total`` in the order of ``bucket`` and then ``key`` (bigint), but the rows of ``df`` stay where they are.

    Only buckets, keys and weights are shuffled; every bucket becomes one row of
    sorted keys and of the weights before them, and each row looks its own up.
    ``df`` is read twice.  None if two rows share a key, the weights of a bucket
    exceed 32 bits, or there are more than ``LOOKED_UP_ROWS`` rows.
    """
    narrow = df.select(*group, bucket.alias("_bucket"), key.alias("_key"), weight.cast("bigint").alias("_weight"))
    by_bucket = [*group, "_bucket"]
    local = W.partitionBy(*by_bucket).orderBy("_key").rowsBetween(W.unboundedPreceding, -1)
    within = F.coalesce(F.sum("_weight").over(local), F.lit(0))
    buckets = (
        narrow.withColumn("_within", within)
        .groupBy(*by_bucket)
        .agg(
            F.sort_array(F.collect_list(F.struct("_key", "_within"))).alias("_rows"),
            F.sum("_weight").alias("_sum"),
        )
    )
    buckets = written(buckets, "buckets")
    keys = F.col("_rows")["_key"]
    seen = buckets.agg(
        F.sum(F.size("_rows")).alias("n"),
        F.max("_sum").alias("most"),
        F.max(F.size("_rows") - F.size(F.array_distinct(keys))).alias("ties"),
    ).first()
    if (seen["n"] or 0) > LOOKED_UP_ROWS or (seen["most"] or 0) >= 2**31 or seen["ties"]:
        return None
    totals = bucket_totals(buckets.select(*by_bucket, "_sum"), group, F.col("_bucket"), F.col("_sum"))
    table = buckets.join(small_side(totals), by_bucket).select(
        *by_bucket, "_before", "_total", keys.alias("_keys"), F.col("_rows")["_within"].cast("array<int>").alias("_within")
    )
    found = df.withColumns({"_bucket": bucket, "_key": key}).join(F.broadcast(table), by_bucket)
    at = F.array_position("_keys", F.col("_key")).cast("int")
    return (
        found.withColumn(start, F.col("_before") + F.element_at("_within", at))
        .withColumnRenamed("_total", total)
        .drop("_bucket", "_key", "_keys", "_within", "_before")
    )


def global_rank(
    df: DataFrame,
    group: Sequence[str],
    order_hex: str,
    ties: Sequence[str],
    rank: str,
    total: str,
    digits: int = 2,
) -> DataFrame:
    """Zero-based rank of each row in its group, in ``order_hex`` order."""
    return running_total(df, group, order_hex, ties, F.lit(1).cast("bigint"), rank, total, digits)
