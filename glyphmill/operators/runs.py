"""Run logs: epoch means, best checkpoint, early stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value.
PATIENCE = 3


def loss_means(batch_log: DataFrame) -> DataFrame:
    """Mean loss per run, epoch and phase over the batches seen."""
    return batch_log.groupBy("run", "epoch", "phase").agg(
        F.count("*").alias("n_batches"), F.round(F.avg("loss"), 6).alias("mean_loss")
    )


def best_epoch(run_log: DataFrame) -> DataFrame:
    """Per run: the first epoch with the highest sample_acc, beside the lowest val loss.

    Two aggregates, combined map-side, instead of two rankings.
    """
    return run_log.groupBy("run").agg(
        F.max_by("epoch", F.struct(F.col("sample_acc"), -F.col("epoch"))).alias("best_epoch"),
        F.round(F.max("sample_acc"), 6).alias("best_acc"),
        # An epoch without a val loss keeps its accuracy but has no lowest loss.
        F.min_by("epoch", F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "epoch"))).alias("lowest_loss_epoch"),
        F.round(F.min("val_loss"), 6).alias("lowest_loss"),
    )


def early_stop(run_log: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """Per run: the first epoch that ends ``patience`` epochs without improvement.

    An epoch improves if its sample_acc is above every earlier one.  A run's log
    has one row per epoch.
    """
    order = W.partitionBy("run").orderBy("epoch")
    so_far = F.max("sample_acc").over(order.rowsBetween(W.unboundedPreceding, -1))
    better = so_far.isNull() | (F.col("sample_acc") > so_far)
    flagged = run_log.select("run", "epoch", "sample_acc", better.cast("int").alias("better"))
    island = flagged.withColumn(
        "island", F.sum("better").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    streak = island.withColumn(
        "streak",
        F.row_number().over(W.partitionBy("run", "island").orderBy("epoch")) - 1,
    )
    return streak.groupBy("run").agg(
        F.min(F.when(F.col("streak") >= patience, F.col("epoch"))).alias("stop_epoch"),
        F.max("epoch").alias("last_epoch"),
    )
