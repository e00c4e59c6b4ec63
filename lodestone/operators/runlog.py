"""Aggregates over a training log: perplexity, running loss, best checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import id_bucket, prefix_aggregates, trailing_mean


def perplexity(losses: DataFrame, loss: Column) -> DataFrame:
    """One row: exp of the mean loss over all batches of all workers."""
    return losses.agg(F.exp(F.avg(loss)).alias("perplexity"))


def rolling_loss(log: DataFrame, run: str, step: str, loss: str, window: int, bits: int = 16) -> DataFrame:
    """``log`` with the mean loss since the start of the run and over the last
    ``window`` steps. A run of any length is averaged block by block."""
    before = prefix_aggregates(
        log,
        [run],
        [F.col(step)],
        id_bucket(F.col(step), bits),
        {"_sum": ("sum", F.col(loss)), "_count": ("sum", F.lit(1).cast("bigint"))},
    )
    running = before.withColumn(
        "rolling_loss", (F.col("_sum") + F.col(loss)) / (F.col("_count") + 1)
    )
    return trailing_mean(running, [run], "_count", F.col(loss), window, "window_loss", bits).drop("_sum", "_count")


def best_so_far(log: DataFrame, run: str, step: str, metric: str, bits: int = 16) -> DataFrame:
    """``log`` with the best metric up to each step and whether the step set it."""
    before = prefix_aggregates(
        log, [run], [F.col(step)], id_bucket(F.col(step), bits), {"_best": ("max", F.col(metric))}
    )
    improved = F.coalesce(F.col(metric) > F.col("_best"), F.lit(True))
    return (
        before.withColumn("improved", improved)
        .withColumn("best", F.greatest("_best", metric))
        .drop("_best")
    )


def best_checkpoint(log: DataFrame, run: str, step: str, metric: str) -> DataFrame:
    """(run, step, metric) of the first step with the best metric."""
    return log.groupBy(run).agg(
        F.max_by(step, F.struct(F.col(metric), -F.col(step))).alias(step), F.max(metric).alias(metric)
    )
