"""Per-epoch roll-up of a training-step loss log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigen.functions.metrics import exact_mean


def valid_step(loss: str = "loss") -> Column:
    """A step counts when its loss is a number other than NaN and 0.0."""
    c = F.col(loss)
    return c.isNotNull() & ~F.isnan(c) & (c != F.lit(0.0))


def training_rollup(log: DataFrame, epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """epoch -> mean loss over valid steps (null when none), valid and skipped counts."""
    v = valid_step(loss)
    return log.groupBy(epoch).agg(
        exact_mean(F.when(v, F.col(loss))).alias("mean_loss"),
        F.count_if(v).alias("valid_steps"),
        F.count_if(~v).alias("skipped_steps"),
    )
