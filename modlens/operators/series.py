"""Training curves: one row per (run, step) with a value.

A run may hold most of the rows, so positions come from a prefix scan and the
moving average works on blocks with a margin, never on a whole run in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modlens.functions.numbers import py_round
from modlens.operators.ranking import with_position

BLOCK = 100_000


def positioned(df: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """Add the 0-based position in the run and the run's length."""
    sizes = df.groupBy(run).agg(F.count("*").alias("n"))
    return with_position(df, step, [run]).join(sizes, run)


def every_nth(df: DataFrame, n: int = 3) -> DataFrame:
    return positioned(df).where(F.col("pos") % n == 0).drop("n")


def tail_mean(df: DataFrame, parts: int = 4) -> DataFrame:
    """Mean of the last quarter of each run, rounded to 4.

    A run shorter than ``parts`` uses all of its rows, as a slice from -0 would.
    """
    take = F.floor(F.col("n") / parts)
    take = F.when(take == 0, F.col("n")).otherwise(take)
    tail = positioned(df).where(F.col("pos") >= F.col("n") - take)
    return tail.groupBy("run").agg(py_round(F.avg("value"), 4).alias("tail_mean"))


def moving_average(df: DataFrame, width: int = 25, block: int = BLOCK) -> DataFrame:
    """Centred moving average; beyond the ends the edge value is repeated."""
    left = width // 2
    right = width - 1 - left
    p = positioned(df)
    edges = df.groupBy("run").agg(
        F.min_by("value", "step").alias("_first"), F.max_by("value", "step").alias("_last")
    )
    b = F.floor(F.col("pos") / block)
    inner = F.col("pos") % block
    # a row near a block border is also sent to the neighbour block
    homes = F.array_compact(F.array(
        b,
        F.when((inner < right) & (b > 0), b - 1),
        F.when(inner >= block - left, b + 1),
    ))
    rows = p.withColumn("_own", b).withColumn("_b", F.explode(homes))
    w = W.partitionBy("run", "_b").orderBy("pos").rowsBetween(-left, right)
    summed = rows.withColumn("_s", F.sum("value").over(w)).where("_b = _own").join(edges, "run")
    low = F.greatest(F.lit(left) - F.col("pos"), F.lit(0))
    high = F.greatest(F.col("pos") + right - (F.col("n") - 1), F.lit(0))
    avg = (F.col("_s") + low * F.col("_first") + high * F.col("_last")) / float(width)
    return summed.select("run", "step", "pos", "value", avg.alias("moving_average"))


def epoch_marks(df: DataFrame, run: str, epoch: str, size: Column) -> DataFrame:
    """Running total of batches at each epoch end (epochs of a run are few)."""
    per = df.groupBy(run, epoch).agg(size.alias("batches"))
    w = W.partitionBy(run).orderBy(epoch).rowsBetween(W.unboundedPreceding, 0)
    return per.withColumn("epoch_end", F.sum("batches").over(w))


def epoch_table(df: DataFrame) -> DataFrame:
    """Loss and accuracy per (run, epoch), rounded to 4."""
    return df.groupBy("run", "epoch").agg(
        py_round(F.avg("loss"), 4).alias("loss"), py_round(F.avg("acc"), 4).alias("acc")
    )


def best_epochs(epochs: DataFrame) -> DataFrame:
    """Epoch with the least loss and with the best accuracy, the first on ties."""
    return epochs.groupBy("run").agg(
        F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"),
        F.min("loss").alias("best_loss"),
        F.min_by("epoch", F.struct((-F.col("acc")).alias("a"), F.col("epoch"))).alias("best_acc_epoch"),
        F.max("acc").alias("best_acc"),
    )
