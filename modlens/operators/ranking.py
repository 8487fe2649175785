"""Global positions, running totals and exact hash samples without a hot task.

Spark evaluates a window in one task per partition key.  With few groups (labels,
runs, datasets) or none at all that task would hold the whole table, so every
operator that needs a rank over data-sized groups goes through this module: rows
are dealt by range along the order, partition totals are summed over a small
table, and only the rows inside one partition are sorted together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modlens.functions.text import shuffle_key
from modlens.session import cut_lineage


def prefix_sums(df: DataFrame, groups: Sequence[str], order: str, values: Mapping[str, Column]) -> DataFrame:
    """Add inclusive running totals ``values`` along ``order`` inside each group.

    A prefix scan over a range partition: rows are dealt by (groups, order), so that every
    partition is one stretch of the order, as large as any other, whatever a group holds;
    they are written with the number of their partition.  Partition totals are summed along
    the numbers, one row per partition and group in it, and joined back as offsets; rows are
    sorted inside their partition alone.  The number of partitions is the session's.

    ``order`` is unique inside a group (aggregate ties first); a null group is a group.
    """
    names = list(groups)
    for name, value in values.items():
        df = df.withColumn(f"_v_{name}", value)
    dealt = df.repartitionByRange(*names, order).withColumn("_p", F.spark_partition_id())
    ranged = cut_lineage(dealt, "ranged")
    totals = ranged.groupBy(*names, "_p").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = W.partitionBy(*names).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_p").alias("_q"), *[F.col(g).alias(f"_g_{g}") for g in names],
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    same = [F.col("_p") == F.col("_q"), *[F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in names]]
    inside = W.partitionBy(*names, "_p").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.join(offsets, same)
    for n in values:
        out = out.withColumn(n, F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(inside))
    return out.drop("_p", "_q", *[f"_g_{g}" for g in names], *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


def with_position(df: DataFrame, order: str, groups: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """0-based position of each row along a unique ``order``."""
    out = prefix_sums(df, groups, order, {name: F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col(name) - 1)


def file_position(df: DataFrame, name: str = "row_index") -> DataFrame:
    """0-based position of each row of a file scan, in file order.

    Rows are ordered by file path, split start and place inside the split, which is
    the order a sequential reader sees.  A window partition is one input split, so it
    never exceeds ``spark.sql.files.maxPartitionBytes``.
    """
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_s"),
        F.monotonically_increasing_id().alias("_m"),
    )
    sizes = tagged.groupBy("_f", "_s").agg(F.count("*").alias("_n"))
    # one row per input split: split metadata, not data
    before = W.orderBy("_f", "_s").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_f", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")
    )
    inside = W.partitionBy("_f", "_s").orderBy("_m")
    return (
        tagged.join(offsets, ["_f", "_s"])
        .withColumn(name, F.col("_o") + F.row_number().over(inside) - 1)
        .drop("_f", "_s", "_m", "_o")
    )


def _hashes(df: DataFrame, keys: Sequence[str], groups: Sequence[str], seed: int) -> DataFrame:
    """Group, hash and hash range of every row; only the keys are read."""
    g = list(groups) or [F.lit(1).alias("_all")]
    h = shuffle_key(*[F.col(k) for k in keys], seed=seed)
    return df.select(*g, h.alias("_h")).withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))


def hash_histogram(df: DataFrame, keys: Sequence[str], groups: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Rows of each group in each of 65,536 hash ranges, written: the group sizes are its sums."""
    gn = list(groups) or ["_all"]
    return cut_lineage(_hashes(df, keys, groups, seed).groupBy(*gn, "_b").agg(F.count("*").alias("_n")), "histogram")


def hash_cut(
    df: DataFrame,
    size: Callable[[Column], Column],
    keys: Sequence[str],
    groups: Sequence[str] = (),
    seed: int = 42,
    hist: DataFrame | None = None,
) -> DataFrame:
    """Hash value up to which a group's first ``size(total)`` rows in hash order lie.

    Returns ``groups, _cut, _ties``: one row per group (no row where the size is 0); of the
    rows whose hash equals the cut ``_ties`` belong, as keys may repeat.  Only the keys are read.
    A histogram over 65,536 hash ranges (``hist`` if it is there already) finds the range of the
    last row, and just that range is sorted, so no task sees a whole group.
    """
    groups = list(groups)
    gn = groups or ["_all"]
    small = _hashes(df, keys, groups, seed)
    if hist is None:
        hist = small.groupBy(*gn, "_b").agg(F.count("*").alias("_n"))
    run = W.partitionBy(*gn).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("_n").over(W.partitionBy(*gn))
    hist = (
        hist.withColumn("_cum", F.sum("_n").over(run))
        .withColumn("_size", F.least(size(total).cast("bigint"), total))
    )
    edge = hist.where((F.col("_cum") >= F.col("_size")) & (F.col("_cum") - F.col("_n") < F.col("_size")))
    edge = edge.select(*gn, "_b", (F.col("_size") - F.col("_cum") + F.col("_n")).alias("_need"))
    # one row per group each, written so that joins with them go by their real size
    edge = cut_lineage(edge, "edge")
    # equal hashes are one row here, however often their key repeats
    ties = small.join(edge, [*gn, "_b"]).groupBy(*gn, "_need", "_h").agg(F.count("*").alias("_n"))
    upto = W.partitionBy(*gn).orderBy("_h").rowsBetween(W.unboundedPreceding, 0)
    cut = (
        ties.withColumn("_cum", F.sum("_n").over(upto))
        .where((F.col("_cum") >= F.col("_need")) & (F.col("_cum") - F.col("_n") < F.col("_need")))
        .select(*groups, F.col("_h").alias("_cut"), (F.col("_need") - F.col("_cum") + F.col("_n")).alias("_ties"))
    )
    return cut_lineage(cut, "cut")


def mark_first(df: DataFrame, cut: DataFrame, keys: Sequence[str], groups: Sequence[str], seed: int) -> DataFrame:
    """Add ``_in``: whether a row is among its group's rows up to the cut, ties counted out.

    Rows at the cut itself (one, unless its key repeats) are numbered by their place in the
    task that wrote them plus the rows of the tasks before, so no task sees all copies of a key.
    """
    groups = list(groups)
    h = shuffle_key(*[F.col(k) for k in keys], seed=seed)
    both = (df.join(cut, groups, "left") if groups else df.join(cut, how="left")).withColumn("_h", h)
    plain = both.where(~F.col("_h").eqNullSafe(F.col("_cut"))).withColumn("_in", F.coalesce(F.col("_h") < F.col("_cut"), F.lit(False)))
    at = cut_lineage(both.where(F.col("_h") == F.col("_cut")).withColumn("_p", F.spark_partition_id()), "ties")
    per = at.groupBy(*groups, "_p").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*groups).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)    # one row a task
    per = per.select(*groups, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(W.partitionBy(*groups, "_p").orderBy("_h"))
    numbered = at.join(per, [*groups, "_p"]).withColumn("_in", F.col("_o") + place <= F.col("_ties"))
    return plain.drop("_h", "_cut", "_ties").unionByName(numbered.drop("_h", "_cut", "_ties", "_p", "_o"))


def hash_sample(
    df: DataFrame,
    size: int | Column | Callable[[Column], Column],
    keys: Sequence[str],
    groups: Sequence[str] = (),
    seed: int = 42,
) -> DataFrame:
    """Exactly ``size`` rows (per group), repeatable, capped at what is there.

    ``keys`` decide the order; they may repeat.  With few groups (datasets, topics) the cuts
    are broadcast and the rows are not shuffled: each is kept or dropped by comparing its
    hash with the group's cut.
    """
    fn = size if callable(size) and not isinstance(size, Column) else (
        lambda total: size if isinstance(size, Column) else F.lit(size)
    )
    cut = hash_cut(df, fn, keys, groups, seed)
    return mark_first(df, cut, keys, groups, seed).where("_in").select(*df.columns)


def share_of(fraction: float) -> Callable[[Column], Column]:
    """Size rule: the fraction of a group, rounded half to even."""
    return lambda total: F.bround(total.cast("double") * float(fraction), 0)
