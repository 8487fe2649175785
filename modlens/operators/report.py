"""Comparison tables over many runs.

Metrics come in long form ``run, dataset, precision, recall, f_beta, specificity``
(or ``run, topic, recall``).  A report row has a ``row_kind``: ``run``, ``baseline``,
``Average`` or ``Median``, so nothing depends on row positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.functions import text as T
from modlens.functions.numbers import f_beta, py_round

BASELINE = "Primary"


def _kind(run: Column) -> Column:
    return F.when(run == BASELINE, "baseline").otherwise("run")


def _summary(wide: DataFrame, values: Sequence[str], skip_baseline: bool) -> DataFrame:
    base = wide.where("row_kind <> 'baseline'") if skip_baseline else wide
    # one aggregate over the report rows; no column depends on data size
    both = base.agg(*[F.avg(c).alias(f"a_{c}") for c in values], *[F.median(c).alias(f"m_{c}") for c in values])
    rows = F.array(*[
        F.struct(F.lit(name).alias("run"), F.lit(name).alias("row_kind"), *[F.col(f"{p}_{c}").alias(c) for c in values])
        for name, p in (("Average", "a"), ("Median", "m"))
    ])
    return both.select(F.explode(rows).alias("_r")).select("_r.*")


def with_summary(wide: DataFrame, skip_baseline: bool = False) -> DataFrame:
    """Append Average and Median rows."""
    values = [c for c in wide.columns if c not in ("run", "row_kind")]
    return wide.select("run", "row_kind", *values).unionByName(_summary(wide, values, skip_baseline))


def wide_report(
    metrics: DataFrame, names: Sequence[str] = ("precision", "recall", "f_beta", "specificity"),
    beta: float | None = None, datasets: Sequence[str] = C.DATASETS,
    summary: bool = True, skip_baseline: bool = False,
) -> DataFrame:
    """One row per run, one column per metric and dataset (``precision_J`` ...).

    With ``beta`` the F column is computed again from the (rounded) rates.
    """
    if beta is not None:
        metrics = metrics.withColumn("f_beta", f_beta(F.col("precision"), F.col("recall"), beta))
    cells = [
        F.max(F.when(F.col("dataset") == d, F.col(m))).alias(f"{m}_{C.DATASET_ACRONYMS[d]}")
        for d in datasets for m in names
    ]
    wide = metrics.groupBy("run").agg(*cells).withColumn("row_kind", _kind(F.col("run")))
    return with_summary(wide, skip_baseline) if summary else wide


def topic_report(metrics: DataFrame, topics: Sequence[str] = (*C.TOPICS, "mean"), summary: bool = True) -> DataFrame:
    """Recall per topic, one row per run."""
    cells = [F.max(F.when(F.col("topic") == t, F.col("recall"))).alias(t) for t in topics]
    wide = metrics.groupBy("run").agg(*cells).withColumn("row_kind", _kind(F.col("run")))
    return with_summary(wide) if summary else wide


def format_report(wide: DataFrame, digits: int = 4) -> DataFrame:
    """All numbers as text with fixed decimals."""
    values = [c for c in wide.columns if c not in ("run", "row_kind")]
    fmt = f"%.{digits}f"
    return wide.select("run", "row_kind", *[
        F.when(F.col(c).isNotNull(), F.format_string(fmt, py_round(F.col(c), digits))).alias(c) for c in values
    ])


def melt(wide: DataFrame, values: Sequence[str] | None = None) -> DataFrame:
    """Long form: run, row_kind, score, value."""
    values = list(values or [c for c in wide.columns if c not in ("run", "row_kind")])
    return wide.unpivot(["run", "row_kind"], values, "score", "value")


def only_runs(wide: DataFrame, baseline: bool = False) -> DataFrame:
    """Without summary rows (and without the baseline unless asked for)."""
    kinds = ["run", "baseline"] if baseline else ["run"]
    return wide.where(F.col("row_kind").isin(kinds))


def group_means(long: DataFrame) -> DataFrame:
    """Mean of each score column over the runs, baseline left out."""
    return long.where("row_kind = 'run'").groupBy("score").agg(F.avg("value").alias("mean"))


def ordered_group_means(long: DataFrame, order: Sequence[str]) -> DataFrame:
    """Group means with the position of each score column in the report."""
    pos = F.element_at(F.create_map(*[F.lit(v) for i, n in enumerate(order) for v in (n, i)]), F.col("score"))
    return group_means(long).withColumn("position", pos)


def trend(long: DataFrame, x: str = "ratio", y: str = "value", group: str = "score") -> DataFrame:
    """Least-squares line and trend word per group."""
    slope = F.regr_slope(y, x)
    fit = long.groupBy(group).agg(slope.alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    r = py_round(F.col("slope"), 4)
    word = F.when(r == 0, "neutral").when(F.col("slope") > 0, "positive").otherwise("negative")
    return fit.withColumn("trend", word)


def score_vs_ratio(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Points (ratio, value) with the baseline value and the fitted line."""
    long = melt(only_runs(wide, baseline=True), columns)
    base = long.where("row_kind = 'baseline'").select("score", F.col("value").alias("baseline"))
    points = long.where("row_kind = 'run'").withColumn("ratio", T.ratio_value(F.col("run")))
    fit = trend(points)
    return points.join(F.broadcast(fit), "score").join(F.broadcast(base), "score", "left").select(
        "run", "score", "ratio", "value", "baseline", "slope", "intercept", "trend"
    )


def topic_recall_series(wide: DataFrame) -> DataFrame:
    """Topic recall against ratio."""
    return melt(only_runs(wide)).select(
        F.col("score").alias("topic"), T.ratio_value(F.col("run")).alias("ratio"), F.col("value").alias("recall")
    )


def auc_table(per_class: DataFrame, datasets: Sequence[str] = ("jigsaw", "secondary_neutral")) -> DataFrame:
    """Class AUC of two datasets side by side with their means; missing -> 0."""
    clean = per_class.withColumn("auc", F.nanvl("auc", F.lit(None)))
    mean = clean.groupBy("dataset").agg(F.avg("auc").alias("auc")).withColumn("label", F.lit("mean_auc"))
    both = clean.unionByName(mean).where(F.col("dataset").isin(list(datasets)))
    cells = [py_round(F.coalesce(F.max(F.when(F.col("dataset") == d, F.col("auc"))), F.lit(0.0)), 4).alias(d) for d in datasets]
    return both.groupBy("label").agg(*cells)


def dataset_scores(metrics: DataFrame) -> DataFrame:
    """Long table dataset, score, value of precision, recall and F."""
    return metrics.unpivot(["dataset"], ["precision", "recall", "f_beta"], "score", "value")


def model_comparison(wide: DataFrame) -> DataFrame:
    names = [c for c in wide.columns if c not in ("run", "row_kind", "precision_SP", "specificity_SP")]
    return melt(only_runs(wide, baseline=True), names).select("run", F.col("score").alias("metric"), "value")


# --- cell flags -------------------------------------------------------------------


def _unless(skip: Sequence[str], hit: Column) -> Column:
    """Never in a skipped column; a cell without a value is no extreme."""
    return F.coalesce(hit, F.lit(False)) & ~F.col("score").isin(list(skip))


def flag_extremes(long: DataFrame, skip: Sequence[str] = ("precision_SP",)) -> DataFrame:
    """Best and worst cells of every column but the skipped ones; all ties are flagged."""
    w = W.partitionBy("score")
    return long.withColumn("is_max", _unless(skip, F.col("value") == F.max("value").over(w))).withColumn(
        "is_min", _unless(skip, F.col("value") == F.min("value").over(w))
    )


def flag_extremes_without_baseline(
    long: DataFrame, skip: Sequence[str] = ("specificity_J", "precision_SP")
) -> DataFrame:
    """As above, but the baseline cell is never flagged.

    Where the baseline holds the extreme, the best of the other rows is flagged: one
    row (the first run by name) next to any other row that ties with the baseline.
    """
    w = W.partitionBy("score")
    rest = F.when(F.col("row_kind") != "baseline", F.col("value"))
    base = F.max(F.when(F.col("row_kind") == "baseline", F.col("value"))).over(w)
    out = long
    for name, fn, order in (
        ("max", F.max, F.desc_nulls_last("value")), ("min", F.min, F.asc_nulls_last("value"))
    ):
        top = fn("value").over(w)
        second = F.row_number().over(
            W.partitionBy("score").orderBy((F.col("row_kind") == "baseline").cast("int"), order, "run")
        )
        plain = (F.col("value") == top) & rest.isNotNull()
        out = out.withColumn(f"is_{name}", _unless(skip, plain | ((base == top) & (second == 1) & rest.isNotNull())))
    return out


def flag_extremes_in_groups(
    long: DataFrame, position: str = "position", size: int = 3, skip: Sequence[str] = ("precision_SP",)
) -> DataFrame:
    """Column extremes, and extremes of each block of ``size`` rows after the baseline."""
    w = W.partitionBy("score")
    block = F.floor((F.col(position) - 1) / size)
    b = W.partitionBy("score", block)
    live = F.col(position) >= 1
    out = long
    for name, fn in (("max", F.max), ("min", F.min)):
        hit = (F.col("value") == fn("value").over(w)) | (F.col("value") == fn("value").over(b))
        out = out.withColumn(f"is_{name}", _unless(skip, hit & live))
    return out
