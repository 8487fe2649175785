"""Evaluation, threshold search, checkpoint choice and run reports, from files to files."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.functions.labels import label_array
from modlens.functions.text import results_path
from modlens.operators import metrics as M
from modlens.operators import report as R
from modlens.operators.mixing import load_dataset
from modlens.operators.series import best_epochs
from modlens.sources.readers import read_epochs, read_results
from modlens.sources.sinks import write_json

Tables = Mapping[str, Mapping[str, DataFrame]]


def write_document(text: DataFrame, path: str) -> str:
    """One JSON text as a file of its own below ``path``."""
    text.coalesce(1).write.text(path)
    return path


def path_beside(spark: SparkSession, checkpoint: str, suffix: str) -> str:
    """Where the results of a checkpoint go."""
    return spark.range(1).select(results_path(F.lit(checkpoint), suffix)).first()[0]


def scored_sets(tables: Tables, mode: str, score: Callable[[Column], Column], text: str = "comment_text") -> DataFrame:
    """The labelled sets a mode loads, scored: ``dataset, topic, target, score``."""
    out = None
    for name in C.DATASETS if mode == "TEST" else ("jigsaw",):
        d = load_dataset(tables, mode, name)
        topic = F.col("topic") if "topic" in d.columns else F.lit(None).cast("string")
        d = d.select(F.lit(name).alias("dataset"), topic.alias("topic"), label_array().alias("target"), score(F.col(text)).alias("score"))
        out = d if out is None else out.unionByName(d)
    return out


def evaluate_job(scored: DataFrame, threshold: float, checkpoint: str, suffix: str = "j", multi_label: bool = True) -> str:
    """Evaluate the scored test sets and write the document beside the checkpoint; returns its path."""
    doc = M.evaluation_document(scored, threshold, multi_label)
    return write_document(M.evaluation_json(doc), path_beside(scored.sparkSession, checkpoint, suffix))


def search_threshold(swept: DataFrame, limit: float = 0.9) -> float:
    """First threshold with precision above the limit, else the first with the best precision.

    One number comes back to the driver.
    """
    best = swept.agg(F.max("precision").alias("best"))
    wanted = F.when(F.col("best") > limit, F.col("precision") > limit).otherwise(F.col("precision") == F.col("best"))
    found = swept.crossJoin(F.broadcast(best)).where(wanted).agg(F.min("threshold")).first()[0]    # one row joined
    if found is None:
        raise ValueError("no validation rows to search a threshold on")
    return found


def search_then_evaluate(
    validation: DataFrame, test: DataFrame, checkpoint: str, limit: float = 0.9, multi_label: bool = True
) -> tuple[float, str, str]:
    """Sweep the primary validation set, choose a threshold, evaluate the test sets at it.

    Writes the sweep and the result document; returns the threshold and both paths.
    """
    primary = validation.where(F.col("dataset") == "jigsaw")
    triggers = tuple(C.TOPIC_TRIGGERS.values()) if multi_label else (C.TRIGGER,)
    swept = M.threshold_sweep(primary, triggers=triggers)
    sweep = write_document(M.sweep_json(swept), path_beside(primary.sparkSession, checkpoint, "threshold"))
    chosen = search_threshold(swept, limit)
    return chosen, sweep, evaluate_job(test, chosen, checkpoint, multi_label=multi_label)


def run_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per (run, dataset) rates for the report tables."""
    return M.flag_scores(scored, threshold, ["run", "dataset"], tuple(C.TOPIC_TRIGGERS.values()))


def experiment_report(spark: SparkSession, path: str) -> DataFrame:
    """Both comparison tables over the result documents below a folder, in long form.

    ``table`` is ``datasets`` (the positive set by its mean over the topics where it is
    nested) or ``topics``; Average and Median rows included, best and worst cells flagged.
    """
    results = read_results(spark, path).where("error is null and threshold is null")
    flat = results.where("topic is null or topic = 'mean'")
    tables = {"datasets": R.wide_report(flat), "topics": R.topic_report(results.where("topic is not null"))}
    out = None
    for name, wide in tables.items():
        long = R.flag_extremes_without_baseline(R.melt(wide)).withColumn("table", F.lit(name))
        out = long if out is None else out.unionByName(long)
    return out


def choose_checkpoint(spark: SparkSession, path: str, summary: str) -> DataFrame:
    """Every epoch of the validation lists below a folder, with the one of least loss marked.

    The table is written to ``summary`` as JSON lines and read from there.
    """
    epochs = read_epochs(spark, path).withColumn("run", F.regexp_extract("file", "run=([^/]+)", 1))
    best = best_epochs(epochs).select("run", "best_epoch", "best_acc_epoch")       # one row a run
    marked = epochs.join(best, "run").select(
        "run", "epoch", "loss", "acc", (F.col("epoch") == F.col("best_epoch")).alias("best_loss"),
        (F.col("epoch") == F.col("best_acc_epoch")).alias("best_acc"))
    write_json(marked, summary)
    return spark.read.schema(marked.schema).json(summary)
