"""Weak labels, topic labels and training mixes end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.functions.models import lexicon_scorer, zero_shot
from modlens.operators.metrics import accuracy_columns, bce_terms
from modlens.operators.weaklabel import route, topic_positives


def weak_label_job(scores: DataFrame, threshold: float = 0.8, scorer=None) -> DataFrame:
    """``text, scores MAP`` -> labelled rows with ``dataset``."""
    return route(scores, "text", "scores", scorer or lexicon_scorer(), threshold)


def weak_label_report(labelled: DataFrame) -> DataFrame:
    per = labelled.groupBy("dataset").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n")).scalar()
    return per.select("dataset", "n", (F.col("n") / total.cast("double") * 100).alias("percent"))


def topic_label_job(df: DataFrame, text: str, threshold: float = 0.9, score=None) -> DataFrame:
    """Texts x topic sentences, scored, thresholded, labelled."""
    return topic_positives(zero_shot(df, text, list(C.TOPIC_CANDIDATES.items()), score), text, threshold)


def score_rows(df: DataFrame, score: Callable[[Column], Column], text: str = "comment_text") -> DataFrame:
    """Rows with ``score`` from a batch model's probabilities, and the ``logit`` they stand for."""
    scored = df.withColumn("score", score(F.col(text)))
    return scored.withColumn("logit", F.transform("score", lambda p: F.log(p / (1.0 - p))))


def baseline_report(scored: DataFrame, parity: bool = False) -> DataFrame:
    """Loss and accuracies of a model over a table with target, logit and score.

    ``parity`` keeps two quirks: probabilities go into the logit loss, and the exact
    accuracy is divided by the label count.
    """
    acc = accuracy_columns(0.5)
    x = F.col("score") if parity else F.col("logit")
    exact = F.avg(acc["exact"]) / (len(C.LABELS) if parity else 1)
    return scored.agg(
        F.avg(bce_terms(x, F.col("target"))).alias("loss"), exact.alias("acc"), F.avg(acc["flag"]).alias("acc_flag")
    )
