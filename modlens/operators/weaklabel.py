"""Turning label scores into weak training labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.functions.numbers import half_even
from modlens.functions.text import hex_id


def with_candidates(df: DataFrame, candidates: Sequence[tuple[str, str]]) -> DataFrame:
    """Every text with every (topic, sentence): an explode of a literal list, not a join."""
    items = F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(s).alias("label")) for t, s in candidates])
    return df.select("*", F.explode(items).alias("_c")).select(*df.columns, "_c.*")


def any_at_least(long: DataFrame, key: str, threshold: float, strict: bool = False) -> DataFrame:
    """Keys with some score at (or, strict, above) the threshold, from the long table."""
    top = long.groupBy(key).agg(F.max("score").alias("top"))
    return top.where(F.col("top") > threshold if strict else F.col("top") >= threshold)


def any_in_map(scores: Column, threshold: float, strict: bool = False) -> Column:
    """The same test on a MAP column."""
    if strict:
        return F.exists(F.map_values(scores), lambda s: s > threshold)
    return F.exists(F.map_values(scores), lambda s: s >= threshold)


def first_in_map(scores: Column, threshold: float) -> Column:
    return F.element_at(F.map_values(scores), 1) >= threshold


def labelled(df: DataFrame, text: str, labels: Mapping[str, Column]) -> DataFrame:
    """The labelled-table shape: id, comment_text and six labels."""
    return df.select(
        hex_id(F.col(text)).alias("id"), F.col(text).alias("comment_text"),
        *[labels[l].cast("int").alias(l) for l in C.LABELS],
    )


def route(
    df: DataFrame, text: str, scores: str, scorer, threshold: float = 0.8, trigger: str = C.TRIGGER
) -> DataFrame:
    """Positive rows get the trigger labels, the others the scorer's rounded labels.

    The table is split before scoring, so the scorer only sees the neutral rows.
    ``scorer(df, text) -> df`` adds one double column per label.
    """
    hit = any_in_map(F.col(scores), threshold)
    pos = labelled(df.where(hit), text, {l: F.lit(int(trigger[i])) for i, l in enumerate(C.LABELS)})
    neg = relabel(df.where(~hit).select(text), text, scorer)
    return pos.withColumn("dataset", F.lit("secondary_positive")).unionByName(
        neg.withColumn("dataset", F.lit("secondary_neutral"))
    )


def relabel(df: DataFrame, text: str, scorer, aliases: Mapping[str, str] = C.LABEL_ALIASES) -> DataFrame:
    """Label texts by the scorer's scores, rounded half to even."""
    scored = scorer(df, text)
    for old, new in aliases.items():
        if old in scored.columns:
            scored = scored.withColumnRenamed(old, new)
    return labelled(scored, text, {l: half_even(F.col(l)) for l in C.LABELS})


def topic_positives(long: DataFrame, text: str, threshold: float = 0.9, trigger: str = C.TRIGGER) -> DataFrame:
    """Positive rows of every topic in one pass (one candidate sentence per topic)."""
    hit = long.where(F.col("score") >= threshold)
    return hit.select(
        hex_id(F.col(text)).alias("id"), F.col(text).alias("comment_text"), "topic",
        *[F.lit(int(trigger[i])).alias(l) for i, l in enumerate(C.LABELS)],
    )


def best_label(long: DataFrame, key: str = "text_id", mark: float = 0.9) -> DataFrame:
    """Best label of each text and its distance to the mark (ties: first label by name)."""
    best = F.min_by(F.struct("label", "score"), F.struct((-F.col("score")).alias("s"), F.col("label")))
    return long.groupBy(key).agg(best.alias("b")).select(
        key, F.col("b.label").alias("label"), F.col("b.score").alias("score"),
        (F.lit(mark) - F.col("b.score")).alias("margin"),
    )


def around_threshold(best: DataFrame, key: str = "text_id", n: int = 20) -> DataFrame:
    """The ``n`` texts closest to the mark on each side.

    ``row_number <= n`` lets Spark keep n rows per side in every task before the
    shuffle (window group limit).
    """
    side = F.when(F.col("margin") < 0, "above").otherwise("below")
    rank = F.row_number().over(W.partitionBy("side").orderBy(F.abs("margin"), key))
    return best.withColumn("side", side).withColumn("rank", rank).where(F.col("rank") <= n)


def best_topic(long: DataFrame, key: str = "text_id") -> DataFrame:
    """Most probable topic of each text (ties: first topic by name)."""
    best = F.min_by(F.struct("topic", "score"), F.struct((-F.col("score")).alias("s"), F.col("topic")))
    return long.groupBy(key).agg(best.alias("b")).select(
        key, F.col("b.topic").alias("topic"), F.col("b.score").alias("prob")
    )


def top_texts(assigned: DataFrame, key: str = "text_id", n: int = 20) -> DataFrame:
    """Top ``n`` texts of each topic and the topic's size.

    The size comes from its own aggregate, so the ranking can still be cut to n rows
    per task and topic before it is shuffled.
    """
    rank = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("prob"), key))
    top = assigned.withColumn("rank", rank).where(F.col("rank") <= n)
    sizes = assigned.groupBy("topic").agg(F.count("*").alias("topic_size"))
    return top.join(sizes, "topic")


def harden(df: DataFrame, threshold: float) -> DataFrame:
    """Threshold the six score columns to 0/1."""
    return df.withColumns({l: (F.col(l) >= threshold).cast("int") for l in C.LABELS})
