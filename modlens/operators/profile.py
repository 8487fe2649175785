"""Corpus profiling: counts, shares, frequencies, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.functions import text as T
from modlens.functions.labels import bits, label_array, pattern_of
from modlens.functions.numbers import bucket_label, histogram_bin, percent_bucket, py_round


def kept_report(df: DataFrame, kept: Column) -> DataFrame:
    """Rows, kept rows, dropped rows and the kept percentage, in one pass."""
    n, k = F.count("*"), F.count_if(kept)
    return df.agg(
        n.alias("n"), k.alias("kept"), (n - k).alias("dropped"),
        F.when(n > 0, k / n.cast("double") * 100).alias("kept_percent"),
    )


def schema_profile(df: DataFrame) -> DataFrame:
    """Column name, type and non-null count."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    items = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(t).alias("column_type"),
                 F.col(c).alias("non_null"))
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return counts.select(F.explode(F.array(*items)).alias("_i")).select("_i.*")


def date_range(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.min(date).alias("earliest"), F.max(date).alias("latest"))


def language_report(df: DataFrame, lang: str = "lang", wanted: str = "en") -> DataFrame:
    """Distinct languages, their sorted list and the share of one of them."""
    per = df.groupBy(lang).agg(F.count("*").alias("n"))
    total = F.sum("n")
    return per.agg(
        F.count(lang).alias("n_languages"),
        F.array_join(F.sort_array(F.collect_list(lang)), ",").alias("languages"),
        py_round(F.sum(F.when(F.col(lang) == wanted, F.col("n")).otherwise(0)) / total.cast("double") * 100, 2).alias("wanted_percent"),
    )


def top_items(df: DataFrame, items: Column, n: int, name: str = "item") -> DataFrame:
    """Most frequent elements of an array column, ties by name."""
    counts = df.select(F.explode(items).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(name)).limit(n)


def top_hashtags(df: DataFrame, text: str = "text", n: int = 25) -> DataFrame:
    return top_items(df, T.hashtags(F.col(text)), n, "hashtag")


def top_mentions(df: DataFrame, text: str = "text", n: int = 10) -> DataFrame:
    return top_items(df, T.mentions(F.col(text)), n, "mention")


def top_words(df: DataFrame, text: str = "text", n: int = 20, min_length: int = 3) -> DataFrame:
    return top_items(df, T.drop_words(T.words(F.col(text), min_length), C.STOP_WORDS), n, "word")


def keyword_counts(df: DataFrame, text: str, keyword: str, group: str = "dataset") -> DataFrame:
    """Rows that contain the keyword pattern (case matters), per group."""
    return df.groupBy(group).agg(F.count_if(F.col(text).rlike(keyword)).alias("n"))


def label_sums(df: DataFrame, group: str = "dataset") -> DataFrame:
    """Positive count and percentage of each label per group, long form."""
    sums = df.groupBy(group).agg(F.count("*").alias("_n"), *[F.sum(l).alias(l) for l in C.LABELS])
    long = sums.unpivot([group, "_n"], list(C.LABELS), "label", "positives")
    return long.select(group, "label", "positives", (F.col("positives") / F.col("_n").cast("double") * 100).alias("percent"))


def _share_rows(df: DataFrame, hit: Column, group: str) -> DataFrame:
    n, k = F.count("*"), F.count_if(hit)
    return df.groupBy(group).agg(k.alias("n"), (k / n.cast("double") * 100).alias("percent"))


def at_least_one(df: DataFrame, group: str = "dataset") -> DataFrame:
    return _share_rows(df, F.greatest(*[F.col(l) for l in C.LABELS]) == 1, group)


def all_zero(df: DataFrame, group: str = "dataset") -> DataFrame:
    cols = [F.col(l) for l in C.LABELS]
    return _share_rows(df, (F.greatest(*cols) == 0) & (F.least(*cols) == 0), group)


def pattern_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(bits(label_array()).alias("pattern")).agg(F.count("*").alias("n"))


def all_patterns(df: DataFrame) -> DataFrame:
    """All 64 label patterns with their counts, 0 for unused ones."""
    codes = df.sparkSession.range(64).select(
        pattern_of(F.col("id")).alias("pattern"), F.col("id").cast("int").alias("code")
    )
    # at most 64 counted patterns of 0/1 labels
    return codes.join(F.broadcast(pattern_counts(df)), "pattern", "left").na.fill(0, ["n"])


def unused_patterns(df: DataFrame) -> DataFrame:
    return all_patterns(df).where("n = 0").select("pattern", "code")


def split_shares(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split and their share, rounded to whole percent as a fraction of 1."""
    per = df.groupBy(split).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy())       # one row per split
    return per.select(split, "n", (py_round(F.col("n") / total.cast("double"), 2) * 100).alias("percent"))


def growth_table(old: DataFrame, new: DataFrame, group: str = "topic", digits: int = 2) -> DataFrame:
    """Previous and new row counts per group, the change and its ratio (null for a new group)."""
    a = old.groupBy(group).agg(F.count("*").alias("previous"))
    b = new.groupBy(group).agg(F.count("*").alias("new"))
    change = F.col("new") - F.col("previous")
    return a.join(b, group, "full").na.fill(0, ["previous", "new"]).select(
        group, "previous", "new", change.alias("change"),
        F.when(F.col("previous") > 0, py_round(change / F.col("previous").cast("double"), digits)).alias("per_element"),
    )


def mean_length(df: DataFrame, text: str, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(F.avg(F.length(text)).alias("mean_length"))


def corpus_characters(df: DataFrame, text: str) -> DataFrame:
    """Length of all texts joined by single spaces."""
    return df.agg((F.coalesce(F.sum(F.length(text)), F.lit(0)) + F.greatest(F.count(text) - 1, F.lit(0))).alias("characters"))


def longest(df: DataFrame, text: str, key: str, n: int = 10) -> DataFrame:
    return df.select(key, F.length(text).alias("length")).orderBy(F.desc("length"), F.asc(key)).limit(n)


def bucket_counts(long: DataFrame, buckets: int = 7) -> DataFrame:
    """Seven-bucket score histogram per label, empty buckets included."""
    per = long.groupBy("label", percent_bucket(F.col("score"), buckets).alias("bucket")).agg(F.count("*").alias("n"))
    grid = per.select("label").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return (
        grid.join(per, ["label", "bucket"], "left").na.fill(0, ["n"])
        .withColumn("range", bucket_label(F.col("bucket"), buckets))
    )


def score_histogram(long: DataFrame, bins: int) -> DataFrame:
    """Histogram over [0, 1] per label and over all labels (label ``ALL``)."""
    inside = long.where(F.col("score").between(0, 1))
    binned = inside.groupBy("label", histogram_bin(F.col("score"), bins).alias("bin")).agg(F.count("*").alias("n"))
    both = binned.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("label", F.lit("ALL"))
    return binned.unionByName(both)


def scores_by_label(long: DataFrame) -> DataFrame:
    """Size, sum and range of the scores of each label (the lists stay in the long table)."""
    return long.groupBy("label").agg(
        F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.avg("score").alias("mean")
    )


def above_thresholds(long: DataFrame, key: str = "text_id", thresholds: Sequence[float] = C.TWEET_THRESHOLDS) -> DataFrame:
    """Texts with a score above each threshold, and their percentage."""
    top = long.groupBy(key).agg(F.max("score").alias("top"))
    n = F.count("*").cast("double")
    agg = top.agg(n.alias("_n"), *[F.count_if(F.col("top") > t).alias(f"_{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("n")) for i, t in enumerate(thresholds)])
    return agg.select("_n", F.explode(rows).alias("_r")).select(
        "_r.*", py_round(F.col("_r.n") / F.col("_n") * 100, 2).alias("percent")
    )


def cleaning_report(df: DataFrame, text: str, english: Column, kept: Column, final: DataFrame, final_text: str,
                    parity: bool = False) -> DataFrame:
    """Mean lengths before cleaning and of the ``final`` texts (newline counted), and the change.

    ``parity`` divides the English total by the kept rows instead of the English rows.
    """
    size = F.length(text) + 1
    n, n_en, n_kept = F.count("*"), F.count_if(english), F.count_if(kept)
    den = n_kept if parity else n_en
    before = df.agg(
        n.alias("n"), n_en.alias("n_english"), n_kept.alias("n_kept"),
        py_round(F.sum(size) / n.cast("double"), 2).alias("mean_before"),
        F.when(den > 0, py_round(F.sum(F.when(english, size)) / den.cast("double"), 2)).alias("mean_before_english"),
    )
    n_final = F.count("*")
    after = final.agg(
        n_final.alias("n_final"),
        F.when(n_final > 0, py_round(F.sum(F.length(final_text) + 1) / n_final.cast("double"), 2)).alias("mean_after"),
    )
    change = F.lit(100.0) * (F.col("mean_before") - F.col("mean_after")) / F.col("mean_before")
    # one row each
    return before.join(after, how="cross").withColumn("percent_change", py_round(change, 1))
