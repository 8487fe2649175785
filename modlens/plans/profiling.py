"""Corpus profile of a labelled table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.functions import text as T
from modlens.functions.labels import bits, label_array
from modlens.functions.numbers import py_round
from modlens.session import cut_lineage


def _rows(df: DataFrame, what: str, group, item, value: Column) -> DataFrame:
    return df.select(F.lit(what).alias("what"), group.alias("grp"), item.cast("string").alias("item"), value.cast("double").alias("value"))


def _words(df: DataFrame, text: str, group: str, n: int) -> DataFrame:
    words = df.select(group, F.explode(T.drop_words(T.words(F.col(text), 3), C.STOP_WORDS)).alias("word")).groupBy(group, "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "word"))
    return words.withColumn("rank", rank).where(F.col("rank") <= n)


def corpus_profile(
    df: DataFrame, keyword: str, text: str = "comment_text", key: str = "id", group: str = "dataset", topic: str = "topic",
    split: str = "split", n_words: int = 20, n_longest: int = 10,
) -> DataFrame:
    """All counts of a corpus as ``what, grp, item, value``.

    Rows, rows with a label and without (and their percent), mean length, all characters, each label's
    sum and percent, patterns in use and unused (with their number), split sizes and shares,
    growth of each topic from the splits before the test to all, rows with the keyword, most
    frequent words and longest texts.

    Two passes over the texts: one for words, one into cells of (group, topic, split, pattern),
    at most 64 per split and topic, from which all the rest is added up.
    """
    size = F.length(text)
    tagged = df.select(
        group, topic, split, F.col(key).alias("_key"), bits(label_array()).alias("pattern"), size.alias("_size"),
        F.col(text).rlike(keyword).alias("_hit"))
    narrow = cut_lineage(tagged, "narrow")
    cells = cut_lineage(narrow.groupBy(group, topic, split, "pattern").agg(
        F.count("*").alias("n"), F.sum("_size").alias("chars"), F.count("_size").alias("texts"), F.count_if("_hit").alias("hits")), "cells")
    zero = F.col("pattern") == "0" * len(C.LABELS)
    part = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))
    n = F.sum("n")
    label = {l: part(F.substring("pattern", i + 1, 1) == "1") for i, l in enumerate(C.LABELS)}
    per = cells.groupBy(group).agg(
        n.alias("rows"), part(~zero).alias("positive"), part(zero).alias("all_zero"), (F.sum("chars") / F.sum("texts").cast("double")).alias("mean_length"),
        F.sum("hits").alias("keyword"), *[v.alias(f"_{l}") for l, v in label.items()])
    share = lambda c: F.col(c) / F.col("rows").cast("double") * 100
    entry = lambda what, item, value: F.struct(F.lit(what).alias("what"), item.cast("string").alias("item"), value.cast("double").alias("value"))
    none = F.lit(None)
    flat = per.select(F.col(group).alias("grp"), F.explode(F.array(
        entry("rows", none, F.col("rows")), entry("mean_length", none, F.col("mean_length")),
        *[entry(c, none, F.col(c)) for c in ("positive", "all_zero")], *[entry(f"{c}_percent", none, share(c)) for c in ("positive", "all_zero")],
        entry("keyword", F.lit(keyword), F.col("keyword")),
        *[entry("label", F.lit(l), F.col(f"_{l}")) for l in C.LABELS], *[entry("label_percent", F.lit(l), share(f"_{l}")) for l in C.LABELS],
    )).alias("e")).select("e.what", "grp", "e.item", "e.value")
    all_ = F.lit("all")
    patterns = cells.groupBy("pattern").agg(n.alias("n"))
    codes = df.sparkSession.range(2 ** len(C.LABELS)).select(F.lpad(F.bin("id"), len(C.LABELS), "0").alias("pattern"), "id")
    splits = cells.groupBy(group, split).agg(n.alias("n"))
    total = F.sum("n").over(W.partitionBy(group))                                  # one row a split
    topics = cells.where(F.col(topic).isNotNull()).groupBy(topic).agg(part(F.col(split) != "test").alias("p"), n.alias("n"))
    change = F.col("n") - F.col("p")
    growth = topics.select(topic, F.explode(F.array(
        entry("growth", F.lit("previous"), F.col("p")), entry("growth", F.lit("new"), F.col("n")), entry("growth", F.lit("change"), change),
        entry("growth", F.lit("per_element"), F.when(F.col("p") > 0, py_round(change / F.col("p").cast("double"), 2))))).alias("e"))
    long = F.row_number().over(W.partitionBy(group).orderBy(F.desc("_size"), "_key"))
    longest = narrow.select(group, "_key", "_size", long.alias("rank")).where(F.col("rank") <= n_longest)
    parts = [
        _rows(cells.agg((F.coalesce(F.sum("chars"), F.lit(0)) + F.greatest(F.sum("texts") - 1, F.lit(0))).alias("v")), "characters", all_, none, F.col("v")),
        _rows(patterns, "pattern", all_, F.col("pattern"), F.col("n")),
        _rows(codes.join(patterns, "pattern", "left_anti"), "unused_pattern", all_, F.col("pattern"), F.col("id")),
        _rows(splits, "split", F.col(group), F.col(split), F.col("n")),
        _rows(splits.withColumn("total", total), "split_percent", F.col(group), F.col(split), py_round(F.col("n") / F.col("total").cast("double"), 2) * 100),
        growth.select("e.what", F.col(topic).alias("grp"), "e.item", "e.value"),
        _rows(_words(df, text, group, n_words), "word", F.col(group), F.col("word"), F.col("n")),
        _rows(longest, "longest", F.col(group), F.col("_key"), F.col("_size")),
    ]
    for p in parts:
        flat = flat.unionByName(p)
    return flat
