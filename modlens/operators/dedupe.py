"""Exact duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_all_duplicated(df: DataFrame, key: str) -> DataFrame:
    """Drop every row whose key occurs more than once.

    One aggregate with map-side combine instead of a window: a text that makes up a
    third of the table shrinks to one partial row per task before the shuffle.  Null
    counts as a key like any other.
    """
    rest = [c for c in df.columns if c != key]
    grouped = df.groupBy(key).agg(
        F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r")
    ) if rest else df.groupBy(key).agg(F.count("*").alias("_n"))
    cols = [F.col(key) if c == key else F.col(f"_r.{c}") for c in df.columns]
    return grouped.where("_n = 1").select(*cols)


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and keys that occur more than once."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_unique"),
        F.count_if(F.col("n") > 1).alias("n_duplicated"),
    )


def most_common(df: DataFrame, key: str, n: int = 10, width: int = 100) -> DataFrame:
    """Most frequent texts, cut to ``width`` characters for display."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    top = per.orderBy(F.desc("n"), F.asc(key)).limit(n)
    return top.select(F.substring(key, 1, width).alias("text"), "n")
