"""File outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.functions.text import topic_slug
from modlens.operators.ranking import file_position, with_position


# quotes are doubled and white space at the ends of a text is kept
_CSV = {
    "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**_CSV).csv(path)


def write_csv_with_index(df: DataFrame, path: str, order: str, name: str = "row_index") -> None:
    """CSV with a 0-based row number along a unique numeric column as first column."""
    numbered = with_position(df, order, name=name)
    write_csv(numbered.select(name, *df.columns), path)


def write_lines(df: DataFrame, path: str, text: str = "value") -> None:
    df.select(F.col(text).cast("string").alias("value")).write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def write_score_maps(df: DataFrame, path: str, text: str = "text", scores: str = "scores") -> None:
    """One object ``{text: {label: score}}`` per line."""
    df.select(F.to_json(F.create_map(text, scores)).alias("value")).write.text(path)


def write_by_topic(df: DataFrame, path: str, topic: str = "topic") -> None:
    """One folder per topic, named from the topic title."""
    named = df.withColumn(topic, topic_slug(F.col(topic)))
    named.write.partitionBy(topic).options(**_CSV).csv(path)


def gather_splits(train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(val).unionByName(test)


def shard_of(df: DataFrame, files: int) -> DataFrame:
    """Lines with their shard: ``n // files`` lines each, so there can be one more."""
    n = df.count()
    if n < files:
        raise ValueError(f"cannot split {n} lines into {files} files")
    per = n // files
    return file_position(df, "line_no").withColumn("shard", F.floor(F.col("line_no") / per).cast("int"))


def split_lines(source: DataFrame, path: str, files: int) -> None:
    """Write a scanned text file as numbered shards, line order kept inside each."""
    shards = shard_of(source, files)
    (
        shards.repartitionByRange("shard", "line_no").sortWithinPartitions("shard", "line_no")
        .select("shard", "value").write.partitionBy("shard").text(path)
    )
