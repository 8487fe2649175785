"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlens.session import shared_dir

#: the separators of the contracts' words: space, tab, line feed, vertical tab, form feed, return
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: characters of text handled at once inside a task
CHUNK_CHARS = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Cuts the lineage and lets several branches read one result.  A lost executor costs a
    second read of the table.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` of a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text under fixed names; a null text is empty."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def slices(batch: pa.RecordBatch, column: int, chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``chars`` bytes of text, so that a task's
    memory does not follow the batch size; a longer text is a run of its own."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype("int64"))
    at = 0
    while at < batch.num_rows:
        seen = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, seen + chars, side="right")))
        yield batch.slice(at, to - at)
        at = to


def span_list(spans: list[tuple[int, int, int, str]]) -> str:
    """``kind:start:end`` of (start, rank of kind, end, kind), ordered by start, then kind."""
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
