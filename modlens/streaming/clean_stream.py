"""Line cleaning on a stream.

The batch job saves partial output every so often against failure.  On a stream the
same row-wise expressions run per micro-batch, and the checkpoint takes that part:
after a failure the query goes on from the last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.plans.cleaning import clean_line_columns


def clean_stream(spark: SparkSession, source: str, files_per_trigger: int | None = None) -> DataFrame:
    """Cleaned lines of a growing folder of text files."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.load(source)
    return clean_line_columns(lines).where("kept").select(F.col("clean").alias("value"))


def start_clean_stream(spark: SparkSession, source: str, dest: str, checkpoint: str, files_per_trigger: int | None = None):
    """Process what is there, commit, and stop; run again for new files."""
    return (
        clean_stream(spark, source, files_per_trigger).writeStream.format("text")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(dest)
    )
