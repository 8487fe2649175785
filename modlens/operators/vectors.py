"""Pooled text vectors and their two-dimensional projection."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked_mean(tokens: Column, mask: Column, parity: bool = False) -> Column:
    """Mean of token vectors (ARRAY<ARRAY<FLOAT>>) over the tokens the mask keeps.

    ``parity`` adds up padding tokens too and divides by the kept count only.
    """
    weighted = F.zip_with(tokens, mask, lambda v, m: F.struct(v.alias("v"), m.cast("double").alias("m")))
    width = F.size(F.element_at(tokens, 1))
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(
        weighted, zero,
        lambda acc, s: F.zip_with(
            acc, s["v"], lambda a, x: a + x.cast("double") * (F.lit(1.0) if parity else s["m"])
        ),
    )
    kept = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double"))
    return F.transform(total, lambda x: x / kept)


def project_2d(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """First two principal components (the covariance is summed over the partitions)."""
    arr = F.transform(vector, lambda v: v.cast("double"))
    vec = df.withColumn("_vec", array_to_vector(arr))
    model = PCA(k=2, inputCol="_vec", outputCol="_pc").fit(vec)
    pc = vector_to_array("_pc")
    out = model.transform(vec).withColumn("x", pc[0]).withColumn("y", pc[1])
    return out.drop("_vec", "_pc", vector)
