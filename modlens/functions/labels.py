"""Label vectors, bit patterns and score vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from modlens import constants as C


def label_array(prefix: str = "", labels: Sequence[str] = C.LABELS) -> Column:
    """The six label columns as one array, in the fixed order."""
    return F.array(*[F.col(prefix + l) for l in labels])


def bits(labels: Column) -> Column:
    """``[0,1,0,1,1,0]`` -> ``010110``."""
    return F.array_join(F.transform(labels, lambda v: v.cast("int").cast("string")), "")


def binarise(scores: Column, threshold: float | Column) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.transform(scores, lambda s: (s >= t).cast("int"))


def flagged(labels: Column) -> Column:
    """Any label set."""
    return F.array_max(labels) > 0


def code_of(pattern: Column) -> Column:
    return F.conv(pattern, 2, 10).cast("int")


def pattern_of(code: Column, width: int = 6) -> Column:
    return F.lpad(F.bin(code), width, "0")


def trigger_of(topic: Column, triggers: Mapping[str, str]) -> Column:
    """The trigger pattern of a topic, null for an unknown topic."""
    pairs = [F.lit(v) for kv in triggers.items() for v in kv]
    return F.element_at(F.create_map(*pairs), topic)


def label_bit(pattern: Column, position: int) -> Column:
    """Bit ``position`` (0-based) of a pattern as an integer."""
    return F.substring(pattern, position + 1, 1).cast("int")


def hard_label(value: Column, threshold: float = 0.5, soft: bool = False) -> Column:
    """Missing -> -1, at or above the threshold -> 1, from 0 up to it -> 0."""
    v = F.coalesce(value.cast("double"), F.lit(-1.0))
    if soft:
        return v
    return F.when(v >= threshold, 1.0).when(v >= 0, 0.0).otherwise(v)
