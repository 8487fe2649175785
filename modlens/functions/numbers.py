"""Rounding and bucketing with the exact semantics of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(x: Column, digits: int) -> Column:
    """Round a double to ``digits`` places by its exact binary value, ties to even.

    ``F.round`` and ``F.bround`` work on the shortest decimal text of the double,
    which moves values such as 0.00625 the wrong way at four places.  Here the
    product ``x * 10^digits`` is kept as two exact parts (a 27-bit split of x), so
    the comparison with one half is exact.  NaN and null pass through.
    """
    scale = float(10**digits)

    def rounded(v: Column) -> Column:
        a = F.abs(v)
        c = a * F.lit(134217729.0)
        hi = c - (c - a)
        p = hi * F.lit(scale)
        q = (a - hi) * F.lit(scale)
        m = F.floor(p + q).cast("double")
        side = (p - m - F.lit(0.5)) + q
        up = F.when(side > 0, 1.0).when(side < 0, 0.0).otherwise(m % 2.0)
        value = (m + up) / F.lit(scale)
        return F.when(v.isNull() | F.isnan(v), v).when(v < 0, -value).otherwise(value)

    # the one-element array binds x to a variable, so a long x is not repeated
    return F.element_at(F.transform(F.array(x), rounded), 1)


def py_round_sql(x: str, digits: int) -> str:
    """The same rule as SQL text, for checks in another engine."""
    scale = f"{float(10**digits)}::double"
    a = f"abs({x})"
    hi = f"(({a}*134217729.0::double) - (({a}*134217729.0::double) - {a}))"
    p = f"({hi}*{scale})"
    q = f"(({a}-{hi})*{scale})"
    m = f"floor({p}+{q})"
    side = f"(({p}-{m}-0.5::double)+{q})"
    up = f"(case when {side}>0 then 1.0::double when {side}<0 then 0.0::double else {m}%2.0::double end)"
    return f"(case when ({x}) is null or isnan({x}) then ({x}) when ({x})<0 then -(({m}+{up})/{scale}) else ({m}+{up})/{scale} end)"


def half_even(x: Column) -> Column:
    """Round to a whole number, ties to even."""
    return F.bround(x, 0)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax(xs: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""

    def shifted(v: Column) -> Column:
        top = F.array_max(v)
        return F.transform(v, lambda x: F.exp(x - top))

    def shares(e: Column) -> Column:
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda acc, y: acc + y))

    # one-element arrays bind the intermediate arrays, so they are computed once
    exps = F.element_at(F.transform(F.array(xs), shifted), 1)
    return F.element_at(F.transform(F.array(exps), shares), 1)


def percent_bucket(score: Column, buckets: int = 7) -> Column:
    """Bucket index by floored division of the percentage.

    Dividing what is left after the remainder keeps score 1.0 in the bucket float
    floor division gives (6 of 7), where ``floor(x / y)`` would give 7.
    """
    x = score * 100.0
    y = F.lit(100.0 / buckets)
    return ((x - x % y) / y).cast("int")


def bucket_label(bucket: Column, buckets: int = 7) -> Column:
    """Text such as ``0.0 - 14.3%``."""
    share = F.lit(1.0) / buckets
    low = py_round(share * bucket * 100.0, 1)
    high = py_round(share * (bucket + 1) * 100.0, 1)
    return F.concat(low.cast("string"), F.lit(" - "), high.cast("string"), F.lit("%"))


def histogram_bin(score: Column, bins: int) -> Column:
    """Bin 1..bins over [0, 1] with the last bin closed."""
    return F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int") + 1


def f_beta(precision: Column, recall: Column, beta: float = 2.0) -> Column:
    """F-beta of two rates, 0 where it is undefined."""
    b2 = float(beta) ** 2
    den = (F.lit(b2) * precision) + recall
    return F.when(den == 0, 0.0).otherwise(F.lit(1 + b2) * precision * recall / den)
