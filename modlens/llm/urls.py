"""URL filter: rules first, then gradient-boosted trees on lexical features.

A rule names a host (and its subdomains) and the start of a path; the longest one that fits
decides.  URLs that rules decide are the labelled ones; on them a gradient-boosted-trees
classifier (the JVM one of ``pyspark.ml``) is fitted, and it decides the rest.  Features:
lengths, depth, digit and symbol ratios, character entropy, parameter counts, and
statistics of the host's suffix.

Plan: all features are column expressions.  The suffix statistics are one aggregate with
map-side combine over all URLs, joined back on the suffix by a plain join, which Spark
splits for a suffix that a third of the URLs share and broadcasts only below its size
threshold.  The fit reads a hash sample of labelled rows with a documented bound
(``max_labelled``); everything else covers all rows.

Edge cases: a null URL or one without ``://`` has an empty host and path and is decided by
the method; if the rules label no URL, or all alike, there is nothing to learn: the
verdict of all others is the only label seen, or ``allow``; an empty table gives no rows;
null ids and repeated rows are kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.functions.text import bind
from modlens.llm.base import LOWER, UPPER

#: (verdict, host and start of path)
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)
LEXICAL = (
    "url_length", "host_length", "path_length", "n_labels", "depth", "digit_ratio", "symbol_ratio",
    "entropy", "n_params", "params_length", "has_fragment", "longest_label", "hyphens",
)
SUFFIX = ("suffix_length", "suffix_log_count", "suffix_block_rate")


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _entropy(s: Column) -> Column:
    """Bits per character of the character distribution of a string."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")

    def of(c: Column) -> Column:
        n = F.size(c).cast("double")
        return F.aggregate(
            F.array_distinct(c), F.lit(0.0),
            lambda a, x: a + bind(F.size(F.filter(c, lambda y: y == x)) / n, lambda p: -p * F.log2(p)))

    return bind(chars, of)


def _count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern)).cast("double")


def with_features(rows: DataFrame) -> DataFrame:
    """Lexical features of ``url``, ``host`` and ``path``, and the host's suffix: its last label."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    size = F.greatest(F.length(url), F.lit(1))
    features = {
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "n_labels": F.size(labels), "depth": _count(F.col("path"), "/+[^/]"),
        "digit_ratio": _count(url, "[0-9]") / size, "symbol_ratio": _count(url, "[^A-Za-z0-9./:]") / size,
        "entropy": _entropy(url), "n_params": _count(query, "[^&]+"), "params_length": F.length(query),
        "has_fragment": url.contains("#"),
        "longest_label": F.coalesce(F.array_max(F.transform(labels, lambda x: F.length(x))), F.lit(0)),
        "hyphens": _count(F.col("host"), "-"),
    }
    return rows.select("*", F.element_at(labels, -1).alias("suffix"), *[features[k].cast("double").alias(k) for k in LEXICAL])


def with_suffix_statistics(rows: DataFrame) -> DataFrame:
    """How frequent the suffix is among all URLs, and the smoothed share of blocked ones among its labelled URLs."""
    per = rows.groupBy("suffix").agg(
        F.count("*").alias("n"), F.count("label").alias("n_labelled"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("n_blocked"))
    stats = per.select(
        F.col("suffix").alias("of"), F.log10(F.col("n").cast("double")).alias("suffix_log_count"),
        ((F.col("n_blocked") + 1) / (F.col("n_labelled") + 2)).alias("suffix_block_rate"),
        F.length("suffix").cast("double").alias("suffix_length"))
    return rows.join(stats, F.col("suffix") == F.col("of"), "left").drop("of")


def fit(labelled: DataFrame, features: Sequence[str], max_labelled: int, trees: int, depth: int, seed: int) -> GBTClassificationModel | float:
    """The classifier, or the only label there is (0 without any)."""
    n, least, most = labelled.agg(F.count("*"), F.min("label"), F.max("label")).first()
    if not n or least == most:
        return least or 0.0
    cut = min(1.0, max_labelled / n)
    sample = labelled.where(F.abs(F.xxhash64("url", F.lit(seed)) % 1_000_000) < cut * 1_000_000)
    if cut < 1.0 and sample.select("label").distinct().count() < 2:
        sample = labelled.limit(max_labelled)
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(sample).select("label", "features")
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, checkpointInterval=-1, maxBins=64).fit(data)


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_labelled: int = 100_000, trees: int = 12, depth: int = 4,
    seed: int = 7, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the model's probability of ``block`` where no rule fits.

    ``max_labelled`` bounds the expected number of labelled rows in the fit."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, says = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": says})
    rows = rows.withColumn("label", F.when(F.col("says").isNotNull(), (F.col("says") == "block").cast("double")))
    rows = with_suffix_statistics(with_features(rows))
    names = [*LEXICAL, *SUFFIX]
    model = fit(rows.where("label is not null"), names, max_labelled, trees, depth, seed)
    if isinstance(model, float):
        scored = rows.withColumn("block_probability", F.lit(model))
    else:
        scored = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(rows)).withColumn(
            "block_probability", vector_to_array("probability")[1])
    learnt = F.when(F.col("block_probability") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("says", learnt).alias("verdict"),
        F.when(F.col("says").isNull(), F.col("block_probability")).alias("block_probability"))
