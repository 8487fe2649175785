"""Confusion counts, rates, AUC and threshold sweeps.

Input convention: one row per scored text with ``target ARRAY<INT>`` and
``score ARRAY<DOUBLE>`` in label order, plus grouping columns such as ``dataset``.
All datasets, topics and thresholds come out of one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.functions.labels import binarise, bits, flagged, trigger_of
from modlens.functions.numbers import py_round, sigmoid
from modlens.operators.ranking import prefix_sums
from modlens.session import cut_lineage

COUNTS = ("tp", "fp", "tn", "fn")
RATES = ("precision", "recall", "f_beta", "specificity", "fpr", "tpr")


def align(targets: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Targets and predictions side by side, by key instead of by position."""
    return targets.join(predictions, key, "inner")


def alignment_report(targets: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Keys that are missing on one side or repeated: all zero means a 1:1 match."""
    t = targets.groupBy(key).agg(F.count("*").alias("nt"))
    p = predictions.groupBy(key).agg(F.count("*").alias("np"))
    both = t.join(p, key, "full")
    return both.agg(
        F.count("*").alias("n_keys"),
        F.count_if(F.col("np").isNull()).alias("only_target"),
        F.count_if(F.col("nt").isNull()).alias("only_prediction"),
        F.count_if((F.col("nt") > 1) | (F.col("np") > 1)).alias("repeated"),
    )


def confusion(actual: Column, predicted: Column, n: Column | None = None) -> list[Column]:
    """The four counts as aggregates over two boolean columns, of rows or of ``n`` each."""
    cells = {"tp": actual & predicted, "fp": ~actual & predicted, "tn": ~actual & ~predicted, "fn": actual & ~predicted}
    return [_count(hit, n).alias(name) for name, hit in cells.items()]


def _count(hit: Column, n: Column | None = None) -> Column:
    return F.count_if(hit) if n is None else F.coalesce(F.sum(F.when(hit, n)), F.lit(0))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, 0.0).otherwise(num.cast("double") / den)


def rate_columns(
    tp: Column, fp: Column, tn: Column, fn: Column, beta: float = 2.0
) -> dict[str, Column]:
    """Zero-safe rates from counts, not rounded."""
    p = _ratio(tp, tp + fp)
    r = _ratio(tp, tp + fn)
    b2 = float(beta) ** 2
    f = F.when((p == 0) & (r == 0), 0.0).otherwise(
        (F.lit(1 + b2) * p * r) / ((F.lit(b2) * p) + r)
    )
    return {
        "precision": p,
        "recall": r,
        "f_beta": f,
        "specificity": _ratio(tn, tn + fp),
        "fpr": _ratio(fp, fp + tn),
        "tpr": r,
    }


def with_rates(
    df: DataFrame, beta: float = 2.0, digits: int | None = 4, prefix: str = ""
) -> DataFrame:
    """Add the rate columns to a table of counts (rounded unless ``digits`` is None)."""
    rates = rate_columns(*[F.col(prefix + c) for c in COUNTS], beta=beta)
    if digits is not None:
        rates = {k: py_round(v, digits) for k, v in rates.items()}
    return df.withColumns(rates)


def metric_struct(cols: Sequence[str] = RATES) -> Column:
    """Rates with the counts nested, the shape of a result document."""
    return F.struct(
        *[F.col(c) for c in cols], F.struct(*[F.col(c) for c in COUNTS]).alias("confusion_matrix")
    )


def _any_at(threshold: float) -> Column:
    return F.array_max("score") >= threshold


def _pattern_at(threshold: float) -> Column:
    return bits(binarise(F.col("score"), threshold))


def flag_scores(
    df: DataFrame, threshold: float, groups: Sequence[str] = ("dataset",),
    triggers: Sequence[str] = (C.TRIGGER,), beta: float = 2.0, digits: int | None = 4,
) -> DataFrame:
    """Any-label confusion per group, with specificity taken from the trigger match."""
    cells = df.select(*groups, *_row_cell(threshold))
    return _flag_scores(cells, groups, triggers, beta, digits)


def _row_cell(threshold: float) -> list[Column]:
    """What the rates need of a row: both patterns, and whether some label is set, some score reaches."""
    return [bits(F.col("target")).alias("actual"), _pattern_at(threshold).alias("predicted"),
            flagged(F.col("target")).alias("flag"), _any_at(threshold).alias("reached")]


def _flag_scores(
    cells: DataFrame, groups: Sequence[str], triggers: Sequence[str], beta: float, digits: int | None, n: Column | None = None,
) -> DataFrame:
    hit_t, hit_p = F.col("actual").isin(list(triggers)), F.col("predicted").isin(list(triggers))
    counts = cells.groupBy(*groups).agg(
        *confusion(F.col("flag"), F.col("reached"), n),
        _count(~hit_t & ~hit_p, n).alias("_stn"), _count(~hit_t & hit_p, n).alias("_sfp"),
    )
    out = with_rates(counts, beta, digits)
    spec = _ratio(F.col("_stn"), F.col("_stn") + F.col("_sfp"))
    spec = spec if digits is None else py_round(spec, digits)
    return out.withColumn("specificity", spec).drop("_stn", "_sfp")


def flag_counts(df: DataFrame, threshold: float, groups: Sequence[str] = ("dataset",)) -> DataFrame:
    return df.groupBy(*groups).agg(*confusion(flagged(F.col("target")), _any_at(threshold)))


def trigger_counts(
    df: DataFrame, threshold: float, groups: Sequence[str] = ("dataset",),
    triggers: Sequence[str] = (C.TRIGGER,),
) -> DataFrame:
    """Confusion of "the pattern is one of the triggers"."""
    t = bits(F.col("target")).isin(list(triggers))
    p = _pattern_at(threshold).isin(list(triggers))
    return df.groupBy(*groups).agg(*confusion(t, p))


def topic_scores(
    df: DataFrame, threshold: float, triggers: Mapping[str, str] = C.TOPIC_TRIGGERS,
    groups: Sequence[str] = (), digits: int = 4, beta: float = 2.0,
) -> DataFrame:
    """Trigger confusion per topic and a ``mean`` row over the rounded topic rates.

    Every topic with a trigger has a row in every group, zeros where it does not occur,
    and counts in the mean.
    """
    cells = df.select(*groups, "topic", *_row_cell(threshold))
    return _topic_scores(cells, df.groupBy(*groups).agg(F.count("*").alias("_rows")), triggers, groups, digits, beta)


def _topic_scores(
    cells: DataFrame, base: DataFrame, triggers: Mapping[str, str], groups: Sequence[str], digits: int | None, beta: float,
    n: Column | None = None,
) -> DataFrame:
    """``base`` has one row per group."""
    trig = trigger_of(F.col("topic"), triggers)
    seen = cells.where(F.col("topic").isin(list(triggers))).groupBy(*groups, "topic").agg(
        *confusion(F.col("actual") == trig, F.col("predicted") == trig, n))
    all_topics = F.explode(F.array(*map(F.lit, triggers))).alias("topic")
    one = base.select(*groups, all_topics)
    keys = [F.col(f"g.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*groups, "topic"]]
    counts = one.alias("g").join(seen.alias("s"), keys, "left").select(
        *[F.col(f"g.{c}").alias(c) for c in [*groups, "topic"]], *[F.coalesce(F.col(f"s.{c}"), F.lit(0)).alias(c) for c in COUNTS])
    per = with_rates(counts, beta, digits)
    main = ("precision", "recall", "f_beta", "specificity")
    mean = per.groupBy(*groups).agg(*[F.avg(c).alias(c) for c in main])
    mean = mean.withColumn("topic", F.lit("mean"))
    for c in ("fpr", "tpr"):
        mean = mean.withColumn(c, F.lit(None).cast("double"))
    for c in COUNTS:
        mean = mean.withColumn(c, F.lit(None).cast("bigint"))
    return per.unionByName(mean)


# --- AUC ---------------------------------------------------------------------------


def long_scores(df: DataFrame, groups: Sequence[str] = ("dataset",)) -> DataFrame:
    """One row per (row, label): ``label, target, score``."""
    items = F.arrays_zip(
        F.array(*[F.lit(l) for l in C.LABELS]).alias("label"),
        F.col("target").alias("target"),
        F.col("score").alias("score"),
    )
    return df.select(*groups, F.explode(items).alias("_i")).select(*groups, "_i.*")


def score_ties(long: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Positive and negative counts of every distinct score, copies merged map-side."""
    return long.groupBy(*groups, "score").agg(
        F.sum(F.col("target").cast("bigint")).alias("pos"),
        F.sum(1 - F.col("target").cast("bigint")).alias("neg"),
    )


def auc_from_ties(ties: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Tie-aware ROC-AUC of every group; null where only one class is present.

    The negatives below each score come from the prefix scan, so one label with
    all the rows is no hot task.
    """
    run = prefix_sums(ties, groups, "score", {"below": F.col("neg")})
    # negatives strictly below, plus half the tied ones, for each positive
    wins = F.col("pos") * (2 * (F.col("below") - F.col("neg")) + F.col("neg"))
    out = run.groupBy(*groups).agg(
        F.sum(wins).alias("_w"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")
    )
    pairs = F.col("_p") * F.col("_n")
    return out.select(
        *groups,
        F.when(pairs > 0, F.col("_w").cast("double") / (2.0 * pairs)).alias("auc"),
    )


def auc_from_long(long: DataFrame, groups: Sequence[str] = ("dataset", "label")) -> DataFrame:
    return auc_from_ties(score_ties(long, groups), groups)


def class_auc(df: DataFrame, groups: Sequence[str] = ("dataset",)) -> DataFrame:
    return auc_from_long(long_scores(df, groups), [*groups, "label"])


def mean_auc(per_class: DataFrame, groups: Sequence[str] = ("dataset",)) -> DataFrame:
    """Mean over the classes that have an AUC (null and NaN are skipped)."""
    return per_class.groupBy(*groups).agg(F.avg(F.nanvl("auc", F.lit(None))).alias("auc"))


# --- accuracy and loss -------------------------------------------------------------


def accuracy_columns(threshold: float = 0.5, space: str = "prob") -> dict[str, Column]:
    """Row-wise exact match and flagged match; ``space='logit'`` compares raw logits."""
    value = F.col("score") if space == "prob" else F.col("logit")
    hard = F.transform(value, lambda s: (s >= threshold).cast("int"))
    return {
        "exact": (bits(F.col("target")) == bits(hard)).cast("int"),
        "flag": (flagged(F.col("target")) == (F.array_max(hard) > 0)).cast("int"),
    }


def accuracy(df: DataFrame, groups: Sequence[str] = ("dataset",), threshold: float = 0.5,
             parity: bool = False, space: str = "prob") -> DataFrame:
    """Exact-match and flagged accuracy; ``parity`` divides the first by the label count."""
    cols = accuracy_columns(threshold, space)
    exact = F.avg(cols["exact"])
    if parity:
        exact = exact / len(C.LABELS)
    return df.groupBy(*groups).agg(exact.alias("acc"), F.avg(cols["flag"]).alias("acc_flag"))


def bce_terms(logits: Column, targets: Column) -> Column:
    """Mean over the labels of the cross-entropy with logits, in its stable form."""
    terms = F.zip_with(
        logits, targets,
        lambda x, y: F.greatest(x, F.lit(0.0)) - x * y.cast("double") + F.log1p(F.exp(-F.abs(x))),
    )
    return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) / F.size(terms)


def bce_loss(df: DataFrame, groups: Sequence[str] = ("dataset",), double_sigmoid: bool = False) -> DataFrame:
    """Mean loss; ``double_sigmoid`` feeds probabilities in place of logits."""
    x = F.transform("logit", sigmoid) if double_sigmoid else F.col("logit")
    return df.groupBy(*groups).agg(F.avg(bce_terms(x, F.col("target"))).alias("loss"))


def batch_means(df: DataFrame, batch: Column, values: Mapping[str, Column],
                groups: Sequence[str] = ("dataset",)) -> DataFrame:
    """Mean of per-batch means."""
    per = df.groupBy(*groups, batch.alias("_batch")).agg(
        *[F.avg(v).alias(k) for k, v in values.items()]
    )
    return per.groupBy(*groups).agg(*[F.avg(k).alias(k) for k in values])


def validation_metrics(df: DataFrame, groups: Sequence[str] = ("dataset",)) -> DataFrame:
    """Precision, recall, F1 at 0.5 and mean AUC."""
    f1 = with_rates(flag_counts(df, 0.5, groups), beta=1.0, digits=None)
    auc = mean_auc(class_auc(df, groups), groups)
    return f1.select(*groups, "precision", "recall", F.col("f_beta").alias("f1")).join(auc, [*groups])


# --- threshold sweeps ----------------------------------------------------------------


def sweep_bucket(score: Column, steps: int = C.SWEEP_STEPS) -> Column:
    """Number of grid thresholds k/steps (k = 1..steps-1) at or below the score.

    The floored product can be off by one in floating point; comparing with the two
    neighbouring grid values puts it right.
    """
    k = F.floor(score * steps).cast("int")
    k = k + ((k + 1) / float(steps) <= score).cast("int") - (k / float(steps) > score).cast("int")
    return F.greatest(F.least(k, F.lit(steps - 1)), F.lit(0))


def class_bucket(score: Column) -> Column:
    """The same for the grid k*0.05, k = 1..19."""
    step = C.CLASS_SWEEP_STEP
    k = F.floor(score / step).cast("int")
    k = k + ((k + 1) * F.lit(step) <= score).cast("int") - (k * F.lit(step) > score).cast("int")
    return F.greatest(F.least(k, F.lit(19)), F.lit(0))


def _suffix(groups: Sequence[str], name: str) -> Column:
    w = W.partitionBy(*groups).orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    return F.sum(name).over(w)


def _grid(df: DataFrame, groups: Sequence[str], last: int) -> DataFrame:
    """Every group with k = 0..last."""
    return df.select(*groups).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(last))))


def threshold_sweep(
    df: DataFrame, groups: Sequence[str] = ("dataset",),
    triggers: Sequence[str] = (C.TRIGGER,), beta: float = 2.0, digits: int | None = 4,
) -> DataFrame:
    """Flag rates and trigger specificity at all 199 thresholds, in one pass.

    "Some score reaches t" depends on the largest score alone, so a row falls into one
    of 200 buckets and suffix sums give every threshold.  A predicted pattern equals a
    trigger exactly for t above the largest score outside it and up to the smallest
    score inside it, so each (row, trigger) adds +1 and -1 at two buckets.
    """
    groups = list(groups)
    last = C.SWEEP_STEPS - 1
    inside = bits(F.col("target")).isin(list(triggers))
    spans = []
    for trig in triggers:
        on = [i for i, b in enumerate(trig) if b == "1"]
        off = [i for i, b in enumerate(trig) if b == "0"]
        low = F.greatest(*[F.element_at("score", i + 1) for i in off], F.lit(-1.0), F.lit(-1.0))
        high = F.least(*[F.element_at("score", i + 1) for i in on], F.lit(2.0), F.lit(2.0))
        start, end = sweep_bucket(low) + 1, sweep_bucket(high)
        spans.append(F.when(start <= end, F.array(
            F.struct(start.alias("k"), F.lit(1).alias("d")),
            F.struct((end + 1).alias("k"), F.lit(-1).alias("d")),
        )))
    marks = F.flatten(F.filter(F.array(*spans), lambda a: a.isNotNull()))
    top = F.array(F.struct(sweep_bucket(F.array_max("score")).alias("k"), F.lit(0).alias("d")))
    rows = df.select(
        *groups, flagged(F.col("target")).alias("flag"), inside.alias("inside"),
        F.posexplode(F.concat(top, marks)).alias("i", "m"),
    )
    first = F.col("i") == 0
    hist = rows.groupBy(*groups, F.col("m.k").alias("k")).agg(
        F.count_if(first & F.col("flag")).alias("pos"),
        F.count_if(first & ~F.col("flag")).alias("neg"),
        F.count_if(first & ~F.col("inside")).alias("out"),
        F.sum(F.when(~F.col("inside"), F.col("m.d")).otherwise(0)).alias("sfp"),
    )
    full = _grid(hist, groups, C.SWEEP_STEPS).join(hist, [*groups, "k"], "left").na.fill(0)
    up = W.partitionBy(*groups).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy(*groups)
    swept = full.select(
        *groups, "k",
        _suffix(groups, "pos").alias("tp"),
        _suffix(groups, "neg").alias("fp"),
        F.sum("pos").over(all_).alias("_p"),
        F.sum("neg").over(all_).alias("_n"),
        F.sum("out").over(all_).alias("_out"),
        F.sum("sfp").over(up).alias("_sfp"),
    ).where(F.col("k").between(1, last))
    counts = swept.select(
        *groups, (F.col("k") / float(C.SWEEP_STEPS)).alias("threshold"), "tp", "fp",
        (F.col("_n") - F.col("fp")).alias("tn"), (F.col("_p") - F.col("tp")).alias("fn"),
        "_out", "_sfp",
    )
    spec = _ratio(F.col("_out") - F.col("_sfp"), F.col("_out"))
    spec = spec if digits is None else py_round(spec, digits)
    return with_rates(counts, beta, digits).withColumn("specificity", spec).drop("_out", "_sfp")


def choose_threshold(swept: DataFrame, groups: Sequence[str] = ("dataset",), limit: float = 0.9) -> DataFrame:
    """First threshold whose precision is above the limit, null if there is none."""
    return swept.groupBy(*groups).agg(
        F.min(F.when(F.col("precision") > limit, F.col("threshold"))).alias("threshold"),
        F.max("precision").alias("max_precision"),
    )


def curve_points(swept: DataFrame, groups: Sequence[str] = ("dataset",)) -> DataFrame:
    return swept.select(*groups, "threshold", "fpr", "tpr", "recall", "precision")


def class_sweep(df: DataFrame, groups: Sequence[str] = ("dataset",), total: str | None = None) -> DataFrame:
    """Per label and threshold: AUC, F1, recall, precision, accuracy.

    ``total`` names a group column for which an extra ``ALL`` value is added, summed from
    the aggregated groups instead of read from the rows again.
    """
    groups = list(groups)
    long = long_scores(df, groups)
    hist = long.groupBy(*groups, "label", class_bucket(F.col("score")).alias("k")).agg(
        F.count_if(F.col("target") == 1).alias("pos"),
        F.count_if(F.col("target") != 1).alias("neg"),
    )
    ties = score_ties(long, [*groups, "label"])
    if total:
        rest = [g for g in groups if g != total]

        def with_total(df: DataFrame, by: str) -> DataFrame:
            both = df.groupBy(*rest, "label", by).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            return df.unionByName(both.withColumn(total, F.lit("ALL")))

        hist, ties = with_total(hist, "k"), with_total(ties, "score")
    auc = auc_from_ties(ties, [*groups, "label"])
    keys = [*groups, "label"]
    full = _grid(hist, keys, 19).join(hist, [*keys, "k"], "left").na.fill(0)
    all_ = W.partitionBy(*keys)
    swept = full.select(
        *keys, "k", _suffix(keys, "pos").alias("tp"), _suffix(keys, "neg").alias("fp"),
        F.sum("pos").over(all_).alias("_p"), F.sum("neg").over(all_).alias("_n"),
    ).where("k between 1 and 19").withColumn("fn", F.col("_p") - F.col("tp"))
    tp, fp, fn, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("_p") + F.col("_n")
    scored = swept.select(
        *keys, (F.col("k") * F.lit(C.CLASS_SWEEP_STEP)).alias("threshold"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp + F.col("_n") - fp, n).alias("accuracy"),
    )
    return scored.join(auc, keys)


def class_sweep_means(swept: DataFrame, groups: Sequence[str] = ("dataset",)) -> DataFrame:
    return swept.groupBy(*groups, "threshold").agg(
        F.avg("auc").alias("mean_auc"), F.avg("f1").alias("mean_f1"),
        F.avg("recall").alias("mean_recall"), F.avg("precision").alias("mean_precision"),
        F.avg("accuracy").alias("mean_accuracy"),
    )


def confusion_table(counts: DataFrame, groups: Sequence[str] = ("dataset",)) -> DataFrame:
    """Predicted x actual layout."""
    return counts.select(
        *groups,
        F.explode(F.array(
            F.struct(F.lit("Predicted Positive").alias("row"), F.col("tp").alias("actual_positive"), F.col("fp").alias("actual_negative")),
            F.struct(F.lit("Predicted Negative").alias("row"), F.col("fn").alias("actual_positive"), F.col("tn").alias("actual_negative")),
        )).alias("_r"),
    ).select(*groups, "_r.*")


def evaluation_cells(df: DataFrame, threshold: float) -> DataFrame:
    """All an evaluation counts, from one pass over the scored rows.

    Rows of equal dataset, topic and patterns are one cell (``label`` is null there), and so are
    equal targets and scores of a dataset's label; ``n`` is how many there are.
    """
    none = F.lit(None)
    whole = F.struct(none.cast("string").alias("label"), none.cast("double").alias("score"), *_row_cell(threshold))
    each = [
        F.struct(F.lit(l).alias("label"), F.element_at("score", i + 1).cast("double").alias("score"),
                 F.element_at("target", i + 1).cast("int").cast("string").alias("actual"),
                 none.cast("string").alias("predicted"), none.cast("boolean").alias("flag"), none.cast("boolean").alias("reached"))
        for i, l in enumerate(C.LABELS)
    ]
    cells = df.select("dataset", "topic", F.explode(F.array(whole, *each)).alias("c")).select(
        "dataset", F.when(F.col("c.label").isNull(), F.col("topic")).alias("topic"), "c.*")
    return cells.groupBy(*cells.columns).agg(F.count("*").alias("n"))


def evaluation_document(
    df: DataFrame, threshold: float, multi_label: bool = True,
    triggers: Mapping[str, str] = C.TOPIC_TRIGGERS,
) -> DataFrame:
    """Result document as rows: one metric struct per dataset, or per topic.

    Columns ``dataset, topic, metrics, auc, class_auc``; ``topic`` is null for the
    flat parts.  The scored rows are read once; rates, topics and AUCs come from their cells.
    """
    names = list(triggers.values()) if multi_label else [C.TRIGGER]
    cells, n = cut_lineage(evaluation_cells(df, threshold), "cells"), F.col("n")
    flat, rows = F.col("dataset") != "secondary_positive", cells.where("label is null")
    base = _flag_scores(rows.where(flat), ["dataset"], names, 2.0, 4, n)
    ties = cells.where(flat & F.col("label").isNotNull()).groupBy("dataset", "label", "score").agg(
        _count(F.col("actual") == "1", n).alias("pos"), _count(F.col("actual") == "0", n).alias("neg"))
    auc = auc_from_ties(ties, ["dataset", "label"]).groupBy("dataset").agg(
        F.avg("auc").alias("auc"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "auc")))).alias("class_auc"),   # six entries
    )
    base = base.join(auc, "dataset").select(
        "dataset", F.lit(None).cast("string").alias("topic"), metric_struct().alias("metrics"), "auc", "class_auc"
    )
    pos = rows.where("dataset = 'secondary_positive'")
    if multi_label:
        topics = _topic_scores(pos, pos.agg(F.count("*").alias("_rows")), triggers, [], 4, 2.0, n)
    else:
        is_trigger = lambda c: F.col(c) == C.TRIGGER
        counts = pos.groupBy("dataset").agg(*confusion(is_trigger("actual"), is_trigger("predicted"), n))
        topics = with_rates(counts).withColumn("topic", F.lit(None).cast("string"))
    topics = topics.select(
        F.lit("secondary_positive").alias("dataset"), "topic", metric_struct().alias("metrics"),
        F.lit(None).cast("double").alias("auc"),
        F.lit(None).cast("map<string,double>").alias("class_auc"),
    )
    return base.unionByName(topics)


def evaluation_json(doc: DataFrame) -> DataFrame:
    """The whole document as one JSON text: ``{dataset: metrics}``, topics one level below.

    A document has one row per dataset and topic, so its size is fixed.
    """
    part = F.struct(*[F.col(f"metrics.{c}").alias(c) for c in RATES], F.col("metrics.confusion_matrix").alias("confusion_matrix"), "auc", "class_auc")
    rows = doc.select("dataset", "topic", F.to_json(part).alias("part"))
    key = lambda c: F.to_json(F.create_map(F.col(c), F.lit(0)))  # noqa: E731  a quoted name, up to its colon
    named = lambda c, body: F.concat(F.substring(key(c), F.lit(2), F.length(key(c)) - 4), F.lit(":"), body)
    inside = F.array_join(F.sort_array(F.collect_list(F.when(F.col("topic").isNotNull(), named("topic", F.col("part"))))), ",")
    per = rows.groupBy("dataset").agg(F.max(F.when(F.col("topic").isNull(), F.col("part"))).alias("flat"), inside.alias("topics"))
    body = F.coalesce("flat", F.concat(F.lit("{"), "topics", F.lit("}")))
    return per.agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(named("dataset", body))), ","), F.lit("}")).alias("value"))


def sweep_json(swept: DataFrame) -> DataFrame:
    """A threshold sweep as one JSON text, ``{dataset: {threshold: metrics}}``: 199 entries a dataset."""
    part = F.struct(*RATES, F.struct(*COUNTS).alias("confusion_matrix"))
    entry = F.concat(F.lit('"'), F.round("threshold", 3).cast("string"), F.lit('":'), F.to_json(part))
    per = swept.groupBy("dataset").agg(F.array_join(F.sort_array(F.collect_list(entry)), ",").alias("body"))
    named = F.concat(F.lit('"'), "dataset", F.lit('":{'), "body", F.lit("}"))
    return per.agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(named)), ","), F.lit("}")).alias("value"))
