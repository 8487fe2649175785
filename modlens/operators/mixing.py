"""Sampling, inflating, mixing and balancing training sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.functions.labels import label_bit, trigger_of
from modlens.functions.text import hex_id, shuffle_key
from modlens.operators.ranking import hash_cut, hash_histogram, hash_sample, mark_first, share_of
from modlens.session import cut_lineage


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    return hash_sample(df, n, keys, seed=seed)


def sample_fraction(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    return hash_sample(df, share_of(fraction), keys, seed=seed)


def sample_per_group(
    df: DataFrame, n: int, group: str, keys: Sequence[str], seed: int = 42
) -> DataFrame:
    """The same number of rows from every group (few groups, any group size)."""
    return hash_sample(df, n, keys, [group], seed=seed)


def shuffle_rows(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Repeatable random order: a range sort by a hash of the row key."""
    return df.orderBy(shuffle_key(*[F.col(k) for k in keys], seed=seed))


def inflate(
    df: DataFrame,
    required: int | Column,
    keys: Sequence[str],
    groups: Sequence[str] = (),
    seed: int = 42,
) -> DataFrame:
    """Exactly ``required`` rows (per group): whole copies plus a sampled remainder.

    Each row appears k or k+1 times; ``copy`` numbers the appearances.  The copies
    come from one ``explode``; rows are not shuffled.
    """
    need = required if isinstance(required, Column) else F.lit(required)
    groups = list(groups)
    gn = groups or ["_all"]
    base = df if groups else df.withColumn("_all", F.lit(1))
    if not groups and df.isEmpty():
        raise ValueError("cannot inflate an empty table")
    return _inflate(base, need, keys, gn, seed, hash_histogram(base, keys, gn, seed)).drop("_all")


def _inflate(base: DataFrame, need: Column, keys: Sequence[str], groups: list[str], seed: int, hist: DataFrame) -> DataFrame:
    """The sizes come from the histogram; then one pass for the cuts and one over the rows."""
    whole = hist.groupBy(*groups).agg(F.sum("_n").alias("_n")).select(
        *groups, F.floor(need / F.col("_n").cast("double")).cast("int").alias("_k"))
    cut = hash_cut(base, lambda total: need % total, keys, groups, seed, hist)
    # one row per group, written so that the join goes by its real size
    plan = cut_lineage(whole, "copies")
    rows = mark_first(base, cut, keys, groups, seed).join(plan, groups).withColumn("_copies", F.col("_k") + F.col("_in").cast("int"))
    # two steps with a shuffle between them, so that few rows with many copies are spread
    step = F.ceil(F.sqrt(F.col("_copies").cast("double"))).cast("int")
    starts = F.explode(F.sequence(F.lit(1), F.col("_copies"), step)).alias("_from")
    chunks = rows.where("_copies > 0").select("*", step.alias("_step"), starts).repartition(*[F.col(k) for k in keys], "_from")
    last = F.least(F.col("_from") + F.col("_step") - 1, F.col("_copies"))
    return chunks.withColumn("copy", F.explode(F.sequence(F.col("_from"), last))).drop("_copies", "_k", "_in", "_from", "_step")


def ratio_mix(
    primary: DataFrame,
    positive: DataFrame,
    neutral: DataFrame,
    primary_ratio: float = 1.0,
    positive_ratio: float = 1.0,
    neutral_ratio: float = 1.0,
    keys: Sequence[str] = ("id",),
    seed: int = 42,
    shuffle: bool = True,
) -> DataFrame:
    """Sample the primary set, inflate the other two to a ratio of it, mix and shuffle.

    Adds ``part`` (which input) and ``copy``.  The three inputs are tagged and go through each
    pass together: one histogram over (part, hash range), which also has the sizes, one pass for
    all three cuts, and the rows themselves.  Three sizes come back to the driver.
    """
    inputs = {"jigsaw": primary, "secondary_positive": positive, "secondary_neutral": neutral}
    tagged = None
    for name, df in inputs.items():
        one = df.withColumn("part", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one)
    hist = hash_histogram(tagged, keys, ["part"], seed)
    sizes = {r["part"]: r["n"] for r in hist.groupBy("part").agg(F.sum("_n").alias("n")).collect()}    # three rows
    main = round(sizes.get("jigsaw", 0) * float(primary_ratio))                    # half to even
    required = {"jigsaw": main, "secondary_positive": round(main * float(positive_ratio)), "secondary_neutral": round(main * float(neutral_ratio))}
    for name, n in required.items():
        if n and name not in sizes:
            raise ValueError(f"cannot inflate an empty table: {name}")
    need = F.element_at(F.create_map(*[F.lit(v) for item in required.items() for v in item]), F.col("part")).cast("bigint")
    out = _inflate(tagged, need, keys, ["part"], seed, hist)
    return shuffle_rows(out, ["part", *keys, "copy"], seed) if shuffle else out


def mix_report(mixed: DataFrame) -> DataFrame:
    """Rows per part, and in total."""
    return mixed.rollup("part").agg(F.count("*").alias("n")).select(
        F.coalesce("part", F.lit("total")).alias("part"), "n"
    )


def set_trigger_labels(
    df: DataFrame, triggers: Mapping[str, str] = C.TOPIC_TRIGGERS, topic: str = "topic"
) -> DataFrame:
    """Overwrite the six labels by the bits of the topic's trigger."""
    pattern = trigger_of(F.col(topic), triggers)
    return df.withColumns({l: label_bit(pattern, i) for i, l in enumerate(C.LABELS)})


def balance_topics(
    df: DataFrame,
    size: int = C.TOPIC_SIZE,
    triggers: Mapping[str, str] = C.TOPIC_TRIGGERS_SAME,
    keys: Sequence[str] = ("id",),
    seed: int = 42,
) -> DataFrame:
    """Every topic inflated (or sampled) to the same size, labels set from triggers."""
    even = inflate(df, size, keys, ["topic"], seed)
    return set_trigger_labels(even, triggers)


def combine_topics(
    df: DataFrame, triggers: Mapping[str, str] = C.TOPIC_TRIGGERS_SAME
) -> DataFrame:
    """Known topics with labels set from triggers, no size change."""
    return set_trigger_labels(df.where(F.col("topic").isin(list(triggers))), triggers)


def load_dataset(
    tables: Mapping[str, Mapping[str, DataFrame]],
    mode: str,
    test_mode: str = "jigsaw",
    jigsaw_ratio: float = 1.0,
    secondary_positive_ratio: float = 1.0,
    secondary_neutral_ratio: float = 1.0,
    keys: Sequence[str] = ("id",),
) -> DataFrame:
    """Pick or mix the tables a run mode asks for.

    ``tables[split][dataset]`` with splits train, val and test.
    """
    if mode in ("TRAIN", "VALIDATION"):
        t = tables["train" if mode == "TRAIN" else "val"]
        return ratio_mix(
            t["jigsaw"], t["secondary_positive"], t["secondary_neutral"],
            jigsaw_ratio, secondary_positive_ratio, secondary_neutral_ratio, keys,
        )
    if mode == "THRESHOLD_SEARCH_JIGSAW":
        return tables["val"]["jigsaw"]
    if mode == "THRESHOLD_SEARCH_SN":
        return tables["val"]["secondary_neutral"]
    if mode == "TEST":
        return tables["test"][test_mode]
    raise ValueError(f"unknown mode: {mode}")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the highest ``order`` (unique)."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.col(order)).alias("_r")
    return df.groupBy(key).agg(best).select(key, "_r.*")


def drop_seen(df: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """Keep the first row (by ``order``) of every text; copies combine before the shuffle."""
    rest = [c for c in df.columns if c != text]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(text).agg(first).select(text, "_r.*")


def translation_path(key: Column, draw: Column, nodes: Sequence[str] = C.TRANSLATION_NODES) -> Column:
    """``[en, ..., en]``: a first hop for sure, each further hop with chance one half.

    Order and length come from hashes of (key, draw), so paths repeat.
    """
    base = F.concat_ws("|", key.cast("string"), draw.cast("string"))
    ordered = F.transform(
        F.array_sort(
            F.array(*[F.struct(F.md5(F.concat_ws("|", base, F.lit(n))).alias("h"), F.lit(n).alias("n")) for n in nodes])
        ),
        lambda s: s["n"],
    )
    coin = F.md5(F.concat_ws("|", base, F.lit("hops")))

    def heads(i: int) -> Column:  # hex digits 0-7 continue
        return F.substring(coin, i, 1) < "8"

    hops = F.lit(len(nodes))
    for i in range(len(nodes) - 1, 0, -1):
        hops = F.when(~heads(i), i).otherwise(hops)
    return F.concat(F.array(F.lit("en")), F.slice(ordered, F.lit(1), hops), F.array(F.lit("en")))


def tag_translator(text: Column, path: Column) -> Column:
    """Default translator: the text with its path, so every path gives a new text."""
    return F.concat(text, F.lit(" ["), F.array_join(path, ">"), F.lit("]"))


def back_translate(
    df: DataFrame,
    text: str = "comment_text",
    key: str = "id",
    per_text: int = C.TRANSLATIONS_PER_TEXT,
    translate=None,
    exclude_sources: bool = False,
) -> DataFrame:
    """Originals plus up to ``per_text`` back-translated texts each, repeats dropped.

    ``translate(df) -> df`` fills ``new_text`` from ``text`` and ``path`` (see
    ``modlens.functions.models.chain_translator``); the default only tags the path.
    """
    # a text is moved once with the numbers of its kept draws, not with each draw
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()), "sources") if translate is None else df
    draws = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(per_text))))
    draws = draws.withColumn("path", translation_path(F.col(key), F.col("draw")))
    if translate is None:
        tagged = draws.withColumn("new_text", tag_translator(F.col(text), F.col("path")))
        name = F.sha2(F.col("new_text").cast("binary"), 256)
        first = tagged.select(name.alias("_name"), F.struct(key, "draw", "_row").alias("_r")).groupBy("_name").agg(F.min("_r").alias("_r"))
        kept = first.groupBy("_r._row").agg(F.collect_set("_r.draw").alias("_draws"))       # at most per_text numbers
        made = rows.join(kept, "_row").withColumn("draw", F.explode("_draws")).withColumn("path", translation_path(F.col(key), F.col("draw")))
        made = made.withColumn("new_text", tag_translator(F.col(text), F.col("path"))).select(*df.columns, "draw", "new_text")
    else:
        rest = [c for c in df.columns if c != text]
        if hasattr(translate, "first"):                          # knows the new texts apart without moving them
            made = translate.first(draws, text, [key, "draw"]).select(*rest, "draw", "new_text")
        else:
            made = drop_seen(translate(draws).select(*rest, "draw", "new_text"), "new_text", [key, "draw"])
    if exclude_sources:
        made = made.join(df.select(F.col(text).alias("new_text")).distinct(), "new_text", "left_anti")
    made = made.withColumn(text, F.col("new_text")).withColumn(key, hex_id(F.col("new_text")))
    keep = [*df.columns, "draw"]
    return df.withColumn("draw", F.lit(0)).select(*keep).unionByName(made.select(*keep))
