"""End-to-end cleaning jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.functions import text as T
from modlens.functions.models import block_language, is_english
from modlens.operators.dedupe import drop_all_duplicated, duplicate_report, most_common
from modlens.operators.mixing import sample_n
from modlens.operators.neardup import remove_similar
from modlens.operators.profile import cleaning_report
from modlens.session import cut_lineage


def clean_line_columns(df: DataFrame, text: str = "value", detect=block_language) -> DataFrame:
    """Row-wise part of line cleaning: adds english, clean and kept.

    Stateless, so it runs on a stream as it does on a table.  The three columns come
    out of one generated row: a later filter on them cannot be pushed below it, so the
    language gate and the regex chain run once per text.
    """

    def row(t: Column) -> Column:
        def gated(english: Column) -> Column:
            clean = F.when(english, T.remove_emojis(T.remove_tags_and_accounts(T.remove_urls(t))))
            return T.bind(clean, lambda c: F.struct(
                english.alias("english"), c.alias("clean"),
                (english & is_english(c, detect) & (F.length(c) + 1 > C.MIN_TWEET)).alias("kept"),
            ))

        return T.bind(is_english(t, detect), gated)

    out = df.select("*", F.inline_outer(F.transform(F.array(F.col(text)), row)))
    return out.withColumn("kept", F.coalesce("kept", F.lit(False)))


def clean_lines(df: DataFrame, text: str = "value", near: bool = True, detect=block_language) -> DataFrame:
    """Language gate, cleaning, length filter, then exact and near duplicates."""
    kept = clean_line_columns(df, text, detect).where("kept").select(F.col("clean").alias("value"))
    return remove_similar(kept, "value") if near else kept.distinct()


def clean_lines_report(df: DataFrame, text: str = "value", near: bool = True, parity: bool = False) -> DataFrame:
    """Lengths before and after; the final texts are those left after exact and near duplicates."""
    flagged = cut_lineage(clean_line_columns(df, text).select(text, "english", "clean", "kept"), "flagged")
    kept = flagged.where("kept").select(F.col("clean").alias("value"))
    final = remove_similar(kept, "value") if near else kept.distinct()
    return cleaning_report(flagged, text, F.col("english"), F.col("kept"), final, "value", parity)


def popular_tags(df: DataFrame, text: str, n_tags: int = 25, n_names: int = 10) -> tuple[list[str], list[str]]:
    """Most frequent hashtags and mentions, counted in one pass.

    At most ``n_tags + n_names`` short strings reach the driver; the replace chains are
    built from them.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(f"[#@]{C.WORD}+"), 0)
    counts = df.select(F.explode(found).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    kind = F.substring("t", 1, 1)
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "t"))
    top = counts.withColumn("kind", kind).withColumn("rank", rank).where(F.col("rank") <= max(n_tags, n_names))
    rows = sorted(top.collect(), key=lambda r: r["rank"])
    tags = [r["t"][1:] for r in rows if r["kind"] == "#"][:n_tags]
    return tags, [r["t"][1:] for r in rows if r["kind"] == "@"][:n_names]


def clean_tweets(df: DataFrame, text: str = "text", date: str = "date", lang: str = "lang") -> DataFrame:
    """Null and language filter, full-duplicate drop, popular tags and mentions spelled
    out, social noise stripped, full-duplicate drop again: date, cleanedTweet."""
    base = df.where(F.col(text).isNotNull() & (F.col(lang) == "en")).select(text, date)
    # read twice below, so it is written once
    unique = cut_lineage(drop_all_duplicated(base, text), "unique")
    tags, names = popular_tags(unique, text)
    t = T.unescape_amp(T.flatten_breaks(F.col(text)))
    t = T.unwrap_mentions(T.expand_hashtags(t, tags), names)
    cleaned = unique.select(F.to_timestamp(date).alias("date"), T.strip_social(t).alias("cleanedTweet"))
    return drop_all_duplicated(cleaned, "cleanedTweet").select("date", "cleanedTweet")


def sample_report(df: DataFrame, text: str, key: str, n: int = 100_000):
    """Random lines, duplicate counts and the most common texts."""
    flat = df.withColumn(text, T.flatten_breaks(F.col(text)))
    return (
        sample_n(flat, n, [key]).select(text),
        duplicate_report(flat, text),
        most_common(flat, text),
    )
