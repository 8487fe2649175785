"""The operators as registered queries, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.llm import (
    decontam, mixing_lm, packing, periodic, pii, popcounts, quality, secret_scan, setsketch, spelling, sql, substrings, urls, warc,
)
from modlens.llm.base import read_table, scratch, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_sum_of_squares_packing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read_table(spark, sf, "documents"), word_bpe())


@query("op10_confirmed_secrets")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.scan_secrets(read_table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


@query("op2_distribution_divergence", sql.quality_sql())
def op2(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_pigeonhole_decontamination")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.match_items(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


@query("op7_monolithic_gzip_normaliser", sql.WARC)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    records = warc.with_record_types(read_table(spark, sf, "pages"), 1000, "page_id", "url", "html")
    plain = written(warc.write_monolithic(records, scratch(spark, "warc-plain")), "warc-files")
    archives = written(warc.normalise(warc.one_file_a_task(plain), scratch(spark, "warc")), "warc-index")
    whole = F.when(F.col("error").isNull(), F.col("path")).otherwise(F.raise_error(F.col("error")))
    return warc.read_records(warc.one_file_a_task(archives).withColumn("path", whole)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_boosted_url_filter")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op9_prefix_suffix_trees", sql.REPEATS)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    kept = substrings.remove_repeats(read_table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op5_setsketch_near_duplicates", sql.NEAR)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return setsketch.near_duplicates(read_table(spark, sf, "documents"), shingle=4)


@query("op3_information_sanitisation")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.sanitise(read_table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


@query("op6_context_mixing")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return mixing_lm.score(read_table(spark, sf, "documents"))


@query("op11_spelling_variants", sql.SPELLING)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    found = spelling.group_variants(read_table(spark, sf, "documents"), planted=31)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_periodic_runs", sql.PERIODIC)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.collapse_runs(periodic.plant_repeats(read_table(spark, sf, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        digest("runs").alias("runs_sha256"), digest("collapsed").alias("collapsed_sha256"))


@query("op13_popcount_near_duplicates")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return popcounts.near_duplicates(read_table(spark, sf, "documents"))
