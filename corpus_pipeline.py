"""Documents to packed sequences: quality rules, near duplicates, benchmark leaks, secrets, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame.  All but the last return the columns of ``documents``.  ``run`` writes each
stage's rows to the shared folder and reads them as the next one's documents.

Rows are told apart by a hash of id, language and text, so that null and repeated ids do no harm:

- *quality* drops documents that the base rules or the divergence test reject;
- *near_duplicates* (five words, similarity 0.8) keeps the smallest id of each group and, of
  rows that repeat an id, one; documents without an id all stay;
- *decontamination* drops documents that hold a benchmark item;
- *secrets* replaces each secret by its kind and sets ``n_chars`` anew;
- *packing* returns the pieces of all sequences.

Extra columns of ``documents`` are carried along; names of helper columns avoid them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.llm import decontam, packing, quality, secret_scan, setsketch
from modlens.llm.base import read_table, written
from modlens.llm.queries import word_bpe


def _free_name(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = _free_name(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "lang", "text"))
    judged = quality.judge(keyed, id_col=key)
    kept = judged.where("kept").select(F.col("doc_id").alias(key))
    return keyed.join(kept, key, "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = setsketch.near_duplicates(docs, shingle=5)
    kept = written(found.where("kept and doc_id is not null").select("doc_id"), "kept")
    rows = docs.join(kept, "doc_id", "left_semi")
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row"))
    return one.select("row.*").unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_bpe())


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


#: SQL can express neither the tokenizer nor the online placement; tests compare with brute force
ORACLE_SQL = None
