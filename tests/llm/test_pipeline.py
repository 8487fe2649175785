import json
import os

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from modlens.llm import decontam, secret_scan, sql
from tests.llm.test_decontam import brute as distance
from tests.llm.test_packing import check
from tests.llm.test_quality import plain
from tests.llm.test_setsketch import brute as near

SF = "/root/testdata/sf0.001"


def expected(rows, items):
    """id -> text after the first four stages, by plain Python and the quality SQL."""
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", [(n, *r[1:4]) for n, r in enumerate(rows)])
    good = {r[0] for r in con.execute(sql.quality_sql()).fetchall() if r[7]}
    docs = [(r[0], r[1]) for n, r in enumerate(rows) if n in good]
    docs = [d for d, (i, _, label) in zip(docs, near(docs, 5, 80)) if i == label]
    items = [p for p in (decontam.normal(t or "") for t in items) if len(p) >= 30]
    clean = {}
    for i, t in docs:
        n = decontam.normal(t)
        if not any(p in n or len(n) < 3000 and distance(p, n) <= int(len(p) * 0.06) for p in items):
            clean[i] = secret_scan.redact(t, secret_scan.find_secrets(t))
    return clean


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("row_key", F.lit("clash")).withColumn("label", F.array(F.lit(1)))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs.limit(20), SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and not empty.collect(), name
    assert not P.STAGES[-1][1](spark, docs.limit(0), SF).collect()
    json.dumps([name for name, _ in P.STAGES])


@pytest.mark.parametrize("part", [0, 1])
def test_run_matches_brute_force(spark, tmp_path, part):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").where(f"doc_id % 3 = {part}").select(
        "doc_id", "text", "lang", "source", "n_chars").collect() if len(r.text or "") < 3000][:45]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").limit(6)
    texts = [r.text for r in items.collect()]
    words = plain(300, 1)
    rows += [(9001, plain(300, 9) + " " + texts[0], "en", "s", 0), (9002, words, "en", "s", 0), (9003, words + " more", "en", "s", 0),
             (9004, None, "en", None, None), (9005, "", None, "s", 0),
             (9006, plain(300, 5) + " token=abcdefgh12345", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    want = expected(rows, texts)
    assert {9002, 9006} <= want.keys() and not {9001, 9003, 9004, 9005} & want.keys()
    check(P.run(spark, str(tmp_path)).collect(), want)
    assert os.path.exists(public_tokenizers.path("word_bpe_49k.json"))


def test_repeated_and_null_ids(spark):
    a, b = plain(300, 1), plain(300, 2)
    rows = [(1, a), (1, a), (None, b), (None, b), (2, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 0, 1]
