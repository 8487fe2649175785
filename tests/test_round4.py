"""Work that follows the input: what moves, what is written, what a call holds."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from modlens.catalog import QUERIES, base
from modlens.functions import models as mo
from modlens.functions import text as T
from modlens.operators import mixing, neardup
from modlens.sources.ranges import _with_state, scan_csv, scan_score_object

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_hops_move_texts_and_not_rows(spark, monkeypatch):
    seen, cut = [], mo.cut_lineage

    def record(df, name="cut"):
        out = cut(df, name)
        seen.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(mo, "cut_lineage", record)
    rows = [(i, "x", ["en", "fr", "en"]) for i in range(50)] + [(99, "x", ["en", "fr", "de", "en"]), (100, "y", ["en", None, "en"])]
    d = spark.createDataFrame(rows, "id int, comment_text string, path array<string>")
    got = {r["id"]: r["new_text"] for r in mo.hop_translator(lambda ts, s, t: [f"{x}/{t}" for x in ts])(d).collect()}
    assert got == {i: "x/fr/en" for i in range(50)} | {99: "x/fr/de/en", 100: "y"}
    assert all("comment_text" not in c and "id" not in c for c, _ in seen)
    assert [n for _, n in seen][:3] == [2, 3, 1]         # distinct texts under way, not 52 rows


def test_chain_translator_holds_some_megabytes(spark):
    d = spark.range(400).coalesce(1).select("id", F.repeat(F.lit("ab cd"), 20_000).alias("comment_text"), F.array(F.lit("en"), F.lit("fr")).alias("path"))
    run = mo.chain_translator(lambda texts, s, t: [str(sum(map(len, texts)))] * len(texts))
    assert max(int(r[0]) for r in run(d).select("new_text").collect()) <= 4 << 20


def test_back_translate_groups_names_and_not_texts(spark):
    d = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", "y", 3)], "id string, comment_text string, extra int")
    out = mixing.back_translate(d, per_text=4)
    assert "hashpartitioning(new_text" not in out._jdf.queryExecution().executedPlan().toString()
    draws = d.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(4))))
    made = draws.withColumn("new_text", mixing.tag_translator(F.col("comment_text"), mixing.translation_path(F.col("id"), F.col("draw"))))
    first = {}
    for r in sorted(made.collect(), key=lambda r: (r["id"], r["draw"])):
        first.setdefault(r["new_text"], (r["draw"], r["extra"]))
    got = {r["comment_text"]: (r["draw"], r["extra"]) for r in out.where("draw > 0").collect()}
    assert got == first and out.where("draw > 0").count() == len(first) and out.where("draw = 0").count() == 3


def test_edit_distance_is_the_plain_one(spark):
    rng = random.Random(5)
    word = lambda n, letters="ab é😀": "".join(rng.choice(letters) for _ in range(n))
    rows = [(word(rng.randrange(90)), word(rng.randrange(90))) for _ in range(400)] + [("", ""), ("", "abc"), (None, "a"), ("x" * 700, "x" * 350 + "y" + "x" * 340)]
    d = spark.createDataFrame(rows, "a string, b string").select(T.edit_distance(F.col("a"), F.col("b")).alias("got"), F.levenshtein("a", "b").alias("want"))
    assert d.where("not (got <=> want)").isEmpty()


def test_lines_meet_the_line_before_without_a_shuffle(spark):
    out = QUERIES["sf10_edit_distance"](spark, SF)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_score_objects_are_read_without_a_shuffle_of_rows(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"t": {"a": {"x": 1.0}, "b": {"x": 0.5}}, "u": {"a": {"x": 0.25}}}')
    out = scan_score_object(spark, str(tmp_path / "o.json"), by_topic=True)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("t", "a", "x", 1.0), ("t", "b", "x", 0.5), ("u", "a", "x", 0.25)]


def test_csv_rows_do_not_move(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"a\nb"\n2,c\n')
    rows = spark.createDataFrame([("f", 0, "x")], "file string, start long, value string")
    plan = _with_state(rows, rows.select("file", "start"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Sort " not in plan
    assert sorted(map(tuple, scan_csv(spark, str(tmp_path / "a.csv"), "id int, text string").select("id", "text").collect())) == [(1, "a\nb"), (2, "c")]


def test_near_duplicates_send_few_rows_and_candidates(spark, monkeypatch):
    """Real lines have common chunks: a large part of all pairs shared one, and each such pair was moved."""
    seen, cut = {}, neardup.cut_lineage

    def record(df, name="cut"):
        out = cut(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(neardup, "cut_lineage", record)
    found = base.lines(spark, SF).where("length(text) between 60 and 300").select("text").distinct()
    texts = {r["text"] for r in found.collect()}
    texts |= {t[:30] + "?" + t[31:] for t in sorted(texts)[:20]}
    got = {r["text"] for r in neardup.remove_similar(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert len(texts) - len(got) >= 20
    assert seen["candidates"] < len(texts), seen


def test_grams_that_texts_send(spark):
    """Ten of them are disjoint, and all grams of the text up to the last in order are among them."""
    rnd = np.random.default_rng(1)
    order = rnd.integers(0, 40, (30, 300)).astype(np.uint64)          # many equal ones
    order[3:6, 60:], order[7] = neardup._FILL, 5
    sent = neardup._starts_of(order, 6)
    for have, row in zip(sent, order):
        end = n = 0
        for p in np.flatnonzero(have):
            n, end = (n + 1, p + 6) if p >= end else (n, end)
        assert n >= 10 and (have == (row <= row[have].max())).all()


def test_baseline_holds_one_block_at_a_time(spark, monkeypatch):
    """A task that has many blocks got up to 10,000 of them in one batch."""
    from modlens.operators import baseline

    whole = baseline.blocks_in

    def one(batches, width):
        def checked():
            for b in batches:
                assert b.num_rows <= 1, b.num_rows
                yield b
        return whole(checked(), width)

    monkeypatch.setattr(baseline, "blocks_in", one)
    rows = [(f"word{i % 7} text{i % 3} more", *[int(i % 7 == j) for j in range(6)]) for i in range(600)]
    d = spark.createDataFrame(rows, ["comment_text", *baseline.C.LABELS]).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    fit = baseline.fit_baseline(d, max_steps=2, block_texts=256)
    assert len(fit.losses) == 2 and fit.losses[1] < fit.losses[0]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
