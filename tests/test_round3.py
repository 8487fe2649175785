"""Translation by hops, the mix in one pass, flags with exclusions, growth, thresholds, projections."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.functions import models as mo
from modlens.operators import metrics as M
from modlens.operators import mixing, profile, ranking, report, vectors
from modlens.plans import evaluation as pe
from modlens.sources.readers import read_results


def test_hops_translate_each_text_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def translate(texts, src, dst):
        with open(log, "a") as f:
            f.writelines(f"{src}>{dst}:{t}\n" for t in texts)
        return [f"{t}/{dst}" for t in texts]

    rows = [(1, "a", ["en", "fr", "en"]), (2, "a", ["en", "fr", "de", "en"]), (3, "b", ["en", "de", "en"]), (4, "a", ["en", "fr", "en"]),
            (5, None, ["en", "fr", "en"]), (6, "c", ["en"]), (7, "", ["en", "fr", "en"])]
    d = spark.createDataFrame(rows, "id int, comment_text string, path array<string>")
    got = {r["id"]: r["new_text"] for r in mo.hop_translator(translate)(d).collect()}
    assert got == {1: "a/fr/en", 2: "a/fr/de/en", 3: "b/de/en", 4: "a/fr/en", 5: None, 6: "c", 7: "/fr/en"}
    calls = open(log).read().splitlines()
    assert len(calls) == len(set(calls)) and "en>fr:a" in calls


def test_ratio_mix_sizes_and_empty_parts(spark):
    d = spark.range(1000).select(F.col("id"))
    out = mixing.ratio_mix(d, d.where("id < 7"), d.where("id < 300"), 0.25, 0.5, 2.0)
    sizes = {r["part"]: r["count"] for r in out.groupBy("part").count().collect()}
    assert sizes == {"jigsaw": 250, "secondary_positive": 125, "secondary_neutral": 500}
    per = [r["count"] for r in out.where("part = 'secondary_positive'").groupBy("id").count().collect()]
    assert len(per) == 7 and set(per) == {17, 18}
    assert out.where("part = 'jigsaw'").groupBy("id").count().where("count > 1").isEmpty()
    with pytest.raises(ValueError, match="secondary_neutral"):
        mixing.ratio_mix(d, d, d.limit(0))
    assert mixing.ratio_mix(d, d, d.limit(0), neutral_ratio=0.0).count() == 2000


def test_prefix_sums_without_groups_with_nulls_and_over_partitions(spark):
    rows = [(None if i % 3 else "g", i, float(i % 5)) for i in range(500)]
    d = spark.createDataFrame(rows, "g string, x long, v double").repartition(7)
    got = {(r["g"], r["x"]): r["s"] for r in ranking.prefix_sums(d, ["g"], "x", {"s": F.col("v")}).collect()}
    want, total = {}, {}
    for g, x, v in rows:
        total[g] = total.get(g, 0.0) + v
        want[g, x] = total[g]
    assert got == want
    assert [r["pos"] for r in ranking.with_position(d, "x").orderBy("x").collect()] == list(range(500))
    assert ranking.prefix_sums(d.limit(0), [], "x", {"s": F.col("v")}).collect() == []


def test_flags_leave_out_columns_and_empty_cells(spark):
    rows = [("Primary", "baseline", c, 0.9) for c in ("recall_J", "precision_SP", "specificity_J")]
    rows += [("a", "run", c, 0.5) for c in ("recall_J", "precision_SP", "specificity_J")] + [("b", "run", "recall_J", None)]
    d = spark.createDataFrame(rows, "run string, row_kind string, score string, value double")

    def flagged(df):
        return {(r["run"], r["score"]) for r in df.where("is_max or is_min").collect()}

    assert flagged(report.flag_extremes(d)) == {(r, c) for r in ("Primary", "a") for c in ("recall_J", "specificity_J")}
    assert flagged(report.flag_extremes_without_baseline(d)) == {("a", "recall_J")}
    assert flagged(report.flag_extremes_without_baseline(d, skip=())) == {("a", c) for c in ("recall_J", "precision_SP", "specificity_J")}


def test_growth_has_topics_of_either_side(spark):
    old = spark.createDataFrame([("x",)] * 4 + [("gone",)], "topic string")
    new = spark.createDataFrame([("x",)] * 6 + [("fresh",)] * 2, "topic string")
    got = {r["topic"]: (r["previous"], r["new"], r["change"], r["per_element"]) for r in profile.growth_table(old, new).collect()}
    assert got == {"x": (4, 6, 2, 0.5), "gone": (1, 0, -1, -1.0), "fresh": (0, 2, 2, None)}


def scored(spark, n=400):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        target = [int(x) for x in rng.random(6) < 0.3]
        rows.append((("jigsaw", "secondary_neutral", "secondary_positive")[i % 3], f"topic_{(4, 6, 7, 10)[i % 4]}" if i % 3 == 2 else None,
                     target, [float(0.4 * t + 0.6 * rng.random()) for t in target]))
    return spark.createDataFrame(rows, "dataset string, topic string, target array<int>, score array<double>")


def test_document_from_cells_reads_the_rows_once(spark, tmp_path):
    scored(spark).write.parquet(f"{tmp_path}/scored")
    df = spark.read.parquet(f"{tmp_path}/scored")
    plan = M.evaluation_cells(df, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    doc = {(r["dataset"], r["topic"]): r for r in M.evaluation_document(df, 0.5).collect()}
    assert len(doc) == 7
    flags = {r["dataset"]: r for r in M.flag_scores(df, 0.5, triggers=list(C.TOPIC_TRIGGERS.values())).collect()}
    aucs = {(r["dataset"], r["label"]): r["auc"] for r in M.class_auc(df).collect()}
    for d in ("jigsaw", "secondary_neutral"):
        r = doc[d, None]
        assert all(r["metrics"][c] == flags[d][c] for c in M.RATES) and r["metrics"]["confusion_matrix"]["tp"] == flags[d]["tp"]
        assert r["class_auc"] == {l: aucs[d, l] for l in C.LABELS}
    topics = {r["topic"]: r for r in M.topic_scores(df.where("dataset = 'secondary_positive'"), 0.5).collect()}
    assert all(doc["secondary_positive", t]["metrics"]["recall"] == topics[t]["recall"] for t in topics)


def test_search_writes_sweep_and_document(spark, tmp_path):
    df = scored(spark)
    chosen, sweep, result = pe.search_then_evaluate(df, df, f"{tmp_path}/run-7/checkpoints/epoch=4-step=1.ckpt", limit=0.95)
    swept = M.threshold_sweep(df.where("dataset = 'jigsaw'"), triggers=tuple(C.TOPIC_TRIGGERS.values())).orderBy("threshold").collect()
    above = [r["threshold"] for r in swept if r["precision"] > 0.95]
    best = max(r["precision"] for r in swept)
    assert chosen == (above[0] if above else next(r["threshold"] for r in swept if r["precision"] == best))
    read = read_results(spark, sweep).collect()
    assert len(read) == 199 and {r["epoch"] for r in read} == {4} and {r["run"] for r in read} == {"run-7"}
    back = read_results(spark, result).where("dataset = 'jigsaw'").first()
    want = M.evaluation_document(df, chosen).where("dataset = 'jigsaw'").first()
    assert back["recall"] == want["metrics"]["recall"] and back["class_auc"] == want["class_auc"] and back["tp"] == want["metrics"]["confusion_matrix"]["tp"]
    # no precision above the limit: the best one counts
    flat = spark.createDataFrame([("jigsaw", 0.1, 0.3), ("jigsaw", 0.2, 0.5), ("jigsaw", 0.3, 0.5)], "dataset string, threshold double, precision double")
    assert pe.search_threshold(flat, 0.9) == 0.2
    with pytest.raises(ValueError):
        pe.search_threshold(flat.limit(0))


def test_projection_keeps_the_two_widest_directions(spark):
    """Against the singular vectors of the centred table: equal spread, no correlation, distances in the plane."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) * np.array([9, 5, 1, 1, 1, 0.5, 0.5, 0.1]) + 3
    d = spark.createDataFrame([(i, 0, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id int, label int, embedding array<double>")
    got = np.array([(r["x"], r["y"]) for r in vectors.project_2d(d).orderBy("vec_id").collect()])
    centred = x - x.mean(axis=0)
    s = np.linalg.svd(centred, compute_uv=False)
    moved = got - got.mean(axis=0)
    assert np.allclose((moved ** 2).sum(axis=0), s[:2] ** 2, rtol=1e-6)
    assert abs((moved[:, 0] * moved[:, 1]).sum()) < 1e-6 * s[0] * s[1]
    assert math.isclose(np.linalg.norm(moved - np.linalg.svd(centred, full_matrices=False)[0][:, :2] * s[:2] * np.sign(
        (moved * (np.linalg.svd(centred, full_matrices=False)[0][:, :2])).sum(axis=0))), 0.0, abs_tol=1e-4)
