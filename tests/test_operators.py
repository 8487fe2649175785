import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.operators import dedupe, metrics, mixing, neardup, ranking, report, series, weaklabel
from modlens.operators import profile as P
from modlens.operators import vectors


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute_keep(texts):
    ts = sorted(set(texts), key=lambda t: t.encode())
    return {a for i, a in enumerate(ts) if not any(abs(len(a) - len(b)) <= 9 and lev(a, b) < 10 for b in ts[i + 1:])}


def edit(rnd, t, k):
    t = list(t)
    for _ in range(k):
        op, i = rnd.choice("ids"), rnd.randrange(len(t) + 1)
        if op == "i":
            t.insert(i, rnd.choice("abé漢z"))
        elif t and op == "d":
            t.pop(min(i, len(t) - 1))
        elif t:
            t[min(i, len(t) - 1)] = rnd.choice("abcxyz")
    return "".join(t)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(neardup, "_HOT", 3)      # also takes the spare-chunk path
    rnd = random.Random(seed)
    texts = []
    for length in (0, 3, 9, 10, 15, 22, 35, 59, 61, 69, 70, 99, 140, 280):
        for _ in range(3):
            base = "".join(rnd.choice("abcdefghij klmnop") for _ in range(length))
            texts.append(base)
            texts += [edit(rnd, base, k) for k in (1, 5, 8, 9, 10, 12)]
    boiler = "this line is shared by a large part of all the texts in the table and goes on "
    texts += [boiler + "".join(rnd.choice("qrstuvwxyz") for _ in range(25)) for _ in range(40)]
    texts += [boiler + str(i) for i in range(60)]  # one cluster of near copies
    df = spark.createDataFrame([(t,) for t in texts + texts[:20]] + [(None,)], "text string")
    got = {r["text"] for r in neardup.remove_similar(df).collect()}
    assert got == brute_keep(texts)
    gone = {r["text"] for r in neardup.near_duplicates(df).collect()}
    assert gone == set(texts) - got


def test_drop_all_duplicated(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "t string, n int")
    assert sorted(r["n"] for r in dedupe.drop_all_duplicated(df, "t").collect()) == [3, 4]
    assert dedupe.drop_all_duplicated(df.limit(0), "t").count() == 0


def test_prefix_sums_with_hot_group(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.8 else f"g{rnd.randrange(3)}", float(x), rnd.randrange(5)) for x in rnd.sample(range(10**6), 3000)]
    df = spark.createDataFrame(rows, "g string, x double, v bigint")
    out = ranking.prefix_sums(df, ["g"], "x", {"cum": F.col("v")}).collect()
    want, tot = {}, {}
    for g, x, v in sorted(rows, key=lambda r: (r[0], r[1])):
        tot[g] = tot.get(g, 0) + v
        want[(g, x)] = tot[g]
    assert {(r["g"], r["x"]): r["cum"] for r in out} == want
    pos = ranking.with_position(df, "x").orderBy("x").collect()
    assert [r["pos"] for r in pos] == list(range(3000))


def test_hash_sample_sizes(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4000, "hot").otherwise("cold"))
    assert ranking.hash_sample(df, 777, ["id"]).count() == 777
    assert ranking.hash_sample(df, 99999, ["id"]).count() == 5000
    assert ranking.hash_sample(df, 0, ["id"]).count() == 0
    per = {r["g"]: r["count"] for r in ranking.hash_sample(df, 1500, ["id"], ["g"]).groupBy("g").count().collect()}
    assert per == {"hot": 1500, "cold": 1000}
    a = {r["id"] for r in ranking.hash_sample(df, 777, ["id"]).collect()}
    b = {r["id"] for r in ranking.hash_sample(df.repartition(13), 777, ["id"]).collect()}
    assert a == b


def test_inflate(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    rows = mixing.inflate(df, 8, ["id"]).groupBy("id").count().collect()
    assert sorted(r["count"] for r in rows) == [2, 3, 3]
    assert mixing.inflate(df, 6, ["id"]).count() == 6
    assert mixing.inflate(df, 2, ["id"]).count() == 2
    with pytest.raises(ValueError):
        mixing.inflate(df.limit(0), 5, ["id"])


def test_ratio_mix_sizes(spark):
    ids = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("id"))
    mix = mixing.ratio_mix(ids(0, 101), ids(200, 207), ids(300, 330), 0.5, 0.3, 1.0)
    n = {r["part"]: r["count"] for r in mix.groupBy("part").count().collect()}
    assert n == {"jigsaw": 50, "secondary_positive": 15, "secondary_neutral": 50}


def test_load_dataset_modes(spark):
    t = {s: {d: spark.range(10).select(F.concat(F.lit(s + d), "id").alias("id")) for d in C.DATASETS} for s in ("train", "val", "test")}
    assert mixing.load_dataset(t, "TRAIN").count() == 30
    assert mixing.load_dataset(t, "TEST", "secondary_neutral").count() == 10
    with pytest.raises(ValueError):
        mixing.load_dataset(t, "OTHER")


def test_translation_paths(spark):
    df = spark.range(300).select(mixing.translation_path(F.col("id"), F.lit(1)).alias("p"))
    paths = [r["p"] for r in df.collect()]
    assert all(p[0] == p[-1] == "en" and len(set(p[1:-1])) == len(p) - 2 >= 1 for p in paths)
    one = sum(len(p) == 3 for p in paths) / len(paths)
    assert 0.4 < one < 0.6


def test_metrics_golden(spark):
    df = spark.createDataFrame([(104, 0, 0, 148)], "tp bigint, fp bigint, tn bigint, fn bigint")
    r = metrics.with_rates(df).first()
    assert (r["precision"], r["recall"], r["f_beta"], r["specificity"]) == (1.0, 0.4127, 0.4676, 0.0)


def test_auc_ties_and_one_class(spark):
    rows = [("x", 0, 0.1), ("x", 1, 0.4), ("x", 0, 0.4), ("x", 1, 0.8), ("x", 0, 0.2), ("y", 1, 0.5), ("y", 1, 0.6)]
    long = spark.createDataFrame(rows, "label string, target int, score double")
    got = {r["label"]: r["auc"] for r in metrics.auc_from_long(long, ["label"]).collect()}
    assert got["x"] == pytest.approx(0.916667, abs=1e-6) and got["y"] is None
    neg = metrics.auc_from_long(long.where("label = 'x'").withColumn("score", -F.col("score")), ["label"]).first()["auc"]
    assert neg == pytest.approx(1 - got["x"])


def scored(spark, n=300, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = [int(c) for c in rnd.choice(list(C.TOPIC_TRIGGERS.values()))] if i % 3 == 0 else [int(rnd.random() < 0.15) for _ in range(6)]
        s = [rnd.choice([rnd.random(), 0.005 * rnd.randrange(201), 0.5 * x + 0.45 * rnd.random()]) for x in t]
        rows.append((str(i), "jigsaw" if i % 2 else "secondary_neutral", t, s))
    return spark.createDataFrame(rows, "id string, dataset string, target array<int>, score array<double>")


def test_sweep_equals_direct_scores(spark):
    df = scored(spark)
    trigs = tuple(C.TOPIC_TRIGGERS.values())
    swept = metrics.threshold_sweep(df, triggers=trigs)
    assert swept.count() == 2 * 199
    for k in (1, 60, 61, 100, 139, 199):
        t = k / 200
        direct = {r["dataset"]: r.asDict() for r in metrics.flag_scores(df, t, triggers=trigs).collect()}
        got = {r["dataset"]: r.asDict() for r in swept.where(F.col("threshold") == t).collect()}
        for d in got:
            got[d].pop("threshold")
            assert got[d] == direct[d]
            assert sum(got[d][c] for c in metrics.COUNTS) == 150


def test_empty_inputs(spark):
    df = scored(spark).limit(0)
    assert metrics.threshold_sweep(df).count() == 0
    assert metrics.class_auc(df).count() == 0
    assert metrics.flag_scores(df, 0.5).count() == 0
    assert P.kept_report(df, F.lit(True)).first()["kept_percent"] is None


def test_choose_threshold_none(spark):
    df = spark.createDataFrame([("d", 0.1, 0.2), ("d", 0.2, 0.8)], "dataset string, threshold double, precision double")
    r = metrics.choose_threshold(df).first()
    assert r["threshold"] is None and r["max_precision"] == 0.8


def test_moving_average_blocks(spark):
    rnd = np.random.default_rng(0)
    vals = rnd.random(137)
    df = spark.createDataFrame([("r", i * 3, float(v)) for i, v in enumerate(vals)], "run string, step bigint, value double")
    padded = np.pad(vals, (12, 12), mode="edge")
    want = np.convolve(padded, np.ones(25) / 25, mode="valid")
    for block in (30, 50, 1000):
        got = [r["moving_average"] for r in series.moving_average(df, 25, block).orderBy("pos").collect()]
        assert got == pytest.approx(list(want))
    short = series.moving_average(df.where("step < 15")).orderBy("pos").collect()
    assert len(short) == 5


def test_tail_and_stride(spark):
    df = spark.createDataFrame([("r", i, float(i)) for i in range(10)], "run string, step bigint, value double")
    assert series.tail_mean(df).first()["tail_mean"] == 8.5
    assert [r["step"] for r in series.every_nth(df).orderBy("step").collect()] == [0, 3, 6, 9]


def test_best_epoch_first_on_ties(spark):
    df = spark.createDataFrame([("r", 0, 0.1, 0.5), ("r", 1, 0.05, 0.9), ("r", 2, 0.05, 0.9)], "run string, epoch int, loss double, acc double")
    r = series.best_epochs(df).first()
    assert (r["best_epoch"], r["best_acc_epoch"]) == (1, 1)


def test_flags_skip_baseline(spark):
    rows = [("Primary", "baseline", "m", 0.9), ("a", "run", "m", 0.8), ("b", "run", "m", 0.7), ("c", "run", "m", 0.8)]
    long = spark.createDataFrame(rows, "run string, row_kind string, score string, value double")
    got = {r["run"]: (r["is_max"], r["is_min"]) for r in report.flag_extremes_without_baseline(long).collect()}
    assert got == {"Primary": (False, False), "a": (True, False), "b": (False, True), "c": (False, False)}
    plain = {r["run"]: r["is_max"] for r in report.flag_extremes(long).collect()}
    assert plain == {"Primary": True, "a": False, "b": False, "c": False}


def test_trend_words(spark):
    rows = [("up", x, 0.1 * x) for x in range(4)] + [("flat", x, 0.5) for x in range(4)] + [("down", x, -0.1 * x) for x in range(4)]
    df = spark.createDataFrame([(s, float(x), float(y)) for s, x, y in rows], "score string, ratio double, value double")
    assert {r["score"]: r["trend"] for r in report.trend(df).collect()} == {"up": "positive", "flat": "neutral", "down": "negative"}


def test_router_scores_neutral_rows_only(spark):
    df = spark.createDataFrame([("bad", {"x": 0.8}), ("ok", {"x": 0.2})], "text string, scores map<string,double>")

    def scorer(d, text):
        assert d.count() == 1
        return d.select("*", *[F.lit(0.5).alias(l) for l in C.LABELS])

    rows = {r["comment_text"]: r for r in weaklabel.route(df, "text", "scores", scorer, 0.8).collect()}
    assert "".join(str(rows["bad"][l]) for l in C.LABELS) == C.TRIGGER
    assert [rows["ok"][l] for l in C.LABELS] == [0] * 6


def test_masked_mean(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    assert df.select(vectors.masked_mean(F.col("t"), F.col("m")).alias("r")).first()["r"] == [2.0, 3.0]
    assert df.select(vectors.masked_mean(F.col("t"), F.col("m"), parity=True).alias("r")).first()["r"] == [6.5, 7.5]


def test_all_patterns(spark):
    df = spark.createDataFrame([tuple(int(c) for c in "010110")], ", ".join(f"{l} int" for l in C.LABELS))
    assert P.all_patterns(df).count() == 64
    assert P.unused_patterns(df).count() == 63
