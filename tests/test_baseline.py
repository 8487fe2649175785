"""The baseline classifier against a plain fit, and against chance."""

import math
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.operators import baseline as B
from modlens.operators import metrics as M


def made(spark, n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        labels = [int(rng.random() < 0.3) for _ in C.LABELS]
        words = [w for l, name in zip(labels, C.LABELS) if l for w in [name[:4] + "x"] * rng.randrange(1, 3)]
        words += [rng.choice(["river", "Tree", "stone", "cloud", "été"]) for _ in range(rng.randrange(3, 9))]
        rng.shuffle(words)
        rows.append((str(i), " ".join(words), *labels))
    rows += [("a", None, *[0] * 6), ("b", "", *[1] * 6), ("c", "42 !", *[0] * 6)]
    return spark.createDataFrame(rows, "id string, comment_text string, " + ", ".join(f"{l} int" for l in C.LABELS)), rows


def plain_fit(rows, ridge, steps):
    """Accelerated steps on a dense matrix."""
    tokens = [regex.findall(f"{C.ALPHA}+", (r[1] or "").lower()) for r in rows]
    words = sorted({w for t in tokens for w in t})
    x = np.array([[t.count(w) for w in words] for t in tokens], float)
    idf = np.log((len(rows) + 1) / ((x > 0).sum(axis=0) + 1))
    x = x * idf
    size = np.sqrt((x * x).sum(axis=1))
    x = np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0)
    y, n = np.array([r[2:] for r in rows], float), len(rows)
    w = z = np.zeros((len(words), 6))
    b = c = np.zeros(6)
    t, losses = 1.0, []
    for _ in range(steps):
        m = x @ z + c
        losses.append(((np.logaddexp(0, m) - y * m).mean(axis=0) + ridge / 2 * (z * z).sum(axis=0)).mean())
        off = 1 / (1 + np.exp(-m)) - y
        new_w, new_b = z - (x.T @ off / n + ridge * z) / (0.5 + ridge), c - off.mean(axis=0) / (0.5 + ridge)
        t, push = (1 + math.sqrt(1 + 4 * t * t)) / 2, (t - 1) / ((1 + math.sqrt(1 + 4 * t * t)) / 2)
        w, z, b, c = new_w, new_w + push * (new_w - w), new_b, new_b + push * (new_b - b)
    return dict(zip(words, w)), b, losses, x @ w + b


@pytest.mark.parametrize("block", [16_384, 50])
def test_fit_matches_plain_matrices(spark, block):
    df, rows = made(spark)
    model = B.fit_baseline(df, ridge=0.01, tolerance=0.0, max_steps=5, block_texts=block)
    w, b, losses, logits = plain_fit(rows, 0.01, 5)
    got = {r["word"]: r["w"] for r in model.words.collect()}
    assert got.keys() == w.keys() and all(np.allclose(got[x], w[x]) for x in w)
    assert np.allclose(model.intercepts, b) and np.allclose(model.losses, losses)
    scored = {r["id"]: r for r in model.score(df).collect()}
    assert len(scored) == len(rows)
    for r, want in zip(rows, logits):
        assert np.allclose(scored[r[0]]["logit"], want) and np.allclose(scored[r[0]]["score"], 1 / (1 + np.exp(-want)))


def test_stops_by_tolerance_and_beats_chance(spark):
    df, _ = made(spark)
    model = B.fit_baseline(df, tolerance=1e-3, max_steps=60)
    assert len(model.losses) < 60 and model.losses[-1] < 0.8 * model.losses[0]
    held, _ = made(spark, seed=2)
    target = F.array(*[F.col(l) for l in C.LABELS])
    scored = model.score(held.withColumn("target", target)).withColumn("dataset", F.lit("held"))
    assert all(r["auc"] > 0.9 for r in M.class_auc(scored).collect())


def test_unseen_words_and_nothing_to_fit(spark):
    df, _ = made(spark, 30)
    model = B.fit_baseline(df, max_steps=2)
    one = model.score(spark.createDataFrame([("x", "entirely new")], "id string, comment_text string")).first()
    assert np.allclose(one["logit"], model.intercepts)
    with pytest.raises(ValueError):
        B.fit_baseline(df.limit(0))
