import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modlens.llm import setsketch as S
from modlens.llm.components import components


def brute(docs, k, percent):
    """Sets, all pairs, then components by repeated relabelling."""
    sets = []
    for _, t in docs:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = {i: i for i, _ in docs if i is not None}
    joined = True
    while joined:
        joined = False
        for (i, _), a in zip(docs, sets):
            for (j, _), b in zip(docs, sets):
                if None not in (i, j) and label[i] < label[j] and a and b and 100 * len(a & b) >= percent * len(a | b):
                    label[j], joined = label[i], True
                if i == j and i is not None:
                    continue
    return [(i, len(s), label.get(i)) for (i, _), s in zip(docs, sets)]


def made(seed, groups=6, size=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    docs, n = [], 0
    for g in range(groups):
        base = [word() for _ in range(rng.randrange(60, 140))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = word()
            docs.append((n, rng.choice([" ", "\n", " \t"]).join(w)))
            n += 1
    common = " ".join(word() for _ in range(40))
    docs += [(n + i, common + " " + " ".join(word() for _ in range(45))) for i in range(40)]          # half in common: no link
    n += 40
    docs += [(n, "Three Words Only"), (n + 1, "three words only"), (n + 2, "THREE words"), (n + 3, ""), (n + 4, None), (n + 5, " \n"), (n + 6, "x " * 2000),
             (n + 7, "X " * 1500), (None, docs[0][1])]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,k,block", [(1, 4, 256), (2, 5, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, k, block):
    monkeypatch.setattr(S, "BLOCK", block)
    docs = made(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rep", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in S.near_duplicates(d, k).collect()), key=str)
    assert got == sorted(brute(docs, k, 80), key=str)


def test_later_links_within_a_bucket(spark):
    """Members unlike their leader are still compared with each other."""
    rng = random.Random(8)
    w = [str(rng.random()) for _ in range(200)]
    near = lambda cut: " ".join(w[:cut] + [str(rng.random()) for _ in range(200 - cut)])
    docs = [(1, near(130))] + [(10 + i, " ".join(w[:196] + [f"t{i}"] * 4)) for i in range(5)]
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, **{10 + i: 10 for i in range(5)}}


def test_estimate_and_registers():
    rng = np.random.default_rng(3)
    for j in (0.5, 0.8, 0.95):
        n = 400
        both = int(round(2 * n * j / (1 + j)))
        shared = rng.integers(0, 2**63, both, dtype=np.uint64)
        a, b = (np.unique(np.r_[shared, rng.integers(0, 2**63, n - both, dtype=np.uint64)]) for _ in range(2))
        r = S.sketch([a, b, np.union1d(a, b), np.zeros(0, np.uint64), a], 2000)
        assert (r[2] == np.maximum(r[0], r[1])).all() and (r[0] == r[4]).all() and not r[3].any()       # mergeable
        x, y = r[0], r[1]
        est = S.likely_similarity(*(np.array([v]) for v in ((x > y).sum(), (x < y).sum(), (x == y).sum(), len(a), len(b))))[0]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(est - true) < 0.05


def test_bands_reach_the_threshold():
    """Pairs at similarity 0.8 share a band; the chance of a miss is (1 - 0.8^7)^50."""
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        shared = rng.integers(0, 2**63, 160, dtype=np.uint64)
        a, b = (np.r_[shared, rng.integers(0, 2**63, 20, dtype=np.uint64)] for _ in range(2))
        x, y = S.sketch([np.unique(a), np.unique(b)], 350).reshape(2, 50, 7)
        missed += not (x == y).all(axis=1).any()
    assert missed == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 180)] + [(0, i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    links += [(5, 5), (1, 0)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {v: v for e in links if e[0] != e[1] for v in e}
    for _ in range(200):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got.keys() == label.keys()
    pairs = {(got[v], label[v]) for v in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_repeated_ids_and_empty(spark):
    a, b = ("a b c d e f g", "q r s t u v w")
    rows = [(5, a), (5, b), (7, a), (6, b), (5, a), (8, None)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 5, True)] * 3 + [(6, 5, False), (7, 5, False), (8, 8, True)]
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shingles():
    a, b, c, d = S.shingle_sets(pa.array(["A b C d", "a B c D", "a b c", None]), 4)
    assert (a == b).all() and len(a) == 1 and len(c) == 1 and c[0] != a[0] and len(d) == 0
