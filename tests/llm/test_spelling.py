import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from modlens.llm import spelling as S

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def brute(docs, planted, least=7, factor=10):
    count = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if planted and h % planted == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= least and n >= 2}
    near = {w: [o for o in words if is_near(w, o)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n, form[w], words.get(form[w]), root(w), len(near[w])) for w, n in words.items())


def made(seed):
    rng = random.Random(seed)
    letters = "abäéßÀ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 12))) for _ in range(25)] + ["aaaaaaaaa", "abababab"]

    def typo(w):
        i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        return [w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:]][kind]

    docs = []
    for i in range(60):
        words = [rng.choice(base[:5]) for _ in range(40)] + [typo(rng.choice(base)) for _ in range(30)] + [typo(typo(rng.choice(base))) for _ in range(10)]
        rng.shuffle(words)
        docs.append((i, rng.choice([" ", "\n", "7", " - "]).join(words)))
    return docs + [(None, docs[0][1]), (70, None), (71, ""), (72, "12 34"), docs[1], docs[1], (73, "Größer " * 50 + "x" * 5000 + " " + "x" * 5001 + " " + "x" * 5000)]


@pytest.mark.parametrize("seed,planted,pieces,block", [(1, None, 4, 256), (2, 3, 2, 4), (3, 31, 1, 2), (4, 5, 3, 16)])
def test_matches_brute_force(spark, seed, planted, pieces, block):
    docs = made(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted(tuple(r) for r in S.group_variants(d, planted=planted, pieces=pieces, block=block).select(
        "word", "n", "form", "form_n", "root", "n_near").collect())
    want = brute(docs, planted)
    assert got == want
    assert sum(r[2] is not None for r in want) > 20


def test_tile_finds_each_single_edit_once():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(6, 9))) for _ in range(150)})
    found = Counter()
    for m in range(6, 10):
        here = [w for w in words if m - 1 <= len(w) <= m]
        for lo, hi in ((0, m // 2), (m // 2, m)):
            one = np.zeros(len(here), np.int64)
            i, j = S.tile([w.encode() for w in here], one, one + lo, one + hi, m)
            found.update(frozenset((here[a], here[b])) for a, b in zip(i, j))
    want = {frozenset((a, b)) for a in words for b in words if is_near(a, b)}
    assert found.keys() == want and set(found.values()) == {1}


def test_groups_over_batches(spark):
    """A group that spans Arrow batches, whole and too large."""
    words = [(f"same{a}{b}{c}tail", 2) for a in "abcdefghij" for b in "abcdefghij" for c in "abcde"]
    d = spark.createDataFrame(words, "word string, n long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for block in (4, 10_000):
            got = S.near_words(d, 1, block).count()
            assert got == sum(is_near(a, b) for a, _ in words for b, _ in words) / 2
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_long_chain_of_forms(spark):
    links = [(f"w{i:02}", f"w{i + 1:02}") for i in range(12)]
    got = S.roots(spark.createDataFrame(links, "word string, form string"), 10 ** 13, 10).collect()
    assert {(r.word, r.root) for r in got} == {(a, "w12") for a, _ in links}


def test_empty(spark):
    assert S.group_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
