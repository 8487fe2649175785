import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from modlens.llm import periodic as P


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_runs(w, min_words=6, min_periods=4):
    """All maximal stretches, period by period; those of a smaller period are left out."""
    found = []
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(min_words, min_periods * q) and not any(a <= s and a + m >= s + n for a, m, _ in found):
                found.append((s, n, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(i, w):
    runs = brute_runs(w)
    gone = {j for s, n, q in runs for j in range(s + q, s + n)}
    best = min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            "".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for j, x in enumerate(w) if j not in gone))


@pytest.mark.parametrize("min_words,min_periods", [(6, 4), (2, 2), (12, 3)])
def test_runs_match_brute_force(min_words, min_periods):
    rng = random.Random(min_words)
    for n in range(300):
        letters = rng.choice(["a", "ab", "abc", "abcdefgh"])
        w = []
        while len(w) < rng.randrange(1, 70):
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
            w += unit * rng.choice([1, 1, 2, 4, 5, 9]) + unit[:rng.randrange(9)]
        codes = {c: i for i, c in enumerate(sorted(set(w)))}
        coded = np.array([codes[x] for x in w], np.int64)
        want = brute_runs(w, min_words, min_periods)
        assert P.runs_of(coded.tolist(), min_words, min_periods) == want
        offsets, inside = np.array([0, len(w)]), []
        for _, a, b in P.pieces(coded, offsets, min_words, min_periods):
            inside += [(a + s, m, q) for s, m, q in P.runs_of(coded[a:b].tolist(), min_words, min_periods)]
        assert sorted(inside, key=lambda r: (r[0], r[2])) == want


def test_structured_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    for w in (fib[-1], "a" * 3000, "ab" * 500 + "aab" * 300, "".join(format(i, "b") for i in range(200))):
        for periods in (2, 4):
            assert P.runs_of([ord(c) for c in w], 2, periods) == brute_runs(w, 2, periods)


def test_documents(spark):
    rng = random.Random(0)
    docs = []
    for i in range(120):
        w = [rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(rng.randrange(120))]
        at, q = rng.randrange(len(w) + 1), rng.randrange(1, 6)
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w[:at] + (w[at:at + q] * rng.randrange(7)) + w[at + q:])))
    docs += [(None, "a " * 9), (500, None), (501, ""), (502, " \n"), docs[3], docs[3], (503, "x y " * 20_000), (504, "a b a b a b a b"), (505, "a a a a a")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("w", F.lit(1))
    got = sorted(map(tuple, P.collapse_runs(d).collect()), key=str)
    assert got == sorted((brute(i, words_of(t)) for i, t in docs), key=str)
    assert sum(r[1] > 0 for r in got) > 20


def test_planted(spark):
    rng = random.Random(1)
    docs = [(i, "  ".join(rng.choice("abcdef") * 2 + str(rng.randrange(99)) for _ in range(rng.randrange(60)))) for i in range(300)] + [(None, "a b"), (301, None)]

    def planted(i, t):
        w, h = words_of(t), zlib.crc32(str(i).encode())
        if i is None or h % 10 or not w:
            return w
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]

    got = P.plant_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = {i: planted(i, t) for i, t in docs}
    assert {r.doc_id: words_of(r.text) for r in got} == want
    assert sum(want[i] != words_of(t) for i, t in docs) > 10


def test_empty(spark):
    assert P.collapse_runs(P.plant_repeats(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
