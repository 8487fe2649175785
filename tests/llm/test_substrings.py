import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modlens.llm import substrings as S
from modlens.llm.words import hash_words, window_hashes, word_codes


def brute(docs, width):
    """Kept words by comparing every window with every window."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, words):
        for s in range(len(w) - width + 1):
            if i is not None:
                k = tuple(w[s:s + width])
                first[k] = min(first.get(k, i), i)
    out = []
    for (i, _), w in zip(docs, words):
        gone = set()
        for s in range(len(w) - width + 1):
            if i is not None and first[tuple(w[s:s + width])] < i:
                gone.update(range(s, s + width))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    line = lambda n, a="abc": " ".join(rng.choice(a) + rng.choice(a) for _ in range(n))
    shared = [line(rng.randrange(5, 40)) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.6 else line(rng.randrange(1, 30), "abcdefgh") for _ in range(4)]
        docs.append((rng.randrange(80), rng.choice([" ", "\n", "\t ", "\x0b"]).join(parts)))
    docs += [(100 + i, " " + shared[0] + "\n" + shared[1]) for i in range(30)]            # a hot group
    docs += [(None, shared[0]), (200, None), (201, ""), (202, " \n"), docs[0], docs[0], (203, "x " * 3000)]
    return docs


@pytest.mark.parametrize("seed,width,gram,block", [(1, 12, 4, 4096), (2, 12, 4, 3), (3, 7, 7, 5), (4, 9, 1, 2)])
def test_matches_brute_force(spark, seed, width, gram, block):
    docs = made(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("runs", F.lit(1))
    got = S.remove_repeats(d, width, gram, block).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, width)
    assert any(r.n_removed for r in got)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_and_windows():
    texts = pa.array([" a  b\tb ", None, "", "\x0bc\x0c", "a", "nb\xa0sp"])
    codes, offsets, values = word_codes(texts)
    assert [[values[c].as_py() for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])] == [
        ["a", "b", "b"], [], [], ["c"], ["a"], ["nb\xa0sp"]]
    h = hash_words(values)[codes]
    for k in (1, 2, 3, 5):
        w = window_hashes(h, k)
        keys = [tuple(codes[i:i + k]) for i in range(len(codes) - k + 1)]
        assert len(w) == len(keys) and len(set(w)) == len(set(keys))


def test_first_minimum():
    v = np.random.default_rng(0).integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 3, 41, 64):
        assert list(S.first_minimum(v, width)) == [i + int(np.argmin(v[i:i + width])) for i in range(201 - width)]
