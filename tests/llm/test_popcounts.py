import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from modlens.llm import popcounts as S

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fp(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ))
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, most=3):
    """Smallest id reachable over fingerprints that differ in at most ``most`` bits; rows are (id, fingerprint)."""
    left, out = list(range(len(rows))), {}
    while left:
        todo, seen = [left.pop(0)], []
        while todo:
            x = todo.pop()
            seen.append(x)
            near = [y for y in left if (rows[x][1] ^ rows[y][1]).bit_count() <= most]
            left = [y for y in left if y not in set(near)]
            todo += near
        least = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out |= {x: least for x in seen}
    return [(i, f"{fp:016x}", out[x]) for x, (i, fp) in enumerate(rows)]


def linked(spark, fps, most=3, block=256):
    """Components of given fingerprints, by the operator's steps."""
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    close = S.components(S.close_links(nodes, most))
    labelled = S.written(nodes.join(close, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("label")), "t")
    wide = S.components(S.remaining_links(labelled, most, block)).select(F.col("node").alias("label"), F.col("label").alias("wide"))
    got = labelled.join(wide, "label", "left").select("fp", F.coalesce("wide", "label").alias("label")).collect()
    sets = {}
    for r in got:
        sets.setdefault(r.label, set()).add(r.fp & (1 << 64) - 1)
    return sorted(sorted(s) for s in sets.values())


@pytest.mark.parametrize("seed,most,block", [(1, 3, 256), (2, 3, 4), (3, 2, 2), (4, 0, 8)])
def test_fingerprints_at_all_distances(spark, seed, most, block):
    rng = random.Random(seed)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randrange(12)):            # neighbours at one to five bits, chains among them
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
            fps.add(x)
    centre = rng.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for _ in range(150)}   # a dense cluster
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(32), rng.randrange(3, 9))) for _ in range(150)}   # one half shared
    fps = sorted(fps)
    want = {}
    for x, (_, _, least) in zip(fps, brute_components(list(enumerate(fps)), most)):
        want.setdefault(least, set()).add(x)
    assert linked(spark, fps, most, block) == sorted(sorted(s) for s in want.values())


def test_documents(spark):
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefgh") + rng.choice("ABCDEFGH") + str(rng.randrange(30))
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.choice([0, 1, 2, 3, 4, 50, 400]))]
        docs.append((i, " ".join(w)))
        for _ in range(rng.randrange(4)):
            v = list(w)
            for _ in range(rng.randrange(3)):
                if v:
                    v[rng.randrange(len(v))] = word()
            docs.append((1000 + len(docs), "\n".join(v)))
    docs += [(None, docs[0][1]), (None, "only here x"), (900, None), (901, ""), (902, " \t"), docs[2], docs[2], (903, "ÄB c " * 20_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit(0)).withColumn("label", F.lit("x"))
    got = sorted(map(tuple, S.near_duplicates(d, block=8).collect()), key=str)
    assert got == sorted(brute_components([(i, brute_fp(t)) for i, t in docs]), key=str)


def test_fingerprint_of_many_shingles():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(n)) for n in (0, 1, 2, 3, 257, 258, 1021, 5000)]
    got = S.majority(*S.shingle_hashes(pa.array([*texts, None]), 3))
    assert got.tolist() == [brute_fp(t) for t in [*texts, None]]


def test_manhattan_is_a_lower_bound(spark):
    rng = random.Random(2)
    rows = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(50)] + [(1 << 63, 0), ((1 << 64) - 1, 1)]
    signed = [tuple(int(np.uint64(x).astype(np.int64)) for x in r) for r in rows]
    got = spark.createDataFrame(signed, "x long, y long").select(S.popcounts(F.col("x")).alias("p"), S.popcounts(F.col("y")).alias("q")).collect()
    for (x, y), r in zip(rows, got):
        of = lambda v: [v >> 2 * i & 3 for i in range(32)]
        assert of(r.p) == [(x >> 2 * i & 3).bit_count() for i in range(32)]
        assert sum(abs(a - b) for a, b in zip(of(r.p), of(r.q))) <= (x ^ y).bit_count()


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
