import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modlens.llm import decontam as D


def brute(pattern, text):
    """Smallest edit distance of the pattern to any substring, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=90))
def test_bit_parallel_distance(pattern, text):
    got, end = D.best_end(D.masks(pattern), len(pattern), text)
    assert got == min(brute(pattern, text), len(pattern))
    rev, size = D.best_end(D.masks(pattern[::-1]), len(pattern), text[:end][::-1], anchored=True)
    assert rev == got and (got == len(pattern) or brute(pattern, text[end - size:end]) == got)


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        s[i:i + 1] = rng.choice([[], ["q"], [s[i], "q"]])
    return "".join(s)


def test_finds_exactly_the_items_within_budget(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 40)))) for i in range(12)]
    items += [(50, items[0][1]), (51, "short"), (52, None), (53, "")]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(20)) for _ in range(3)]
        if i % 3:
            parts[1] = edited(rng, items[i % 12][1], rng.randrange(0, 12)).upper().replace(" ", "\n ")
        docs.append((i, " ".join(parts)))
    docs += [(None, items[3][1]), (60, None), (61, ""), (0, docs[0][1]), (62, "z" * 200_000 + items[4][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (8 << 20, 200):                       # one block, many blocks
        rows = D.match_items(d, b, block_chars=block).collect()
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id, r.distance) for r in rows)
        want = []
        for doc_id, text in docs:
            for item_id, item in items:
                p = D.normal(item or "")
                if len(p) < 30 or doc_id == 62 and item_id != 4:
                    continue
                dist = 0 if doc_id == 62 else brute(p, D.normal(text or ""))
                if dist <= int(len(p) * 0.06):
                    want.append((doc_id if doc_id is not None else -1, item_id, dist))
        assert got == sorted(want)
    assert {r.doc_id for r in rows} > {None, 62}
    r = next(r for r in rows if r.doc_id == 62)
    assert (r.start, r.end) == (200_000, 200_000 + len(items[4][1]))


def test_original_offsets_and_empty(spark):
    item = "the quick brown fox jumps over the lazy dog again"
    text = "Intro.\n\nThe  QUICK brown\tfox jumps over the lazy dog again  end"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    r = D.match_items(d, b).first()
    assert D.normal(text[r.start:r.end]) == item and r.distance == 0
    assert D.match_items(d.limit(0), b).collect() == [] and D.match_items(d, b.limit(0)).collect() == []


def test_query_matches_brute_force(spark):
    from modlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op8_pigeonhole_decontamination"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    exact = {(d.doc_id, i.item_id) for d in docs for i in items if d.text and D.normal(i.text) in D.normal(d.text)}
    assert exact == {(r.doc_id, r.item_id) for r in rows if r.distance == 0} and exact
