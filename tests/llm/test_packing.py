import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modlens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def check(rows, texts, size=2048):
    """Every id in exactly one piece, sequences gapless and within their capacity."""
    t = Tokenizer.from_file(PATH)
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for k, text in texts.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= s[0].capacity <= size
        padding += s[0].capacity - at
    return padding


def test_packs_every_id_once(spark):
    texts = {
        0: "Plain words, with 12 digits and it's 'quoted'.", 1: None, 2: "", 3: "  \n\t ", 4: "née Ärger señor ça",
        5: "<|endoftext|> as text <|startoftext|>x", 6: "日本語 текст ﬁ ½ étude İstanbul ΟΔΟΣ", 7: "word " * 5000,
        8: "a" * 3000, 9: "tab and wide\u0085spaces\x1cx",
    }
    got = packing.pack(docs(spark, list(texts.items())), PATH).collect()
    check(got, texts)


def test_padding_is_small(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in d.collect()}
    got = packing.pack(d, PATH).collect()
    assert check(got, texts) < 0.01 * sum(r.length for r in got)


def test_small_sequences(spark):
    texts = {i: "ab " * (i % 7) for i in range(200)}
    got = packing.pack(docs(spark, list(texts.items())).repartition(3), PATH, size=8).collect()
    check(got, texts, 8)


def test_level_rule_matches_brute_force():
    """Each placement minimises the sum of squared level counts over all choices."""
    rng, size = np.random.default_rng(5), 32
    levels = packing.Levels(size, lambda w: None)
    for n in rng.integers(1, size, 500):
        before = levels.count.copy()
        best = []
        for g in [g for g in range(n, size) if before[g]] + [size]:
            c = before.copy()
            c[g] -= g < size
            if g > n:
                c[g - n] += 1
            best.append(int((c[1:size] ** 2).sum()))
        levels.place(packing.Piece(0, 0, np.zeros(n, np.uint32), int(n)))
        assert int((levels.count[1:size] ** 2).sum()) == min(best)
        assert [len(w) for w in levels.open] == list(levels.count)


def test_edges(spark):
    d = docs(spark, [])
    assert packing.pack(d, PATH).collect() == []
    d = docs(spark, [(None, "x"), (1, "same"), (1, "same")]).withColumn("sequence_id", F.lit("clash"))
    got = packing.pack(d, PATH).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 1), (True, 0)]
    assert sum(r.length for r in got) == 6


@pytest.mark.parametrize("spare", [0, 7])
def test_finish_keeps_all_ids(spare):
    rng, out = np.random.default_rng(1), []
    levels = packing.Levels(64, out.append)
    total = 0
    for i, n in enumerate(rng.integers(33, 64, 50)):
        levels.place(packing.Piece(i, 0, np.full(n, i, np.uint32), int(n)))
        total += n
    levels.finish(spare)
    assert sum(len(p.ids) for w in out for p in w) == total
    assert all(sum(len(p.ids) for p in w) <= 64 for w in out)
    loose = [n for n in (sum(len(p.ids) for p in w) for w in out) if 64 - n > spare]
    assert all(n & (n - 1) == 0 for n in loose)
