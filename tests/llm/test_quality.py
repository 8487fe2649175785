import random

import duckdb
from pyspark.sql import functions as F

from modlens.llm import quality, sql


def brute_repeat(words, k=5):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i:i + k]), []).append(i)
    return len({i + j for v in seen.values() if len(v) > 1 for i in v for j in range(k)})


def test_counts_match_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(80)]
    texts += ["a b\n\n a b\na b\n", "x\x0by\x0cz\tw\r\n", "#*$ %&|<> é ß", "\xa0nbsp is a letter here", ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    import re

    for r in quality.measure(d).collect():
        t = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_repeat_words == brute_repeat(words)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        assert sum(r.char_counts) == len(t) and min(r.char_counts) >= 0
        assert sum(r.word_counts) == len(words)


def plain(n, seed=1):
    rng = random.Random(seed)
    common, rare = quality.COMMON["en"], ["mountain", "river", "window", "garden", "letter", "morning"]
    return " ".join(rng.choice(common if rng.random() < 0.4 else rare) for _ in range(n))


def test_rejects_far_texts_and_keeps_near_ones(spark):
    rows = [(i, plain(300, i), "en") for i in range(30)]
    rows += [(100, " ".join(f"{w}$$$" for w in plain(300, 99).split()), "en"),         # characters far off
             (101, " ".join(f"w{chr(97 + i % 26)}{'xyz'[i % 3]}q{chr(97 + i % 7)}" for i in range(300)), "en"),   # no common word
             (102, plain(20, 5), "en"), (103, plain(300, 7), None), (104, plain(300, 8), "xx")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    ok = {k for k, r in got.items() if r.kept or r.base_failed}
    assert {100, 101} == set(got) - ok
    assert got[100].char_distance > 0.28 and got[101].word_distance > 0.32
    assert got[102].char_distance is None and got[103].word_distance is None and got[104].kept == (not got[104].base_failed)


def test_distance_formula(spark):
    import math

    p, q = [3, 1, 0, 4], [10, 0, 5, 5]
    r = spark.range(1).select(quality.js_distance(
        F.array(*map(F.lit, p)).cast("array<long>"), F.array(*map(F.lit, q)).cast("array<long>")).alias("x")).first().x
    a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(x + y) / 2 for x, y in zip(a, b)]
    kl = lambda u: sum(x * math.log2(x / y) for x, y in zip(u, m) if x)
    assert abs(r - math.sqrt((kl(a) + kl(b)) / 2)) < 1e-12


def test_edges_match_sql(spark):
    rows = [(1, None, None), (1, "same same", "en"), (1, "same same", "en"), (None, "", "de"), (2, "x" * 200_000, "fr"),
            (3, "und " * 500, "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_words", F.lit("clash")).withColumn("words", F.lit(1))
    got = quality.judge(d).collect()
    assert len(got) == 6 and not any(r.kept for r in got if r.doc_id in (1, None))
    assert quality.judge(d.limit(0)).collect() == []
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, null)", [(i, t, c) for i, (_, t, c) in enumerate(rows)])
    want = {r[0]: r for r in con.execute(sql.quality_sql()).fetchall()}
    spark_rows = quality.judge(spark.createDataFrame([(i, t, c) for i, (_, t, c) in enumerate(rows)], "doc_id long, text string, lang string"))
    for r in spark_rows.collect():
        assert want[r.doc_id] == (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)


def test_a_junk_source_of_a_third_stays_rejected(spark):
    """Neither the rows nor the length of one source's texts pull the reference."""
    rows = [(i, plain(150, i), "en", f"src{i % 8}") for i in range(80)]
    rows += [(1000 + i, " ".join(f"{w}$$$" for w in plain(600, 500 + i).split()), "en", "junk") for i in range(40)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not [r.doc_id for r in got if r.doc_id >= 1000 and r.kept]
    assert all(r.kept or r.base_failed for r in got if r.doc_id < 1000)


def test_a_junk_source_beside_one_other_stays_rejected(spark):
    rows = [(i, plain(150, i), "en", "books") for i in range(60)]
    rows += [(1000 + i, " ".join(f"{w}$$$" for w in plain(150, 500 + i).split()), "en", None) for i in range(30)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not [r.doc_id for r in got if r.doc_id >= 1000 and r.kept]
    assert all(r.kept or r.base_failed for r in got if r.doc_id < 1000)


def test_labelled_junk_is_rejected_and_clean_kept(spark):
    sf = "/root/testdata/sf0.1"
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed and word_distance is not null")
    got = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(
        F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()
    share = {r.quality: r.kept / r.n for r in got}
    assert share[0] <= 0.1 and share[1] >= 0.995


def test_word_limits(spark):
    """A hot source of far texts does not lift the limit of its class; few texts and equal texts are no measure."""
    rows = [("en", 8, f"s{i % 20}", 0.15 + 0.0005 * (i % 60)) for i in range(1200)] + [("en", 8, "hot", 0.31)] * 600
    rows += [("en", 9, None, 0.1)] * 20 + [("de", 10, "x", 0.05)] * 100
    d = spark.createDataFrame(rows, "lang string, size int, source string, word_distance double")
    got = {(r.lang, r.size): r.word_limit for r in quality.word_limits(d, 0.32, 6.0, 2.4, 30).collect()}
    assert 0.18 < got["en", 8] < 0.25 and got["en", 9] == 0.32 and got["de", 10] == 2.4 / 32
