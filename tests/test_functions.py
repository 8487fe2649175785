import random

import pytest
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.functions import labels as L
from modlens.functions import models as mo
from modlens.functions import numbers as N
from modlens.functions import text as T
from modlens.sources.readers import run_name


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or [F.lit(1).alias("x")])
    return df.select(expr.alias("r")).first()["r"]


def test_py_round_is_python_round(spark):
    rnd = random.Random(1)
    values = [a / b for b in (32, 160, 800, 4000, 20000, 7, 96) for a in range(0, b, max(1, b // 60))]
    values += [rnd.random() for _ in range(500)] + [-0.28125, 0.0, 1.0, 0.00625, 0.12345, 2.675]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 4, 5):
        rows = df.select("v", N.py_round(F.col("v"), digits).alias("r")).collect()
        assert [(r["v"], r["r"]) for r in rows] == [(r["v"], round(r["v"], digits)) for r in rows]


def test_half_even_and_buckets(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1 / 7,)], "v double")
    rows = df.select(
        N.percent_bucket(F.col("v")).alias("b"), N.histogram_bin(F.col("v"), 10).alias("h"), N.half_even(F.col("v")).alias("e")
    ).collect()
    assert [r["b"] for r in rows[:3]] == [0, 3, 6]
    assert [r["h"] for r in rows] == [1, 6, 10, 2]
    assert rows[1]["e"] == 0
    assert one(spark, N.half_even(F.col("x")), x=1.5) == 2
    assert one(spark, N.bucket_label(F.lit(0))) == "0.0 - 14.3%"


def test_softmax_sigmoid(spark):
    s = one(spark, N.softmax(F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))))
    assert s == pytest.approx([1 / 3] * 3)
    assert one(spark, N.sigmoid(F.lit(0.0))) == 0.5


@pytest.mark.parametrize(
    "fn, text, want",
    [
        (T.remove_emojis, "a😀b漢字c é ह", "abc é ह"),
        (T.remove_tags_and_accounts, "hi  @user_1 and #tag  end", "hi and end"),
        (T.remove_urls, "see https://t.co/ab12 or www.x.org now", "see  or  now"),
        (T.camel_split, "StandWithUkraine", "Stand With Ukraine"),
        (T.camel_split, "ukraine", ""),
        (T.flatten_breaks, "a\nb", "a b"),
        (T.unescape_amp, "a&amp;b", "a b"),
        (T.strip_social, "RT @x: 12 cats :) #été  https://a.io ok 😀", "RT : cats ok"),
        (T.topic_title, "topic_4", "Topic 4"),
        (T.topic_slug, "Topic 4", "topic_4"),
        (T.title_words, "severe_toxicity", "Severe Toxicity"),
        (T.epoch_of, "a/epoch=12-step=5.ckpt", "12"),
        (T.drop_step, "a/epoch=12-step=5.ckpt", "a/epoch=12.ckpt"),
        (T.new_csv_path, "a/b.csv", "a/b_new.csv"),
    ],
)
def test_text(spark, fn, text, want):
    assert one(spark, fn(F.col("x")), x=text) == want


def test_tags_are_unicode(spark):
    assert one(spark, T.hashtags(F.lit("#été #ok_1"))) == ["été", "ok_1"]
    assert one(spark, T.mentions(F.lit("@a @b_2 x"))) == ["a", "b_2"]


def test_hashtag_order_hits_prefix(spark):
    text = F.lit("#WarNow #War")
    assert one(spark, T.expand_hashtags(text, ["War", "WarNow"])) == "WarNow War"
    assert one(spark, T.expand_hashtags(text, ["WarNow", "War"])) == "War Now War"


def test_blocks_and_language(spark):
    text = "x" * 45
    assert [len(b) for b in one(spark, T.blocks(F.lit(text)))] == [20, 20, 5]
    assert one(spark, T.blocks(F.lit(""))) == []
    assert one(spark, mo.is_english(F.lit("the cat and the dog"))) is True
    assert one(spark, mo.is_english(F.lit("le chat et la souris"))) is False
    assert one(spark, mo.is_english(F.lit("the cat is here, यह हिन्दी है"))) is False
    assert one(spark, mo.is_english(F.lit("1234"))) is False


def test_tokens(spark):
    assert one(spark, T.words(F.lit("Don't stop, the CATS!"))) == ["dont", "stop", "the", "cats"]
    assert one(spark, T.alpha_tokens(F.lit("Ab c1d _x élan " + "z" * 16))) == ["ab", "élan"]
    assert "ukraine" not in one(spark, T.topic_tokens(F.lit("Ukraine needs help")))


def test_labels(spark):
    assert one(spark, L.bits(F.array(*[F.lit(int(c)) for c in C.TRIGGER]))) == C.TRIGGER
    assert one(spark, L.code_of(F.lit("010110"))) == 22
    assert one(spark, L.pattern_of(F.lit(22))) == "010110"
    df = spark.createDataFrame([(None,), (0.5,), (0.2,), (-1.0,)], "v double")
    assert [r[0] for r in df.select(L.hard_label(F.col("v"))).collect()] == [-1.0, 1.0, 0.0, -1.0]


def test_paths_and_names(spark):
    assert one(spark, T.scored_path(F.lit("a/b/conf.json"))) == "a/b/scored/conf_test_results.json"
    assert one(spark, T.results_path(F.lit("a/epoch=3.ckpt"), "j")) == "a/epoch=3_test_results_j.json"
    assert one(spark, run_name(F.lit("blank"), F.lit(1.0), F.lit(0.3), F.lit(8), F.lit(10))) == "blank-100-30-8-10"
    assert one(spark, T.ratio_value(F.lit("100:100:30"))) == 30.0
    assert one(spark, T.ratio_value(F.lit("Primary"))) is None


def test_chain_translator_groups_hops(spark):
    df = spark.createDataFrame([("a", ["en", "fr", "en"]), ("b", ["en", "es", "fr", "en"])], "comment_text string, path array<string>")
    run = mo.chain_translator(lambda texts, s, d: [f"{t}>{d}" for t in texts])
    got = {r["comment_text"]: r["new_text"] for r in run(df).collect()}
    assert got == {"a": "a>fr>en", "b": "b>es>fr>en"}


def test_strip_social_keeps_other_scripts(spark):
    rows = [("平和を 😀 願う 한국 ☮️ 👩‍👩‍👧 🇺🇦 1️⃣ a:) ①",)]
    got = spark.createDataFrame(rows, "t string").select(T.strip_social(F.col("t"))).first()[0]
    assert got == "平和を 願う 한국 a ①"        # the keycap goes with its number
