"""Inputs that lost rows or sizes before: repeated keys, NaN, folders, missing topics."""

import json

import pytest
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.operators import metrics, mixing
from modlens.session import shared_dir
from modlens.sources import readers as rd


def test_exact_sizes_with_repeated_keys(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("key"), (F.col("id") % 3).alias("g"))
    assert mixing.sample_n(df, 333, ["key"]).count() == 333
    assert mixing.sample_fraction(df, 0.5, ["key"]).count() == 500
    per = {r.g: r["count"] for r in mixing.sample_per_group(df, 77, "g", ["key"]).groupBy("g").count().collect()}
    assert per == {0: 77, 1: 77, 2: 77}
    assert mixing.inflate(df, 2345, ["key"]).count() == 2345
    one = spark.range(400).select(F.lit(1).alias("key"))
    assert mixing.sample_n(one, 123, ["key"]).count() == 123


def test_inflate_spreads_many_copies_of_one_row(spark):
    got = mixing.inflate(spark.createDataFrame([(1,)], "key int"), 1000, ["key"])
    assert sorted(r.copy for r in got.collect()) == list(range(1, 1001))


def test_results_with_nan_and_unreadable_files(spark, tmp_path):
    doc = {"jigsaw": {"precision": 0.5, "auc": float("nan"), "class_auc": {"NaN": float("inf")}}, "other": {"precision": 0.25}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2).replace('"other"', '"o \\" NaN"'))
    (tmp_path / "b.json").write_text("not json")
    rows = rd.read_results(spark, str(tmp_path), datasets=None).collect()
    got = {r.dataset: r for r in rows}
    assert set(got) == {"jigsaw", 'o " NaN', None}
    assert got["jigsaw"].precision == 0.5 and got["jigsaw"].auc is None and got["jigsaw"].class_auc == {"NaN": None}
    assert got[None].error and got[None].file.endswith("b.json") and got["jigsaw"].error is None


def test_score_maps_in_any_layout(spark, tmp_path):
    doc = {"t1": {"x": {"toxic": 0.5}, "y": {"toxic": 0.25}}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=4))
    got = rd.read_score_map(spark, str(tmp_path / "a.json"), by_topic=True, lines=False).collect()
    assert sorted(map(tuple, got)) == [("t1", "x", "toxic", 0.5), ("t1", "y", "toxic", 0.25)]
    with pytest.raises(Exception, match="not a score map"):
        rd.read_score_map(spark, str(tmp_path / "a.json")).collect()


def test_text_inputs(spark, tmp_path):
    folder = tmp_path / "x.txt"
    folder.mkdir()
    (folder / "part").write_text("one\ntwo\n")
    assert sorted(r.value for r in rd.input_texts(spark, str(folder)).collect()) == ["one", "two"]
    assert [r.value for r in rd.input_texts(spark, "see notes in readme.txt").collect()] == ["see notes in readme.txt"]
    for bad in (str(tmp_path), str(tmp_path / "missing.txt"), 5):
        with pytest.raises(ValueError):
            rd.input_texts(spark, bad)


def test_every_topic_counts_in_the_mean(spark):
    topic, pattern = next(iter(C.TOPIC_TRIGGERS.items()))
    bits = [int(c) for c in pattern]
    df = spark.createDataFrame([(topic, bits, [float(b) for b in bits])], "topic string, target array<int>, score array<double>")
    got = {r.topic: r for r in metrics.topic_scores(df, 0.5).collect()}
    assert set(got) == {*C.TOPIC_TRIGGERS, "mean"}
    assert got[topic].recall == 1.0 and got["mean"].recall == 1 / len(C.TOPIC_TRIGGERS)


class Elsewhere:
    """The part of a session on a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Sc:
                    @staticmethod
                    def getCheckpointDir():
                        class Empty:
                            @staticmethod
                            def isDefined():
                                return False

                        return Empty

                return Sc


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Elsewhere)
