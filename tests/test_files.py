import json
import os

import pytest
from pyspark.sql import functions as F

from modlens.operators import metrics as M
from modlens.sources import readers as rd
from modlens.sources import sinks as sk
from modlens.streaming.clean_stream import start_clean_stream


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf8") as f:
        f.write(text)


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", text'), (2, "two\nlines"), (3, " padded "), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "n int, t string")
    sk.write_csv(df, str(tmp_path / "c"))
    back = rd.read_csv(spark, str(tmp_path / "c"), "n int, t string")
    want = rows[:4] + [(5, None)]      # a CSV field cannot tell empty from missing
    assert sorted((r["n"], r["t"]) for r in back.collect()) == want


def test_csv_tree_and_parts(spark, tmp_path):
    write(str(tmp_path / "d/a.csv"), "n\n1\n2\n")
    write(str(tmp_path / "d/x/b.csv"), "n\n3\n")
    write(str(tmp_path / "p/small_file_0.csv"), "n\n1\n")
    write(str(tmp_path / "p/small_file_1.csv"), "n\n2\n")
    write(str(tmp_path / "p/other.csv"), "n\n9\n")
    tree = rd.read_csv_tree(spark, str(tmp_path / "d"), "n int")
    assert sorted(r["n"] for r in rd.rows_per_file(tree).collect()) == [1, 2]
    assert sorted(r["n"] for r in rd.read_parts(spark, str(tmp_path / "p"), "n int").collect()) == [1, 2]


def test_input_texts(spark, tmp_path):
    p = str(tmp_path / "in.txt")
    write(p, "one\ntwo\n")
    assert [r["value"] for r in rd.input_texts(spark, p).collect()] == ["one", "two"]
    assert [r["value"] for r in rd.input_texts(spark, "just text").collect()] == ["just text"]
    bad = str(tmp_path / "in.csv")
    write(bad, "x")
    with pytest.raises(ValueError):
        rd.input_texts(spark, bad)
    with pytest.raises(ValueError):
        rd.input_texts(spark, 5)


def test_split_keeps_order_and_may_exceed(spark, tmp_path):
    p = str(tmp_path / "ten.txt")
    write(p, "".join(f"line {i}\n" for i in range(10)))
    sk.split_lines(rd.read_lines(spark, p), str(tmp_path / "out"), 4)
    back = spark.read.schema("value string, shard int").text(str(tmp_path / "out"))
    got = {}
    for r in back.collect():
        got.setdefault(r["shard"], []).append(r["value"])
    assert {k: sorted(v) for k, v in got.items()} == {i: [f"line {2 * i}", f"line {2 * i + 1}"] for i in range(5)}
    with pytest.raises(ValueError):
        sk.shard_of(rd.read_lines(spark, p), 11)


def test_result_documents_of_all_ages(spark, tmp_path):
    base = str(tmp_path / "saved/M/logs/{}/checkpoints/converted/epoch=2_test_results_j.json")
    cm = {"tp": 104, "fp": 0, "tn": 0, "fn": 148}
    cur = {"precision": 1.0, "recall": 0.4127, "f_beta": 0.4676, "specificity": 0, "fpr": 0, "tpr": 0.4127, "confusion_matrix": cm}
    old = {"precision": 0.9, "recall": 0.5, "f1": 0.6429}
    write(base.format("blank-100-1"), json.dumps({"jigsaw": {**cur, "auc": 0.9, "class_auc": {"threat": 0.9}}, "secondary_positive": cur}))
    write(base.format("blank-100-30"), json.dumps({"jigsaw": old, "secondary": old, "secondary_positive": {"topic_4": cur, "mean": cur}}))
    write(base.format("version_0"), json.dumps({"jigsaw": {"0.5": old, "0.6": old}}))
    rows = rd.read_results(spark, str(tmp_path / "saved")).collect()
    assert len(rows) == 2 + 3 + 2
    by = {(r["run"], r["dataset"], r["topic"], r["threshold"]): r for r in rows}
    a = by[("blank-100-1", "jigsaw", None, None)]
    assert (a["tp"], a["auc"], a["class_auc"], a["metric_version"], a["ratio"], a["epoch"]) == (104, 0.9, {"threat": 0.9}, "f_beta", "100-1", 2)
    assert by[("blank-100-30", "jigsaw", None, None)]["metric_version"] == "f1"
    assert by[("blank-100-30", "secondary_positive", "topic_4", None)]["fn"] == 148
    assert by[("version_0", "jigsaw", None, 0.6)]["f1"] == 0.6429
    again = M.with_rates(rd.read_results(spark, str(tmp_path / "saved")).where("tp is not null").select("recall", *M.COUNTS).withColumnRenamed("recall", "stored"))
    assert all(r["recall"] == r["stored"] for r in again.collect())


def test_series_epochs_configs(spark, tmp_path):
    write(str(tmp_path / "s/t.json"), json.dumps({"loss": [[0, 0.5], [10, 0.4]], "acc": [[0, 0.1]], "acc_flag": [], "epoch_batch_count": [3]}, indent=1))
    got = {(r["metric"], r["pos"]): (r["step"], r["value"]) for r in rd.read_series(spark, str(tmp_path / "s")).collect()}
    assert got == {("loss", 0): (0.0, 0.5), ("loss", 1): (10.0, 0.4), ("acc", 0): (0.0, 0.1)}
    write(str(tmp_path / "e/v.json"), json.dumps([{"epoch": str(i), "loss": 0.1 * i, "acc": 0.5} for i in range(8)]))
    e = rd.read_epochs(spark, str(tmp_path / "e"), first=5).collect()
    assert sorted(r["epoch"] for r in e) == [0, 1, 2, 3, 4]
    conf = {"name": "M", "batch_size": 8, "accumulate_grad_batches": 10, "arch": {"args": {"model_type": "albert"}},
            "dataset": {"args": {"test": {"jigsaw": "t.csv"}, "secondary_positive_ratio": 0.3, "secondary_neutral_ratio": 1, "classes": ["a"]}}}
    write(str(tmp_path / "c/x.json"), json.dumps(conf, indent=2))
    c = rd.read_configs(spark, str(tmp_path / "c")).first()
    assert (c["name"], c["jigsaw_ratio"], c["secondary_positive_ratio"], c["test"]) == ("M", 1.0, 0.3, {"jigsaw": "t.csv"})


def test_topic_score_map(spark, tmp_path):
    write(str(tmp_path / "z.json"), json.dumps({"Topic 4": {"a text": {"lab": 0.9}}, "Topic 6": {"b": {"lab": 0.1}}}))
    rows = rd.read_score_map(spark, str(tmp_path / "z.json"), by_topic=True).collect()
    assert sorted((r["topic"], r["text"], r["label"], r["score"]) for r in rows) == [("Topic 4", "a text", "lab", 0.9), ("Topic 6", "b", "lab", 0.1)]


def test_index_sink(spark, tmp_path):
    df = spark.range(50).select((F.col("id") * 7).alias("k"))
    sk.write_csv_with_index(df, str(tmp_path / "i"), "k")
    rows = rd.read_csv(spark, str(tmp_path / "i"), "row_index bigint, k bigint").collect()
    assert all(r["k"] == 7 * r["row_index"] for r in rows) and len(rows) == 50


def test_clean_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("src", "out", "ck"))
    keep = "the weather in the city is good and the people are out in the sun"
    write(f"{src}/1.txt", f"{keep} https://t.co/x #Sun\nshort\nle chat et la souris dans la maison des amis\n")
    start_clean_stream(spark, src, out, ck).awaitTermination()
    write(f"{src}/2.txt", f"{keep} again and again @me\n")
    start_clean_stream(spark, src, out, ck).awaitTermination()
    got = sorted(r["value"].strip() for r in spark.read.text(out).collect())
    assert got == [keep, keep + " again and again"]
