"""File inputs and outputs: whole tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as ty

from modlens import constants as C
from modlens.catalog.base import curve, labelled, lines, preds, query, series, table, zs
from modlens.catalog.evaluation import TRIGGERS, flag_scores_sql, topic_scores_sql
from modlens.catalog.reports import _EP, _M, _RP, _TM, run_metrics, topic_metrics
from modlens.functions.models import score_map
from modlens.functions.text import topic_title
from modlens.operators import metrics as M
from modlens.operators import series as S
from modlens.session import cut_lineage, freed_after, scratch_path
from modlens.sources import readers as rd
from modlens.sources import sinks as sk
from modlens.sources.ranges import scan_csv, scan_score_object

_DOC = "doc_id bigint, text string, lang string"


def _doc_csv(spark, sf):
    path = scratch_path(spark, "csv")
    sk.write_csv(table(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return path


@query("sc1_csv_scan", "select doc_id, text, lang from documents")
def _(spark, sf):
    return scan_csv(spark, _doc_csv(spark, sf), _DOC).drop("file")


@query("sc1_csv_whole_files", "select doc_id, text, lang from documents")
def _(spark, sf):
    return rd.read_csv(spark, _doc_csv(spark, sf), _DOC)


@query("sk1_csv_sink", "select doc_id, md5(text) as digest, lang from documents")
def _(spark, sf):
    return scan_csv(spark, _doc_csv(spark, sf), _DOC).select("doc_id", F.md5("text").alias("digest"), "lang")


@query("sc2_csv_tree", "select lang as folder, doc_id, text, count(*) over (partition by lang) as n from documents")
def _(spark, sf):
    path = scratch_path(spark, "tree")
    table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("folder")).write.partitionBy("folder").options(**sk._CSV).csv(path)
    rows = cut_lineage(rd.read_csv_tree(spark, path, "doc_id bigint, text string"), "rows")
    folder = F.regexp_extract("file", "folder=([^/]+)", 1).alias("folder")
    per = rd.rows_per_file(rows).groupBy(folder).agg(F.sum("n").alias("n"))
    return rows.select(folder, "doc_id", "text").join(F.broadcast(per), "folder")     # one row a folder


@query("sc3_part_files", "select doc_id, lang from documents")
def _(spark, sf):
    path = scratch_path(spark, "parts")
    d = table(spark, sf, "documents").select("doc_id", "lang")
    for i in range(3):  # three part folders that together hold the table
        sk.write_csv(d.where(F.col("doc_id") % 3 == i), f"{path}/small_file_{i}.csv")
    return rd.read_parts(spark, path, "doc_id bigint, lang string")


def _text_file(spark, sf):
    path = scratch_path(spark, "lines")
    ordered = lines(spark, sf).repartitionByRange("line_id").sortWithinPartitions("line_id")
    sk.write_lines(ordered, path, "text")
    return path


@query("sc4_line_scan", "select text as value, count(*) as n from lines group by text", ("lines",))
def _(spark, sf):
    return rd.read_lines(spark, _text_file(spark, sf)).groupBy("value").agg(F.count("*").alias("n"))


@query("sc4_line_count", "select count(*) as n from lines", ("lines",))
def _(spark, sf):
    return rd.read_lines(spark, _text_file(spark, sf)).agg(F.count("*").alias("n"))


@query("sk3_line_sink", "select text as value from lines", ("lines",))
def _(spark, sf):
    return rd.read_lines(spark, _text_file(spark, sf))


@query("sk5_split_files", ", r as (select text, row_number() over (order by line_id) - 1 as i, count(*) over () as n from lines) select (i // (n // 7))::int as shard, text as value from r", ("lines",))
def _(spark, sf):
    path = scratch_path(spark, "shards")
    sk.split_lines(rd.read_lines(spark, _text_file(spark, sf)), path, 7)
    back = spark.read.schema("value string, shard int").text(path, lineSep="\n")
    return back.select("shard", "value")


@query("sc5_text_input", "select text as value from lines union all select 'A literal text'", ("lines",))
def _(spark, sf):
    path = scratch_path(spark, "input") + ".txt"
    sk.write_lines(lines(spark, sf), path, "text")
    # a folder named .txt is what Spark writes; a single .txt file reads the same way
    return rd.input_texts(spark, path).unionByName(rd.input_texts(spark, "A literal text"))


@query("sc6_score_maps", "select text_id::varchar as text, label, score from zs", ("zs",))
def _(spark, sf):
    path = scratch_path(spark, "scores")
    maps = score_map(zs(spark, sf), "text_id").select(F.col("text_id").cast("string").alias("text"), "scores")
    sk.write_score_maps(maps, path)
    return rd.read_score_map(spark, path)


def _object_files(spark, sf, topics: bool) -> str:
    """One JSON object per two hundred documents, all their texts in it, as a writer leaves it that holds them in memory."""
    path = scratch_path(spark, "object")
    name = F.concat("text", F.lit(" #"), F.col("text_id").cast("string"))
    of = ["topic"] if topics else []
    # lines are dealt once, to the task that writes their object; what follows groups within it
    dealt = zs(spark, sf, lambda x: x.withColumn("part", F.floor(F.col("line_id") / 20_000_000)).repartition("part"))
    per = dealt.groupBy("part", "text_id", *of).agg(F.first(name).alias("name"), F.map_from_entries(F.collect_list(F.struct("label", "score"))).alias("scores"))
    entry = per.select("part", *of, F.to_json(F.create_map("name", "scores")).alias("m")).withColumn("m", F.expr("substring(m, 2, length(m) - 2)"))
    docs = entry.groupBy("part", *of).agg(F.array_join(F.collect_list("m"), ", ").alias("body"))
    if topics:
        title = F.concat(F.lit('"'), "topic", F.lit('": {'), "body", F.lit("}"))
        docs = docs.groupBy("part").agg(F.array_join(F.collect_list(title), ",  ").alias("body"))
    with freed_after(spark):
        docs.select(F.concat(F.lit("{"), "body", F.lit("}")).alias("value")).write.text(path)
    return path


@query("sc6_score_object", "select text || ' #' || text_id as text, label, score from zs", ("zs",))
def _(spark, sf):
    return scan_score_object(spark, _object_files(spark, sf, False))


@query("sc6_topic_score_object", "select topic, text || ' #' || text_id as text, label, score from zs", ("zs",))
def _(spark, sf):
    return scan_score_object(spark, _object_files(spark, sf, True), by_topic=True)


def result_documents(spark, sf):
    """One result document per run: flat parts and a per-topic part."""
    flat = run_metrics(spark, sf).where("dataset <> 'secondary_positive'").select("run", "dataset", M.metric_struct().alias("m"))
    topics = topic_metrics(spark, sf).select("run", "topic", M.metric_struct().alias("m"))
    to_map = lambda key: F.map_from_entries(F.collect_list(F.struct(key, "m")))  # noqa: E731  a few entries per run
    a = flat.groupBy("run").agg(to_map("dataset").alias("flat"))
    b = topics.groupBy("run").agg(to_map("topic").alias("secondary_positive"))
    # a small table may have runs without flat parts or without topics
    return a.join(b, "run", "full").select(
        "run",
        F.to_json(F.struct(F.col("flat")["jigsaw"].alias("jigsaw"), F.col("flat")["secondary_neutral"].alias("secondary_neutral"), "secondary_positive")).alias("value"),
    )


_FLAT_SQL = "select run, dataset, null as topic, precision, recall, f_beta, specificity, tp, fp, tn, fn, 'f_beta' as metric_version from m where dataset <> 'secondary_positive'"
_TOP_SQL = "select run, 'secondary_positive', topic, precision, recall, f_beta, specificity, tp, fp, tn, fn, 'f_beta' from tops"
_RESULTS = (_M + _TM + f", all_ as ({_FLAT_SQL} union all {_TOP_SQL}) select run, dataset, topic, round(precision, 9) as precision, round(recall, 9) as recall, "
            "round(f_beta, 9) as f_beta, round(specificity, 9) as specificity, tp, fp, tn, fn, metric_version from all_")


@query("sc7_result_documents", _RESULTS, ("preds",))
def _(spark, sf):
    path = scratch_path(spark, "results")
    docs = result_documents(spark, sf).withColumn("run", F.replace("run", F.lit(":"), F.lit("-")))
    docs.write.partitionBy("run").text(path)
    r = rd.read_results(spark, path)
    return r.select(
        F.replace("run", F.lit("-"), F.lit(":")).alias("run"), "dataset", "topic",
        *[F.round(c, 9).alias(c) for c in M.RATES[:4]], *M.COUNTS, "metric_version",
    )


@query("sk4_json_sink", _M + " select run, dataset, precision, recall, f_beta, specificity, fpr, tpr, tp, fp, tn, fn from m", ("preds",))
def _(spark, sf):
    path = scratch_path(spark, "json")
    sk.write_json(run_metrics(spark, sf).select("run", "dataset", M.metric_struct().alias("metrics")), path)
    counts = ty.StructType([ty.StructField(c, ty.LongType()) for c in M.COUNTS])
    shape = ty.StructType([ty.StructField(c, ty.DoubleType()) for c in M.RATES] + [ty.StructField("confusion_matrix", counts)])
    back = spark.read.schema(ty.StructType([
        ty.StructField("run", ty.StringType()), ty.StructField("dataset", ty.StringType()), ty.StructField("metrics", shape),
    ])).json(path)
    return back.select("run", "dataset", *[F.col(f"metrics.{c}").alias(c) for c in M.RATES], *[F.col(f"metrics.confusion_matrix.{c}").alias(c) for c in M.COUNTS])


@query("sc8_training_series", "select run, step, value from series", ("series",))
def _(spark, sf):
    path = scratch_path(spark, "series")
    # documents of at most 1,000 points, so no row holds a whole run
    docs = series(spark, sf).groupBy("run", F.floor(F.col("step") / 1000).alias("part")).agg(
        F.sort_array(F.collect_list(F.array(F.col("step").cast("double"), "value"))).alias("loss")
    )
    docs.select("run", "loss").write.partitionBy("run").json(path)
    back = rd.read_series(spark, path, ("loss",), multi_line=False)
    return back.select(F.regexp_extract("file", "run=([^/]+)", 1).alias("run"), F.col("step").cast("bigint").alias("step"), "value")


def epoch_lists(spark, sf) -> str:
    """One validation list per run."""
    path = scratch_path(spark, "epochs")
    entry = F.struct(F.col("epoch").alias("o"), F.struct(F.col("epoch").cast("string").alias("epoch"), "loss", "acc").alias("e"))
    docs = S.epoch_table(curve(spark, sf)).groupBy("run").agg(  # a few epochs per run
        F.to_json(F.transform(F.sort_array(F.collect_list(entry)), lambda s: s["e"])).alias("value")
    )
    docs.write.partitionBy("run").text(path)
    return path


@query("sc9_epoch_lists", _EP + " select run, epoch, loss, acc from e where epoch <= 5", ("curve",))
def _(spark, sf):
    e = rd.read_epochs(spark, epoch_lists(spark, sf), first=5)
    return e.select(F.regexp_extract("file", "run=([^/]+)", 1).alias("run"), "epoch", "loss", "acc")


@query("sc10_run_configs", "select 'run-'||doc_id as name, (doc_id % 16)::int as batch_size, 'albert' as model_type, case when doc_id % 5 = 0 then 1.0::double else 0.5::double end as jigsaw_ratio, (doc_id % 100)/100.0::double as secondary_positive_ratio, 6::int as n_classes, 'blank-100-'||floor((doc_id % 100)/100.0::double*100)::int||'-'||(doc_id % 16)||'-10' as run, "
       + ", ".join(f"'{s}_{n}_'||(doc_id % 7)||'.csv' as {s}_{n}" for s in ("train", "val", "test") for n in C.DATASETS) + " from documents")
def _(spark, sf):
    path = scratch_path(spark, "configs")
    d = F.col("doc_id")
    doc = table(spark, sf, "documents").select(
        F.concat(F.lit("run-"), d.cast("string")).alias("name"), (d % 16).cast("int").alias("batch_size"), F.lit(10).alias("accumulate_grad_batches"),
        F.struct(F.lit("ALBERT").alias("type"), F.struct(F.lit(6).alias("num_classes"), F.lit("albert").alias("model_type")).alias("args")).alias("arch"),
        F.struct(F.struct(
            F.when(d % 5 != 0, F.lit(0.5)).alias("jigsaw_ratio"), ((d % 100) / 100.0).alias("secondary_positive_ratio"), F.lit(1.0).alias("secondary_neutral_ratio"),
            *[F.create_map(*[v for n in C.DATASETS for v in (F.lit(n), F.concat(F.lit(f"{s}_{n}_"), (d % 7).cast("string"), F.lit(".csv")))]).alias(s) for s in ("train", "val", "test")],
            F.array(*[F.lit(l) for l in C.LABELS]).alias("classes")).alias("args")).alias("dataset"),
    )
    doc.write.json(path)
    c = rd.read_configs(spark, path, multi_line=False)
    name = rd.run_name(F.lit("blank"), F.col("secondary_neutral_ratio"), F.round(F.col("secondary_positive_ratio"), 2), F.col("batch_size"), F.col("accumulate_grad_batches"))
    return c.select("name", "batch_size", "model_type", "jigsaw_ratio", "secondary_positive_ratio", F.size("classes").alias("n_classes"), name.alias("run"),
                    *[F.col(s)[n].alias(f"{s}_{n}") for s in ("train", "val", "test") for n in C.DATASETS])


@query("sk2_csv_with_index", "select row_number() over (order by line_id) - 1 as row_index, line_id, text from lines", ("lines",))
def _(spark, sf):
    path = scratch_path(spark, "indexed")
    sk.write_csv_with_index(lines(spark, sf).select("line_id", "text"), path, "line_id")
    return rd.read_csv(spark, path, "row_index bigint, line_id bigint, text string")


@query("sk6_gather_splits", "select id, split from labelled", ("labelled",))
def _(spark, sf):
    path = scratch_path(spark, "splits")
    l = labelled(spark, sf).select("id", "split")
    sk.write_csv(sk.gather_splits(*[l.where(F.col("split") == s) for s in ("train", "val", "test")]), path)
    return rd.read_csv(spark, path, "id string, split string")


@query("sk7_by_topic", "select id, topic from labelled where topic is not null", ("labelled",))
def _(spark, sf):
    path = scratch_path(spark, "topics")
    t = labelled(spark, sf).where("topic is not null").select("id", topic_title(F.col("topic")).alias("topic"))
    sk.write_by_topic(t, path)
    return spark.read.schema("id string, topic string").option("header", True).csv(path)
