"""File inputs: CSV tables, text lines, score maps, result documents, run files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from modlens import constants as C
from modlens.sources.ranges import scan_csv, scan_score_object

RAW_TWEETS = ty.StructType([
    ty.StructField("renderedContent", ty.StringType()),
    ty.StructField("date", ty.StringType()),
    ty.StructField("lang", ty.StringType()),
])
LABELLED = ty.StructType(
    [ty.StructField("id", ty.StringType()), ty.StructField("comment_text", ty.StringType())]
    + [ty.StructField(l, ty.IntegerType()) for l in C.LABELS]
)
SCORE_MAP = "map<string,map<string,double>>"
TOPIC_SCORE_MAP = "map<string,map<string,map<string,double>>>"
EPOCHS = "epoch string, loss double, acc double"
CONFIG = """
    name string, batch_size int, accumulate_grad_batches int,
    arch struct<type:string, args:struct<num_classes:int, model_type:string>>,
    dataset struct<type:string, args:struct<
        train:map<string,string>, val:map<string,string>, test:map<string,string>,
        jigsaw_ratio:double, secondary_positive_ratio:double, secondary_neutral_ratio:double,
        classes:array<string>>>
"""


def read_csv(spark: SparkSession, path, schema: ty.StructType | str, **options) -> DataFrame:
    """CSV with header and quoted multi-line fields, explicit schema.

    A file is one task here; ``ranges.scan_csv`` splits files.  An empty field is null, quoted
    or not.
    """
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"')
        .options(**options).csv(path)
    )


def read_csv_tree(spark: SparkSession, path: str, schema) -> DataFrame:
    """All CSV files below a folder, with the file each row came from; large files are split."""
    return scan_csv(spark, path, schema, recursiveFileLookup=True)


def rows_per_file(df: DataFrame) -> DataFrame:
    return df.groupBy("file").agg(F.count("*").alias("n"))


def read_parts(spark: SparkSession, folder: str, schema, pattern: str = "*small_file_*.csv*") -> DataFrame:
    """Part files (or part folders) whose names match a pattern, as one table."""
    return read_csv(spark, f"{folder}/{pattern}", schema)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n")


def input_texts(spark: SparkSession, value) -> DataFrame:
    """Lines of a ``.txt`` file or folder, or one row for a literal text.

    A value on one line that ends in ``.txt`` is meant as a path and must exist; any other
    existing file or folder is refused rather than read as a text.
    """
    if not isinstance(value, str):
        raise ValueError(f"expected a text or the path of a .txt file, got {type(value).__name__}")
    if value and "\n" not in value:
        means_path = value.rstrip("/").endswith(".txt")
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(value)
            exists = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        except Exception:  # a text that is not a valid path
            exists = False
        if exists and means_path:
            return read_lines(spark, value)
        if exists:
            raise ValueError(f"{value!r} is a file or folder, but its name does not end in .txt")
        if means_path and " " not in value:
            raise ValueError(f"{value!r} looks like a path, but there is no such file or folder")
    return spark.createDataFrame([(value,)], "value string")


def read_score_map(spark: SparkSession, path: str, by_topic: bool = False, lines: bool = True) -> DataFrame:
    """JSON objects text -> {label -> score} (or topic -> text -> ...) as a long table.

    ``lines``: every line holds one object, as ``sinks.write_score_maps`` writes; such files
    are split.  Without it every file is one object, indented or not, read by several tasks
    (``ranges.scan_score_object``).  What does not parse fails the job and names the file.
    """
    if not lines:
        return scan_score_object(spark, path, by_topic)
    kind = TOPIC_SCORE_MAP if by_topic else SCORE_MAP
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"))
    m = F.from_json("value", kind)
    says = F.concat(F.lit("not a score map in "), F.col("_f"))
    parsed = raw.where(F.trim("value") != "").select(F.when(m.isNull(), F.raise_error(says).cast(kind)).otherwise(m).alias("_m"))
    if by_topic:
        parsed = parsed.select(F.explode("_m").alias("topic", "_m"))
        m = parsed.select("topic", F.explode("_m").alias("text", "_s"))
        return m.select("topic", "text", F.explode("_s").alias("label", "score"))
    m = parsed.select(F.explode("_m").alias("text", "_s"))
    return m.select("text", F.explode("_s").alias("label", "score"))


#: a bare NaN or infinity as a value, which strict JSON lacks; strings are matched first and kept
_BARE = r'("(?:[^"\\]++|\\.)*+")|-?(?:NaN|Infinity)\b'


def strict_json(text: Column) -> Column:
    """The document with bare NaN and infinities as null."""
    marked = F.regexp_replace(text, _BARE, "$1\u0000")             # also after each string
    return F.replace(F.regexp_replace(marked, "(?<=\")\u0000", ""), F.lit("\u0000"), F.lit("null"))


def _num(path: str) -> Column:
    return F.try_variant_get("_v", F.lit("$" + path), "double")


def read_results(spark: SparkSession, path, datasets: Sequence[str] | None = C.DATASETS) -> DataFrame:
    """Result documents of many runs as one row per (file, dataset, topic).

    Files differ: ``f_beta`` or the older ``f1``; with or without specificity and
    counts; ``secondary_positive`` flat or per topic; metrics below threshold keys.
    ``metric_version`` tells them apart; ``f_beta`` and ``f1`` stay separate columns.  A bare
    NaN, which writers use for an undefined AUC, is read as null.  A file that cannot be read
    gives one row with ``error``.  ``datasets=None`` keeps dataset keys that are not known here.
    """
    raw = (
        spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.try_parse_json(strict_json(F.col("value"))).alias("_doc"))
        .withColumn("_parts", F.try_variant_get("_doc", F.lit("$"), "map<string,variant>"))
    )
    bad = raw.where(F.col("_parts").isNull()).select("file", F.lit("not a JSON object").alias("error"))
    per = raw.select("file", F.explode("_parts").alias("dataset", "_v"))
    if datasets is not None:
        per = per.where(F.col("dataset").isin(list(datasets)))
    flat = _num(".precision").isNotNull()
    nested = per.where(~flat).select(
        "file", "dataset", F.explode(F.variant_get("_v", "$", "map<string,variant>")).alias("part", "_v")
    )
    both = per.where(flat).select("file", "dataset", F.lit(None).cast("string").alias("part"), "_v").unionByName(nested)
    is_threshold = F.col("part").try_cast("double").isNotNull()
    out = both.select(
        "file", "dataset",
        F.when(~is_threshold | F.col("part").isNull(), F.col("part")).alias("topic"),
        F.when(is_threshold, F.col("part").try_cast("double")).alias("threshold"),
        *[_num(f".{m}").alias(m) for m in ("precision", "recall", "f_beta", "f1", "specificity", "fpr", "tpr", "auc")],
        *[_num(f".confusion_matrix.{c}").cast("bigint").alias(c) for c in ("tp", "fp", "tn", "fn")],
        F.try_variant_get("_v", F.lit("$.class_auc"), "map<string,double>").alias("class_auc"),
    ).unionByName(bad, allowMissingColumns=True)
    return (
        out.withColumn("metric_version", F.when(F.col("f_beta").isNotNull(), "f_beta").when(F.col("f1").isNotNull(), "f1"))
        .withColumn("run", F.coalesce(
            F.nullif(F.regexp_extract("file", r"/run=([^/]+)/", 1), F.lit("")),
            F.regexp_extract("file", r"/([^/]+)/checkpoints/", 1),
        ))
        .withColumn("ratio", F.regexp_extract("file", r"/[a-z]+-([0-9]+-[0-9]+)[^/]*/checkpoints/", 1))
        .withColumn("epoch", F.regexp_extract("file", r"epoch(?:=|%3D)(\d+)", 1).try_cast("int"))
    )


def read_series(
    spark: SparkSession, path, metrics: Sequence[str] = ("loss", "acc", "acc_flag"), multi_line: bool = True
) -> DataFrame:
    """Training-series files: ``file, metric, pos, step, value``.

    ``multi_line=False`` reads one document per line, which can be split.
    """
    schema = ", ".join(f"{m} array<array<double>>" for m in metrics) + ", epoch_batch_count array<int>"
    raw = spark.read.schema(schema).json(path, multiLine=multi_line, recursiveFileLookup=True)
    pairs = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in metrics]), F.array(*metrics))).alias("metric", "_s"),
    )
    return pairs.select("file", "metric", F.posexplode("_s").alias("pos", "_p")).select(
        "file", "metric", "pos", F.col("_p")[0].alias("step"), F.col("_p")[1].alias("value")
    )


def read_epochs(spark: SparkSession, path, first: int | None = None) -> DataFrame:
    """Epoch validation lists, optionally the first few entries of each file."""
    schema = ty.ArrayType(ty.StructType([
        ty.StructField("epoch", ty.StringType()), ty.StructField("loss", ty.DoubleType()),
        ty.StructField("acc", ty.DoubleType()),
    ]))
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("_e")
    )
    entries = F.slice("_e", 1, first) if first else F.col("_e")
    return raw.select("file", F.posexplode(entries).alias("pos", "_e")).select(
        "file", "pos", F.col("_e.epoch").cast("int").alias("epoch"), "_e.loss", "_e.acc"
    )


def read_configs(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """Run configs, flattened; a missing primary ratio counts as 1."""
    raw = spark.read.schema(CONFIG).json(path, multiLine=multi_line, recursiveFileLookup=True)
    args = "dataset.args."
    return raw.select(
        F.col("_metadata.file_path").alias("file"), "name", "batch_size", "accumulate_grad_batches",
        F.col("arch.args.model_type").alias("model_type"),
        F.coalesce(F.col(args + "jigsaw_ratio"), F.lit(1.0)).alias("jigsaw_ratio"),
        F.col(args + "secondary_positive_ratio").alias("secondary_positive_ratio"),
        F.col(args + "secondary_neutral_ratio").alias("secondary_neutral_ratio"),
        F.col(args + "classes").alias("classes"), *[F.col(args + s).alias(s) for s in ("train", "val", "test")],
    )


def run_name(start: Column, neutral: Column, positive: Column, batch: Column, accumulate: Column) -> Column:
    """``<start>-<neutral%>-<positive%>-<batch>-<accumulate>``."""
    return F.format_string(
        "%s-%d-%d-%d-%d", start, (neutral * 100).cast("int"), (positive * 100).cast("int"),
        batch.cast("int"), accumulate.cast("int"),
    )
