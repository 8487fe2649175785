"""Registry of queries and the input views they share.

Every view is derived from the given tables by Spark expressions; ``VIEW_SQL`` states
the same derivation for the SQL check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.functions.labels import label_bit, trigger_of
from modlens.functions.text import hash01

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# views in dependency order
_DEPENDS = {
    "lines": (), "tweets": ("lines",), "preds": (), "labelled": ("preds",),
    "long": ("preds",), "zs": ("lines",), "series": (), "curve": (),
}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``sql`` may start with ``, x as (...)`` to add more CTEs."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = ctes(*views) + sql if views else sql
        return fn

    return add


def ctes(*views: str) -> str:
    need: list[str] = []

    def visit(v: str) -> None:
        for d in _DEPENDS[v]:
            visit(d)
        if v not in need:
            need.append(v)

    for v in views:
        visit(v)
    return "with " + ", ".join(f"{v} as ({VIEW_SQL[v]})" for v in need) + " "


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def h_sql(key: str) -> str:
    return f"(cast(('0x'||substr(md5({key}),1,8))::BIGINT as double)/4294967296.0::DOUBLE)"


def in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- Spark views ---------------------------------------------------------------------


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(
        (F.col("doc_id") * 100000 + F.col("pos")).alias("line_id"), "doc_id", "lang", "text"
    )


def tweets(spark: SparkSession, sf: str) -> DataFrame:
    """Lines dressed as tweets: mentions, links, tags, emojis, entities; '' -> null."""
    n = F.col("line_id")

    def every(k: int, piece: str) -> Column:
        return F.when(n % k == 0, piece).otherwise("")

    text = F.concat(
        every(5, "@user_1 "), F.col("text"), every(7, " https://t.co/ab12"),
        F.when(n % 3 == 0, " #StandWithUkraine").when(n % 4 == 0, " #peace").otherwise(""),
        every(11, " 😀"), every(13, " &amp; more"), every(17, " :)"), every(19, " 2022"),
    )
    when = F.date_format(
        F.timestamp_add("SECOND", (n % 8640000).cast("int"), F.lit("2022-02-24 00:00:00").cast("timestamp_ntz")),
        "yyyy-MM-dd HH:mm:ss",
    )
    return lines(spark, sf).select(
        "line_id", "doc_id", "lang", when.alias("date"),
        F.when(F.length("text") > 0, text).alias("text"),
    )


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Scored documents: target and score vectors of six labels."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id").cast("string")
    m = F.col("doc_id") % 10
    dataset = F.when(m < 4, "jigsaw").when(m < 8, "secondary_neutral").otherwise("secondary_positive")
    t = F.col("doc_id") % 4
    topic = F.when(t == 0, "topic_4").when(t == 1, "topic_6").when(t == 2, "topic_7").otherwise("topic_10")
    positive = F.col("dataset") == "secondary_positive"
    base = d.select("doc_id", "text", "source", k.alias("id"), dataset.alias("dataset"), topic.alias("_t"))
    base = base.withColumn("topic", F.when(positive, F.col("_t"))).withColumn(
        "trig", trigger_of(F.col("_t"), C.TOPIC_TRIGGERS)
    ).withColumn("hit", hash01(F.concat("id", F.lit("|hit"))) < 0.7)
    target = F.array(*[
        F.when(positive, label_bit(F.col("trig"), i)).otherwise(
            (hash01(F.concat("id", F.lit(f"|t|{l}"))) < 0.1).cast("int"))
        for i, l in enumerate(C.LABELS)
    ])
    base = base.withColumn("target", target)
    score = []
    for i, l in enumerate(C.LABELS):
        s = hash01(F.concat("id", F.lit(f"|s|{l}")))
        score.append(F.when(F.col("hit"), F.lit(0.5) * F.element_at("target", i + 1) + F.lit(0.45) * s).otherwise(s))
    return base.withColumn("score", F.array(*score)).select(
        "doc_id", "id", "text", "source", "dataset", "topic", "target", "score"
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled-table shape with dataset, topic and a train/val/test split."""
    p = preds(spark, sf)
    u = hash01(F.concat("id", F.lit("|split")))
    split = F.when(u < 0.7, "train").when(u < 0.85, "val").otherwise("test")
    return p.select(
        "doc_id", "id", F.col("text").alias("comment_text"), "dataset", "topic", split.alias("split"),
        *[F.element_at("target", i + 1).alias(l) for i, l in enumerate(C.LABELS)],
    )


def long(spark: SparkSession, sf: str) -> DataFrame:
    """label, score, target of every scored document."""
    items = F.arrays_zip(F.array(*[F.lit(l) for l in C.LABELS]).alias("label"), "target", "score")
    return preds(spark, sf).select("id", "dataset", F.explode(items).alias("i")).select("id", "dataset", "i.*")


def zs(spark: SparkSession, sf: str, dealt: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Zero-shot scores of every line for the four topic sentences; ``dealt`` may place the lines and add columns."""
    from modlens.operators.weaklabel import with_candidates

    x = lines(spark, sf).select("line_id", "text")
    x = (dealt(x) if dealt else x).withColumnRenamed("line_id", "text_id")
    base = with_candidates(x, list(C.TOPIC_CANDIDATES.items()))
    return base.withColumn("score", hash01(F.concat(F.col("text_id").cast("string"), F.lit("|"), F.col("topic"))))


def series(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), "value")


def curve(spark: SparkSession, sf: str) -> DataFrame:
    """Per-row loss and accuracy by run, epoch (day of month) and batch."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"),
        F.floor(F.col("event_id") / 50).alias("batch"),
        (F.col("value") / 100.0).alias("loss"), (F.lit(1.0) / (F.lit(1.0) + F.col("value"))).alias("acc"),
    )


# --- the same views as SQL ---------------------------------------------------------------


def _bit_sql(i: int) -> str:
    return f"cast(substr(trig,{i + 1},1) as int)"


_TARGETS = ", ".join(
    f"case when dataset='secondary_positive' then {_bit_sql(i)} else cast({h_sql(f'id||{chr(39)}|t|{l}{chr(39)}')} < 0.1::double as int) end as t{i + 1}"
    for i, l in enumerate(C.LABELS)
)
_SCORES = ", ".join(
    f"case when {h_sql('id||' + chr(39) + '|hit' + chr(39))} < 0.7::double then 0.5::double*t{i + 1} + 0.45::double*{h_sql(f'id||{chr(39)}|s|{l}{chr(39)}')} else {h_sql(f'id||{chr(39)}|s|{l}{chr(39)}')} end as s{i + 1}"
    for i, l in enumerate(C.LABELS)
)
_T = "[" + ",".join(f"t{i}" for i in range(1, 7)) + "]"
_S = "[" + ",".join(f"s{i}" for i in range(1, 7)) + "]"

VIEW_SQL = {
    "lines": """select doc_id*100000+pos as line_id, doc_id, lang, string_split(text, chr(10))[pos+1] as text
        from (select doc_id, lang, text, unnest(range(len(string_split(text, chr(10))))) as pos from documents)""",
    "tweets": """select line_id, doc_id, lang,
        strftime(timestamp '2022-02-24 00:00:00' + to_seconds(line_id % 8640000), '%Y-%m-%d %H:%M:%S') as date,
        case when length(text) > 0 then concat(case when line_id % 5 = 0 then '@user_1 ' else '' end, text,
         case when line_id % 7 = 0 then ' https://t.co/ab12' else '' end,
         case when line_id % 3 = 0 then ' #StandWithUkraine' when line_id % 4 = 0 then ' #peace' else '' end,
         case when line_id % 11 = 0 then ' 😀' else '' end,
         case when line_id % 13 = 0 then ' &amp; more' else '' end,
         case when line_id % 17 = 0 then ' :)' else '' end,
         case when line_id % 19 = 0 then ' 2022' else '' end) end as text
        from lines""",
    "preds": f"""select *, {_T} as target, {_S} as score from (
        select *, {_SCORES} from (
        select *, {_TARGETS} from (
        select *, case when dataset='secondary_positive' then tp end as topic,
          case tp when 'topic_4' then '001101' when 'topic_6' then '010110' when 'topic_7' then '010000' else '110111' end as trig
        from (select doc_id, text, source, doc_id::varchar as id,
          case when doc_id % 10 < 4 then 'jigsaw' when doc_id % 10 < 8 then 'secondary_neutral' else 'secondary_positive' end as dataset,
          case doc_id % 4 when 0 then 'topic_4' when 1 then 'topic_6' when 2 then 'topic_7' else 'topic_10' end as tp
          from documents))))""",
    "labelled": f"""select doc_id, id, text as comment_text, dataset, topic,
        case when {h_sql("id||'|split'")} < 0.7::double then 'train' when {h_sql("id||'|split'")} < 0.85::double then 'val' else 'test' end as split,
        """ + ", ".join(f"t{i + 1} as {l}" for i, l in enumerate(C.LABELS)) + " from preds",
    "long": "select id, dataset, label, target, score from (select id, dataset, unnest([" + in_list(C.LABELS)
        + "]) as label, unnest(target) as target, unnest(score) as score from preds)",
    "zs": "select text_id, text, topic, label, "
        + h_sql("text_id::varchar||'|'||topic")
        + " as score from (select line_id as text_id, text, unnest(["
        + in_list(C.TOPIC_CANDIDATES) + "]) as topic, unnest([" + in_list(C.TOPIC_CANDIDATES.values()) + "]) as label from lines)",
    "series": "select event_type as run, event_id as step, value from events",
    "curve": "select event_type as run, day(ts)::int as epoch, event_id // 50 as batch, value/100.0::double as loss, "
        "1.0::double/(1.0::double+value) as acc from events",
}
