"""The flagship query: lines -> cleaning -> scores -> evaluation against a real target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.catalog.base import ORACLE, QUERIES, ctes, query, table, tweets
from modlens.catalog.evaluation import counts_sql, rates_sql
from modlens.catalog.jobs import _hits
from modlens.catalog.text import SQL_LINE_CLEAN
from modlens.functions import text as T
from modlens.functions.models import lexicon_scorer
from modlens.operators.metrics import confusion, with_rates

_WORST = "greatest(" + ", ".join(f"{_hits('clean', C.LEXICON[l])}/({_hits('clean', C.LEXICON[l])}+0.5::double)" for l in C.LABELS) + ")"


@query("flagship_clean_score_evaluate",
       f", c as (select doc_id, lang, {SQL_LINE_CLEAN} as clean from tweets where text is not null), "
       f"s as (select doc_id, any_value(lang) as lang, max({_WORST}) as worst from c where length(clean)+1 > 30 group by doc_id), "
       f"k as (select lang, {counts_sql('toxic = 1', 'worst >= 0.5::double')} from s join labels using (doc_id) group by lang) "
       f"select lang, tp, fp, tn, fn, {rates_sql()} from k", ("tweets",))
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    lines = tweets(spark, sf).where("text is not null")
    chain = T.remove_emojis(T.remove_tags_and_accounts(T.remove_urls(F.col("text"))))
    # a generated row, so that the filter on it does not run the chain a second time
    clean = lines.select("doc_id", "lang", F.explode(F.array(chain)).alias("clean")).where(F.length("clean") + 1 > C.MIN_TWEET)
    scored = lexicon_scorer()(clean, "clean")
    worst = scored.groupBy("doc_id").agg(
        F.first("lang").alias("lang"), F.max(F.greatest(*[F.col(l) for l in C.LABELS])).alias("worst")
    )
    target = table(spark, sf, "labels").select("doc_id", "toxic")
    both = worst.join(target, "doc_id")
    return with_rates(both.groupBy("lang").agg(*confusion(F.col("toxic") == 1, F.col("worst") >= 0.5)))
