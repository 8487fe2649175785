"""Text functions, projections and filters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from modlens import constants as C
from modlens.catalog.base import h_sql, in_list, lines, long, labelled, preds, query, series, table, tweets, zs
from modlens.functions import labels as L
from modlens.functions import models as M
from modlens.functions import numbers as N
from modlens.functions import text as T
from modlens.functions.numbers import py_round_sql
from modlens.operators import mixing, profile, weaklabel
from modlens.operators import series as S


def _q(s: str) -> str:
    return s.replace("'", "''")


def _text_query(name, fn, sql, source=tweets, view="tweets", out="result"):
    """One text expression over every row of a view."""

    @query(name, f"select line_id, {sql} as {out} from {view}", (view,))
    def run(spark, sf, fn=fn):
        return source(spark, sf).select("line_id", fn(F.col("text")).alias(out))


def _rx(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{_q(pattern)}', '{to}', 'g')"


SQL_URLS = _rx("{x}", C.URL)
SQL_CLEAN_TAGS = _rx(_rx(_rx("{x}", C.MENTION_ASCII), C.HASHTAG_ASCII), " +", " ")
SQL_EMOJI = _rx("{x}", C.EMOJI)


def _apply(template: str, x: str) -> str:
    return template.replace("{x}", x)


SQL_LINE_CLEAN = _apply(SQL_EMOJI, _apply(SQL_CLEAN_TAGS, _apply(SQL_URLS, "text")))


def strip_social_sql(x: str) -> str:
    for p in (C.URL, C.MENTION_ANY, C.HASHTAG_ANY, C.NUMBER, C.PICTOGRAPH, C.SMILEY):
        x = _rx(x, p)
    return f"trim({_rx(x, '[ \\t\\r\\n]+', ' ')}, ' ')"


def camel_sql(x: str) -> str:
    return f"array_to_string(regexp_extract_all({x}, '{C.CAMEL_PART}'), ' ')"


_text_query("sf1_flatten_and_unescape", lambda c: T.unescape_amp(T.flatten_breaks(c)),
            "replace(replace(text, chr(10), ' '), '&amp;', ' ')")
_text_query("sf2_remove_urls", T.remove_urls, _apply(SQL_URLS, "text"))
_text_query("sf3_remove_tags_and_accounts", T.remove_tags_and_accounts, _apply(SQL_CLEAN_TAGS, "text"))
_text_query("sf4_remove_emojis", T.remove_emojis, _apply(SQL_EMOJI, "text"))
_text_query("sf7_strip_social", T.strip_social, strip_social_sql("text"))
_text_query("sf8_extract_hashtags", lambda c: F.array_join(T.hashtags(c), " "),
            f"array_to_string(regexp_extract_all(text, '#({C.WORD}+)', 1), ' ')")
_text_query("sf9_hex_id", T.hex_id, "substr(md5(text), 1, 16)")
_text_query("sf12_words", lambda c: F.array_join(T.words(c), " "),
            f"array_to_string(list_filter(string_split_regex(lower(translate(text, '{_q(C.PUNCTUATION)}', '')), '\\s+'), lambda w: length(w) >= 3), ' ')")
_text_query("sf13_drop_stop_words", lambda c: F.array_join(T.drop_words(T.words(c), C.STOP_WORDS), " "),
            f"array_to_string(list_filter(string_split_regex(lower(translate(text, '{_q(C.PUNCTUATION)}', '')), '\\s+'), lambda w: length(w) >= 3 and w not in ({in_list(C.STOP_WORDS)})), ' ')")
SQL_ALPHA = f"list_filter(regexp_extract_all(lower(text), '{C.ALPHA}+'), lambda w: length(w) between 2 and 15 and substr(w,1,1) <> '_')"
_text_query("sf14_alpha_tokens", lambda c: F.array_join(T.alpha_tokens(c), " "), f"array_to_string({SQL_ALPHA}, ' ')")
_text_query("sf25_camel_split", T.camel_split, camel_sql("text"))
SQL_BLOCKS = "list_filter(list_transform(range(0, length(text), 20), lambda i: substr(text, i::int + 1, 20)), lambda b: length(b) > 0)"
_text_query("sf23_blocks", lambda c: F.array_join(T.blocks(c), "|"), f"array_to_string({SQL_BLOCKS}, '|')")


def language_sql(b: str) -> str:
    hits = lambda p: f"(length({b}) - length({_rx(b, p)}))"
    words = lambda ws: f"len(list_filter(string_split_regex(lower({b}), '[^a-zà-ÿ]+'), lambda w: w in ({in_list(ws)})))"
    fr = f"({words(C.FRENCH_WORDS)} + {hits('[' + C.FRENCH_ACCENTS + ']')})"
    out = f"case when {hits('[A-Za-zÀ-ÿ]')} > 0 then (case when {fr} > {words(C.ENGLISH_WORDS)} then 'fr' else 'en' end) end"
    for lang, chars in C.SCRIPT_RANGES.items():
        out = f"case when {hits('[' + chars + ']')} > 0 then '{lang}' else {out} end"
    return out


SQL_LANGS = f"list_sort(list_distinct(list_filter(list_transform({SQL_BLOCKS}, lambda b: {language_sql('b')}), lambda l: l is not null)))"
SQL_ENGLISH = "coalesce({x} = ['en'], false)"
_text_query("ud1_block_languages", lambda c: F.array_join(F.sort_array(M.block_languages(c)), ","), f"array_to_string({SQL_LANGS}, ',')")
_text_query("sf24_is_english", M.is_english, f"coalesce({SQL_LANGS} = ['en'], false)")


@query("sf11_length_gap", "select line_id, length(text) as n, abs(length(text) - lag_n) as gap from (select *, 100 as lag_n from tweets)", ("tweets",))
def _(spark, sf):
    n = F.length("text")
    return tweets(spark, sf).select("line_id", n.alias("n"), F.abs(n - 100).alias("gap"))


# accented letters become single bytes (one control character each), since the other
# engine measures edit distance in bytes
ACCENTS = "éÉßÇçäÄóÊíêüÖÍÜèñÑÈöÓ"
CONTROLS = "||".join(f"chr({i})" for i in (1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24))


@query("sf10_edit_distance", f", e as (select line_id, doc_id, text, translate(text, '{ACCENTS}', {CONTROLS}) as t from lines), "
       "p as (select line_id, t, lag(t) over (partition by doc_id order by line_id) as before from e) "
       "select line_id, levenshtein(t, before) as distance, case when levenshtein(t, before) <= 9 then levenshtein(t, before) "
       "when before is not null then -1 end as within_nine from p", ("lines",))
def _(spark, sf):
    """Every line against the line before it in its document."""
    # a document's lines stand in one row, so a line meets the one before it there
    parts = F.split("text", "\n")
    pair = F.transform(parts, lambda t, i: F.struct(t.alias("text"), F.get(parts, i - 1).alias("before")))
    pairs = table(spark, sf, "documents").select("doc_id", F.posexplode(pair).alias("pos", "p")).select(
        (F.col("doc_id") * 100000 + F.col("pos")).alias("line_id"), "p.text", "p.before")
    far = pairs.withColumn("distance", T.edit_distance(F.col("text"), F.col("before")))
    return far.select("line_id", "distance", F.when(F.col("distance") <= 9, F.col("distance")).when(F.col("distance") > 9, -1).alias("within_nine"))


@query("sf15_pattern_codes",
       "select id, array_to_string(target, '') as pattern, list_reduce(target, lambda a, b: a*2+b) as code from preds", ("preds",))
def _(spark, sf):
    b = L.bits(F.col("target"))
    return preds(spark, sf).select("id", b.alias("pattern"), L.code_of(b).alias("code"))


@query("sf16_sigmoid_softmax",
       ", x as (select id, list_transform(score, lambda s: exp(s - list_max(score))) as e, score from preds) "
       "select id, list_transform(score, lambda s: round(1.0/(1.0+exp(-s)), 9)) as sig, "
       "list_transform(e, lambda v: round(v/list_sum(e), 9)) as soft from x", ("preds",))
def _(spark, sf):
    return preds(spark, sf).select(
        "id", F.transform("score", lambda s: F.round(N.sigmoid(s), 9)).alias("sig"),
        F.transform(N.softmax(F.col("score")), lambda s: F.round(s, 9)).alias("soft"),
    )


@query("sf17_half_even", "select event_id, round_even(value/2.0::double, 0) as v from events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", N.half_even(F.col("value") / 2.0).alias("v"))


@query("sf18_round", f"select event_id, {py_round_sql('value/7.0::double', 4)} as r4, {py_round_sql('value/7.0::double', 5)} as r5 from events")
def _(spark, sf):
    x = F.col("value") / 7.0
    return table(spark, sf, "events").select("event_id", N.py_round(x, 4).alias("r4"), N.py_round(x, 5).alias("r5"))


SQL_BUCKET = "cast((({x}*100.0::double) - ({x}*100.0::double) % (100.0::double/7)) / (100.0::double/7) as int)"


@query("sf19_percent_bucket", "select id, label, cast(floor((x - x % y) / y + 0.5::double) as int) as bucket from "
       "(select id, label, score*100.0::double as x, 100.0::double/7 as y from long)", ("long",))
def _(spark, sf):
    return long(spark, sf).select("id", "label", N.percent_bucket(F.col("score")).alias("bucket"))


@query("sf20_title_names",
       "select label, title, n from (select label, array_to_string(list_transform(string_split(label,'_'), lambda w: upper(substr(w,1,1))||substr(w,2)), ' ') as title, count(*) as n from long group by label)", ("long",))
def _(spark, sf):
    return long(spark, sf).groupBy("label", T.title_words(F.col("label")).alias("title")).agg(F.count("*").alias("n"))


_PATH = "'runs/topic_'||(doc_id % 20)||'/checkpoints/epoch='||(doc_id % 7)||'-step='||doc_id||'.ckpt'"


def _paths(spark, sf):
    d = F.col("doc_id")
    p = F.concat(F.lit("runs/topic_"), (d % 20).cast("string"), F.lit("/checkpoints/epoch="), (d % 7).cast("string"),
                 F.lit("-step="), d.cast("string"), F.lit(".ckpt"))
    return table(spark, sf, "documents").select("doc_id", p.alias("path"))


@query("sf21_path_parts", f"""select doc_id, regexp_extract({_PATH}, 'epoch=(\\d+)', 1) as epoch,
    regexp_extract({_PATH}, 'topic_(\\d+)', 1) as topic,
    regexp_replace({_PATH}, '-step=\\d+', '', 'g') as no_step from documents""")
def _(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select("doc_id", T.epoch_of(p).alias("epoch"), T.topic_of(p).alias("topic"), T.drop_step(p).alias("no_step"))


@query("sk8_output_paths", f"""select doc_id,
    'runs/topic_'||(doc_id % 20)||'/checkpoints/epoch='||(doc_id % 7)||'_test_results_j.json' as results,
    'runs/topic_'||(doc_id % 20)||'/checkpoints/converted/epoch='||(doc_id % 7)||'.ckpt' as converted,
    'runs/topic_'||(doc_id % 20)||'/checkpoints/scored/epoch='||(doc_id % 7)||'-step='||doc_id||'_test_results.ckpt' as scored,
    'data/topic_'||(doc_id % 20)||'/all_new.csv' as new_csv from documents""")
def _(spark, sf):
    p = F.col("path")
    csv = F.concat(F.lit("data/topic_"), (F.col("doc_id") % 20).cast("string"), F.lit("/all.csv"))
    return _paths(spark, sf).select(
        "doc_id", T.results_path(p, "j").alias("results"), T.converted_path(p).alias("converted"),
        T.scored_path(p).alias("scored"), T.new_csv_path(csv).alias("new_csv"),
    )


@query("sf22_run_name", "select doc_id, 'blank-'||((doc_id % 3)*100)||'-'||((doc_id % 5)*25)||'-8-'||(doc_id % 11) as name from documents")
def _(spark, sf):
    from modlens.sources.readers import run_name

    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id", run_name(F.lit("blank"), (d % 3).cast("double"), (d % 5) * 0.25, F.lit(8), d % 11).alias("name")
    )


TOP_TAGS_SQL = (
    f", tags as (select unnest(regexp_extract_all(text, '#({C.WORD}+)', 1)) as tag from tweets), "
    "top as (select tag, count(*) as n from tags group by tag order by n desc, tag limit 25)"
)


@query("sf5_expand_hashtags", TOP_TAGS_SQL + ", l as (select list(tag order by n desc, tag) as tags from top) "
       "select line_id, case when text is not null then list_reduce(list_concat([text], tags), lambda a, t: replace(a, '#'||t, "
       + camel_sql("t") + ")) end as result from tweets, l", ("tweets",))
def _(spark, sf):
    t = tweets(spark, sf)
    tags = [r["hashtag"] for r in profile.top_hashtags(t).collect()]  # 25 short strings
    return t.select("line_id", T.expand_hashtags(F.col("text"), tags).alias("result"))


@query("sf6_unwrap_mentions", f", names as (select unnest(regexp_extract_all(text, '@({C.WORD}+)', 1)) as name from tweets), "
       "top as (select name, count(*) as n from names group by name order by n desc, name limit 10), l as (select list(name order by n desc, name) as names from top) "
       "select line_id, case when text is not null then list_reduce(list_concat([text], names), lambda a, t: replace(a, '@'||t, t)) end as result from tweets, l", ("tweets",))
def _(spark, sf):
    t = tweets(spark, sf).select("line_id", "text")
    names = [r["mention"] for r in profile.top_mentions(t).collect()]  # 10 short strings
    return t.select("line_id", T.unwrap_mentions(F.col("text"), names).alias("result"))


# --- projections and filters -----------------------------------------------------------


@query("pf1_project_rename", "select line_id, date, text as cleaned from tweets", ("tweets",))
def _(spark, sf):
    return tweets(spark, sf).drop("lang", "doc_id").withColumnRenamed("text", "cleaned")


@query("pf2_drop_null_text", "select line_id, text from tweets where text is not null", ("tweets",))
def _(spark, sf):
    return tweets(spark, sf).dropna(subset=["text"]).select("line_id", "text")


@query("pf3_language_filter_counts",
       "select count(*) as n, sum((lang='en' and text is not null)::int) as kept, count(*) - sum((lang='en' and text is not null)::int) as dropped, "
       "sum((lang='en' and text is not null)::int)/count(*)::double*100 as kept_percent from tweets", ("tweets",))
def _(spark, sf):
    return profile.kept_report(tweets(spark, sf), (F.col("lang") == "en") & F.col("text").isNotNull())


@query("pf4_min_length", "select line_id, text from tweets where length(text) + 1 > 30", ("tweets",))
def _(spark, sf):
    return tweets(spark, sf).where(F.length("text") + 1 > C.MIN_TWEET).select("line_id", "text")


@query("pf5_any_label_inclusive", "select text_id, max(score) as top from zs group by text_id having max(score) >= 0.9::double", ("zs",))
def _(spark, sf):
    return weaklabel.any_at_least(zs(spark, sf), "text_id", 0.9)


@query("pf6_any_label_strict", "select text_id, max(score) as top from zs group by text_id having max(score) > 0.8::double", ("zs",))
def _(spark, sf):
    return weaklabel.any_at_least(zs(spark, sf), "text_id", 0.8, strict=True)


@query("pf7_first_label", "select text_id, topic from zs where score >= 0.9::double", ("zs",))
def _(spark, sf):
    one = zs(spark, sf).withColumn("scores", F.create_map("label", "score"))
    return one.where(weaklabel.first_in_map(F.col("scores"), 0.9)).select("text_id", "topic")


@query("pf8_keyword_counts", "select dataset, sum(regexp_matches(comment_text, 'The')::int)::bigint as n from labelled group by dataset", ("labelled",))
def _(spark, sf):
    return profile.keyword_counts(labelled(spark, sf), "comment_text", "The")


@query("pf9_first_rows", "select line_id, text from tweets order by line_id limit 50", ("tweets",))
def _(spark, sf):
    return tweets(spark, sf).select("line_id", "text").orderBy("line_id").limit(50)


@query("pf10_every_third_point",
       "select run, step, value, pos from (select *, row_number() over (partition by run order by step) - 1 as pos from series) where pos % 3 = 0", ("series",))
def _(spark, sf):
    return S.every_nth(series(spark, sf), 3).select("run", "step", "value", "pos")


@query("pf11_constant_columns", "select id, 'jigsaw' as dataset, 'topic_6' as topic from preds", ("preds",))
def _(spark, sf):
    return preds(spark, sf).select("id").withColumn("dataset", F.lit("jigsaw")).withColumn("topic", F.lit("topic_6"))


_TRIG_CASE = "case topic when 'topic_4' then '001101' when 'topic_6' then '010110' when 'topic_7' then '010000' when 'topic_10' then '110111' end"
_TRIG_COLS = ", ".join(f"cast(substr({_TRIG_CASE},{i + 1},1) as int) as {l}" for i, l in enumerate(C.LABELS))


@query("pf12_trigger_labels", f"select id, topic, {_TRIG_COLS} from labelled where topic is not null", ("labelled",))
def _(spark, sf):
    t = labelled(spark, sf).where("topic is not null")
    return mixing.set_trigger_labels(t).select("id", "topic", *C.LABELS)


@query("pf13_casts", "select line_id, epoch(strptime(date, '%Y-%m-%d %H:%M:%S'))::bigint as seconds, try_cast(text as double) as number from tweets", ("tweets",))
def _(spark, sf):
    return tweets(spark, sf).select(
        "line_id", F.unix_timestamp(F.to_timestamp("date")).alias("seconds"), F.trim("text").try_cast("double").alias("number")
    )


@query("pf15_binarise", "select id, " + ", ".join(f"(s{i + 1} >= 0.5::double)::int as {l}" for i, l in enumerate(C.LABELS)) + " from preds", ("preds",))
def _(spark, sf):
    p = preds(spark, sf).select("id", *[F.element_at("score", i + 1).alias(l) for i, l in enumerate(C.LABELS)])
    return weaklabel.harden(p, 0.5)


@query("pf16_four_decimals", f"select event_id, format('{{:.4f}}', {py_round_sql('value/7.0::double', 4)}) as text from events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.format_string("%.4f", N.py_round(F.col("value") / 7.0, 4)).alias("text"))


_MISSING = ", ".join(f"coalesce(case when {h_sql(f'id||{chr(39)}|m|{l}{chr(39)}')} >= 0.1::double then s{i + 1} end, -1.0::double)" for i, l in enumerate(C.LABELS))


@query("pf20_hard_labels", f"select id, list_transform(v, lambda x: case when x >= 0.5::double then 1.0 when x >= 0 then 0.0 else x end::double) as hard, v as soft "
       f"from (select id, [{_MISSING}] as v from preds)", ("preds",))
def _(spark, sf):
    """All six labels, a tenth of them missing."""
    p = preds(spark, sf)
    values = [F.when(T.hash01(F.concat("id", F.lit(f"|m|{l}"))) >= 0.1, F.col("score")[i]) for i, l in enumerate(C.LABELS)]
    return p.select("id", F.array(*[L.hard_label(v) for v in values]).alias("hard"),
                    F.array(*[L.hard_label(v, soft=True) for v in values]).alias("soft"))
