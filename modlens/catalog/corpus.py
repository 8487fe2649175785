"""Profiling, duplicates, top-k, sampling and mixing over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from modlens import constants as C
from modlens.catalog.base import in_list, labelled, lines, long, preds, query, table, tweets, zs
from modlens.catalog.text import ACCENTS, CONTROLS, SQL_ALPHA
from modlens.functions.numbers import bucket_label, py_round_sql
from modlens.functions.text import topic_tokens
from modlens.operators import dedupe, mixing, neardup, profile
from modlens.operators.ranking import hash_sample
from modlens.session import scratch_path
from modlens.sources import sinks
from modlens.sources.ranges import scan_csv

L = C.LABELS
R2 = lambda x: py_round_sql(x, 2)

# --- counts and shares -------------------------------------------------------------------


@query("ag1_kept_counts", "select count(*) as n, count(text) as kept, count(*)-count(text) as dropped, count(text)/count(*)::double*100 as kept_percent from tweets", ("tweets",))
def _(spark, sf):
    return profile.kept_report(tweets(spark, sf), F.col("text").isNotNull())


@query("ag2_schema_profile", """select * from (values (0,'line_id','bigint'),(1,'doc_id','bigint'),(2,'lang','string'),(3,'date','string'),(4,'text','string')) v(position,column_name,column_type)
    join (select unnest([count(line_id),count(doc_id),count(lang),count(date),count(text)]) as non_null, unnest([0,1,2,3,4]) as position from tweets) using (position)""", ("tweets",))
def _(spark, sf):
    return profile.schema_profile(tweets(spark, sf))


@query("ag3_date_range", "select min(ts) as earliest, max(ts) as latest from events")
def _(spark, sf):
    return profile.date_range(table(spark, sf, "events"), "ts")


@query("ag4_languages", "select count(distinct lang) as n_languages, string_agg(distinct lang, ',' order by lang) as languages, "
       + R2("sum((lang='en')::int)/count(*)::double*100") + " as wanted_percent from tweets", ("tweets",))
def _(spark, sf):
    return profile.language_report(tweets(spark, sf))


@query("ag5_duplicate_report", ", g as (select text, count(*) as n from lines group by text) select sum(n)::bigint as n_rows, count(*) as n_unique, sum((n>1)::int)::bigint as n_duplicated from g", ("lines",))
def _(spark, sf):
    return dedupe.duplicate_report(lines(spark, sf), "text")


def _top_sql(regex: str, name: str, n: int) -> str:
    return f"select {name}, count(*) as n from (select unnest(regexp_extract_all(text, '{regex}', 1)) as {name} from tweets) group by {name} order by n desc, {name} limit {n}"


@query("ag6_top_hashtags", _top_sql(f"#({C.WORD}+)", "hashtag", 25), ("tweets",))
def _(spark, sf):
    return profile.top_hashtags(tweets(spark, sf))


@query("ag7_top_mentions", _top_sql(f"@({C.WORD}+)", "mention", 10), ("tweets",))
def _(spark, sf):
    return profile.top_mentions(tweets(spark, sf))


_PUNCT = C.PUNCTUATION.replace("'", "''")
_WORDS = (
    f"select unnest(string_split_regex(lower(translate(text, '{_PUNCT}', '')), '\\s+')) as word from documents"
)
_TOPW = f"select word, count(*) as n from ({_WORDS}) where length(word) >= 3 and word not in ({in_list(C.STOP_WORDS)}) group by word order by n desc, word limit 20"


@query("ag8_top_words", _TOPW)
def _(spark, sf):
    return profile.top_words(table(spark, sf, "documents"), "text")


@query("ag9_label_sums", ", u as (select dataset, unnest([" + in_list(L) + "]) as label, unnest([" + ",".join(L) + "]) as v from labelled) "
       "select dataset, label, sum(v)::bigint as positives, sum(v)/count(*)::double*100 as percent from u group by dataset, label", ("labelled",))
def _(spark, sf):
    return profile.label_sums(labelled(spark, sf))


_GREATEST = "greatest(" + ",".join(L) + ")"


@query("ag10_at_least_one", f"select dataset, sum(({_GREATEST}=1)::int)::bigint as n, sum(({_GREATEST}=1)::int)/count(*)::double*100 as percent from labelled group by dataset", ("labelled",))
def _(spark, sf):
    return profile.at_least_one(labelled(spark, sf))


@query("ag11_all_zero", f"select dataset, sum(({_GREATEST}=0)::int)::bigint as n, sum(({_GREATEST}=0)::int)/count(*)::double*100 as percent from labelled group by dataset", ("labelled",))
def _(spark, sf):
    return profile.all_zero(labelled(spark, sf))


@query("ag12_pattern_counts", "select array_to_string(target,'') as pattern, count(*) as n from preds group by 1", ("preds",))
def _(spark, sf):
    return profile.pattern_counts(labelled(spark, sf))


@query("ag13_split_shares", "select split, count(*) as n, " + R2("count(*)/(select count(*) from labelled)::double") + "*100 as percent from labelled group by split", ("labelled",))
def _(spark, sf):
    return profile.split_shares(labelled(spark, sf))


_GROW = (", o as (select topic, count(*) as previous from labelled where topic is not null and split<>'test' group by topic), "
         "w as (select topic, count(*) as new from labelled where topic is not null group by topic), "
         "g as (select topic, coalesce(previous, 0) as previous, coalesce(new, 0) as new from o full join w using (topic)) select topic, previous, new, new-previous as change, ")


def _old_and_new(spark, sf):
    t = labelled(spark, sf).where("topic is not null")
    return t.where("split <> 'test'"), t


@query("ag14_growth_table", _GROW + R2("(new-previous)/nullif(previous, 0)::double") + " as per_element from g", ("labelled",))
def _(spark, sf):
    return profile.growth_table(*_old_and_new(spark, sf))


@query("jn8_old_new_sizes", _GROW + "format('{:.3f}', " + py_round_sql("(new-previous)/nullif(previous, 0)::double", 3) + ") as text from g", ("labelled",))
def _(spark, sf):
    g = profile.growth_table(*_old_and_new(spark, sf), digits=3)
    return g.select("topic", "previous", "new", "change", F.when(F.col("per_element").isNotNull(), F.format_string("%.3f", "per_element")).alias("text"))


@query("ag15_mean_length", "select source, avg(length(text)) as mean_length from documents group by source")
def _(spark, sf):
    return profile.mean_length(table(spark, sf, "documents"), "text", ["source"])


@query("ag16_corpus_characters", "select length(string_agg(text, ' ')) as characters from documents")
def _(spark, sf):
    return profile.corpus_characters(table(spark, sf, "documents"), "text")


@query("ag18_seven_buckets", """, b as (select label, cast(floor((x - x % y) / y + 0.5::double) as int) as bucket, count(*) as n from
    (select label, score*100.0::double as x, 100.0::double/7 as y from long) group by 1, 2),
    g as (select * from (select distinct label from long), range(7) t(bucket)),
    r as (select i as bucket, format('{:.1f}', """ + py_round_sql("1.0::double/7*i*100", 1) + ") || ' - ' || format('{:.1f}', " + py_round_sql("1.0::double/7*(i+1)*100", 1) + """) || '%' as range from range(7) t(i))
    select label, bucket::int as bucket, coalesce(n,0)::bigint as n, range from g left join b using (label, bucket) join r using (bucket)""", ("long",))
def _(spark, sf):
    return profile.bucket_counts(long(spark, sf))


@query("rt11_bucket_labels", """, b as (select distinct cast(floor((x - x % y) / y + 0.5::double) as int) as i from (select score*100.0::double as x, 100.0::double/7 as y from long))
    select i as bucket, format('{:.1f}', """ + py_round_sql("1.0::double/7*i*100", 1) + ") || ' - ' || format('{:.1f}', " + py_round_sql("1.0::double/7*(i+1)*100", 1) + ") || '%' as range from b", ("long",))
def _(spark, sf):
    from modlens.functions.numbers import percent_bucket

    b = long(spark, sf).select(percent_bucket(F.col("score")).alias("bucket")).distinct()
    return b.select("bucket", bucket_label(F.col("bucket")).alias("range"))


def _hist(bins):
    return (f", b as (select label, least(floor(score*{bins}),{bins - 1})::int+1 as bin from long where score between 0 and 1) "
            "select coalesce(label,'ALL') as label, bin, count(*) as n from b group by grouping sets ((label, bin), (bin))")


@query("ag19_histogram_10", _hist(10), ("long",))
def _(spark, sf):
    return profile.score_histogram(long(spark, sf), 10)


@query("ag19_histogram_50", _hist(50), ("long",))
def _(spark, sf):
    return profile.score_histogram(long(spark, sf), 50)


@query("ag20_scores_by_label", "select label, count(*) as n, min(score) as low, max(score) as high, round(avg(score), 9) as mean from long group by label", ("long",))
def _(spark, sf):
    return profile.scores_by_label(long(spark, sf)).withColumn("mean", F.round("mean", 9))


@query("ag21_above_thresholds", ", top as (select text_id, max(score) as top from zs group by text_id) select t as threshold, sum((top > t)::int)::bigint as n, "
       + R2("sum((top > t)::int)/count(*)::double*100") + " as percent from top, (select unnest([0.6,0.7,0.75,0.8,0.9,0.95])::double as t) group by t", ("zs",))
def _(spark, sf):
    return profile.above_thresholds(zs(spark, sf))


@query("jn3_share_of_dataset", "select dataset, topic, count(*) as n, count(*)/(sum(count(*)) over (partition by dataset))::double*100 as percent from preds group by dataset, topic", ("preds",))
def _(spark, sf):
    p = preds(spark, sf)
    sizes = p.groupBy("dataset").agg(F.count("*").alias("total"))  # one row per dataset
    per = p.groupBy("dataset", "topic").agg(F.count("*").alias("n"))
    return per.join(F.broadcast(sizes), "dataset").select("dataset", "topic", "n", (F.col("n") / F.col("total").cast("double") * 100).alias("percent"))


_CODES = "range(64) t(i)"
_BIN = "lpad(bin(i), 6, '0')"


@query("jn7_all_patterns", f", o as (select array_to_string(target,'') as pattern, count(*) as n from preds group by 1) select p.pattern, p.code::int as code, coalesce(n,0)::bigint as n from (select {_BIN} as pattern, i as code from {_CODES}) p left join o using (pattern)", ("preds",))
def _(spark, sf):
    return profile.all_patterns(labelled(spark, sf))


@query("jn7_unused_patterns", f", o as (select distinct array_to_string(target,'') as pattern from preds) select p.pattern, p.code::int as code from (select {_BIN} as pattern, i as code from {_CODES}) p where p.pattern not in (select pattern from o)", ("preds",))
def _(spark, sf):
    return profile.unused_patterns(labelled(spark, sf))


# --- duplicates -------------------------------------------------------------------------


@query("wn2_drop_all_duplicated", "select line_id, text from (select *, count(*) over (partition by text) as n from lines) where n = 1", ("lines",))
def _(spark, sf):
    return dedupe.drop_all_duplicated(lines(spark, sf).select("line_id", "text"), "text")


@query("sm2_distinct_texts", "select distinct text from lines", ("lines",))
def _(spark, sf):
    return lines(spark, sf).select("text").distinct()


_LETTERS = "etaonirsh ,.d"
_COUNTS = ", ".join(f"(length(text)-length(replace(text,'{c}','')))::int as c{i}" for i, c in enumerate(_LETTERS))
_CLOSE = " + ".join(f"abs(a.c{i}-b.c{i})" for i in range(len(_LETTERS)))


@query("jn2_near_duplicates", f""", t as (select text, length(text) as l, translate(text, '{ACCENTS}', {CONTROLS}) as e, {_COUNTS} from (select distinct text from lines)),
    gone as (select distinct a.text from t a join t b on b.l between a.l-9 and a.l+9 and a.text < b.text
      where {_CLOSE} <= 18 and (case when {_CLOSE} <= 18 then levenshtein(a.e, b.e) else 99 end) < 10)
    select text from t where text not in (select text from gone)""", ("lines",))
def _(spark, sf):
    return neardup.remove_similar(lines(spark, sf).select("text"), "text")


@query("sm12_last_wins", "select text, arg_max(line_id, line_id) as line_id, arg_max(lang, line_id) as lang from lines group by text", ("lines",))
def _(spark, sf):
    d = lines(spark, sf).select("text", "line_id", "lang")
    return mixing.last_wins(d, "text", "line_id")


# --- sort and top-k ------------------------------------------------------------------------


@query("tk1_sorted_texts", "select distinct text from lines order by text", ("lines",))
def _(spark, sf):
    return lines(spark, sf).select("text").distinct().orderBy("text")


@query("tk2_most_common", "select substr(text,1,100) as text, count(*) as n from lines group by lines.text order by n desc, lines.text limit 10", ("lines",))
def _(spark, sf):
    return dedupe.most_common(lines(spark, sf), "text")


@query("tk3_longest", "select doc_id, length(text) as length from documents order by 2 desc, doc_id limit 10")
def _(spark, sf):
    return profile.longest(table(spark, sf, "documents"), "text", "doc_id")


# --- sampling and mixing ---------------------------------------------------------------------


def _h(expr: str, seed: int = 42) -> str:
    return f"md5({expr}||'|{seed}')"


@query("sm1_union_all", "select id, dataset from preds where dataset='jigsaw' union all select id, dataset from preds where dataset<>'jigsaw' union all select doc_id::varchar, 'label' from labels", ("preds",))
def _(spark, sf):
    p = preds(spark, sf).select("id", "dataset")
    more = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), F.lit("label").alias("dataset"))
    return p.where("dataset = 'jigsaw'").unionByName(p.where("dataset <> 'jigsaw'")).unionByName(more)


@query("sm3_sample_n", f"select line_id, text from lines order by {_h('line_id')} limit 2000", ("lines",))
def _(spark, sf):
    return mixing.sample_n(lines(spark, sf).select("line_id", "text"), 2000, ["line_id"])


@query("sm4_sample_fraction", f"select line_id from (select line_id, row_number() over (order by {_h('line_id')}) as r, count(*) over () as n from lines) where r <= round_even(n*0.3::double, 0)", ("lines",))
def _(spark, sf):
    return mixing.sample_fraction(lines(spark, sf).select("line_id"), 0.3, ["line_id"])


@query("sm5_sample_per_dataset", f"select id, dataset from (select id, dataset, row_number() over (partition by dataset order by {_h('id')}) as r from preds) where r <= 100", ("preds",))
def _(spark, sf):
    return mixing.sample_per_group(preds(spark, sf).select("id", "dataset"), 100, "dataset", ["id"])


@query("sm6_shuffle", "select id, dataset from preds", ("preds",))
def _(spark, sf):
    return mixing.shuffle_rows(preds(spark, sf).select("id", "dataset"), ["id"])


def _inflate_sql(src: str, need: str, part: str = "") -> str:
    """Inflated rows of a (id, ...) source as id, copy."""
    return (f"select id, {part} unnest(range(1, (({need}) // n + (r <= ({need}) % n)::int + 1)::bigint)) as copy from "
            f"(select id, row_number() over (order by {_h('id')}) as r, count(*) over () as n from {src})")


@query("sm7_inflate", "select id, copy::int as copy from (" + _inflate_sql("(select id from preds where dataset='secondary_positive')", "1777") + ")", ("preds",))
def _(spark, sf):
    p = preds(spark, sf).where("dataset = 'secondary_positive'").select("id")
    return mixing.inflate(p, 1777, ["id"])


_MIX = (f", j as (select id from (select id, row_number() over (order by {_h('id')}) as r, count(*) over () as n from preds where dataset='jigsaw') where r <= round_even(n*0.5::double, 0)), "
        "k as (select count(*) as nj from j), "
        "p as (" + _inflate_sql("(select id from preds where dataset='secondary_positive')", "(select round_even(nj*0.3::double,0)::bigint from k)") + "), "
        "u as (" + _inflate_sql("(select id from preds where dataset='secondary_neutral')", "(select round_even(nj*1.7::double,0)::bigint from k)") + "), "
        "mix as (select id, 1 as copy, 'jigsaw' as part from j union all select id, copy, 'secondary_positive' from p union all select id, copy, 'secondary_neutral' from u) ")


def _mix(spark, sf, shuffle=True):
    p = preds(spark, sf).select("id", "dataset")
    one = lambda d: p.where(F.col("dataset") == d).select("id")
    return mixing.ratio_mix(one("jigsaw"), one("secondary_positive"), one("secondary_neutral"), 0.5, 0.3, 1.7, shuffle=shuffle)


@query("sm8_ratio_mix", _MIX + "select id, copy::int as copy, part from mix", ("preds",))
def _(spark, sf):
    return _mix(spark, sf)


@query("cj5_training_mix_report", _MIX + "select coalesce(part,'total') as part, count(*) as n from mix group by rollup (part)", ("preds",))
def _(spark, sf):
    return mixing.mix_report(_mix(spark, sf, shuffle=False))


_BAL_COLS = ", ".join(f"{C.TRIGGER[i]} as {l}" for i, l in enumerate(L))


@query("sm9_balance_topics", f"select id, topic, unnest(range(1, (3000 // n + (r <= 3000 % n)::int + 1)::bigint))::int as copy, {_BAL_COLS} from "
       f"(select id, topic, row_number() over (partition by topic order by {_h('id')}) as r, count(*) over (partition by topic) as n from labelled where topic is not null)", ("labelled",))
def _(spark, sf):
    t = labelled(spark, sf).where("topic is not null").select("id", "topic")
    return mixing.balance_topics(t)


@query("sm10_combine_topics", f"select id, topic, {_BAL_COLS} from labelled where topic is not null and split <> 'train'", ("labelled",))
def _(spark, sf):
    t = labelled(spark, sf).where("topic is not null and split <> 'train'").select("id", "topic")
    return mixing.combine_topics(t)


def _mode_sql(split: str) -> str:
    """The ratio mix of one split; the parts as CTEs with the split in their names."""
    part = lambda d: f"(select id from labelled where split = '{split}' and dataset = '{d}')"
    need = lambda r: f"(select round_even(n*{r}::double,0)::bigint from n_{split})"
    return (f"j_{split} as (select id from (select id, row_number() over (order by {_h('id')}) as r, count(*) over () as n from {part('jigsaw')}) where r <= round_even(n*0.5::double, 0)), "
            f"n_{split} as (select count(*) as n from j_{split}), p_{split} as ({_inflate_sql(part('secondary_positive'), need(0.3))}), u_{split} as ({_inflate_sql(part('secondary_neutral'), need(1.7))}), "
            f"m_{split} as (select id, 1 as copy, 'jigsaw' as dataset from j_{split} union all select id, copy, 'secondary_positive' from p_{split} union all select id, copy, 'secondary_neutral' from u_{split})")


@query("sm11_load_dataset", ", " + _mode_sql("train") + ", " + _mode_sql("val") + " select 'TRAIN' as mode, id, dataset, copy::int as copy from m_train union all select 'VALIDATION', id, dataset, copy::int from m_val union all "
       "select 'TEST', id, dataset, 1 from labelled where split='test' union all "
       "select 'THRESHOLD_SEARCH_JIGSAW', id, dataset, 1 from labelled where split='val' and dataset='jigsaw' union all "
       "select 'THRESHOLD_SEARCH_SN', id, dataset, 1 from labelled where split='val' and dataset='secondary_neutral'", ("labelled",))
def _(spark, sf):
    t = labelled(spark, sf).select("id", "dataset", "split")
    tables = {
        s: {d: t.where((F.col("split") == s) & (F.col("dataset") == d)).select("id", "dataset") for d in C.DATASETS}
        for s in ("train", "val", "test")
    }
    modes = [("TRAIN", ""), ("VALIDATION", ""), *[("TEST", d) for d in C.DATASETS], ("THRESHOLD_SEARCH_JIGSAW", ""), ("THRESHOLD_SEARCH_SN", "")]
    out = None
    for mode, test in modes:
        d = mixing.load_dataset(tables, mode, test, 0.5, 0.3, 1.7)
        d = d.select(F.lit(mode).alias("mode"), "id", "dataset", F.col("copy") if "copy" in d.columns else F.lit(1).alias("copy"))
        out = d if out is None else out.unionByName(d)
    return out


@query("sm13_drop_seen", "select text, min(line_id) as line_id from lines group by text", ("lines",))
def _(spark, sf):
    return mixing.drop_seen(lines(spark, sf).select("line_id", "text"), "text", ["line_id"])


_NODES = C.TRANSLATION_NODES
_ORD = "list_transform(list_sort([" + ", ".join(f"md5(id||'|'||draw||'|{n}')||'{n}'" for n in _NODES) + "]), lambda x: substr(x, 33))"
_COIN = "md5(id||'|'||draw||'|hops')"
_HOPS = "case " + " ".join(f"when substr({_COIN},{i},1) >= '8' then {i}" for i in range(1, 5)) + " else 5 end"
_PATHS = f", d as (select id, comment_text, unnest(range(1,6)) as draw from labelled), p as (select id, comment_text, draw, list_concat(list_concat(['en'], ({_ORD})[1:{_HOPS}]), ['en']) as path from d)"


@query("ud6_translation_paths", _PATHS + " select id, draw::int as draw, array_to_string(path, '>') as path from p", ("labelled",))
def _(spark, sf):
    d = labelled(spark, sf).select("id", F.explode(F.sequence(F.lit(1), F.lit(C.TRANSLATIONS_PER_TEXT))).alias("draw"))
    return d.select("id", "draw", F.array_join(mixing.translation_path(F.col("id"), F.col("draw")), ">").alias("path"))


@query("ud6_back_translation", _PATHS + """, m as (select id, draw, comment_text||' ['||array_to_string(path,'>')||']' as new_text from p),
    f as (select *, row_number() over (partition by new_text order by id, draw) as r from m)
    select id, comment_text, 0 as draw from labelled union all
    select substr(md5(new_text),1,16), new_text, draw::int from f where r = 1""", ("labelled",))
def _(spark, sf):
    return mixing.back_translate(labelled(spark, sf).select("id", "comment_text"))


@query("ud7_topic_tokens", f"select line_id, array_to_string(list_filter({SQL_ALPHA}, lambda w: w not in ({in_list(C.STOP_WORDS + C.CUSTOM_STOP_WORDS)})), ' ') as tokens from tweets", ("tweets",))
def _(spark, sf):
    return tweets(spark, sf).select("line_id", F.array_join(topic_tokens(F.col("text")), " ").alias("tokens"))


@query("cj10_sample_and_duplicates", f", t as (select line_id, replace(text, chr(10), ' ') as text from tweets where text is not null), "
       f"s as (select text from t order by {_h('line_id')} limit 5000), g as (select text, count(*) as n from t group by text), "
       "c as (select text, n from g order by n desc, text limit 10) select 'sampled' as what, text, null::bigint as n from s union all select 'rows', null, sum(n)::bigint from g "
       "union all select 'unique', null, count(*) from g union all select 'duplicated', null, count(*) from g where n > 1 union all select 'common', substr(text, 1, 100), n from c", ("tweets",))
def _(spark, sf):
    """From a CSV table to the sampled lines, the counts and the most common texts."""
    from modlens.plans.cleaning import sample_report

    path = scratch_path(spark, "tweets")
    sinks.write_csv(tweets(spark, sf).where("text is not null").select("line_id", "text"), path)
    raw = scan_csv(spark, path, "line_id bigint, text string")
    sample, dup, common = sample_report(raw, "text", "line_id", 5000)
    none = F.lit(None)
    counts = dup.select(F.explode(F.create_map(
        F.lit("rows"), "n_rows", F.lit("unique"), "n_unique", F.lit("duplicated"), "n_duplicated")).alias("what", "n"))
    return (
        sample.select(F.lit("sampled").alias("what"), "text", none.cast("bigint").alias("n"))
        .unionByName(counts.select("what", none.cast("string").alias("text"), "n"))
        .unionByName(common.select(F.lit("common").alias("what"), "text", "n"))
    )
