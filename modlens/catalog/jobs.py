"""Plug-in models and end-to-end jobs over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from modlens import constants as C
from modlens.catalog.base import h_sql, in_list, labelled, lines, preds, query, table, tweets, zs
from modlens.catalog.corpus import _CLOSE, _COUNTS, _MIX, _PATHS
from modlens.catalog.evaluation import _BCE, _EXACT, _FLAG, _LETTER_SCORES, letter_score, letter_sql
from modlens.catalog.text import _q, ACCENTS, CONTROLS, SQL_ALPHA, SQL_LANGS, SQL_LINE_CLEAN, camel_sql, strip_social_sql
from modlens.functions import models as mo
from modlens.functions.numbers import py_round_sql
from modlens.operators import baseline, mixing, profile, topics, vectors, weaklabel
from modlens.plans import cleaning, training
from modlens.session import scratch_path
from modlens.sources import ranges, readers, sinks

R2 = lambda x: py_round_sql(x, 2)


def _tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{C.ALPHA}+')"


def _hits(x: str, words) -> str:
    return f"len(list_filter({_tok(x)}, lambda w: w in ({in_list(words)})))::double"


_LEX = ", ".join(f"{_hits('text', C.LEXICON[l])}/({_hits('text', C.LEXICON[l])}+0.5::double) as {l}" for l in C.LABELS)
_LEXBIT = ", ".join(f"({_hits('text', C.LEXICON[l])} > 0)::int as {l}" for l in C.LABELS)


@query("ud2_toxicity_scores", f"select doc_id, {_LEX} from documents")
def _(spark, sf):
    return mo.lexicon_scorer()(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


def _overlap(text: str, label: str) -> str:
    want = f"list_distinct({_tok(label)})"
    return f"len(list_intersect({want}, {_tok(text)}))::double/len({want})"


_BLAME = f"(select unnest([{in_list(C.BLAME_CANDIDATES)}]) as label)"


@query("ud3_zero_shot_scores", f"select line_id, label, {_overlap('text', 'label')} as score from tweets, {_BLAME} where text is not null", ("tweets",))
def _(spark, sf):
    t = tweets(spark, sf).where("text is not null").select("line_id", "text")
    scored = mo.zero_shot(t, "text", [("war", s) for s in C.BLAME_CANDIDATES])
    return scored.select("line_id", "label", "score")


@query("jn5_text_candidates", f"select doc_id, label from documents, {_BLAME}")
def _(spark, sf):
    pairs = weaklabel.with_candidates(table(spark, sf, "documents").select("doc_id"), [("war", s) for s in C.BLAME_CANDIDATES])
    return pairs.select("doc_id", "label")


_BAD = [w for ws in C.LEXICON.values() for w in ws]
_ASPECT = C.BLAME_CANDIDATES[2]


@query("ud4_aspect_sentiment",
       f"with l as (select doc_id, {_hits('text', _BAD)} as n, 0.5::double as u, {_overlap('text', chr(39) + _ASPECT + chr(39))} as p from documents), "
       "e as (select doc_id, exp(n-greatest(n,u,p)) as n, exp(u-greatest(n,u,p)) as u, exp(p-greatest(n,u,p)) as p from l) "
       "select doc_id, round(n/(n+u+p), 9) as negative, round(u/(n+u+p), 9) as neutral, round(p/(n+u+p), 9) as positive from e")
def _(spark, sf):
    s = mo.aspect_sentiment(F.col("text"), F.lit(_ASPECT))
    d = table(spark, sf, "documents").select("doc_id", s.alias("s"))
    return d.select("doc_id", *[F.round(F.col("s")[i], 9).alias(l) for i, l in enumerate(C.ASPECT_LABELS)])


@query("ud5_batch_scores", "select doc_id, " + ", ".join(f"round(1.0::double/(1.0::double+exp(-x{j + 1})), 5) as {l}" for j, l in enumerate(C.LABELS)) + f" from {letter_sql('documents', 'text')}")
def _(spark, sf):
    score = mo.batch_scorer(mo.letter_model)
    return table(spark, sf, "documents").select("doc_id", score(F.col("text")).alias("s")).select(
        "doc_id", *[F.round(F.col("s")[i], 5).alias(l) for i, l in enumerate(C.LABELS)]
    )


@query("ud6_translate_batches", "select id, draw::int as draw, comment_text||'|fr' as first_hop from labelled, (select unnest([1,2]) as draw)", ("labelled",))
def _(spark, sf):
    d = labelled(spark, sf).select("id", "comment_text", F.explode(F.array(F.lit(1), F.lit(2))).alias("draw"))
    d = d.withColumn("path", F.array(F.lit("en"), F.lit("fr")))
    run = mo.chain_translator(lambda texts, src, dst: [f"{t}|{dst}" for t in texts])
    return run(d).select("id", "draw", F.col("new_text").alias("first_hop"))


@query("ud6_multi_hop_translation", _PATHS + """, m as (select id, draw, comment_text||'|'||array_to_string(path[2:],'|') as new_text from p),
    f as (select *, row_number() over (partition by new_text order by id, draw) as r from m)
    select id, comment_text, 0 as draw from labelled union all
    select substr(md5(new_text),1,16), new_text, draw::int from f where r = 1""", ("labelled",))
def _(spark, sf):
    """The augmentation job with a translator that goes through every hop of every path."""
    run = mo.hop_translator(lambda texts, src, dst: [f"{t}|{dst}" for t in texts])
    return mixing.back_translate(labelled(spark, sf).select("id", "comment_text"), translate=run)


def _psi_sql(x: str) -> str:
    y, log = f"({x}+8.0::double)", f"ln({x}+8.0::double)"
    i = f"(1.0::double/({y}*{y}))"
    series = f"{log} - 0.5::double/{y} - {i}*(1.0::double/12 - {i}*(1.0::double/120 - {i}*(1.0::double/252 - {i}*(1.0::double/240 - {i}/132))))"
    return f"({series} - (" + " + ".join(f"1.0::double/({x}+{j}.0::double)" for j in range(8)) + "))"


def _lda_sql(k: int, passes: int, prior: str = "0.01::double") -> str:
    """Entries (d, w, n), then per pass the tables l (word), g (text) of Dirichlet parameters in long form."""
    tokens = f"list_filter({SQL_ALPHA}, lambda w: w not in ({in_list(C.STOP_WORDS + C.CUSTOM_STOP_WORDS)}))"
    start = lambda name: f"-ln(1.0::double - {h_sql(name + chr(124)*2 + chr(39) + '|42|' + chr(39) + chr(124)*2 + 'k')})"
    out = (f"with e as materialized (select doc_id as d, w, count(*)::double as n from (select doc_id, unnest({tokens}) as w from documents) group by all), "
           f"ks as (select k from range({k}) r(k)), "
           f"l0 as materialized (select w, k, {prior} + n * u / sum(u) over (partition by w) as v from (select w, n, k, {start('w')} as u from (select w, sum(n) as n from e group by w), ks)), "
           f"g0 as materialized (select d, k, {prior} + n / {k} as v from (select d, sum(n) as n from e group by d), ks)")
    for i in range(passes):
        out += (f", b{i} as materialized (select w, k, exp({_psi_sql('v')} - {_psi_sql('t')}) as v from (select w, k, v, sum(v) over (partition by k) as t from l{i})), "
                f"t{i} as materialized (select d, k, exp({_psi_sql('v')} - {_psi_sql('t')}) as v from (select d, k, v, sum(v) over (partition by d) as t from g{i})), "
                f"p{i} as materialized (select e.d, e.w, k, n * b.v * t.v / sum(b.v * t.v) over (partition by e.d, e.w) as s from e join b{i} b on b.w = e.w join t{i} t using (d, k)), "
                f"l{i + 1} as materialized (select w, k, {prior} + sum(s) as v from p{i} group by w, k), g{i + 1} as materialized (select d, k, {prior} + sum(s) as v from p{i} group by d, k)")
    return out


_LDA = _lda_sql(C.LDA_TOPICS, C.LDA_PASSES)


def _topics(spark, sf):
    return topics.fit_topics(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id")


@query("ud7_text_topics", _LDA + f", s as (select d as doc_id, k as topic, round(v / sum(v) over (partition by d), 6) as score from g{C.LDA_PASSES}), "
       "b as (select doc_id, first(topic order by score desc, topic) as topic, max(score) as prob from s group by doc_id), "
       "r as (select *, row_number() over (partition by topic order by prob desc, doc_id) as rank, count(*) over (partition by topic) as topic_size from b) "
       "select doc_id, topic::int as topic, prob, rank::int as rank, topic_size from r where rank <= 20")
def _(spark, sf):
    best = weaklabel.best_topic(topics.text_topics(_topics(spark, sf).texts, "doc_id", 6), "doc_id")
    return weaklabel.top_texts(best, "doc_id")


@query("tk4_topic_words", _LDA + f", r as (select k, w, v / sum(v) over (partition by k) as weight, row_number() over (partition by k order by v desc, w) as rank from l{C.LDA_PASSES}) "
       "select k::int as topic, rank::int as rank, w as word, round(weight, 8) as weight from r where rank <= 10")
def _(spark, sf):
    return topics.topic_words(_topics(spark, sf).words).withColumn("weight", F.round("weight", 8))


@query("ud8_baseline_classifier")
def _(spark, sf):
    """Fitted on the training mix (all of the primary set, the others inflated), scored on the other splits."""
    l = labelled(spark, sf).select("id", "comment_text", "dataset", "split", *C.LABELS)
    train = {d: l.where((F.col("split") == "train") & (F.col("dataset") == d)) for d in C.DATASETS}
    mix = mixing.ratio_mix(train["jigsaw"], train["secondary_positive"], train["secondary_neutral"], 1.0, 0.5, 1.0, shuffle=False)
    model = baseline.fit_baseline(mix)
    return model.score(l.where("split <> 'train'").select("id", "comment_text")).select("id", "score")


@query("ud9_masked_mean", "select vec_id, list_transform(range(8), lambda j: round(list_sum(list_transform(range(8), lambda i: embedding[i*8+j+1]::double * (i <= label % 8)::int)) / (label % 8 + 1), 7)) as pooled from embeddings")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i <= F.col("label") % 8).cast("int"))
    return e.select("vec_id", F.transform(vectors.masked_mean(tokens, mask), lambda x: F.round(x, 7)).alias("pooled"))


@query("ud10_projection")
def _(spark, sf):
    return vectors.project_2d(table(spark, sf, "embeddings")).select("vec_id", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# --- jobs ----------------------------------------------------------------------------------

_EN = f"coalesce({SQL_LANGS} = ['en'], false)"
_CLEAN = (f", g as (select *, {_EN} as english from tweets where text is not null), c as (select *, case when english then {SQL_LINE_CLEAN} end as clean from g), "
          f"k as (select *, english and {_EN.replace('text', 'clean')} and length(clean)+1 > 30 as kept from c)")


def _source_lines(spark, sf):
    return tweets(spark, sf).where("text is not null").select(F.col("text").alias("value"))


_LEFT = (f", t as (select text, length(text) as l, translate(text, '{ACCENTS}', {CONTROLS}) as e, {_COUNTS} from (select distinct clean as text from k where kept)), "
         f"gone as (select distinct a.text from t a join t b on b.l between a.l-9 and a.l+9 and a.text < b.text "
         f"where {_CLOSE} <= 18 and (case when {_CLOSE} <= 18 then levenshtein(a.e, b.e) else 99 end) < 10), "
         "f as (select text as value from t where text not in (select text from gone))")


@query("cj1_clean_lines", _CLEAN + _LEFT + " select value from f", ("tweets",))
def _(spark, sf):
    return cleaning.clean_lines(_source_lines(spark, sf))


@query("ag17_cleaning_report", _CLEAN + _LEFT + ", s as (select count(*) as n, sum(english::int)::bigint as n_english, sum(kept::int)::bigint as n_kept, "
       f"{R2('sum(length(text)+1)/count(*)::double')} as mean_before, {R2('sum(case when english then length(text)+1 end)/sum(english::int)::double')} as mean_before_english from k), "
       f"e as (select count(*) as n_final, {R2('sum(length(value)+1)/count(*)::double')} as mean_after from f) "
       f"select *, {py_round_sql('100.0::double*(mean_before-mean_after)/mean_before', 1)} as percent_change from s, e", ("tweets",))
def _(spark, sf):
    return cleaning.clean_lines_report(_source_lines(spark, sf))


@query("cj2_clean_tweets", f""", b as (select text, date from tweets where text is not null and lang = 'en'),
    u as (select text, date from (select *, count(*) over (partition by text) as n from b) where n = 1),
    tg as (select list(t order by n desc, t) as tags from (select t, count(*) as n from (select unnest(regexp_extract_all(text, '#({C.WORD}+)', 1)) as t from u) group by t order by n desc, t limit 25)),
    mn as (select list(t order by n desc, t) as names from (select t, count(*) as n from (select unnest(regexp_extract_all(text, '@({C.WORD}+)', 1)) as t from u) group by t order by n desc, t limit 10)),
    x as (select date, replace(replace(text, chr(10), ' '), '&amp;', ' ') as text, tags, names from u, tg, mn),
    y as (select date, names, list_reduce(list_concat([text], tags), lambda a, t: replace(a, '#'||t, {camel_sql('t')})) as text from x),
    z as (select date, list_reduce(list_concat([text], names), lambda a, t: replace(a, '@'||t, t)) as text from y),
    w as (select strptime(date, '%Y-%m-%d %H:%M:%S') as date, {strip_social_sql('text')} as "cleanedTweet" from z)
    select date, "cleanedTweet" from (select *, count(*) over (partition by "cleanedTweet") as n from w) where n = 1""", ("tweets",))
def _(spark, sf):
    """From a folder of CSV files, one below another, to a CSV table."""
    source, target = scratch_path(spark, "tweets"), scratch_path(spark, "cleaned")
    tweets(spark, sf).select("text", "date", "lang", F.col("lang").alias("folder")).write.partitionBy("folder").options(**sinks._CSV).csv(source)
    cleaned = cleaning.clean_tweets(readers.read_csv_tree(spark, source, "text string, date string, lang string"))
    sinks.write_csv(cleaned, target)
    return ranges.scan_csv(spark, target, cleaned.schema).drop("file")


_POS = ", ".join(f"{C.TRIGGER[i]} as {l}" for i, l in enumerate(C.LABELS))
_WEAK = (", top as (select text_id, text, max(score) as top from zs group by text_id, text), "
         f"lab as (select substr(md5(text),1,16) as id, text as comment_text, {_POS}, 'secondary_positive' as dataset from top where top >= 0.8::double union all "
         f"select substr(md5(text),1,16), text, {_LEXBIT}, 'secondary_neutral' from top where top < 0.8::double)")


def _score_maps(spark, sf):
    z = zs(spark, sf)
    return z.groupBy("text_id").agg(
        F.first("text").alias("text"), F.map_from_entries(F.collect_list(F.struct("label", "score"))).alias("scores")
    )


@query("pf17_route", _WEAK + " select id, comment_text, dataset, " + ", ".join(C.LABELS) + " from lab", ("zs",))
def _(spark, sf):
    return training.weak_label_job(_score_maps(spark, sf), 0.8)


@query("cj3_weak_label_report", _WEAK + " select dataset, count(*) as n, count(*)/(select count(*) from lab)::double*100 as percent from lab group by dataset", ("zs",))
def _(spark, sf):
    return training.weak_label_report(training.weak_label_job(_score_maps(spark, sf), 0.8))


@query("pf18_topic_positives", f"select substr(md5(text),1,16) as id, text as comment_text, topic, {_POS} from zs where score >= 0.9::double", ("zs",))
def _(spark, sf):
    return weaklabel.topic_positives(zs(spark, sf), "text")


@query("pf19_relabel", f"select substr(md5(text),1,16) as id, text as comment_text, {_LEXBIT} from documents")
def _(spark, sf):
    def scorer(df, text):  # a scorer that names the last label differently
        return mo.lexicon_scorer()(df, text).withColumnRenamed("identity_attack", "identity_hate")

    return weaklabel.relabel(table(spark, sf, "documents"), "text", scorer)


_TC = f"(select unnest([{in_list(C.TOPIC_CANDIDATES)}]) as topic, unnest([{in_list(C.TOPIC_CANDIDATES.values())}]) as label)"


@query("cj4_topic_labels", f"select substr(md5(text),1,16) as id, text as comment_text, topic, {_POS} from tweets, {_TC} where text is not null and {_overlap('text', 'label')} >= 0.1::double", ("tweets",))
def _(spark, sf):
    t = tweets(spark, sf).where("text is not null").select("text")
    return training.topic_label_job(t, "text", 0.1)


_SCORED = ("(select *, " + ", ".join(f"ln(score[{j}]/(1.0::double-score[{j}])) as x{j}" for j in range(1, 7)) + ", " + ", ".join(f"target[{j}] as u{j}" for j in range(1, 7))
           + f" from (select *, {_LETTER_SCORES} as score from {letter_sql('(select doc_id, id, text, target from preds)', 'text')}))")
_BASE = _MIX + f", sc as (select q.*, mix.copy from mix join {_SCORED} q using (id)) "


def _mixed_texts(spark, sf):
    p = preds(spark, sf).select("id", "dataset", "text", "target")
    one = lambda d: p.where(F.col("dataset") == d)
    return mixing.ratio_mix(one("jigsaw"), one("secondary_positive"), one("secondary_neutral"), 0.5, 0.3, 1.7, shuffle=False)


@query("cj11_baseline_report", _BASE + f"select round(avg({_BCE.replace('*t', '*u')}), 7) as loss, avg({_EXACT}) as acc, avg({_FLAG}) as acc_flag from sc", ("preds",))
def _(spark, sf):
    """The training mix, scored in batches by a model as it is, and its loss and accuracies."""
    r = training.baseline_report(training.score_rows(_mixed_texts(spark, sf), letter_score, "text"))
    return r.withColumn("loss", F.round("loss", 7))


_G = "greatest(" + ",".join(C.LABELS) + ")"
_PAT = "||".join(C.LABELS)
_PROFILE = [
    "select 'rows' as what, dataset as grp, null::varchar as item, count(*)::double as value from labelled group by dataset",
    f"select 'positive', dataset, null, sum(({_G}=1)::int)::double from labelled group by dataset",
    f"select 'positive_percent', dataset, null, sum(({_G}=1)::int)/count(*)::double*100 from labelled group by dataset",
    f"select 'all_zero', dataset, null, sum(({_G}=0)::int)::double from labelled group by dataset",
    f"select 'all_zero_percent', dataset, null, sum(({_G}=0)::int)/count(*)::double*100 from labelled group by dataset",
    "select 'mean_length', dataset, null, avg(length(comment_text)) from labelled group by dataset",
    "select 'characters', 'all', null, (sum(length(comment_text)) + greatest(count(comment_text) - 1, 0))::double from labelled",
    *[f"select 'label', dataset, '{l}', sum({l})::double from labelled group by dataset" for l in C.LABELS],
    *[f"select 'label_percent', dataset, '{l}', sum({l})/count(*)::double*100 from labelled group by dataset" for l in C.LABELS],
    f"select 'pattern', 'all', {_PAT}, count(*)::double from labelled group by {_PAT}",
    f"select 'unused_pattern', 'all', lpad(bin(i), 6, '0'), i::double from range(64) t(i) where lpad(bin(i), 6, '0') not in (select {_PAT} from labelled)",
    "select 'split', dataset, split, count(*)::double from labelled group by dataset, split",
    f"select 'split_percent', dataset, split, {R2('count(*)/(sum(count(*)) over (partition by dataset))::double')}*100 from labelled group by dataset, split",
    "select 'growth', topic, c.k, c.v from (select topic, sum((split <> 'test')::int) as p, count(*) as n from labelled where topic is not null group by topic), "
    "lateral (select unnest(['previous', 'new', 'change', 'per_element']) as k, unnest([p::double, n::double, (n-p)::double, case when p > 0 then " + R2("(n-p)/p::double") + " end]) as v) c",
    "select 'keyword', dataset, 'The', sum(regexp_matches(comment_text, 'The')::int)::double from labelled group by dataset",
    f"select 'word', dataset, word, n::double from (select dataset, word, count(*) as n, row_number() over (partition by dataset order by count(*) desc, word) as r from "
    f"(select dataset, unnest(string_split_regex(lower(translate(comment_text, '{_q(C.PUNCTUATION)}', '')), '\\s+')) as word from labelled) "
    f"where length(word) >= 3 and word not in ({in_list(C.STOP_WORDS)}) group by dataset, word) where r <= 20",
    "select 'longest', dataset, id, length::double from (select dataset, id, length(comment_text) as length, row_number() over (partition by dataset order by length(comment_text) desc, id) as r from labelled) where r <= 10",
]


@query("cj12_corpus_profile", "select what, grp, item, round(value, 9) as value from (" + " union all ".join(_PROFILE) + ")", ("labelled",))
def _(spark, sf):
    from modlens.plans.profiling import corpus_profile

    return corpus_profile(labelled(spark, sf), "The").withColumn("value", F.round("value", 9))
