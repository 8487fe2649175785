"""Evaluation metrics over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from modlens import constants as C
from modlens.catalog.base import h_sql, in_list, labelled, long, preds, query, table
from modlens.functions import labels as L
from modlens.functions.models import batch_scorer, letter_model
from modlens.functions.numbers import f_beta, py_round_sql
from modlens.functions.text import hash01
from modlens.operators import metrics as M
from modlens.session import cut_lineage, scratch_path
from modlens.sources.ranges import scan_csv
from modlens.sources.readers import read_results
from modlens.sources.sinks import write_csv

TRIGGERS = tuple(C.TOPIC_TRIGGERS.values())
TRIGS = in_list(TRIGGERS)
R4 = lambda x: py_round_sql(x, 4)


def pattern_sql(t: str) -> str:
    return f"array_to_string(list_transform(score, lambda s: (s >= {t})::int), '')"


TARGET = "array_to_string(target, '')"


def counts_sql(actual: str, predicted: str) -> str:
    out = []
    for name, a, p in (("tp", "", ""), ("fp", "not ", ""), ("tn", "not ", "not "), ("fn", "", "not ")):
        out.append(f"sum(({a}({actual}) and {p}({predicted}))::int)::bigint as {name}")
    return ", ".join(out)


def ratio_sql(a: str, b: str) -> str:
    return f"(case when ({b}) = 0 then 0.0::double else ({a})::double/({b}) end)"


def rates_sql(beta: float = 2.0, digits: int | None = 4) -> str:
    p, r = ratio_sql("tp", "tp+fp"), ratio_sql("tp", "tp+fn")
    b2 = beta * beta
    f = f"(case when {p}=0 and {r}=0 then 0.0::double else ({1 + b2}::double*{p}*{r})/(({b2}::double*{p})+{r}) end)"
    cols = {"precision": p, "recall": r, "f_beta": f, "specificity": ratio_sql("tn", "tn+fp"), "fpr": ratio_sql("fp", "fp+tn"), "tpr": r}
    return ", ".join(f"{py_round_sql(v, digits) if digits is not None else v} as {k}" for k, v in cols.items())


FLAG_T = "list_max(target) > 0"


def flag_p(t: str) -> str:
    return f"list_max(score) >= {t}"


RATES = "precision, recall, f_beta, specificity, fpr, tpr"


def flag_scores_sql(src: str, groups: str, t: str, trigs: str = TRIGS) -> str:
    """flag rates with the trigger specificity."""
    return (f"select {groups}, tp, fp, tn, fn, precision, recall, f_beta, fpr, tpr, {R4(ratio_sql('stn', 'stn+sfp'))} as specificity from "
            f"(select {groups}, stn, sfp, tp, fp, tn, fn, {rates_sql()} from (select {groups}, {counts_sql(FLAG_T, flag_p(t))}, "
            f"sum(({TARGET} not in ({trigs}) and {pattern_sql(t)} not in ({trigs}))::int) as stn, "
            f"sum(({TARGET} not in ({trigs}) and {pattern_sql(t)} in ({trigs}))::int) as sfp from {src} group by {groups}))")


@query("jn1_align", "select a.id, target, score from preds a join (select doc_id::varchar as id from documents) b using (id)", ("preds",))
def _(spark, sf):
    p = preds(spark, sf)
    return M.align(p.select("id", "target"), p.select("id", "score"))


@query("jn1_alignment_report", "select count(*) as n_keys, sum((l.doc_id is null)::int)::bigint as only_target, 0::bigint as only_prediction, 0::bigint as repeated from documents d left join labels l using (doc_id)")
def _(spark, sf):
    return M.alignment_report(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("jn4_topic_triggers", "select id, topic, case topic when 'topic_4' then '001101' when 'topic_6' then '010110' when 'topic_7' then '010000' when 'topic_10' then '110111' end as distinct_trigger, case when topic is not null then '010110' end as same_trigger from preds", ("preds",))
def _(spark, sf):
    p = preds(spark, sf)
    return p.select("id", "topic", L.trigger_of(F.col("topic"), C.TOPIC_TRIGGERS).alias("distinct_trigger"),
                    L.trigger_of(F.col("topic"), C.TOPIC_TRIGGERS_SAME).alias("same_trigger"))


@query("em1_binarise", f"select id, {pattern_sql('0.5::double')} as pattern from preds", ("preds",))
def _(spark, sf):
    return preds(spark, sf).select("id", L.bits(L.binarise(F.col("score"), 0.5)).alias("pattern"))


@query("em2_flag_counts", f"select dataset, {counts_sql(FLAG_T, flag_p('0.5::double'))} from preds group by dataset", ("preds",))
def _(spark, sf):
    return M.flag_counts(preds(spark, sf), 0.5)


@query("em3_rates", f"select *, {rates_sql()} from (select source, {counts_sql(FLAG_T, flag_p('0.5::double'))} from preds group by source)", ("preds",))
def _(spark, sf):
    return M.with_rates(M.flag_counts(preds(spark, sf), 0.5, ["source"]))


@query("em3_rates_exact", f"select *, {rates_sql(digits=None)} from (select source, {counts_sql(FLAG_T, flag_p('0.5::double'))} from preds group by source)", ("preds",))
def _(spark, sf):
    return M.with_rates(M.flag_counts(preds(spark, sf), 0.5, ["source"]), digits=None)


@query("em4_trigger_counts", f"select *, {rates_sql()} from (select dataset, {counts_sql(f'{TARGET} in ({TRIGS})', pattern_sql('0.3::double') + f' in ({TRIGS})')} from preds group by dataset)", ("preds",))
def _(spark, sf):
    return M.with_rates(M.trigger_counts(preds(spark, sf), 0.3, triggers=TRIGGERS))


@query("em5_flag_scores", flag_scores_sql("preds", "dataset", "0.3::double"), ("preds",))
def _(spark, sf):
    return M.flag_scores(preds(spark, sf), 0.3, triggers=TRIGGERS)


_TC = "case topic when 'topic_4' then '001101' when 'topic_6' then '010110' when 'topic_7' then '010000' when 'topic_10' then '110111' end"


def topic_scores_sql(groups: str, t: str, src: str = "preds") -> str:
    """Every trigger topic in every group, zeros where it has no rows; the mean divides by all of them."""
    g = f"{groups}, " if groups else ""
    gb = f"group by {groups}" if groups else ""
    topics = ", ".join(f"('{k}')" for k in C.TOPIC_TRIGGERS)
    cells = ", ".join(f"coalesce({c}, 0)::bigint as {c}" for c in ("tp", "fp", "tn", "fn"))
    return (f", seen as (select {g}topic, {counts_sql(f'{TARGET} = {_TC}', pattern_sql(t) + f' = {_TC}')} from {src} where topic in ({in_list(C.TOPIC_TRIGGERS)}) group by {g}topic), "
            f"grid as (select * from (select {f'distinct {groups}' if groups else '1 as one'} from {src if groups else '(select 1)'}), (values {topics}) as tt(topic)), "
            f"per as (select *, {rates_sql()} from (select {g}topic, {cells} from grid left join seen using ({g}topic))), "
            f"tops as (select {g}topic, tp, fp, tn, fn, {RATES} from per union all select {g}'mean', null, null, null, null, avg(precision), avg(recall), avg(f_beta), avg(specificity), null, null from per {gb}) ")


@query("em6_topic_scores", topic_scores_sql("", "0.3::double") + f"select topic, tp, fp, tn, fn, " + ", ".join(f"round({c}, 9) as {c}" for c in M.RATES) + " from tops", ("preds",))
def _(spark, sf):
    t = M.topic_scores(preds(spark, sf), 0.3)
    return t.select("topic", *M.COUNTS, *[F.round(c, 9).alias(c) for c in M.RATES])


@query("ag24_topic_macro_mean", topic_scores_sql("source", "0.3::double") + "select source, " + ", ".join(f"round({c}, 9) as {c}" for c in M.RATES[:4]) + " from tops where topic = 'mean'", ("preds",))
def _(spark, sf):
    t = M.topic_scores(preds(spark, sf), 0.3, groups=["source"])
    return t.where("topic = 'mean'").select("source", *[F.round(c, 9).alias(c) for c in M.RATES[:4]])


def auc_sql(src: str, groups: str) -> str:
    """Tie-averaged rank form."""
    return (f"select {groups}, case when p > 0 and n > 0 then (rs - p*(p+1)/2.0::double)/(p*n)::double end as auc from "
            f"(select {groups}, sum(target)::bigint as p, sum(1-target)::bigint as n, sum(case when target=1 then rk else 0 end) as rs from "
            f"(select *, rank() over (partition by {groups} order by score) + (count(*) over (partition by {groups}, score) - 1)/2.0::double as rk from {src}) group by {groups})")


@query("em7_class_auc", "select dataset, label, round(auc, 9) as auc from (" + auc_sql("long", "dataset, label") + ")", ("long",))
def _(spark, sf):
    return M.class_auc(preds(spark, sf)).withColumn("auc", F.round("auc", 9))


@query("wn10_auc_with_ties", "select dataset, label, round(auc, 9) as auc from (" + auc_sql("(select dataset, label, target, round(score, 1) as score from long)", "dataset, label") + ")", ("long",))
def _(spark, sf):
    l = long(spark, sf).withColumn("score", F.round("score", 1))
    return M.auc_from_long(l).withColumn("auc", F.round("auc", 9))


@query("em7_real_target_auc", "select 'toxic' as label, round(auc, 9) as auc from (" + auc_sql("(select 1 as g, toxic as target, length(text)::double as score from labels join documents using (doc_id))", "g") + ")")
def _(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    l = d.select(F.lit("toxic").alias("label"), F.col("toxic").alias("target"), F.length("text").cast("double").alias("score"))
    return M.auc_from_long(l, ["label"]).withColumn("auc", F.round("auc", 9))


@query("ag25_nan_skipping_mean", ", a as (" + auc_sql("long", "dataset, label") + ") select dataset, round(avg(auc), 9) as auc from a group by dataset", ("long",))
def _(spark, sf):
    per = M.class_auc(preds(spark, sf)).withColumn("auc", F.coalesce("auc", F.lit(float("nan"))))
    return M.mean_auc(per).withColumn("auc", F.round("auc", 9))


_EXACT = f"({TARGET} = {pattern_sql('0.5::double')})::int"
_FLAG = f"(({FLAG_T}) = ({flag_p('0.5::double')}))::int"


@query("em8_exact_accuracy", f"select dataset, avg({_EXACT}) as acc from preds group by dataset", ("preds",))
def _(spark, sf):
    return M.accuracy(preds(spark, sf)).select("dataset", "acc")


@query("em9_row_accuracy_parity", f"select dataset, avg({_EXACT})/6 as acc from preds group by dataset", ("preds",))
def _(spark, sf):
    return M.accuracy(preds(spark, sf), parity=True).select("dataset", "acc")


@query("em10_flag_accuracy", f"select dataset, avg({_FLAG}) as acc_flag from preds group by dataset", ("preds",))
def _(spark, sf):
    return M.accuracy(preds(spark, sf)).select("dataset", "acc_flag")


_BCE = "(" + "+".join(f"(greatest(x{i},0.0::double) - x{i}*t{i} + ln(1.0::double+exp(-abs(x{i}))))" for i in range(1, 7)) + ")/6"
_LOGITS = "(select *, " + ", ".join(f"(s{i}-0.5::double)*4.0::double as x{i}" for i in range(1, 7)) + " from preds)"


def with_logits(df):
    return df.withColumn("logit", F.transform("score", lambda s: (s - 0.5) * 4.0))


@query("em11_bce_loss", f"select dataset, round(avg({_BCE}), 8) as loss from {_LOGITS} group by dataset", ("preds",))
def _(spark, sf):
    return M.bce_loss(with_logits(preds(spark, sf))).withColumn("loss", F.round("loss", 8))


@query("ag30_batch_means", f"select dataset, round(avg(loss), 8) as loss, round(avg(acc), 8) as acc from (select dataset, doc_id // 8 as b, avg({_BCE}) as loss, avg({_EXACT}) as acc from {_LOGITS} group by 1, 2) group by dataset", ("preds",))
def _(spark, sf):
    p = with_logits(preds(spark, sf))
    out = M.batch_means(p, F.floor(F.col("doc_id") / 8), {
        "loss": M.bce_terms(F.col("logit"), F.col("target")), "acc": M.accuracy_columns()["exact"]})
    return out.select("dataset", F.round("loss", 8).alias("loss"), F.round("acc", 8).alias("acc"))


def sweep_sql(src: str, groups: str, trigs: str = TRIGS) -> str:
    """Direct form: every row at every threshold."""
    return (f"(select * from (" + flag_scores_sql(
        f"(select a.*, k/200.0::double as threshold from {src} a, (select unnest(range(1,200)) as k))", f"{groups}, threshold", "threshold", trigs) + "))")


_SWEEP_COLS = "dataset, threshold, tp, fp, tn, fn, " + RATES


@query("em12_threshold_sweep", f"select {_SWEEP_COLS} from {sweep_sql('preds', 'dataset')}", ("preds",))
def _(spark, sf):
    return M.threshold_sweep(preds(spark, sf), triggers=TRIGGERS)


@query("jn6_sweep_counts", f"select dataset, threshold, tp, fp, tn, fn from {sweep_sql('preds', 'dataset')}", ("preds",))
def _(spark, sf):
    return M.threshold_sweep(preds(spark, sf)).select("dataset", "threshold", *M.COUNTS)


_CHOOSE = "min(case when precision > {l}::double then threshold end) as threshold, max(precision) as max_precision"


@query("em13_choose_threshold", f"select dataset, {_CHOOSE.format(l=0.9)} from {sweep_sql('preds', 'dataset')} group by dataset", ("preds",))
def _(spark, sf):
    return M.choose_threshold(M.threshold_sweep(preds(spark, sf), triggers=TRIGGERS))


@query("em14_thresholds_by_run", f"select source, {_CHOOSE.format(l=0.9)} from {sweep_sql('preds', 'source')} group by source", ("preds",))
def _(spark, sf):
    return M.choose_threshold(M.threshold_sweep(preds(spark, sf), ["source"], TRIGGERS), ["source"])


@query("em16_curve_points", f"select dataset, threshold, fpr, tpr, recall, precision from {sweep_sql('preds', 'dataset')}", ("preds",))
def _(spark, sf):
    return M.curve_points(M.threshold_sweep(preds(spark, sf), triggers=TRIGGERS))


def class_sweep_sql(groups: str = "dataset", src: str = "long") -> str:
    return (f", auc as ({auc_sql(src, groups + ', label')}), sw as (select {groups}, label, threshold, {ratio_sql('2*tp', '2*tp+fp+fn')} as f1, {ratio_sql('tp', 'tp+fn')} as recall, "
            f"{ratio_sql('tp', 'tp+fp')} as precision, {ratio_sql('tp+tn', 'tp+fp+tn+fn')} as accuracy from (select {groups}, label, threshold, {counts_sql('target=1', 'score >= threshold')} "
            f"from {src} a, (select k*0.05::double as threshold from (select unnest(range(1,20)) as k)) g group by {groups}, label, threshold)) ")


_CS = "round(auc, 9) as auc, f1, recall, precision, accuracy"


@query("em15_class_sweep", class_sweep_sql() + f"select dataset, label, threshold, {_CS} from sw join auc using (dataset, label)", ("long",))
def _(spark, sf):
    return M.class_sweep(preds(spark, sf)).withColumn("auc", F.round("auc", 9))


_CSM = ", ".join(f"round(avg({c}), 9) as mean_{c}" for c in ("auc", "f1", "recall", "precision", "accuracy"))


@query("em15_class_sweep_means", class_sweep_sql() + f"select dataset, threshold, {_CSM} from sw join auc using (dataset, label) group by dataset, threshold", ("long",))
def _(spark, sf):
    m = M.class_sweep_means(M.class_sweep(preds(spark, sf)))
    return m.select("dataset", "threshold", *[F.round(c, 9).alias(c) for c in m.columns[2:]])


@query("em21_class_sweep_with_total", ", lt as (select dataset, label, target, score from long union all select 'ALL', label, target, score from long)"
       + class_sweep_sql(src="lt") + f"select dataset, label, threshold, {_CS} from sw join auc using (dataset, label)", ("long",))
def _(spark, sf):
    return M.class_sweep(preds(spark, sf), total="dataset").withColumn("auc", F.round("auc", 9))


_P, _R = R4(ratio_sql("tp", "tp+fp")), R4(ratio_sql("tp", "tp+fn"))


@query("em17_f_beta_again", f"select source, round(case when 0.25::double*p+r = 0 then 0.0::double else 1.25::double*p*r/(0.25::double*p+r) end, 9) as f_half from (select source, {_P} as p, {_R} as r from (select source, {counts_sql(FLAG_T, flag_p('0.5::double'))} from preds group by source))", ("preds",))
def _(spark, sf):
    m = M.with_rates(M.flag_counts(preds(spark, sf), 0.5, ["source"]))
    return m.select("source", F.round(f_beta(F.col("precision"), F.col("recall"), 0.5), 9).alias("f_half"))


@query("em18_confusion_table", f", c as (select dataset, {counts_sql(FLAG_T, flag_p('0.5::double'))} from preds group by dataset) select dataset, 'Predicted Positive' as row, tp as actual_positive, fp as actual_negative from c union all select dataset, 'Predicted Negative', fn, tn from c", ("preds",))
def _(spark, sf):
    return M.confusion_table(M.flag_counts(preds(spark, sf), 0.5))


@query("em19_validation_metrics", f", f as (select dataset, precision, recall, f_beta as f1 from (select dataset, {rates_sql(1.0, None)} from (select dataset, {counts_sql(FLAG_T, flag_p('0.5::double'))} from preds group by dataset))), a as ({auc_sql('long', 'dataset, label')}), "
       "m as (select dataset, avg(auc) as auc from a group by dataset) select dataset, precision, recall, round(f1, 9) as f1, round(auc, 9) as auc from f join m using (dataset)", ("preds", "long"))
def _(spark, sf):
    m = M.validation_metrics(preds(spark, sf))
    return m.select("dataset", "precision", "recall", F.round("f1", 9).alias("f1"), F.round("auc", 9).alias("auc"))


_DOC = (topic_scores_sql("", "0.3::double") + ", fl as (" + flag_scores_sql("(select * from preds where dataset<>'secondary_positive')", "dataset", "0.3::double") + f"), au as ({auc_sql('long', 'dataset, label')}), "
        "am as (select dataset, avg(auc) as auc, " + ", ".join(f"max(case when label='{l}' then auc end) as auc_{l}" for l in C.LABELS) + " from au group by dataset) ")
_AUCS = [f"auc_{l}" for l in C.LABELS]
_DOC_COLS = ", ".join(f"round({c}, 9) as {c}" for c in (*M.RATES, "auc", *_AUCS))
_NO_AUC = ", ".join(["null"] * (1 + len(_AUCS)))


def _flat_doc(doc):
    return doc.select(
        "dataset", "topic", *[F.round(f"metrics.{c}", 9).alias(c) for c in M.RATES],
        *[F.col(f"metrics.confusion_matrix.{c}").alias(c) for c in M.COUNTS],
        F.round("auc", 9).alias("auc"), *[F.round(F.element_at("class_auc", l), 9).alias(f"auc_{l}") for l in C.LABELS],
    )


_DOC_SQL = _DOC + (f"select dataset, topic, tp, fp, tn, fn, {_DOC_COLS} from (select dataset, null as topic, tp, fp, tn, fn, {RATES}, auc, {', '.join(_AUCS)} from fl join am using (dataset) "
                   f"union all select 'secondary_positive', topic, tp, fp, tn, fn, {RATES}, {_NO_AUC} from tops)")


@query("em20_evaluation_document", _DOC_SQL, ("preds", "long"))
def _(spark, sf):
    return _flat_doc(M.evaluation_document(preds(spark, sf), 0.3))


def document_sql(src: str, threshold: str, name: str) -> str:
    """CTEs that end in ``name``: the result document of the scored rows ``src`` as read from its file."""
    long_ = f"(select dataset, unnest([{in_list(C.LABELS)}]) as label, unnest(target) as target, unnest(score) as score from {src} where dataset <> 'secondary_positive')"
    aucs = ", ".join(f"max(case when label='{l}' then auc end) as auc_{l}" for l in C.LABELS)
    return (topic_scores_sql("", threshold, f"(select * from {src} where dataset = 'secondary_positive')")
            + f", fl as ({flag_scores_sql(f'(select * from {src} where dataset <> {chr(39)}secondary_positive{chr(39)})', 'dataset', threshold)}), au as ({auc_sql(long_, 'dataset, label')}), "
            f"am as (select dataset, avg(auc) as auc, {aucs} from au group by dataset), "
            f"{name} as (select dataset, topic, tp, fp, tn, fn, {_DOC_COLS} from (select dataset, null as topic, tp, fp, tn, fn, {RATES}, auc, {', '.join(_AUCS)} from fl join am using (dataset) "
            f"union all select 'secondary_positive', topic, tp, fp, tn, fn, {RATES}, {_NO_AUC} from tops))")


def _read_back(results, *more):
    return results.select(
        *more, "dataset", "topic", *[F.round(c, 9).alias(c) for c in M.RATES], *M.COUNTS, F.round("auc", 9).alias("auc"),
        *[F.round(F.element_at("class_auc", l), 9).alias(f"auc_{l}") for l in C.LABELS])


LETTER_LOGITS = [
    "(" + " + ".join(f"l{i}*({math.cos((i + 1) * (j + 1))!r}::double)" for i in range(26)) + ")*4.0::double/greatest(ln, 1) - 1.0::double" for j in range(len(C.LABELS))]


def letter_sql(src: str, text: str) -> str:
    """``src`` with the logits x1 to x6 of the letter model."""
    counts = ", ".join(f"(length(low) - length(replace(low, '{chr(97 + i)}', ''))) as l{i}" for i in range(26))
    total = " + ".join(f"l{i}" for i in range(26))
    return (f"(select *, {', '.join(f'{x} as x{j + 1}' for j, x in enumerate(LETTER_LOGITS))} from (select *, {total} as ln from "
            f"(select *, {counts} from (select *, lower({text}) as low from {src}))))")


_LETTER_SCORES = "[" + ", ".join(f"round(1.0::double/(1.0::double+exp(-x{j})), 6)" for j in range(1, 7)) + "]"
_SPLIT_TARGET = "[" + ", ".join(C.LABELS) + "]"


def letter_score(text):
    """The letter model in batches, rounded so that both engines see the same ties."""
    return F.transform(batch_scorer(letter_model)(text), lambda s: F.round(s, 6))


def split_files(spark, sf):
    """The labelled table as CSV files, one per split and dataset, and the tables read from them."""
    path = scratch_path(spark, "splits")
    t = cut_lineage(labelled(spark, sf), "labelled")
    schema = "id string, comment_text string, topic string, " + ", ".join(f"{l} int" for l in C.LABELS)
    tables = {}
    for s in ("val", "test"):
        for d in C.DATASETS:
            write_csv(t.where((F.col("split") == s) & (F.col("dataset") == d)).select("id", "comment_text", "topic", *C.LABELS), f"{path}/{s}/{d}.csv")
            tables.setdefault(s, {})[d] = scan_csv(spark, f"{path}/{s}/{d}.csv", schema)
    return tables, f"{path}/run-1/checkpoints/epoch=3-step=10.ckpt"


@query("cj6_evaluate_job", ", sc as (select dataset, topic, " + _SPLIT_TARGET + " as target, " + _LETTER_SCORES + " as score from "
       + letter_sql("labelled", "comment_text") + " where split = 'test')" + document_sql("sc", "0.25::double", "doc")
       + " select 3 as epoch, * from doc", ("labelled",))
def _(spark, sf):
    """Test files, scored in batches, evaluated, written beside the checkpoint and read back."""
    from modlens.plans.evaluation import evaluate_job, scored_sets

    tables, checkpoint = split_files(spark, sf)
    path = evaluate_job(scored_sets(tables, "TEST", letter_score), 0.25, checkpoint)
    return _read_back(read_results(spark, path), "epoch")


_SPLIT = h_sql("id||'|split'")
_SPLIT_CASE = f"case when {_SPLIT} < 0.7::double then 'train' when {_SPLIT} < 0.85::double then 'val' else 'test' end"
_VAL = f"(select * from preds where dataset = 'jigsaw' and {_SPLIT_CASE} = 'val')"


@query("cj7_search_then_evaluate", f", sw as (select * from {sweep_sql(_VAL, 'dataset')}), mx as (select max(precision) as best from sw), "
       "th as (select min(threshold) as threshold from sw, mx where case when best > 0.6::double then precision > 0.6::double else precision = best end), "
       f"tst as (select p.*, th.threshold as cut from preds p, th where {_SPLIT_CASE} = 'test')" + document_sql("tst", "cut", "doc")
       + f" select 'test' as part, (select threshold from th) as threshold, * from doc union all select 'sweep', round(threshold, 3), dataset, null, tp, fp, tn, fn, {RATES}, {_NO_AUC} from sw", ("preds",))
def _(spark, sf):
    """The sweep of the validation files and the document of the test files at the threshold found."""
    from modlens.plans.evaluation import search_then_evaluate

    u = hash01(F.concat("id", F.lit("|split")))
    p = preds(spark, sf).withColumn("split", F.when(u < 0.7, "train").when(u < 0.85, "val").otherwise("test"))
    checkpoint = scratch_path(spark, "search") + "/run-1/checkpoints/epoch=2-step=7.ckpt"
    chosen, sweep, result = search_then_evaluate(p.where("split = 'val'"), p.where("split = 'test'"), checkpoint, limit=0.6)
    tested = _read_back(read_results(spark, result), F.lit("test").alias("part"), F.lit(chosen).alias("threshold"))
    swept = read_results(spark, sweep).select(
        F.lit("sweep").alias("part"), F.round("threshold", 3).alias("threshold"), "dataset", F.lit(None).cast("string").alias("topic"),
        *[F.round(c, 9).alias(c) for c in M.RATES], *M.COUNTS, *[F.lit(None).cast("double").alias(c) for c in ("auc", *_AUCS)])
    return tested.unionByName(swept)


@query("em22_row_export", "select id, target, list_transform(score, lambda s: round(s, 9)) as prediction from preds", ("preds",))
def _(spark, sf):
    return preds(spark, sf).select("id", "target", F.transform("score", lambda s: F.round(s, 9)).alias("prediction"))
