"""Run reports, windows and training curves over whole tables.

A hash spreads the scored documents over twenty runs: the first is the baseline, the
others are named by an injection ratio.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from modlens import constants as C
from modlens.catalog.base import curve, h_sql, in_list, preds, query, series, table, zs
from modlens.catalog.evaluation import TRIGGERS, auc_sql, flag_scores_sql, topic_scores_sql
from modlens.functions.numbers import py_round_sql
from modlens.functions.text import hash01, ratio_value
from modlens.operators import metrics as M
from modlens.operators import report as R
from modlens.operators import series as S
from modlens.operators import weaklabel
from modlens.session import scratch_path

R4 = lambda x: py_round_sql(x, 4)
_RUN_NO = "floor(" + h_sql("id||'|run'") + "*20)::int"
_RUN = f"case when {_RUN_NO} = 0 then 'Primary' else '100:100:'||{_RUN_NO} end"


def runs(spark, sf):
    n = F.floor(hash01(F.concat("id", F.lit("|run"))) * 20)
    run = F.when(n == 0, "Primary").otherwise(F.concat(F.lit("100:100:"), n.cast("string")))
    return preds(spark, sf).withColumn("run", run)


def run_metrics(spark, sf):
    return M.flag_scores(runs(spark, sf), 0.5, ["run", "dataset"], TRIGGERS)


def topic_metrics(spark, sf):
    return M.topic_scores(runs(spark, sf), 0.3, groups=["run"])


_RP = f", rp as (select *, {_RUN} as run from preds)"
_M = _RP + ", m as (" + flag_scores_sql("rp", "run, dataset", "0.5::double") + ")"
_TM = topic_scores_sql("run", "0.3::double", "rp")
NAMES = ("precision", "recall", "f_beta", "specificity")
COLS = [f"{m}_{C.DATASET_ACRONYMS[d]}" for d in C.DATASETS for m in NAMES]
_CELLS = ", ".join(f"max(case when dataset='{d}' then {m} end) as {m}_{a}" for d, a in C.DATASET_ACRONYMS.items() for m in NAMES)
_KIND = "case when run='Primary' then 'baseline' else 'run' end as row_kind"


def wide_sql(src: str, cells: str, cols, skip: bool = False, summary: bool = True) -> str:
    base = f", w0 as (select run, {_KIND}, {cells} from {src} group by run)"
    if not summary:
        return base.replace("w0", "w")
    where = "where row_kind <> 'baseline'" if skip else ""
    avg = ", ".join(f"avg({c})" for c in cols)
    med = ", ".join(f"median({c})" for c in cols)
    return base + f", w as (select * from w0 union all select 'Average', 'Average', {avg} from w0 {where} union all select 'Median', 'Median', {med} from w0 {where})"


_WIDE = _M + wide_sql("m", _CELLS, COLS)
_R9 = lambda cols: ", ".join(f"round({c}, 9) as {c}" for c in cols)


def _r9(df, cols):
    return df.select("run", "row_kind", *[F.round(c, 9).alias(c) for c in cols])


@query("rt2_wide_report", _WIDE + f" select run, row_kind, {_R9(COLS)} from w", ("preds",))
def _(spark, sf):
    return _r9(R.wide_report(run_metrics(spark, sf)), COLS)


_NAMES1 = ("precision", "recall", "f_beta")
_COLS1 = [f"{m}_{C.DATASET_ACRONYMS[d]}" for d in C.DATASETS for m in _NAMES1]
_CELLS1 = ", ".join(f"max(case when dataset='{d}' then {m} end) as {m}_{a}" for d, a in C.DATASET_ACRONYMS.items() for m in _NAMES1)
_M1 = _M + ", m1 as (select run, dataset, precision, recall, case when precision+recall = 0 then 0.0::double else 2.0::double*precision*recall/(precision+recall) end as f_beta from m)"


@query("rt1_wide_report_f1", _M1 + wide_sql("m1", _CELLS1, _COLS1, skip=True) + f" select run, row_kind, {_R9(_COLS1)} from w", ("preds",))
def _(spark, sf):
    return _r9(R.wide_report(run_metrics(spark, sf), _NAMES1, beta=1.0, skip_baseline=True), _COLS1)


@query("ag22_average_median", _WIDE + f" select run, row_kind, {_R9(COLS)} from w where row_kind in ('Average','Median')", ("preds",))
def _(spark, sf):
    return _r9(R.wide_report(run_metrics(spark, sf)).where(F.col("row_kind").isin("Average", "Median")), COLS)


@query("rt2_formatted_report", _M + wide_sql("m", _CELLS, COLS, summary=False) + " select run, row_kind, " + ", ".join(f"format('{{:.4f}}', {c}) as {c}" for c in COLS) + " from w", ("preds",))
def _(spark, sf):
    return R.format_report(R.wide_report(run_metrics(spark, sf), summary=False))


_TOPICS = (*C.TOPICS, "mean")
_TCELLS = ", ".join(f"max(case when topic='{t}' then recall end) as {t}" for t in _TOPICS)
_TWIDE = _RP + _TM + wide_sql("tops", _TCELLS, _TOPICS)


@query("rt3_topic_report", _TWIDE + f" select run, row_kind, {_R9(_TOPICS)} from w", ("preds",))
def _(spark, sf):
    return _r9(R.topic_report(topic_metrics(spark, sf)), _TOPICS)


def melt_sql(cols, src="w", name="melted"):
    return f", {name} as (select run, row_kind, unnest([{in_list(cols)}]) as score, unnest([{', '.join(cols)}]) as value from {src})"


_MELT = _WIDE + melt_sql(COLS)


@query("rt4_melt", _MELT + " select run, row_kind, score, round(value, 9) as value from melted", ("preds",))
def _(spark, sf):
    return R.melt(R.wide_report(run_metrics(spark, sf))).withColumn("value", F.round("value", 9))


@query("pf14_only_runs", _WIDE + f" select run, row_kind, {_R9(COLS)} from w where row_kind = 'run'", ("preds",))
def _(spark, sf):
    return _r9(R.only_runs(R.wide_report(run_metrics(spark, sf))), COLS)


@query("rt5_ratio_value", f"select id, try_cast(split_part({_RUN}, ':', -1) as double) as ratio from preds", ("preds",))
def _(spark, sf):
    return runs(spark, sf).select("id", ratio_value(F.col("run")).alias("ratio"))


_TREND = (", pts as (select *, try_cast(split_part(run, ':', -1) as double) as ratio from melted where row_kind='run'), "
          "fit as (select score, regr_slope(value, ratio) as slope, regr_intercept(value, ratio) as intercept from pts group by score)")
_WORD = f"case when {R4('slope')} = 0 then 'neutral' when slope > 0 then 'positive' else 'negative' end"


@query("ag26_trend_lines", _MELT + _TREND + f" select score, round(slope, 9) + 0.0::double as slope, round(intercept, 9) as intercept, {_WORD} as trend from fit", ("preds",))
def _(spark, sf):
    points = R.melt(R.only_runs(R.wide_report(run_metrics(spark, sf)))).withColumn("ratio", ratio_value(F.col("run")))
    return R.trend(points).withColumn("slope", F.round("slope", 9) + 0.0).withColumn("intercept", F.round("intercept", 9))


_SVR = ["recall_J", "precision_J", "recall_SN", "recall_SP"]


@query("rt6_score_vs_ratio", _WIDE + melt_sql(_SVR) + _TREND + f", b as (select score, value as baseline from melted where row_kind='baseline') select run, score, ratio, value, baseline, round(slope, 9) + 0.0::double as slope, round(intercept, 9) as intercept, {_WORD} as trend from pts join fit using (score) left join b using (score)", ("preds",))
def _(spark, sf):
    s = R.score_vs_ratio(R.wide_report(run_metrics(spark, sf)), _SVR)
    return s.withColumn("slope", F.round("slope", 9) + 0.0).withColumn("intercept", F.round("intercept", 9))


@query("rt7_auc_table", f", a as ({auc_sql('long', 'dataset, label')}), b as (select dataset, label, auc from a union all select dataset, 'mean_auc', avg(auc) from a group by dataset) select label, "
       + ", ".join(R4(f"coalesce(max(case when dataset='{d}' then auc end), 0.0::double)") + f" as {d}" for d in ("jigsaw", "secondary_neutral")) + " from b group by label", ("long",))
def _(spark, sf):
    return R.auc_table(M.class_auc(preds(spark, sf)))


@query("rt8_dataset_scores", ", d as (" + flag_scores_sql("preds", "dataset", "0.5::double") + ") select dataset, unnest(['precision','recall','f_beta']) as score, unnest([precision, recall, f_beta]) as value from d", ("preds",))
def _(spark, sf):
    return R.dataset_scores(M.flag_scores(preds(spark, sf), 0.5, triggers=TRIGGERS))


_CMP = [c for c in COLS if c not in ("precision_SP", "specificity_SP")]


@query("rt9_model_comparison", _WIDE + melt_sql(_CMP) + " select run, score as metric, round(value, 9) as value from melted where row_kind in ('run','baseline')", ("preds",))
def _(spark, sf):
    return R.model_comparison(R.wide_report(run_metrics(spark, sf))).withColumn("value", F.round("value", 9))


@query("rt10_topic_recall_series", _TWIDE + melt_sql(_TOPICS) + " select score as topic, try_cast(split_part(run, ':', -1) as double) as ratio, round(value, 9) as recall from melted where row_kind='run'", ("preds",))
def _(spark, sf):
    return R.topic_recall_series(R.topic_report(topic_metrics(spark, sf))).withColumn("recall", F.round("recall", 9))


_GM = _MELT + ", g as (select score, avg(value) as mean from melted where row_kind='run' group by score)"


@query("ag23_group_means", _GM + " select score, round(mean, 9) as mean from g", ("preds",))
def _(spark, sf):
    return R.group_means(R.melt(R.wide_report(run_metrics(spark, sf)))).withColumn("mean", F.round("mean", 9))


@query("wn11_ordered_group_means", _GM + f" select score, round(mean, 9) as mean, list_position([{in_list(COLS)}], score) - 1 as position from g", ("preds",))
def _(spark, sf):
    g = R.ordered_group_means(R.melt(R.wide_report(run_metrics(spark, sf))), COLS)
    return g.withColumn("mean", F.round("mean", 9))


_FLAGS = "run, row_kind, score, round(value, 9) as value"


def _flags(df):
    return df.select("run", "row_kind", "score", F.round("value", 9).alias("value"), "is_max", "is_min")


@query("wn7_flag_extremes", _MELT + f" select {_FLAGS}, score <> 'precision_SP' and coalesce(value = max(value) over (partition by score), false) as is_max, "
       "score <> 'precision_SP' and coalesce(value = min(value) over (partition by score), false) as is_min from melted", ("preds",))
def _(spark, sf):
    return _flags(R.flag_extremes(R.melt(R.wide_report(run_metrics(spark, sf)))))


_NOBASE = (_MELT + ", x as (select *, max(value) over (partition by score) as mx, min(value) over (partition by score) as mn, "
           "max(case when row_kind='baseline' then value end) over (partition by score) as base, "
           "row_number() over (partition by score order by (row_kind='baseline')::int, value desc, run) as r1, "
           "row_number() over (partition by score order by (row_kind='baseline')::int, value, run) as r2 from melted) "
           f"select {_FLAGS}, score not in ('specificity_J', 'precision_SP') and row_kind<>'baseline' and (coalesce(value=mx,false) or coalesce(base=mx,false) and r1=1) as is_max, "
           "score not in ('specificity_J', 'precision_SP') and row_kind<>'baseline' and (coalesce(value=mn,false) or coalesce(base=mn,false) and r2=1) as is_min from x")


@query("wn8_flag_without_baseline", _NOBASE, ("preds",))
def _(spark, sf):
    return _flags(R.flag_extremes_without_baseline(R.melt(R.wide_report(run_metrics(spark, sf)))))


# both tables of the report, the positive set by its mean over the topics
_FILES = (_M + _TM + ", mf as (select run, dataset, precision, recall, f_beta, specificity from m where dataset <> 'secondary_positive' union all "
          "select run, 'secondary_positive', precision, recall, f_beta, specificity from tops where topic = 'mean')")


def flagged_sql(src: str, name: str) -> str:
    """CTEs x_<name> and <name>: the melted cells with their flags, baseline left out."""
    return (f", x_{name} as (select *, max(value) over (partition by score) as mx, min(value) over (partition by score) as mn, "
            "max(case when row_kind='baseline' then value end) over (partition by score) as base, "
            "row_number() over (partition by score order by (row_kind='baseline')::int, value desc nulls last, run) as r1, "
            f"row_number() over (partition by score order by (row_kind='baseline')::int, value nulls last, run) as r2 from {src}), "
            f"{name} as (select {_FLAGS}, {_hit('mx', 'r1')} as is_max, {_hit('mn', 'r2')} as is_min from x_{name})")


def _hit(extreme: str, rank: str) -> str:
    return (f"score not in ('specificity_J', 'precision_SP') and row_kind<>'baseline' and value is not null and "
            f"(coalesce(value={extreme},false) or coalesce(base={extreme},false) and {rank}=1)")


@query("cj8_experiment_report", _FILES + wide_sql("mf", _CELLS, COLS).replace("w0", "w1").replace(" w as", " wa as") + melt_sql(COLS, "wa", "ma") + flagged_sql("ma", "fa")
       + wide_sql("tops", _TCELLS, _TOPICS) + melt_sql(_TOPICS, "w", "mb") + flagged_sql("mb", "fb")
       + " select 'datasets' as \"table\", * from fa union all select 'topics', * from fb", ("preds",))
def _(spark, sf):
    """From the result files of all runs to both tables with their flags."""
    from modlens.catalog.files import result_documents
    from modlens.plans.evaluation import experiment_report

    path = scratch_path(spark, "results")
    # a colon is no part of a folder's name
    docs = result_documents(spark, sf).withColumn("run", F.replace("run", F.lit(":"), F.lit("-")))
    docs.write.partitionBy("run").text(path)
    report = experiment_report(spark, path)
    plain = F.when(F.col("row_kind") == "run", F.replace("run", F.lit("-"), F.lit(":"))).otherwise(F.col("run"))
    return report.select("table", plain.alias("run"), "row_kind", "score", F.round("value", 9).alias("value"), "is_max", "is_min")


@query("wn9_flag_in_threes", _M + wide_sql("m", _CELLS, COLS, summary=False) + melt_sql(COLS) + ", p as (select *, case when row_kind='baseline' then 0 else try_cast(split_part(run, ':', -1) as int) end as position from melted) "
       f"select run, row_kind, score, round(value, 9) as value, score <> 'precision_SP' and coalesce(position >= 1 and (value = max(value) over (partition by score) or value = max(value) over (partition by score, floor((position-1)/3.0))), false) as is_max, "
       "score <> 'precision_SP' and coalesce(position >= 1 and (value = min(value) over (partition by score) or value = min(value) over (partition by score, floor((position-1)/3.0))), false) as is_min from p", ("preds",))
def _(spark, sf):
    m = R.melt(R.wide_report(run_metrics(spark, sf), summary=False))
    m = m.withColumn("position", F.when(F.col("row_kind") == "baseline", 0).otherwise(ratio_value(F.col("run")).cast("int")))
    return _flags(R.flag_extremes_in_groups(m))


# --- best label, best topic ---------------------------------------------------------------

_BEST = ", b as (select text_id, first(topic order by score desc, topic) as topic, first(label order by score desc, label) as label, max(score) as score from zs group by text_id)"


@query("wn3_best_topic", _BEST + " select text_id, topic, score as prob from b", ("zs",))
def _(spark, sf):
    return weaklabel.best_topic(zs(spark, sf))


@query("wn4_top_texts_per_topic", _BEST + ", r as (select *, row_number() over (partition by topic order by score desc, text_id) as rank, count(*) over (partition by topic) as topic_size from b) select text_id, topic, score as prob, rank::int as rank, topic_size from r where rank <= 20", ("zs",))
def _(spark, sf):
    return weaklabel.top_texts(weaklabel.best_topic(zs(spark, sf)))


@query("wn5_best_label", _BEST + " select text_id, label, score, 0.9::double - score as margin from b", ("zs",))
def _(spark, sf):
    return weaklabel.best_label(zs(spark, sf))


@query("wn6_around_threshold", _BEST + ", m as (select text_id, label, score, 0.9::double - score as margin, case when 0.9::double - score < 0 then 'above' else 'below' end as side from b), "
       "r as (select *, row_number() over (partition by side order by abs(margin), text_id) as rank from m) select text_id, label, score, margin, side, rank::int as rank from r where rank <= 20", ("zs",))
def _(spark, sf):
    return weaklabel.around_threshold(weaklabel.best_label(zs(spark, sf)))


# --- training curves ------------------------------------------------------------------------

_POS = ", p as (select *, row_number() over (partition by run order by step) - 1 as pos, count(*) over (partition by run) as n, first_value(value) over (partition by run order by step) as f, " \
       "last_value(value) over (partition by run order by step rows between unbounded preceding and unbounded following) as l, sum(value) over (partition by run order by step rows between 12 preceding and 12 following) as s from series)"


@query("wn1_moving_average", _POS + " select run, step, pos, value, round((s + greatest(12-pos,0)*f + greatest(pos+12-(n-1),0)*l)/25.0::double, 6) as moving_average from p", ("series",))
def _(spark, sf):
    m = S.moving_average(series(spark, sf))
    return m.withColumn("moving_average", F.round("moving_average", 6))


@query("ag28_tail_mean", _POS + f", t as (select run, avg(value) as a from p where pos >= n - n // 4 group by run) select run, {R4('a')} as tail_mean from t", ("series",))
def _(spark, sf):
    return S.tail_mean(series(spark, sf))


@query("wn12_epoch_marks", ", c as (select run, epoch, count(*) as batches from curve group by run, epoch) select run, epoch, batches, (sum(batches) over (partition by run order by epoch))::bigint as epoch_end from c", ("curve",))
def _(spark, sf):
    return S.epoch_marks(curve(spark, sf), "run", "epoch", F.count("*"))


_EP = f", e as (select run, epoch, {R4('l')} as loss, {R4('a')} as acc from (select run, epoch, avg(loss) as l, avg(acc) as a from curve group by run, epoch))"


@query("ag29_epoch_table", _EP + " select run, epoch, loss, acc from e", ("curve",))
def _(spark, sf):
    return S.epoch_table(curve(spark, sf))


_BESTEP = _EP + " select run, arg_min(epoch, (loss, epoch)) as best_epoch, min(loss) as best_loss, arg_min(epoch, (-acc, epoch)) as best_acc_epoch, max(acc) as best_acc from e group by run"


@query("ag27_best_epochs", _BESTEP, ("curve",))
def _(spark, sf):
    return S.best_epochs(S.epoch_table(curve(spark, sf)))


@query("cj9_choose_checkpoint", _EP + ", b as (select run, arg_min(epoch, (loss, epoch)) as l, arg_min(epoch, (-acc, epoch)) as a from e group by run) "
       "select run, epoch, loss, acc, epoch = l as best_loss, epoch = a as best_acc from e join b using (run)", ("curve",))
def _(spark, sf):
    """From the validation lists of a folder of runs to the marked epoch table, written and read back."""
    from modlens.catalog.files import epoch_lists
    from modlens.plans.evaluation import choose_checkpoint

    return choose_checkpoint(spark, epoch_lists(spark, sf), scratch_path(spark, "model_validation"))
