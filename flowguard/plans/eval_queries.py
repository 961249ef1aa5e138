"""Registered queries: evaluation (E1–E16) over ``preds`` and ``labelled_docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import r6
from ..operators import evaluation as ev
from ..sources import fixtures
from ..sources.fixtures import with_views
from .registry import query

BY = ["model", "split"]

_TAX = "tax as (select class1, min(class2) as class2, min(class3) as class3 from flows group by class1)"
_D = "d as (select p.*, t.class2 as pred_cat, t.class3 as pred_bin from preds p left join tax t on p.pred_type = t.class1)"


def _sql(body: str, *ctes: str) -> str:
    return with_views("with " + ",\n".join([_TAX, _D, *ctes]) + "\n" + body, "preds")


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.preds(spark, sf_dir)
    tax = ev.taxonomy(fixtures.flows(spark, sf_dir))
    return ev.derive_hierarchy(p, tax)


def _round(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep or dict(df.dtypes)[c] != "double" else r6(c).alias(c) for c in df.columns])


@query("derive_hierarchy", group="E", oracle=_sql("select sample_id, model, pred_type, pred_cat, pred_bin from d"))
def q_derive_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir).select("sample_id", "model", "pred_type", "pred_cat", "pred_bin")


_CONF_SQL = """select model, split, count_if(true_bin <> 'attack' and pred_bin <> 'attack')::bigint as tn,
  count_if(true_bin <> 'attack' and pred_bin = 'attack')::bigint as fp, count_if(true_bin = 'attack' and pred_bin <> 'attack')::bigint as fn,
  count_if(true_bin = 'attack' and pred_bin = 'attack')::bigint as tp, count(*)::bigint as n from d group by model, split"""


@query("binary_confusion", group="E", oracle=_sql(_CONF_SQL))
def q_binary_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.binary_confusion(_derived(spark, sf_dir), BY, "true_bin", "pred_bin")


@query(
    "accuracy",
    group="E",
    oracle=_sql(
        """select model, split, round(avg(case when true_type = pred_type then 1.0 else 0.0 end), 6) as acc_type,
  round(avg(case when true_cat = pred_cat then 1.0 else 0.0 end), 6) as acc_cat,
  round(avg(case when true_bin = pred_bin then 1.0 else 0.0 end), 6) as acc_bin from d group by model, split"""
    ),
)
def q_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ev.accuracy(_derived(spark, sf_dir), BY, {"acc_type": ("true_type", "pred_type"), "acc_cat": ("true_cat", "pred_cat"), "acc_bin": ("true_bin", "pred_bin")})
    return _round(a, BY)


_REPORT_CTE = """lc as (select model, split, label, sum(is_true) as n_true, sum(is_pred) as n_pred, sum(is_tp) as tp from (
    select model, split, true_type as label, 1 as is_true, 0 as is_pred, case when true_type = pred_type then 1 else 0 end as is_tp from d
    union all select model, split, pred_type, 0, 1, 0 from d) u group by model, split, label),
rep as (select model, split, label, coalesce(tp * 1.0 / nullif(n_pred, 0), 0.0) as precision, coalesce(tp * 1.0 / nullif(n_true, 0), 0.0) as recall, n_true as support from lc),
rep2 as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) as f1 from rep)"""


@query(
    "per_class_report",
    group="E",
    oracle=_sql(
        "select model, split, label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::bigint as support from rep2",
        _REPORT_CTE,
    ),
)
def q_per_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ev.per_class_report(_derived(spark, sf_dir), BY, "true_type", "pred_type")
    return _round(r, BY + ["label"]).withColumn("support", F.col("support").cast("long"))


@query(
    "macro_weighted",
    group="E",
    oracle=_sql(
        """select model, split, round(avg(precision), 6) as precision_macro, round(avg(recall), 6) as recall_macro, round(avg(f1), 6) as f1_macro,
  round(sum(precision * support) / sum(support), 6) as precision_weighted, round(sum(recall * support) / sum(support), 6) as recall_weighted,
  round(sum(f1 * support) / sum(support), 6) as f1_weighted from rep2 group by model, split""",
        _REPORT_CTE,
    ),
)
def q_macro_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ev.per_class_report(_derived(spark, sf_dir), BY, "true_type", "pred_type")
    return _round(ev.macro_weighted(r, BY), BY)


_BIN_CTE = f"conf as ({_CONF_SQL})"
_PRF = """coalesce(tp * 1.0 / nullif(tp + fp, 0), 0.0) as p, coalesce(tp * 1.0 / nullif(tp + fn, 0), 0.0) as r"""


@query(
    "binary_prf",
    group="E",
    oracle=_sql(
        f"""select model, split, round(p, 6) as precision_bin, round(r, 6) as recall_bin, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) as f1_bin
from (select model, split, {_PRF} from conf) x""",
        _BIN_CTE,
    ),
)
def q_binary_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ev.binary_confusion(_derived(spark, sf_dir), BY, "true_bin", "pred_bin")
    return _round(ev.binary_prf(c, BY).drop("fpr_bin"), BY)


@query("fpr", group="E", oracle=_sql("select model, split, round(fp * 1.0 / nullif(fp + tn, 0), 6) as fpr_bin from conf", _BIN_CTE))
def q_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ev.binary_confusion(_derived(spark, sf_dir), BY, "true_bin", "pred_bin")
    return _round(ev.binary_prf(c, BY).select(*BY, "fpr_bin"), BY)


_SC_CTE = """sc as (select model, split, score, sum(case when true_bin = 'attack' then 1 else 0 end) as pos,
  sum(case when true_bin = 'attack' then 0 else 1 end) as neg from preds group by model, split, score)"""
_AUC_CTE = """auc as (select model, split, sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0) as auc from (
  select *, sum(neg) over (partition by model, split order by score rows between unbounded preceding and current row) - neg as below from sc) x
  group by model, split)"""


@query("auc_exact", group="E", oracle=_sql("select model, split, round(auc, 6) as auc from auc", _SC_CTE, _AUC_CTE))
def q_auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ev.auc_exact(fixtures.preds(spark, sf_dir), BY, "true_bin", "score"), BY)


@query(
    "roc_points",
    group="E",
    oracle=_sql(
        """select model, split, round(score, 6) as threshold,
  round(sum(neg) over w / sum(neg) over (partition by model, split), 6) as fpr,
  round(sum(pos) over w / sum(pos) over (partition by model, split), 6) as tpr
from sc window w as (partition by model, split order by score desc rows between unbounded preceding and current row)""",
        _SC_CTE,
    ),
)
def q_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ev.roc_points(fixtures.preds(spark, sf_dir), BY, "true_bin", "score"), BY)


@query(
    "cost_metrics",
    group="E",
    oracle=_sql(
        """select model, split, (tp + fp)::bigint as manual_alerts, round((tp + fp) * 1000.0 / n, 6) as manual_alerts_per_1000,
  round((tp + fp) * 0.05::double, 6) as review_hours, round((tp + fp) * 0.05::double * 1000.0 / n, 6) as review_hours_per_1000,
  round(fp * 0.05::double * 25.0, 6) as fp_cost_eur, round((tp + fp) * 0.05::double * 25.0, 6) as total_operational_cost_eur, fn::bigint as missed_attacks from conf""",
        _BIN_CTE,
    ),
)
def q_cost_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ev.binary_confusion(_derived(spark, sf_dir), BY, "true_bin", "pred_bin")
    return _round(ev.cost_metrics(c, BY), BY)


def _macro_cte(name: str, t: str, p: str) -> str:
    return f"""{name} as (select model, split, avg(f1) as f1, avg(pr) as pr, avg(rc) as rc from (
  select *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0.0) as f1 from (
    select model, split, label, coalesce(sum(is_tp) * 1.0 / nullif(sum(is_pred), 0), 0.0) as pr, coalesce(sum(is_tp) * 1.0 / nullif(sum(is_true), 0), 0.0) as rc from (
      select model, split, {t} as label, 1 as is_true, 0 as is_pred, case when {t} = {p} then 1 else 0 end as is_tp from d
      union all select model, split, {p}, 0, 1, 0 from d) u group by model, split, label) a) b group by model, split)"""


_SCORES_CTES = [
    _macro_cte("mt", "true_type", "pred_type"),
    _macro_cte("mc", "true_cat", "pred_cat"),
    _BIN_CTE,
    f"bp as (select model, split, coalesce(2 * p * r / nullif(p + r, 0), 0.0) as f1_bin from (select model, split, {_PRF} from conf) x)",
    _SC_CTE,
    _AUC_CTE,
    """scores as (select mt.model, mt.split, mt.f1 as f1_type, mc.f1 as f1_cat, bp.f1_bin, auc.auc, (bp.f1_bin + mc.f1 + mt.f1) / 3.0 as f1_mean
  from mt join mc using (model, split) join bp using (model, split) join auc using (model, split))""",
]


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.preds(spark, sf_dir)
    tax = ev.taxonomy(fixtures.flows(spark, sf_dir))
    return ev.level_scores(p, tax, BY)


@query(
    "f1_mean",
    group="E",
    oracle=_sql("select model, split, round(f1_type, 6) as f1_type, round(f1_cat, 6) as f1_cat, round(f1_bin, 6) as f1_bin, round(f1_mean, 6) as f1_mean from scores", *_SCORES_CTES),
)
def q_f1_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    return _round(s.select(*BY, "f1_type", "f1_cat", "f1_bin", "f1_mean"), BY)


@query(
    "generalisation_gap",
    group="E",
    oracle=_sql(
        """select model, round(max(case when split = 'train' then f1_mean end) - max(case when split = 'val' then f1_mean end), 6) as gap_train_val,
  round(max(case when split = 'train' then f1_mean end) - max(case when split = 'test' then f1_mean end), 6) as gap_train_test from scores group by model""",
        *_SCORES_CTES,
    ),
)
def q_generalisation_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ev.generalisation_gap(_scores(spark, sf_dir)), ["model"])


@query(
    "model_ranking",
    group="E",
    oracle=_sql(
        """select split, model, round(f1_mean, 6) as f1_mean, round(f1_type, 6) as f1_type, round(auc, 6) as auc,
  row_number() over (partition by split order by f1_mean desc, f1_type desc, auc desc nulls last, model) as rank from scores""",
        *_SCORES_CTES,
    ),
)
def q_model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ev.model_ranking(_scores(spark, sf_dir))
    return _round(r, ["split", "model"]).withColumn("rank", F.col("rank").cast("int"))


_MELT = ["f1_type", "f1_cat", "f1_bin", "f1_mean", "auc"]


@query(
    "melt_metrics",
    group="E",
    oracle=_sql(
        "select model, split, metric, round(value, 6) as value from (unpivot scores on "
        + ", ".join(_MELT)
        + " into name metric value value) u",
        *_SCORES_CTES,
    ),
)
def q_melt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ev.melt(_scores(spark, sf_dir), BY, _MELT)
    return m.withColumn("value", r6("value"))


@query(
    "confusion_norm",
    group="E",
    oracle=_sql(
        """labels as (select model, split, true_cat as l from d union select model, split, pred_cat from d),
cells as (select model, split, true_cat, pred_cat, count(*) as n from d group by all),
grid as (select a.model, a.split, a.l as true_label, b.l as pred_label from labels a join labels b on a.model = b.model and a.split = b.split)
select g.model, g.split, g.true_label, g.pred_label, coalesce(c.n, 0)::bigint as n,
  round(coalesce(coalesce(c.n, 0) * 1.0 / nullif(sum(coalesce(c.n, 0)) over (partition by g.model, g.split, g.true_label), 0), 0.0), 6) as share
from grid g left join cells c on g.model = c.model and g.split = c.split and g.true_label = c.true_cat and g.pred_label = c.pred_cat""".replace(
            "labels as", "with labels as", 1
        ).replace("with labels as", "labels as", 1),
    ).replace("\nlabels as", ",\nlabels as", 1),
)
def q_confusion_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ev.confusion_normalised(_derived(spark, sf_dir), BY, "true_cat", "pred_cat")
    return c.withColumn("share", r6("share"))


@query(
    "hard_classes",
    group="E",
    oracle=_sql(
        """t as (select split, model, row_number() over (partition by split order by f1_mean desc, f1_type desc, auc desc nulls last, model) as rank from scores),
top as (select model from t where split = 'test' and rank <= 3),
r as (select model, label, recall, precision, support from rep2 where split = 'test' and model in (select model from top))
select label, round(avg(recall), 6) as mean_recall, round(avg(precision), 6) as mean_precision, max(support)::bigint as support
from r group by label order by mean_recall, support, label limit 12""",
        *_SCORES_CTES,
        _REPORT_CTE,
    ).replace("\nt as (", ",\nt as (", 1),
)
def q_hard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    top = ev.model_ranking(scores).filter((F.col("split") == "test") & (F.col("rank") <= 3)).select("model")
    d = _derived(spark, sf_dir).filter(F.col("split") == "test")
    rep = ev.per_class_report(d, ["model"], "true_type", "pred_type").join(top, "model", "left_semi")
    g = rep.groupBy("label").agg(F.avg("recall").alias("mean_recall"), F.avg("precision").alias("mean_precision"), F.max("support").cast("long").alias("support"))
    # the 12 hardest classes: a top-k report over one row per class
    g = g.select("label", r6("mean_recall").alias("mean_recall"), r6("mean_precision").alias("mean_precision"), "support")
    return g.orderBy("mean_recall", "support", "label").limit(12)


# second labelled source: documents with quality / toxic labels ---------------
_DOC_SQL = """docs as (select doc_id, case when toxic = 1 then 'attack' else 'normal' end as true_bin,
  case when n_chars > 2000 then 'attack' else 'normal' end as pred_bin, cast(n_chars as double) as score, lang from labelled_docs)"""


@query(
    "docs_binary_eval",
    group="E",
    oracle=with_views(
        f"""with {_DOC_SQL}
select lang, count_if(true_bin <> 'attack' and pred_bin <> 'attack')::bigint as tn, count_if(true_bin <> 'attack' and pred_bin = 'attack')::bigint as fp,
  count_if(true_bin = 'attack' and pred_bin <> 'attack')::bigint as fn, count_if(true_bin = 'attack' and pred_bin = 'attack')::bigint as tp, count(*)::bigint as n
from docs group by lang""",
        "labelled_docs",
    ),
)
def q_docs_binary_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.labelled_docs(spark, sf_dir).select(
        "doc_id", "lang",
        F.when(F.col("toxic") == 1, "attack").otherwise("normal").alias("true_bin"),
        F.when(F.col("n_chars") > 2000, "attack").otherwise("normal").alias("pred_bin"),
    )
    return ev.binary_confusion(d, ["lang"], "true_bin", "pred_bin")


@query(
    "docs_auc",
    group="E",
    oracle=with_views(
        f"""with {_DOC_SQL},
sc as (select lang, score, sum(case when true_bin = 'attack' then 1 else 0 end) as pos, sum(case when true_bin = 'attack' then 0 else 1 end) as neg from docs group by lang, score)
select lang, round(sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0), 6) as auc from (
  select *, sum(neg) over (partition by lang order by score rows between unbounded preceding and current row) - neg as below from sc) x group by lang""",
        "labelled_docs",
    ),
)
def q_docs_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.labelled_docs(spark, sf_dir).select(
        "lang", F.when(F.col("toxic") == 1, "attack").otherwise("normal").alias("true_bin"), F.col("n_chars").cast("double").alias("score")
    )
    return ev.auc_exact(d, ["lang"], "true_bin", "score").withColumn("auc", r6("auc"))
