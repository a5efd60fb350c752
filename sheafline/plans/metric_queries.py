"""Queries on votes and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as nb
from ..operators import features as ft
from ..operators import metrics as mt
from ..operators import voting as vt
from . import fixtures as fx
from . import oracles as oc
from .catalog import register

# A rule to be judged: long documents are good ones. Its score grows with the length.
JUDGED = """select l.doc_id, quality as truth, case when n_chars >= 1000 then 1 else 0 end as pred,
 n_chars / (n_chars + 1000.0::double) as score from labels l join documents d using (doc_id)"""


def judged(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    n = F.col("n_chars")
    return (
        fx.table(spark, sf, "labels")
        .join(docs, "doc_id")
        .select(
            "doc_id",
            F.col("quality").alias("truth"),
            F.when(n >= 1000, 1).otherwise(0).alias("pred"),
            (n / (n + F.lit(1000.0))).alias("score"),
        )
    )


_RAW = "((doc_id * {a} + line_no * {b} + {k} * 5) % 10 + 1)::double"
_MODELS = [("lr", 7, 3), ("rf", 3, 7), ("gb", 11, 2), ("knn", 2, 9)]


def _probabilities():
    """Four made-up class distributions over three classes for every block."""
    out = {}
    for name, a, b in _MODELS:
        raw = [((F.col("doc_id") * a + F.col("line_no") * b + k * 5) % 10 + 1).cast("double") for k in range(3)]
        total = raw[0] + raw[1] + raw[2]
        out[name] = F.array(*[r / total for r in raw])
    return out


def _p(a: int, b: int, k: int) -> str:
    raws = [_RAW.format(a=a, b=b, k=i) for i in range(3)]
    return f"({raws[k]} / ({raws[0]} + {raws[1]} + {raws[2]}))"


_WEIGHTS = (1, 2, 2, 1)
_MEAN = [
    "(" + " + ".join(f"{w}.0::double * {_p(a, b, k)}" for w, (_, a, b) in zip(_WEIGHTS, _MODELS)) + ") / 6.0::double"
    for k in range(3)
]

VOTED = f"""select doc_id, line_no, greatest(p0, p1, p2) as confidence,
 case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as predicted
 from (select doc_id, line_no, {_MEAN[0]} as p0, {_MEAN[1]} as p1, {_MEAN[2]} as p2 from blocks)"""


def voted(spark, sf):
    rows = fx.blocks(spark, sf).select("doc_id", "line_no").withColumns(_probabilities())
    return vt.soft_vote(rows, [m for m, _, _ in _MODELS], _WEIGHTS)


@register(
    "soft_vote",
    oc.sql(f"select doc_id, line_no, predicted, round(confidence, 6) as confidence from ({VOTED})"),
)
def soft_vote(spark, sf):
    return voted(spark, sf).select(
        "doc_id", "line_no", "predicted", nb.r6(F.col("confidence")).alias("confidence")
    )


@register(
    "confidence_hist",
    oc.sql(
        f"""select r::int as bin, coalesce(n, 0) as n from range(1, 21) t(r) left join (
  select least(20, floor((confidence - lo) / (hi - lo) * 20) + 1)::int as bin, count(*) n
  from (select *, min(confidence) over () lo, max(confidence) over () hi from ({VOTED})) group by all) c on c.bin = r"""
    ),
)
def confidence_hist(spark, sf):
    return mt.confidence_histogram(voted(spark, sf), "confidence")


REPORT = f"""with j as ({JUDGED}), k as (select c, (select count(*) from j where truth = c and pred = c) h,
  (select count(*) from j where truth = c) s, (select count(*) from j where pred = c) p from (values (0), (1)) v(c)),
 m as (select c, h, s, h / nullif(p, 0)::double as pr, h / nullif(s, 0)::double as re from k),
 f as (select *, 2 * pr * re / nullif(pr + re, 0) as f1 from m)
 select c::varchar as class, pr as precision, re as recall, f1, s as support from f
 union all select 'accuracy', sum(h) / sum(s), sum(h) / sum(s), sum(h) / sum(s), sum(s)::bigint from f
 union all select 'macro avg', avg(pr), avg(re), avg(f1), sum(s)::bigint from f
 union all select 'weighted avg', sum(pr * s) / sum(s), sum(re * s) / sum(s), sum(f1 * s) / sum(s), sum(s)::bigint from f"""


@register(
    "classification_report",
    f"""select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support
 from ({REPORT})""",
)
def classification_report(spark, sf):
    return mt.classification_report(judged(spark, sf), "truth", "pred").select(
        "class", *[nb.r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


@register(
    "confusion_matrix",
    f"""select truth, count(*) filter (pred = 0) as pred_0, count(*) filter (pred = 1) as pred_1
 from ({JUDGED}) group by truth""",
)
def confusion_matrix(spark, sf):
    return mt.confusion_matrix(judged(spark, sf), "truth", "pred", [0, 1])


@register(
    "metrics_long",
    f"""select class, metric, round(value, 6) as value from ({REPORT})
 unpivot (value for metric in (precision, recall, f1))""",
)
def metrics_long(spark, sf):
    wide = mt.classification_report(judged(spark, sf), "truth", "pred")
    long = mt.melt(wide, ["class"], ["precision", "recall", "f1"], "metric", "value")
    return long.select("class", "metric", nb.r6(F.col("value")).alias("value"))


_CORR = ["font_size", "weight", "page", "x_center", "y_center", "n_words", "text_length", "bbox_area"]
_CORR_SQL = " union all ".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, round(corr({a}, {b}), 6) as corr from feats"
    for a in _CORR
    for b in _CORR
)


@register(
    "feature_corr",
    oc.sql(
        f"""select * from (with feats as materialized (select font_size, weight, page, x_center, y_center, n_words,
  length(text) as text_length, (x1 - x0) * (y1 - y0) as bbox_area from blocks) {_CORR_SQL})"""
    ),
)
def feature_corr(spark, sf):
    b = ft.network_features(fx.blocks(spark, sf))
    return mt.correlation_matrix(b, _CORR).select(
        "feature_a", "feature_b", nb.r6(F.col("corr")).alias("corr")
    )


ROC = f"""with j as ({JUDGED}), r as (
  select 1 as class, score as threshold, truth = 1 as hit from j
  union all select 0, 1 - score, truth = 0 from j),
 g as (select class, threshold, count(*) filter (hit) pos, count(*) filter (not hit) neg from r group by all),
 c as (select *, sum(pos) over w tp, sum(neg) over w fp, sum(pos) over a p, sum(neg) over a f from g
  window w as (partition by class order by threshold desc), a as (partition by class))"""


def _roc_points(spark, sf):
    """One-vs-rest rows: each class with its own score."""
    j = judged(spark, sf)
    rows = j.select(
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("class"), F.col("score").alias("s"), (F.col("truth") == 1).alias("hit")),
                F.struct(
                    F.lit(0).alias("class"), (1 - F.col("score")).alias("s"), (F.col("truth") == 0).alias("hit")
                ),
            )
        ).alias("r")
    ).select("r.*")
    return mt.roc_curve(rows, ["class"], "s", F.col("hit"), largest=None)


@register(
    "roc_curve",
    f"""{ROC} select class, round(threshold, 6) as threshold, round(fp / f, 6) as fpr, round(tp / p, 6) as tpr from c""",
)
def roc_curve(spark, sf):
    return _roc_points(spark, sf).select(
        "class", *[nb.r6(F.col(c)).alias(c) for c in ("threshold", "fpr", "tpr")]
    )


@register(
    "roc_auc",
    f"""{ROC} select class, round(sum((fp / f - pf) * (tp / p + pt) / 2), 6) as auc from (
  select *, lag(fp / f, 1, 0) over w pf, lag(tp / p, 1, 0) over w pt from c
  window w as (partition by class order by threshold desc)) group by class""",
)
def roc_auc(spark, sf):
    return mt.roc_auc(_roc_points(spark, sf), ["class"]).withColumn("auc", nb.r6(F.col("auc")))
