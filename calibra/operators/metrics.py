"""Binary-classification metrics and curves (V1-V10) on a scored DataFrame
``(model, label, prediction, score)``.

Everything is derived from per-(model, score) class counts -- a map-side
combined aggregation -- so the curve work scales with distinct scores, and
cumulative counts use ``dist_cumsum`` (no one-task window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.functions.scalar import safe_div
from calibra.operators.cumulative import dist_cumsum
from calibra.operators.profile import confusion
from calibra.session import staged

METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


def score_counts(scored: DataFrame, label: str = "label", score: str = "score",
                 by: str = "model") -> DataFrame:
    """(model, score, p, n): positives / negatives per distinct score."""
    y = F.col(label).cast("long")
    return (scored.where(F.col(score).isNotNull())
            .groupBy(by, score).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n")))


def curve_counts(scored: DataFrame, label: str = "label", score: str = "score",
                 by: str = "model") -> DataFrame:
    """Distinct scores descending with running counts: (model, score, p, n,
    cp, cn, idx) -- cp/cn = positives/negatives scoring >= score, idx = 1-based
    position.  One ``dist_cumsum``; AUC, AP and both curves derive from it."""
    g = score_counts(scored, label, score, by).withColumn("one", F.lit(1.0))
    return dist_cumsum(g, [by], [(score, False)], {"cp": "p", "cn": "n", "idx": "one"})


def _auc_ap(c: DataFrame, by: str) -> DataFrame:
    """AUC (ties half credit) and step AP from the descending running counts.

    For a positive at score s the negatives below s are N - cn, and the tied
    negatives count half: credit = N - cn + n / 2."""
    a = c.groupBy(by).agg(
        F.sum("p").alias("pos_all"), F.sum("n").alias("neg_all"),
        F.sum(F.col("p") * (F.col("n") * 0.5 - F.col("cn"))).alias("u"),
        F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cn"))).alias("ap_num"))
    a = a.where((F.col("pos_all") > 0) & (F.col("neg_all") > 0))
    auc = (F.col("u") + F.col("pos_all") * F.col("neg_all")) / (
        F.col("pos_all").cast("double") * F.col("neg_all"))
    return a.select(by, auc.alias("roc_auc"), (F.col("ap_num") / F.col("pos_all")).alias("pr_auc"))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score",
            by: str = "model") -> DataFrame:
    """V2: area under ROC, tied scores count half (Mann-Whitney form)."""
    return _auc_ap(curve_counts(scored, label, score, by), by).select(by, "roc_auc")


def average_precision(scored: DataFrame, label: str = "label", score: str = "score",
                      by: str = "model") -> DataFrame:
    """V3: step-wise average precision sum((R_n - R_n-1) * P_n), never trapezoid."""
    return _auc_ap(curve_counts(scored, label, score, by), by).select(by, "pr_auc")


def roc_curve(scored: DataFrame, label: str = "label", score: str = "score",
              by: str = "model", drop_intermediate: bool = True) -> DataFrame:
    """V4: (model, threshold, fpr, tpr), thresholds descending; collinear points
    dropped; the origin (threshold NULL) added.  Single-class models skipped."""
    g = curve_counts(scored, label, score, by)
    tot = g.groupBy(by).agg(F.sum("p").alias("pos_all"), F.sum("n").alias("neg_all"),
                            F.max("idx").alias("m"))
    tot = tot.where((F.col("pos_all") > 0) & (F.col("neg_all") > 0))
    g = g.join(tot, by)
    if drop_intermediate:
        # a point lies on the line through its neighbours if the step to the
        # next has as many positives and negatives as its own: one join on a
        # unique index
        nxt = g.select(by, (F.col("idx") - 1).alias("idx"), F.col("p").alias("p_next"), F.col("n").alias("n_next"))
        g = g.join(nxt, [by, "idx"], "left")
        g = g.where((F.col("idx") == 1) | (F.col("idx") == F.col("m"))
                    | (F.col("p") != F.col("p_next")) | (F.col("n") != F.col("n_next")))
    pts = g.select(by, F.col(score).cast("double").alias("threshold"),
                   (F.col("cn") / F.col("neg_all")).alias("fpr"), (F.col("cp") / F.col("pos_all")).alias("tpr"))
    origin = tot.select(by, F.lit(None).cast("double").alias("threshold"),
                        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def pr_curve(scored: DataFrame, label: str = "label", score: str = "score",
             by: str = "model") -> DataFrame:
    """V5: (model, threshold, precision, recall) at every distinct score, plus
    the end point (recall 0, precision 1, threshold NULL)."""
    g = curve_counts(scored, label, score, by)
    tot = g.groupBy(by).agg(F.sum("p").alias("pos_all"), F.sum("n").alias("neg_all"))
    tot = tot.where((F.col("pos_all") > 0) & (F.col("neg_all") > 0))
    g = g.join(tot, by)
    pts = g.select(by, F.col(score).cast("double").alias("threshold"),
                   (F.col("cp") / (F.col("cp") + F.col("cn"))).alias("precision"),
                   (F.col("cp") / F.col("pos_all")).alias("recall"))
    end = tot.select(by, F.lit(None).cast("double").alias("threshold"),
                     F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def threshold_metrics(scored: DataFrame, label: str = "label", pred: str = "prediction",
                      by: str = "model", weight: str | None = None) -> DataFrame:
    """V1: accuracy, balanced accuracy, precision, recall, F1 (zero_division=0)."""
    c = confusion(scored, label, pred, (by,), weight=weight)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    pos, neg = tp + fn, tn + fp
    rec_pos = safe_div(tp, pos)
    rec_neg = safe_div(tn, neg)
    bal = (F.when((pos > 0) & (neg > 0), (rec_pos + rec_neg) / 2)
           .when(pos > 0, rec_pos).otherwise(rec_neg))
    return c.select(
        by,
        safe_div(tp + tn, pos + neg).alias("accuracy"),
        bal.alias("balanced_accuracy"),
        safe_div(tp, tp + fp).alias("precision"),
        rec_pos.alias("recall"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def compact(scored: DataFrame, label: str = "label", pred: str = "prediction",
            score: str = "score", by: str = "model") -> DataFrame:
    """One pass over the scored rows -> (model, score, prediction, p, n),
    map-side combined and written; confusion counts and curves both derive
    from it, so upstream work (feature extraction, model transforms) runs once."""
    y = F.col(label).cast("long")
    return staged(scored.groupBy(by, F.col(score).alias("score"), F.col(pred).alias("prediction"))
                  .agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n")), "scores")


def binary_metrics(scored: DataFrame, label: str = "label", pred: str = "prediction",
                   score: str | None = "score", by: str = "model",
                   runs: DataFrame | None = None) -> DataFrame:
    """V1-V3, V9, V10 as long rows (model, metric, value); a metric that does
    not apply (one class, no score, no timing) is simply absent."""
    names = ["accuracy", "balanced_accuracy", "precision", "recall", "f1"]
    if score is None:
        th = threshold_metrics(scored, label, pred, by)
        long = th.unpivot([by], names, "metric", "value")
    else:
        c = compact(scored, label, pred, score, by)
        cells = c.select(by, F.explode(F.array(
            F.struct(F.lit(1).alias("label"), F.col("p").alias("w")),
            F.struct(F.lit(0).alias("label"), F.col("n").alias("w")))).alias("e"), "prediction")
        th = threshold_metrics(cells.select(by, "e.label", "prediction", "e.w"), "label",
                               "prediction", by, weight="w")
        long = th.unpivot([by], names, "metric", "value")
        sc = (c.where(F.col("score").isNotNull()).groupBy(by, "score")
              .agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
        g = dist_cumsum(sc.withColumn("one", F.lit(1.0)), [by], [("score", False)],
                        {"cp": "p", "cn": "n", "idx": "one"})
        both = _auc_ap(g, by)
        long = long.unionByName(both.unpivot([by], ["roc_auc", "pr_auc"], "metric", "value"))
    if runs is not None:
        long = long.unionByName(runs.select(by, F.lit("train_seconds").alias("metric"),
                                            F.col("train_seconds").cast("double").alias("value")))
    return long
