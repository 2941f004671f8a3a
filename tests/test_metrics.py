import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from calibra.operators import metrics as V
from calibra.operators.cumulative import dist_cumsum

# ten rows with tied scores, across and within the classes
Y = [1, 0, 0, 1, 0, 1, 0, 0, 1, 0]
PRED = [1, 1, 0, 0, 0, 1, 0, 0, 1, 1]
SCORE = [.75, .75, .35, .35, .05, .95, .15, .35, .55, .65]


def _auc():
    pairs = [(a, b) for a, y in zip(SCORE, Y) if y for b, z in zip(SCORE, Y) if not z]
    return sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)


def _ap():
    out, before = 0.0, 0.0
    for t in sorted(set(SCORE), reverse=True):
        got = [y for s, y in zip(SCORE, Y) if s >= t]
        recall = sum(got) / sum(Y)
        out, before = out + (recall - before) * sum(got) / len(got), recall
    return out


@pytest.fixture()
def vec(spark):
    return spark.createDataFrame([("m", i, y, p, s) for i, (y, p, s) in enumerate(zip(Y, PRED, SCORE))],
                                 "model string, key long, label int, prediction int, score double")


def _m(df):
    return {r["metric"]: r["value"] for r in V.binary_metrics(df).collect()}


def test_tied_scores_against_brute_force(vec):
    m = _m(vec)
    tp, fp, fn, tn = 3, 2, 1, 4
    assert m["roc_auc"] == pytest.approx(_auc())
    assert m["pr_auc"] == pytest.approx(_ap())
    assert m["accuracy"] == pytest.approx((tp + tn) / 10)
    assert m["precision"] == pytest.approx(tp / (tp + fp))
    assert m["recall"] == pytest.approx(tp / (tp + fn))
    assert m["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
    assert m["balanced_accuracy"] == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)
    assert set(m) == set(V.METRICS)


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([("m", i, 1, 1, 0.1 * i) for i in range(5)],
                               "model string, key long, label int, prediction int, score double")
    m = _m(df)
    assert "roc_auc" not in m and "pr_auc" not in m
    assert m["balanced_accuracy"] == 1.0


def test_zero_division(spark):
    df = spark.createDataFrame([("m", i, i % 2, 0, 0.5) for i in range(6)],
                               "model string, key long, label int, prediction int, score double")
    m = _m(df)
    assert m["precision"] == 0.0 and m["f1"] == 0.0
    assert m["roc_auc"] == pytest.approx(0.5)          # all tied: half credit


def _brute_roc(y, s):
    order = np.argsort(-np.asarray(s), kind="mergesort")
    ys, ss = np.asarray(y)[order], np.asarray(s)[order]
    idx = np.r_[np.where(np.diff(ss))[0], len(ss) - 1]
    tps = np.cumsum(ys)[idx]
    fps = 1 + idx - tps
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    return list(zip(np.r_[0, fps[keep] / fps[-1]], np.r_[0, tps[keep] / tps[-1]]))


def test_roc_curve_matches_bruteforce(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.3).astype(int)
    s = np.round(rng.random(400) + 0.3 * y, 2)          # many ties
    df = spark.createDataFrame([("m", i, int(a), 0, float(b)) for i, (a, b) in enumerate(zip(y, s))],
                               "model string, key long, label int, prediction int, score double")
    got = sorted((round(r.fpr, 9), round(r.tpr, 9)) for r in V.roc_curve(df.repartition(5)).collect())
    exp = sorted((round(a, 9), round(b, 9)) for a, b in _brute_roc(y, s))
    assert got == exp
    # AUC by brute force over all pairs
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert V.roc_auc(df).first()["roc_auc"] == pytest.approx(auc)


def test_pr_curve_endpoint(vec):
    pts = V.pr_curve(vec).collect()
    end = [r for r in pts if r.threshold is None]
    assert len(end) == 1 and end[0].precision == 1.0 and end[0].recall == 0.0
    assert len(pts) == len(set(SCORE)) + 1


def test_dist_cumsum_matches_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "o": rng.permutation(3000),
                        "v": rng.random(3000)})
    df = spark.createDataFrame(pdf).repartition(7)
    got = dist_cumsum(df, ["g"], [("o", True)], {"c": "v"}, num_partitions=6).toPandas()
    exp = pdf.sort_values(["g", "o"]).assign(c=lambda d: d.groupby("g")["v"].cumsum())
    m = got.merge(exp, on=["g", "o"], suffixes=("", "_e"))
    assert len(m) == 3000
    assert np.allclose(m["c"], m["c_e"])


def test_dist_cumsum_one_hot_group(spark):
    # one group is the whole table: it must span several range partitions
    df = spark.range(20000).select(F.lit(1).alias("g"), F.col("id").alias("o"), F.lit(1.0).alias("v"))
    got = dist_cumsum(df, ["g"], [("o", False)], {"c": "v"}, num_partitions=8)
    assert got.where(F.col("c") != 20000 - F.col("o")).count() == 0
