from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from calibra.operators import kernels as K
from calibra.operators import models as M
from calibra.operators import results as R


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=120) > 0).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, c double")
    return M.assemble(df, ["a", "b", "c"])


def test_classical_models_scores(toy):
    tr, te = toy.where("id < 90"), toy.where("id >= 90")
    scored, runs = M.run_models(tr, te, {"logreg": "logreg", "random_forest": "random_forest"},
                                   "id", "label", num_trees=10)
    rows = scored.collect()
    assert {r.model for r in rows} == {"logreg", "random_forest"}
    assert all(r.prediction in (0, 1) and 0 <= r.score <= 1 for r in rows)
    assert len(rows) == 60 and len(runs) == 2


def test_forest_scores_rows_on_all_cores(toy):
    tr, te = toy.where("id < 90"), toy.where("id >= 60").coalesce(1)
    scored, runs = M.run_models(tr, te, {"random_forest": "random_forest"}, "id", "label", num_trees=3, max_depth=4)
    par = toy.sparkSession.sparkContext.defaultParallelism
    assert sum(1 for part in scored.rdd.glom().map(len).collect() if part) >= par
    # the rows and their scores are those of the model as it is
    want = M.score(runs[0].model, te, "random_forest", "id", "label")
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, want.collect()))


def test_nystroem_svm_and_loss(toy):
    d = toy.withColumn("vec", F.array("a", "b", "c")).drop("features")
    lm = d.where("id < 40")
    ny = M.Nystroem.fit(lm, "vec", K.make_kernel("rbf", gamma=0.3), key="id")
    assert 0 < ny.dim <= 40
    f = ny.transform(d, "vec")
    tr, te = f.where("id < 90"), f.where("id >= 90")
    s, fits = M.run_models(tr, te, {"svm": "svm"}, "id", "label", max_iter=50)
    acc = s.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.7 and fits[0].curve[0] > 0
    assert s.where("score < 0 OR score > 1").count() == 0
    # one class is no ground for a curve
    assert M.platt(M.estimator("svm", 90, max_iter=50), f.where("label = 1"), "id", "label") is None


def test_logreg_converges_and_keeps_its_losses(toy):
    tr = toy.where("id < 90")
    _, fits = M.run_models(tr, toy, {"logreg": "logreg"}, "id", "label")
    g = M.logreg_gradient(fits[0].model, tr, "label", ["a", "b", "c"]).collect()
    assert [r.feature for r in g] == ["(intercept)", "a", "b", "c"] and all(abs(r.gradient) < 1e-4 for r in g)
    loss = M.loss_history(fits[0].model, "logreg")
    assert len(loss) > 1 and loss[-1][2] <= loss[0][2]
    assert M.loss_history(object(), "x") == []


def test_upsert_flatten_rank(spark):
    old = spark.createDataFrame([("classical", "svm_rbf", "accuracy", 0.8), ("classical", "svm_rbf", "f1", 0.4),
                                 ("qsvm", "qsvm_zz", "roc_auc", 0.52)], "block string, model string, metric string, value double")
    new = spark.createDataFrame([("qsvm", "qsvm_custom", "roc_auc", 0.74)], old.schema)
    up = R.upsert(old, new)
    assert sorted(r.model for r in up.collect()) == ["qsvm_custom", "svm_rbf", "svm_rbf"]
    both = up.unionByName(spark.createDataFrame([("bonus", "svm_rbf", "accuracy", 0.1)], old.schema))
    flat = {(r.model, r.metric): r.value for r in R.flatten(both).collect()}
    assert flat == {("svm_rbf", "accuracy"): 0.1, ("qsvm_custom", "roc_auc"): 0.74}
    ranks = [r.model for r in R.rank_models(R.flatten(up)).orderBy("rank").collect()]
    assert ranks == ["qsvm_custom", "svm_rbf"]
    assert R.upsert(None, new).count() == 1


def test_json_round_trip_and_missing(spark, tmp_path):
    df = spark.createDataFrame([("classical", "svm_rbf", "accuracy", 0.8)], "block string, model string, metric string, value double")
    R.write_results(df, str(tmp_path / "res"))
    assert R.read_results(spark, str(tmp_path / "res")).collect() == df.collect()
    with pytest.raises(AnalysisException):
        R.read_results(spark, str(tmp_path / "nope")).collect()
    js = R.nested_json(df).first()
    assert js.json == '{"svm_rbf":{"accuracy":0.8}}'


def test_markdown_splice():
    text = "a\n<!-- B -->\nold\n<!-- E -->\nz"
    assert "new" in R.splice_table(text, "new", "<!-- B -->", "<!-- E -->")
    with pytest.raises(ValueError):
        R.splice_table("no markers", "x", "<!-- B -->", "<!-- E -->")


def test_versioned_store(spark, tmp_path):
    base = str(tmp_path / "store")
    assert R.load_store(spark, base) is None
    a = spark.createDataFrame([("classical", "logreg", "f1", 0.5), ("qsvm", "qsvm_zz", "f1", 0.4)],
                              "block string, model string, metric string, value double")
    R.upsert_store(spark, base, a)
    b = spark.createDataFrame([("qsvm", "qsvm_custom", "f1", 0.7)], a.schema)
    p = R.upsert_store(spark, base, b)
    assert p.endswith("v=1")
    got = sorted((r.block, r.model) for r in R.load_store(spark, base).collect())
    assert got == [("classical", "logreg"), ("qsvm", "qsvm_custom")]


def test_nested_json_sorted(spark):
    df = spark.createDataFrame([("b", "z", "f1", 1.0), ("b", "a", "recall", 0.5), ("b", "a", "accuracy", 0.25)],
                               "block string, model string, metric string, value double")
    assert R.nested_json(df).first().json == '{"a":{"accuracy":0.25,"recall":0.5},"z":{"f1":1.0}}'


def test_concurrent_versions_do_not_meet(spark, tmp_path):
    base = str(tmp_path / "store")
    a = spark.createDataFrame([("classical", "logreg", "f1", 0.5)], "block string, model string, metric string, value double")
    R.upsert_store(spark, base, a)
    (tmp_path / "store" / "_commit-1").touch()  # a run died after it had taken version 1
    assert R.upsert_store(spark, base, a, wait=1).endswith("v=2")


def test_overlapping_writers_keep_both_blocks(spark, tmp_path):
    base = str(tmp_path / "both")
    block = lambda b: spark.createDataFrame([(b, "m", "f1", 0.5)], "block string, model string, metric string, value double")
    R.upsert_store(spark, base, block("first"))
    with ThreadPoolExecutor(4) as pool:
        paths = list(pool.map(lambda k: R.upsert_store(spark, base, block(f"b{k}")), range(4)))
    assert sorted(p.rsplit("/", 1)[1] for p in paths) == [f"v={k}" for k in range(1, 5)]
    assert sorted(r.block for r in R.load_store(spark, base).collect()) == ["b0", "b1", "b2", "b3", "first"]


def test_long_vectors_are_dealt_to_the_cores(spark, monkeypatch):
    """A step over few rows of long vectors is not one task's, a small set's is."""
    rows = spark.range(0, 400, 1, 1).select("id", array_to_vector(F.array(*[F.col("id") * float(j) for j in range(20)])).alias("features")).persist()
    assert M._dealt(rows, 400, "features", "id").rdd.getNumPartitions() == 1
    monkeypatch.setattr(M, "TASK_NUMBERS", 2000)
    got = M._dealt(rows, 400, "features", "id")
    assert got.rdd.getNumPartitions() == 5 and sorted(r.id for r in got.collect()) == list(range(400))
    assert got.is_cached
    got.unpersist()
    rows.unpersist()
