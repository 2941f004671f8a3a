import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from calibra.operators import models as M
from calibra.plans.benchmark import Benchmark, at_once, prepare
from calibra.sources import tables
from calibra.sources.tables import TOXIC_SPEC, ENC_SPEC, documents_labeled, encounters


def test_prepare_leak_free_scope(spark, sf):
    p = prepare(encounters(spark, sf), ENC_SPEC, k=3, n=40, fit_scope="train", split_mode="exact")
    cols = p.data.columns
    assert cols[:3] == ["id", "split", "label"] and len(p.selected) == 3
    assert p.data.where(F.col("split") == "train").count() > 0
    c = dict(p.train_q.groupBy("label").count().collect())
    assert c[1] == 20 and c[0] == 20


def test_workflow_end_to_end(spark, sf):
    b = Benchmark(spark, documents_labeled(spark, sf), replace(TOXIC_SPEC, target="quality"),
                  n=40, landmarks=60)
    rep = {r.model: r for r in b.run_all().collect()}
    assert set(rep) == {"logreg", "random_forest", "svm_rbf", "svm_cos2"}
    assert all(r.train_seconds > 0 and 0 <= r.accuracy <= 1 for r in rep.values())
    blocks = {r.block for r in b.results.select("block").distinct().collect()}
    assert blocks == {"classical", "qsvm"}
    # Platt curves were fitted on held-out rows and keep the order of margins
    assert b.fitted["svm_rbf"].curve[0] > 0 and b.fitted["svm_cos2"].curve is not None


def test_rows_meet_the_models_once(spark, sf):
    b = Benchmark(spark, documents_labeled(spark, sf), replace(TOXIC_SPEC, target="quality"), n=40)
    b.baseline(("logreg",))
    test = b.data().data.where(F.col("split") == "test")
    want = M.score(b.fitted["logreg"].model, M.assemble(test, b.data().features), "logreg", "doc_id", "label")
    scored = b.scored["classical"]
    # what the metrics read is what the caller gets: no model in its plan
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "InMemoryTableScan" not in plan
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, want.collect()))
    b.close()


def test_texts_without_a_label_are_not_read_through(spark, tmp_path, monkeypatch):
    docs = [(1, "a b\n1!", "en", 6), (2, "no label", "en", 8), (3, None, None, None), (3, "twice", "de", 5), (None, "x", "fr", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 0, 1), (1, 1, 0), (3, None, 1), (None, 1, 1), (9, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def found():
        d = documents_labeled(spark, str(tmp_path))
        return d, sorted(map(repr, d.collect()))

    d, rows = found()
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    # counted on what the join with the ids leaves
    assert "LeftSemi" in plan and plan.index("digit_ratio") < plan.index("LeftSemi")
    monkeypatch.setattr(tables, "SENT_LABELS", 0)
    whole, same = found()
    assert "LeftSemi" not in whole._jdf.queryExecution().optimizedPlan().toString()
    assert rows == same and len(rows) == 4


def test_side_by_side_gives_the_same_report(spark, sf, monkeypatch):
    whole = M.estimator
    # a few steps are enough to compare
    monkeypatch.setattr(M, "estimator", lambda name, n, **kw: whole(name, n, **kw | {"max_iter": 3, "num_trees": 5}))

    def report(**kw):
        b = Benchmark(spark, documents_labeled(spark, sf), replace(TOXIC_SPEC, target="quality"), n=40, landmarks=60)
        rows = {r.model: r.asDict() for r in b.run_all(**kw).drop("train_seconds").collect()}
        blocks = {tuple(r) for r in b.results.select("block", "model").distinct().collect()}
        b.close()
        return rows, blocks, set(b.fitted), set(b.scored)

    one, many = report(), report(side_by_side=True)
    assert one[1:] == many[1:]
    assert one[0].keys() == many[0].keys()
    for model, row in one[0].items():
        assert {k: v if isinstance(v, str) else round(v, 6) for k, v in row.items()} == {
            k: v if isinstance(v, str) else round(v, 6) for k, v in many[0][model].items()}


def test_at_once_keeps_order_pools_and_errors(spark):
    pool = lambda: spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    met = threading.Barrier(3, timeout=60)

    def job(n):
        met.wait()  # passes only if all three run at the same time
        return spark.range(n).count(), pool()

    before = pool()
    assert at_once(spark, [lambda n=n: job(n) for n in (3, 1, 2)]) == [(3, "side-0"), (1, "side-1"), (2, "side-2")]
    assert pool() == before
    with pytest.raises(ZeroDivisionError):
        at_once(spark, [lambda: 1 // 0, lambda: spark.range(5).count()])
    assert at_once(spark, []) == []


def test_class_weights_balance(spark):
    from calibra.operators.models import class_weights
    df = spark.createDataFrame([(i, 1 if i < 10 else 0) for i in range(40)], "id long, label int")
    w = {r.label: r.weight for r in class_weights(df, "label").select("label", "weight").distinct().collect()}
    assert w[1] * 10 == w[0] * 30 == 20.0


def test_save_and_markdown(spark, sf, tmp_path):
    from calibra.operators import results as R
    b = Benchmark(spark, documents_labeled(spark, sf), replace(TOXIC_SPEC, target="quality"),
                  n=40, landmarks=60)
    b.baseline(("logreg",))
    path = b.save(str(tmp_path / "store"))
    assert path.endswith("v=0")
    assert {r.model for r in R.load_store(spark, str(tmp_path / "store")).collect()} == {"logreg"}
    md = b.markdown().splitlines()
    assert md[0].startswith("| model |") and md[2].startswith("| logreg |")
    b.close()


def test_benchmark_options_validated(spark, sf):
    import pytest
    with pytest.raises(ValueError):
        Benchmark(spark, encounters(spark, sf), ENC_SPEC, split_mode="bogus")
    b = Benchmark(spark, encounters(spark, sf), ENC_SPEC, k=2, n=40, split_mode="exact", fit_scope="train")
    p = b.data()
    assert len(p.selected) == 2 and p.data.select("split").distinct().count() == 3
    b.close()


def test_kernel_heatmap(spark, sf):
    import numpy as np
    b = Benchmark(spark, encounters(spark, sf), ENC_SPEC, k=3, n=40)
    rows = b.kernel_heatmap(n_viz=20).collect()
    m = np.zeros((20, 20))
    for r in rows:
        m[r.pos_i, r.pos_j] = r.k
    assert len(rows) == 400 and np.allclose(np.diag(m), 1.0) and np.allclose(m, m.T)
    b.close()


def test_close_leaves_other_caches(spark, sf):
    mine = encounters(spark, sf).persist()
    mine.count()
    b = Benchmark(spark, encounters(spark, sf), ENC_SPEC, k=2, n=40)
    b.data()
    b.close()
    assert mine.storageLevel.useMemory and mine.is_cached
    mine.unpersist()


def test_drawn_features_need_no_landmarks(spark, sf, monkeypatch):
    # a step is a Spark job or two: few of them show the path from data to scores
    monkeypatch.setattr("calibra.plans.benchmark.DRAWN_STEPS", 3)
    b = Benchmark(spark, documents_labeled(spark, sf), replace(TOXIC_SPEC, target="quality"),
                  k=7, rbf_map="fourier", places=16, split_mode="hash")
    b.baseline(("svm_rbf",))
    b.kernel_svm()
    # 32 drawn features, not 3^7 numbers or as many as there are landmarks
    assert {n: f.model.numFeatures for n, f in b.fitted.items()} == {"svm_rbf": 32, "svm_cos2": 32}
    test = b.data().data.where("split = 'test'").count()
    assert b.scored["classical"].where("score between 0 and 1").count() == test
    b.close()
