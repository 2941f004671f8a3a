import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import kernels as K


def _frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row], i % 2) for i, row in enumerate(x)],
                                 "id long, vec array<double>, cls int")


def _wide(spark, x):
    cols = [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *cols]), cols


def test_unknown_kernel():
    with pytest.raises(ValueError):
        K.make_kernel("bogus")


@pytest.mark.parametrize("k", [1, 2, 4])
def test_cos2_vector_gives_the_kernel(spark, k):
    x = np.random.default_rng(k).normal(size=(8, k))
    df, cols = _wide(spark, x)
    v = np.array([r.vec for r in K.cos2_features(df, cols).orderBy("id").collect()])
    assert v.shape == (8, 3 ** k)
    g = v @ v.T
    assert np.allclose(g, K.make_kernel("cos2").matrix(x, x))
    assert np.allclose(np.diag(g), 1.0) and np.linalg.eigvalsh(g).min() > -1e-9


def test_cos2_vector_of_null(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, 0.5, 0.1)], "id long, a double, b double")
    got = {r.id: r.vec for r in K.cos2_features(df, ["a", "b"]).collect()}
    assert got[1] is None and len(got[2]) == 9


def test_sums_equal_all_pairs(spark):
    x = np.random.default_rng(5).normal(size=(37, 4))
    s = K.kernel_sums(_frame(spark, x).repartition(5), "vec", "cls")
    full = x @ x.T
    st = K.kernel_stats(s).first()
    assert st.n == 37
    assert st.offdiag_mean == pytest.approx((full.sum() - np.trace(full)) / 37 ** 2)
    assert st.diag_mean == pytest.approx(np.trace(full) / 37)
    cls = np.arange(37) % 2
    for r in K.kernel_blocks(s).collect():
        assert r.mean_k == pytest.approx(full[np.ix_(cls == r.label_i, cls == r.label_j)].mean())


@pytest.mark.parametrize("broadcast_rows", [100, 5])
def test_cross_gram(spark, broadcast_rows):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(23, 2)), rng.normal(size=(17, 2))
    right = _frame(spark, b).withColumn("id", F.col("id") + 100)
    ker = K.make_kernel("rbf", gamma=0.5)
    out = K.cross_gram(_frame(spark, a), "id", "vec", right, "id", "vec", ker, broadcast_rows=broadcast_rows, block_rows=4)
    full = ker.matrix(a, b)
    rows = out.collect()
    assert len(rows) == 23 * 17 and all(abs(full[r.i, r.j - 100] - r.k) < 1e-12 for r in rows)


def test_cross_gram_of_nothing(spark):
    df = _frame(spark, np.zeros((3, 2)))
    assert K.cross_gram(df, "id", "vec", df.limit(0), "id", "vec", K.make_kernel("linear")).count() == 0


def test_cross_gram_copies_no_side(spark, monkeypatch):
    """Each row of a side is shuffled or written once, however many blocks meet."""
    monkeypatch.setattr(K, "LEFT_ROWS", 5)
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(23, 2)), rng.normal(size=(17, 2))
    ker = K.make_kernel("rbf", gamma=0.5)
    out = K.cross_gram(_frame(spark, a), "id", "vec", _frame(spark, b).repartition(3), "id", "vec", ker, broadcast_rows=5, block_rows=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "CoGroup" not in plan
    full = ker.matrix(a, b)
    assert sorted((r.i, r.j) for r in out.collect()) == [(i, j) for i in range(23) for j in range(17)]
    assert all(abs(full[r.i, r.j] - r.k) < 1e-12 for r in out.collect())
