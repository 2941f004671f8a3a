import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from calibra.operators import newton as NT
from calibra.operators import sparse as SP
from calibra.operators import spectrum as EV


@pytest.mark.parametrize("values", [3, 5000])
def test_one_schema_for_any_vocabulary(spark, values):
    rng = random.Random(values)
    rows = [(i, rng.choice([0.0, 1.5, -2.0, None]), f"v{rng.randrange(values):05d}" if i % 9 else None, "ab"[i % 2], i % 2) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, num double, big string, small string, y int").repartition(5)
    words = SP.Vocabulary.fit(df, ["num"], ["big", "small"])
    seen = sorted({r[2] for r in rows if r[2]})
    count = {v: sum(r[2] == v for r in rows) for v in seen}
    fill = min(seen, key=lambda v: (-count[v], v))
    assert words.slots == 1 + len(seen) - 1 + 1 and words.fill["big"] == fill
    dense = np.zeros((len(rows), words.slots))
    for i, num, big, small, _ in rows:
        dense[i, 0] = num or 0.0
        k = seen.index(big or fill)
        if k:
            dense[i, k] = 1
        dense[i, len(seen)] = small == "b"
    coded = words.encode(df, ["id", "y"])
    assert [f.name for f in coded.schema.fields] == ["id", "y", "entries"]
    for r in coded.collect():
        want = [(int(s), dense[r.id, s]) for s in np.flatnonzero(dense[r.id])]
        assert [tuple(e) for e in r.entries] == want
    vectors = words.vectors(df, ["id"])
    assert vectors.first().features.size == words.slots
    for r in vectors.where("id % 97 = 0").select("id", vector_to_array("features").alias("x")).collect():
        assert r.x == dense[r.id].tolist()
    got = {r.slot: (r.mean, r.std) for r in SP.moments(coded, words.slots).collect()}
    assert all(np.allclose(got[s], (dense[:, s].mean(), dense[:, s].std()), atol=1e-9) for s in range(words.slots))
    y = np.array([r[4] for r in rows])
    for r in SP.f_scores(coded, "y", words.slots).collect():
        a, b = dense[y == 0, r.slot], dense[y == 1, r.slot]
        g = dense[:, r.slot].mean()
        between = len(a) * (a.mean() - g) ** 2 + len(b) * (b.mean() - g) ** 2
        within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
        if within < 1e-9:
            assert r.f_score == float("inf")
        else:
            assert np.isclose(r.f_score, between / (within / (len(rows) - 2)), rtol=1e-6, atol=1e-9)


def test_values_that_were_not_fitted_have_no_entry(spark):
    fit = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, s string")
    words = SP.Vocabulary.fit(fit, [], ["s"])
    other = spark.createDataFrame([(1, "zzz"), (2, "c"), (3, None), (4, "a")], "id long, s string")
    assert {r.id: [tuple(e) for e in r.entries] for r in words.encode(other, ["id"]).collect()} == {1: [], 2: [(1, 1.0)], 3: [], 4: []}
    assert {r.id: r.features.toArray().tolist() for r in words.vectors(other, ["id"]).collect()} == {1: [0, 0], 2: [0, 1], 3: [0, 0], 4: [0, 0]}
    assert SP.Vocabulary.fit(fit.limit(0), [], ["s"]).slots == 0


def _points(spark, n=800, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [1.5, -2.0, 0.3] + 0.4)))).astype(int)
    from pyspark.ml.functions import array_to_vector
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)], "id long, x array<double>, label int")
    return df.withColumn("features", array_to_vector("x")).repartition(5), x, y


def test_newton_reaches_the_optimum(spark):
    df, x, y = _points(spark)
    model = NT.fit_logistic(df, "label", penalty=0.01)
    p = 1 / (1 + np.exp(-(x @ model.coefficients + model.intercept)))
    assert np.abs(x.T @ (p - y) / len(y) + 0.01 * model.coefficients).max() < 1e-9 and abs((p - y).mean()) < 1e-9
    assert all(b <= a for a, b in zip(model.history, model.history[1:])) and len(model.history) < 12
    out = model.transform(df).select("id", "probability", "prediction").collect()
    assert all(abs(r.probability[1] - p[r.id]) < 1e-9 and r.prediction == (p[r.id] > 0.5) for r in out)
    assert np.allclose(NT.fit_logistic(df.repartition(2), "label", penalty=0.01).coefficients, model.coefficients, atol=1e-9)


def test_newton_on_odd_sets(spark):
    df, _, _ = _points(spark, 60)
    split = NT.fit_logistic(df.withColumn("label", (F.col("x")[0] > 0).cast("int")), "label", penalty=0.01)  # separable
    assert np.isfinite(split.coefficients).all() and split.coefficients[0] > 0
    one = NT.fit_logistic(df.withColumn("label", F.lit(1)), "label")
    assert one.intercept > 0 and not one.coefficients.any()
    with pytest.raises(ValueError):
        NT.fit_logistic(df.limit(0), "label")


def test_out_of_fold_margins_come_from_other_rows(spark):
    df, x, y = _points(spark, 300)
    fits = []

    def fit(rows):
        ids = {r.id for r in rows.select("id").collect()}
        model = NT.fit_logistic(rows, "label", penalty=0.01)
        fits.append((ids, model))
        return model
    got = NT.out_of_fold(df, "id", "label", fit).collect()
    assert sorted(r.key for r in got) == list(range(300)) and len(fits) == NT.FOLDS
    for r in got:
        others = [m for ids, m in fits if r.key not in ids]
        assert len(others) == 1 and abs(r.margin - (x[r.key] @ others[0].coefficients + others[0].intercept)) < 1e-9
    margins = spark.createDataFrame(got)
    slope, intercept = NT.platt_curve(margins)
    m, t = np.array([r.margin for r in got]), np.array([r.label for r in got])
    target = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    off = 1 / (1 + np.exp(-(slope * m + intercept))) - target
    assert abs(off.mean()) < 1e-8 and abs((off * m).mean()) < 1e-8
    assert NT.platt_curve(margins.where("label = 1")) is None
    assert NT.out_of_fold(df.where("label = 1"), "id", "label", fit).count() == 0


def test_eigenvalues_without_the_gram_matrix(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "vec array<double>").repartition(4)
    values = np.linalg.eigvalsh(x @ x.T)
    r = EV.eigenvalue_range(df, "vec").first()
    assert (r.n, r.rank, r.smallest_of_all) == (90, 6, 0.0)
    assert np.allclose([r.trace, r.frobenius2, r.largest, r.smallest], [values.sum(), (values ** 2).sum(), values[-1], values[-6]])
    few = EV.eigenvalue_range(df.limit(3), "vec").first()
    assert few.rank == 3 and few.smallest_of_all == few.smallest > 0
    assert EV.eigenvalue_range(df.limit(0), "vec").first().n == 0


def test_entries_are_summed_before_a_shuffled_join(spark):
    """A numeric slot has an entry in every row: only its sums are joined."""
    df = spark.range(500).select((F.col("id") % 2).cast("int").alias("y"), F.array(
        F.struct(F.lit(0).cast("long").alias("slot"), (F.col("id") % 7 + 1e9).alias("x")),
        F.struct((F.col("id") % 150 + 1).alias("slot"), F.lit(1.0).alias("x"))).alias("entries"))
    out = SP.f_scores(df, "y", 151)

    def children(node):
        return [node.children().apply(i) for i in range(node.children().size())]

    def whole(node):
        return node.nodeName() == "Generate" or node.nodeName() != "Aggregate" and any(map(whole, children(node)))

    def check(node):
        if node.nodeName() == "Join" and "broadcast" not in node.hint().toString():
            assert not any(map(whole, children(node)))
        for c in children(node):
            check(c)

    check(out._jdf.queryExecution().optimizedPlan())
    x, y = np.arange(500) % 7, np.arange(500) % 2
    between = sum((y == c).sum() * (x[y == c].mean() - x.mean()) ** 2 for c in (0, 1))
    within = sum(((x[y == c] - x[y == c].mean()) ** 2).sum() for c in (0, 1))
    got = {r.slot: r.f_score for r in out.collect()}
    assert len(got) == 151 and abs(got[0] - between / (within / 498)) < 1e-6
    z = (np.arange(500) % 150 == 4).astype(float)
    between = sum((y == c).sum() * (z[y == c].mean() - z.mean()) ** 2 for c in (0, 1))
    within = sum(((z[y == c] - z[y == c].mean()) ** 2).sum() for c in (0, 1))
    assert abs(got[5] - between / (within / 498)) < 1e-9
