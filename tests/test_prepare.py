import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import prepare as P
from calibra.operators import scale as N
from calibra.operators import split as E
from calibra.operators.order_stats import medians, select_ranks
from calibra.sources.tables import ENC_SPEC, encounters
from calibra.spec import FeatureSpec


def test_select_features_drops_absent_and_requires_target(spark, sf):
    enc = encounters(spark, sf)
    spec = FeatureSpec("id", ("acctbal", "missing_col", "price"), ("seg",), "y")
    out = P.select_features(enc, spec)
    assert out.columns == ["id", "acctbal", "price", "seg", "y"]
    with pytest.raises(KeyError):
        P.select_features(enc.drop("y"), spec)


def test_clean_has_no_nulls_and_keeps_rows(spark, sf):
    enc = encounters(spark, sf)
    out, params = P.clean(enc, ENC_SPEC, return_params=True)
    assert out.count() == enc.count()
    nulls = out.select([F.sum(F.col(c).isNull().cast("int")).alias(c) for c in out.columns]).first()
    assert all(v == 0 for v in nulls)
    # dummies: sorted vocab, first dropped
    assert params.vocab["seg"] == sorted(params.vocab["seg"])
    assert f"seg_{params.vocab['seg'][0]}" not in out.columns
    assert all(f"seg_{v}" in out.columns for v in params.vocab["seg"][1:])


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 4.0],
    [1.0, 2.0, 4.0, 10.0],
    [5.0] * 7 + [1.0, 9.0],           # hot value: a third or more of the rows
    [3.0, None, 1.0, None, 2.0, 2.0],
])
def test_exact_median_matches_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    got = medians(df, ["x"]).first()["median"]
    assert got == pytest.approx(float(np.median([v for v in values if v is not None])))


def test_median_of_a_coarse_sketch(spark):
    # few grid values: the bracket holds a good part of the rows
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).cast("double").alias("x"))
    got = medians(df, ["x"], grid=10, accuracy=1000).first()["median"]
    assert got == pytest.approx(2499.5)


def test_ranks_of_two_values(spark):
    """Half the rows share each value: counted as two rows, not ranked one by one."""
    df = spark.range(20_000).select((F.col("id") % 2).cast("double").alias("x"), F.col("id").alias("key"))
    assert medians(df, ["x"]).first()["median"] == 0.5
    got = select_ranks(df, [], "x", {"a": lambda n: F.lit(10_000), "b": lambda n: F.lit(10_001)}, tiebreak=("key",)).collect()
    assert {(r["tag"], r["value"], r["key"]) for r in got} == {("a", 0.0, 19_998), ("b", 1.0, 1)}


def test_rank_outside_its_bracket_raises(spark, monkeypatch):
    import calibra.operators.order_stats as O
    monkeypatch.setattr(O, "_bracket", lambda q, k, n, grid: (F.lit(1e9), F.lit(2e9)))
    with pytest.raises(ArithmeticError):
        medians(spark.range(10).select(F.col("id").cast("double").alias("x")), ["x"])


def test_select_ranks_with_ties(spark):
    df = spark.createDataFrame([(i % 3, float(i % 5), i) for i in range(60)], "g int, v double, key int")
    got = select_ranks(df, ["g"], "v", {"r": lambda n: F.lit(7)}, tiebreak=("key",)).orderBy("g").collect()
    pdf = df.toPandas().sort_values(["g", "v", "key"])
    assert len(got) == 3
    for r in got:
        exp = pdf[pdf.g == r["g"]].iloc[6]
        assert (r["value"], r["key"]) == (exp.v, exp.key)


def test_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "s string")
    m = P.modes_from_counts(P.category_counts(df, ["s"])).first()["mode"]
    assert m == "a"


def test_all_null_categorical_becomes_unknown(spark):
    df = spark.createDataFrame([(1, None, 0), (2, None, 1)], "id long, s string, y int")
    spec = FeatureSpec("id", (), ("s",), "y")
    out, params = P.clean(df, spec, return_params=True)
    assert params.fill["s"] == "Unknown" and params.vocab["s"] == ["Unknown"]
    assert out.columns == ["id", "y"]


def test_splits_disjoint_exhaustive_stable(spark, sf):
    enc = encounters(spark, sf).select("id", "y")
    base = {r["id"]: r["split"] for r in E.split_hash(enc, "id").collect()}
    assert len(base) == enc.count()
    for n in (1, 7, 64):
        again = {r["id"]: r["split"] for r in E.split_hash(enc.repartition(n), "id").collect()}
        assert again == base
    rate = enc.agg(F.avg("y")).first()[0]
    s = E.split_hash(enc, "id")
    for r in s.groupBy("split").agg(F.avg("y").alias("r")).collect():
        assert abs(r["r"] - rate) < 0.1


def test_split_exact_quotas(spark, sf):
    enc = encounters(spark, sf).select("id", "y")
    s = E.split_exact(enc.repartition(5), "id", "y")
    counts = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    for y, n in ((r["y"], r["count"]) for r in enc.groupBy("y").count().collect()):
        assert counts[(y, "test")] == int(np.ceil(0.2 * n))
        assert counts[(y, "val")] == int(np.ceil(0.1 * n))


def test_standardize_train_moments(spark, sf):
    enc, params = P.clean(encounters(spark, sf), ENC_SPEC, return_params=True)
    enc = E.split_hash(enc, "id")
    cols = params.encoded_columns
    z = N.standardize(enc, cols, fit_filter=F.col("split") == "train").where(F.col("split") == "train")
    st = z.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    for c in cols:
        assert abs(st[f"m_{c}"]) < 1e-7
        assert abs(st[f"s_{c}"] - 1.0) < 0.1 or st[f"s_{c}"] == 0.0


def test_top_k_exactly_k(spark, sf):
    enc, params = P.clean(encounters(spark, sf), ENC_SPEC, return_params=True)
    out, chosen = N.select_top_k(enc, params.encoded_columns, "y", 3, keep=["id"])
    assert len(chosen) == 3 and out.columns == ["id", *chosen]
    order = [params.encoded_columns.index(c) for c in chosen]
    assert order == sorted(order)


def test_anova_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    y = (rng.random(200) < 0.4).astype(int)
    x[y == 1] += 0.5
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    f = N.anova_f(df, ["x"], "y").first()["f_score"]
    groups = [x[y == k] for k in (0, 1)]
    ssb = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert f == pytest.approx((ssb / 1) / (ssw / (len(x) - 2)), rel=1e-9)


def test_subsample_edge_cases(spark):
    rows = [(i, 1 if i % 10 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, y int")
    s = E.subsample(df, "id", "y", 100)
    c = dict(s.groupBy("y").count().collect())
    assert c == {1: 50, 0: 50}
    s = E.subsample(df, "id", "y", 301)
    c = dict(s.groupBy("y").count().collect())
    assert c == {1: 100, 0: 201}               # too few positives: negatives fill
    assert E.subsample(df, "id", "y", 5000).count() == 1000   # n >= rows: all
    u = E.subsample(df, "id", "y", 77, balanced=False)
    assert u.count() == 77
    assert sorted(r.id for r in u.collect()) == sorted(
        r.id for r in E.subsample(df.repartition(9), "id", "y", 77, balanced=False).collect())


def test_inject_missing_rate(spark, sf):
    enc = encounters(spark, sf).select("id", "price")
    out = P.inject_missing(enc, ["price"], "id", rate=0.5)
    frac = out.agg(F.avg(F.col("price").isNull().cast("double"))).first()[0]
    assert 0.4 < frac < 0.6


def test_anova_degenerate_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 0), (1.0, 1)], "x double, y int")
    assert N.anova_f(df, ["x"], "y").first()["f_score"] is None
    one = spark.createDataFrame([(1.0, 0), (2.0, 0)], "x double, y int")
    assert N.anova_f(one, ["x"], "y").first()["f_score"] is None


def test_approx_median_close(spark):
    df = spark.range(10001).select(F.col("id").cast("double").alias("x"))
    got = medians(df, ["x"], approx=True).first()["median"]
    assert abs(got - 5000.0) <= 10001 / 100_000 + 1
    assert medians(df, ["x"]).first()["median"] == 5000.0


def test_top_k_ties_prefer_later_column(spark):
    rows = [(float(i % 7), float(i % 7), 0.0, i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    sc = N.anova_f(df, ["a", "b", "c"], "y")
    fa, fb = (sc.where(F.col("feature") == f).first()["f_score"] for f in ("a", "b"))
    assert fa == fb
    assert sc.where(F.col("feature") == "c").first()["f_score"] is None   # constant: no F
    assert [r.feature for r in N.top_k_features(sc, 1).collect()] == ["b"]
    assert [r.feature for r in N.top_k_features(sc, 2).collect()] == ["a", "b"]


def test_all_null_numeric_column_stays_null(spark):
    df = spark.createDataFrame([(1, None, 1.0, 0), (2, None, 2.0, 1), (3, None, None, 0)],
                               "id long, a double, b double, y int")
    spec = FeatureSpec("id", ("a", "b"), (), "y")
    out, params = P.clean(df, spec, return_params=True)
    assert "a" not in params.fill and params.fill["b"] == 1.5
    rows = {r.id: r for r in out.collect()}
    assert rows[3].b == 1.5 and rows[1].a is None


def test_dummies_of_a_large_vocabulary(spark):
    rows = [(i, f"v{i % 1200:04d}", i % 2) for i in range(2400)]
    out, params = P.clean(spark.createDataFrame(rows, "id long, big string, y int"), FeatureSpec("id", (), ("big",), "y"), return_params=True)
    assert params.encoded_columns == [f"big_v{i:04d}" for i in range(1, 1200)]


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_subsample_beyond_the_heaps(spark, monkeypatch, kind):
    """The cut has the key's type, and copies of a key give no row too many."""
    monkeypatch.setattr(E, "HEAP_ROWS", 10)
    df = spark.range(200).select(F.col("id").cast(kind).alias("id"), (F.col("id") % 2).cast("int").alias("y"))
    want = df.withColumn("h", E.hash_hex("id", 42)).orderBy("h", "id").limit(77)
    got = E.subsample(df, "id", "y", 77, balanced=False)
    assert got.columns == ["id", "y"] and {r.id for r in got.collect()} == {r.id for r in want.collect()}
    assert E.subsample(df.unionByName(df).unionByName(df.limit(1).withColumn("id", F.lit(None).cast(kind))), "id", "y", 77, balanced=False).count() == 77


def test_impute_binary_draws_its_rows_once(spark, sf):
    from calibra.plans.queries import impute_binary
    assert "md5" not in impute_binary(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
