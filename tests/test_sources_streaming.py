import uuid

import pytest
from pyspark.sql import functions as F

from calibra.session import checkpoint_dir
from calibra.sources import files as S
from calibra.sources.synthetic import MISSING_COLUMNS, synthetic_encounters, synthetic_range
from calibra.sources.tables import encounters


def _scratch(spark, tag):
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def test_synthetic_schema_rates_and_determinism(spark):
    df = synthetic_range(spark, 3000)
    assert df.columns[:2] == ["encounter_id", "patient_id"] and df.columns[-1] == "hospital_death"
    st = df.agg(F.avg("hospital_death").alias("y"), F.avg(F.col("age").isNull().cast("double")).alias("m"),
                F.min("age").alias("lo"), F.max("age").alias("hi"),
                F.sum(F.col("gcs_eyes_apache").isNull().cast("int")).alias("gcs_null")).first()
    assert 0.1 < st.y < 0.4 and 0.015 < st.m < 0.05
    assert st.lo >= 16 and st.hi <= 95 and st.gcs_null == 0
    a = {tuple(r) for r in synthetic_range(spark, 500).collect()}
    b = {tuple(r) for r in synthetic_encounters(spark.range(500).repartition(7), "id").collect()}
    assert a == b
    assert len(MISSING_COLUMNS) == 14


def test_csv_round_trip_keeps_nulls(spark, sf):
    enc = encounters(spark, sf)
    path = _scratch(spark, "csv")
    S.write_csv(enc, path)
    back = S.read_csv(spark, path, schema=enc.schema)
    assert sorted(back.collect()) == sorted(enc.collect())
    assert back.where(F.col("acctbal").isNull()).count() == enc.where(F.col("acctbal").isNull()).count()


def test_nan_normalised_to_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert S.nan_to_null(df).where(F.col("x").isNull()).count() == 1


def test_prepared_partition_pruning(spark, sf):
    enc = encounters(spark, sf).withColumn("split", F.when(F.col("y") == 1, "a").otherwise("b"))
    path = _scratch(spark, "prep")
    S.write_prepared(enc, path)
    only = S.read_prepared(spark, path, split="a")
    assert only.count() == enc.where("y = 1").count()
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_resolve_source_fallback(spark, sf):
    got = S.resolve_source(spark, ["/nonexistent/x.parquet", f"{sf}/region.parquet"])
    assert got.count() == 5
    fb = S.resolve_source(spark, ["/nonexistent/y.csv"], fallback=lambda s: synthetic_range(s, 10))
    assert fb.count() == 10
    with pytest.raises(FileNotFoundError):
        S.resolve_source(spark, ["/nonexistent/z.parquet"])


def test_streaming_equals_batch(spark, sf):
    from calibra.plans import queries as Q
    batch = sorted(tuple(r) for r in Q.standardize(spark, sf).collect())
    stream = Q.streaming_standardize(spark, sf)
    assert sorted(tuple(r) for r in stream.select(*Q.standardize(spark, sf).columns).collect()) == batch


def test_synthetic_prepares_to_29_features(spark):
    from calibra.plans.benchmark import prepare_data
    from calibra.sources.synthetic import SYN_SPEC
    data, feats = prepare_data(synthetic_range(spark, 600), SYN_SPEC)
    assert len(feats) == 29
    assert feats[:17] == list(SYN_SPEC.numeric) and feats[17] == "elective_surgery"
    assert feats[18] == "gender_M" and feats[19] == "ethnicity_Asian" and feats[-1] == "icu_type_SICU"
    nulls = data.select([F.sum(F.col(c).isNull().cast("int")) for c in feats]).first()
    assert all(v == 0 for v in nulls)


def test_stream_features_and_model_scoring(spark, sf):
    """The cos2 vector and a fitted model are narrow: the same objects score a
    stream."""
    from pyspark.ml.functions import array_to_vector

    from calibra.operators import kernels as K
    from calibra.operators import models as M
    from calibra.plans import queries as Q
    from calibra.streaming.scoring import run_available_now
    batch, cols = Q.selected_vectors(spark, sf)
    features = lambda d: K.cos2_features(d, cols).withColumn("features", array_to_vector("vec"))
    train = features(batch).withColumn("label", F.col("cls").cast("double"))
    model = M.estimator("logreg", 500, max_iter=10).fit(train)
    path = str(sf)
    raw = spark.read.parquet(f"{path}/embeddings.parquet")
    stream = (spark.readStream.schema(raw.schema).option("pathGlobFilter", "embeddings.parquet").parquet(path))
    dims = [int(c[1:]) - 1 for c in cols]
    pick = lambda d: d.select("vec_id", (F.col("label") % 2).cast("int").alias("cls"),
                              *[F.col("embedding")[i].cast("double").alias(c) for i, c in zip(dims, cols)])
    params = {r["feature"]: (r["mean"], r["std"]) for r in Q.N.fit_scaler(pick(raw), cols).collect()}
    scored = M.score(model, features(Q.N.apply_scaler(pick(stream), params)), "m", "vec_id", "cls")
    out = spark.read.parquet(run_available_now(scored))
    assert out.count() == raw.count()
    exp = {r.key: r.score for r in M.score(model, train, "m", "vec_id", "cls").collect()}
    assert all(abs(r.score - exp[r.key]) < 1e-9 for r in out.collect())


def test_only_absence_is_passed_over(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"this is no parquet file")
    with pytest.raises(Exception, match="(?i)parquet|footer|schema"):
        S.resolve_source(spark, [str(tmp_path / "bad.parquet")], fallback=lambda s: s.range(1)).count()
    nan = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    nan.write.parquet(str(tmp_path / "nan.parquet"))
    got = S.resolve_source(spark, [str(tmp_path / "gone.parquet"), str(tmp_path / "nan.parquet")])
    assert sorted(str(r.x) for r in got.collect()) == ["1.0", "None"]


def test_session_follows_the_cluster(spark, monkeypatch):
    import calibra.session as session
    asked = {}

    class Builder:
        def appName(self, _):
            return self

        def master(self, m):
            asked["master"] = m
            return self

        def config(self, k, v):
            asked[k] = v
            return self

        def getOrCreate(self):
            return spark

    monkeypatch.setattr(session.SparkSession, "builder", Builder())
    session.get_spark()
    assert "master" not in asked and "spark.sql.shuffle.partitions" not in asked and "spark.driver.memory" not in asked


def test_no_own_folder_off_local_mode(spark, monkeypatch):
    import calibra.session as session

    class Unset:
        """A session on a cluster, without a checkpoint folder."""
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Unset())


def test_each_draw_is_made_once(spark):
    """One loop per group of draws, with the numbers of ``hash_uniform``."""
    from calibra.functions.hashing import hash_begin, hash_uniform, uniform
    df = synthetic_range(spark, 50)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("md5(") <= 5
    keys = spark.range(50).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("id")))
    pairs = keys.select(hash_uniform("id", 42, "age:a").alias("a"), uniform(F.concat(hash_begin("id", 42), F.lit("age:a"))).alias("b"))
    assert all(r.a == r.b for r in pairs.collect())
