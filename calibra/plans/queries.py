"""Registered queries: each reads the given tables from ``sf_dir`` and returns a
lazy DataFrame.  Floats are rounded to 6 digits so that the DuckDB oracle in
``calibra.plans.oracle`` can be compared value by value."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions.scalar import clip, round6, sigmoid
from calibra.operators import kernels as K
from calibra.operators import metrics as V
from calibra.operators import models as M
from calibra.operators import newton as NT
from calibra.operators import prepare as P
from calibra.operators import profile as G
from calibra.operators import random_maps as RM
from calibra.operators import results as R
from calibra.operators import scale as N
from calibra.operators import sparse as SP
from calibra.operators import spectrum as EV
from calibra.operators import split as E
from calibra.operators.order_stats import medians
from calibra.operators.value_blocks import ValueBlocks
from calibra.plans.benchmark import Benchmark
from calibra.session import scratch_path, staged
from calibra.sources import buckets as B
from calibra.sources import files as S
from calibra.sources import synthetic as SY
from calibra.sources.tables import (ENC_SPEC, TOXIC_SPEC, documents_labeled, encounters,
                                    encounters_from, read_table, vectors)
from calibra.spec import FeatureSpec
from calibra.streaming.scoring import prepare_stream, run_available_now

SEED = 42


def _r6(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round every floating column (not in ``keep``) to 6 digits."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float") and f.name not in keep:
            out.append(round6(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ---------------------------------------------------------------- preparation
def curated_projection(spark: SparkSession, sf: str) -> DataFrame:
    return P.select_features(encounters(spark, sf), ENC_SPEC)


def drop_null_target(spark: SparkSession, sf: str) -> DataFrame:
    """P2 on a view whose outcome is missing for one key in 32."""
    gone = F.md5(F.concat(F.col("id").cast("string"), F.lit(":y"))) < "08"
    enc = encounters(spark, sf).withColumn("y", F.when(gone, F.lit(None)).otherwise(F.col("y")))
    return P.drop_null_target(P.select_features(enc, ENC_SPEC), ENC_SPEC)


def head(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of the encounter view, by key."""
    return encounters(spark, sf).orderBy("id").limit(5)


def clip_columns(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer")
    return c.select("c_custkey", clip("c_acctbal", 0.0, 5000.0).alias("acctbal_clipped"))


def inject_missing(spark: SparkSession, sf: str) -> DataFrame:
    e = encounters(spark, sf).select("id", "price", "priority")
    return P.inject_missing(e, ["price", "priority"], "id", rate=0.03, seed=SEED)


def missing_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(G.missing_fraction(encounters(spark, sf)))


def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(medians(encounters(spark, sf), ["acctbal", "price"]))


def impute_median_discrete(spark: SparkSession, sf: str) -> DataFrame:
    """I1 on columns of very few values: half the rows share one."""
    li = read_table(spark, sf, "lineitem")
    return _r6(medians(li.select((F.col("l_orderkey") % 2).alias("parity"), (F.col("l_orderkey") % 3).alias("third"),
                                 F.lit(7).alias("same")), ["parity", "third", "same"]))


def impute_median_appended(spark: SparkSession, sf: str) -> DataFrame:
    """I1 on data that came in three appends: only blocks at the medians are
    read again."""
    li = read_table(spark, sf, "lineitem")
    store = ValueBlocks(spark, _scratch(spark, "blocks"))
    number = F.col("l_linenumber")
    for batch in (number <= 2, (number > 2) & (number <= 4), number > 4):
        store.append(li.where(batch), LINE_FEATURES)
    return _r6(store.medians())


def impute_binary(spark: SparkSession, sf: str) -> DataFrame:
    """A 0/1 column with missing values, filled by its median."""
    keys = read_table(spark, sf, "orders").select("o_orderkey")
    syn = SY.synthetic_encounters(keys, "o_orderkey", seed=SEED).select("encounter_id", "elective_surgery", "hospital_death")
    # the medians take several passes: draw the rows once
    syn = staged(P.inject_missing(syn, ["elective_surgery"], "encounter_id", rate=0.1, seed=SEED), "drawn")
    spec = FeatureSpec("encounter_id", ("elective_surgery",), (), "hospital_death")
    return _r6(P.clean(syn, spec).select("encounter_id", F.col("elective_surgery").cast("double").alias("elective_surgery")))


def clean_nan(spark: SparkSession, sf: str) -> DataFrame:
    """I5 where missing numbers are NaN: the same result as with NULL."""
    enc = encounters(spark, sf).withColumn("acctbal", F.coalesce(F.col("acctbal").cast("double"), F.lit(float("nan"))))
    return _r6(P.clean(enc, ENC_SPEC))


def missing_fraction_nan(spark: SparkSession, sf: str) -> DataFrame:
    enc = encounters(spark, sf).withColumn("acctbal", F.coalesce(F.col("acctbal").cast("double"), F.lit(float("nan"))))
    return _r6(G.missing_fraction(enc))


def impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    counts = P.category_counts(encounters(spark, sf), ["seg", "priority"])
    return P.modes_from_counts(counts)


def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    enc = staged(encounters(spark, sf), "encounters")
    params = P.fit_clean(enc, ENC_SPEC)
    return P.one_hot(P.impute(enc, params), params).drop("acctbal", "price", "y")


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(P.clean(staged(encounters(spark, sf), "encounters"), ENC_SPEC))


def split_hash(spark: SparkSession, sf: str) -> DataFrame:
    return E.split_hash(encounters(spark, sf).select("id", "y"), "id", seed=SEED)


def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    return E.split_exact(encounters(spark, sf).select("id", "y"), "id", "y", seed=SEED)


def split_exact_fractions(spark: SparkSession, sf: str) -> DataFrame:
    """Other shares than the defaults, and a label of three classes."""
    li = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("y"))
    return E.split_exact(li, "id", "y", seed=7, test=0.35, val=0.15)


def split_balance(spark: SparkSession, sf: str) -> DataFrame:
    s = E.split_hash(encounters(spark, sf).select("id", "y"), "id", seed=SEED)
    return _r6(s.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                      F.avg("y").alias("positive_rate")))


def _prepared_enc(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    # read and joined once: medians, categories, moments and the result follow
    enc = staged(P.select_features(encounters(spark, sf), ENC_SPEC), "encounters")
    df, params = P.clean(enc, ENC_SPEC, return_params=True)
    df = E.split_hash(df, "id", seed=SEED)
    return df, params.encoded_columns


def scale_params(spark: SparkSession, sf: str) -> DataFrame:
    df, cols = _prepared_enc(spark, sf)
    return _r6(N.fit_scaler(df.where(F.col("split") == "train"), cols))


def standardize(spark: SparkSession, sf: str) -> DataFrame:
    df, cols = _prepared_enc(spark, sf)
    return _r6(N.standardize(df, cols, fit_filter=F.col("split") == "train"))


def _toxic(spark: SparkSession, sf: str) -> DataFrame:
    return documents_labeled(spark, sf)


def anova_f(spark: SparkSession, sf: str) -> DataFrame:
    d = _toxic(spark, sf)
    return _r6(N.anova_f(d, list(TOXIC_SPEC.numeric), "toxic"))


LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lineitem_labeled(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.select(*LINE_FEATURES, (F.col("l_returnflag") == "R").cast("int").alias("y"))


def anova_f_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(N.anova_f(_lineitem_labeled(spark, sf), LINE_FEATURES, "y"))


def anova_f_shifted(spark: SparkSession, sf: str) -> DataFrame:
    """N2 on features moved by 10^9: F must not change."""
    li = _lineitem_labeled(spark, sf)
    moved = li.select(*[(F.col(c) + 1e9).alias(c) for c in ("l_quantity", "l_extendedprice")], "y")
    return N.anova_f(moved, ["l_quantity", "l_extendedprice"], "y").withColumn("f_score", F.round("f_score", 2))


def top_k_perfect(spark: SparkSession, sf: str) -> DataFrame:
    """A feature that separates the classes perfectly comes first, a
    constant one (no F at all) last."""
    li = _lineitem_labeled(spark, sf).select("l_quantity", (F.col("y") * 3.0).alias("perfect"), F.lit(1.0).alias("same"), "y")
    return N.top_k_features(N.anova_f(li, ["l_quantity", "perfect", "same"], "y"), 3).select(
        "feature", "rank", F.col("f_score").isNotNull().alias("has_f"),
        F.coalesce(F.col("f_score") == float("inf"), F.lit(False)).alias("infinite"))


def select_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The two best features by the training rows, of the test rows, long."""
    enc = staged(P.select_features(encounters(spark, sf), ENC_SPEC), "encounters")
    df = E.split_hash(P.clean(enc, ENC_SPEC), "id", seed=SEED)
    cols = [c for c in df.columns if c not in ("id", "y", "split")]
    chosen, best = N.select_top_k(df, cols, "y", 2, keep=["id", "split"], fit_filter=F.col("split") == "train")
    test = chosen.where(F.col("split") == "test").select("id", *[F.col(f"`{c}`").cast("double").alias(c) for c in best])
    return _r6(test.unpivot(["id"], best, "feature", "x"))


#: Line items with a string column of very many values (each part is one).
CODED_LINES = ["l_quantity", "l_discount"]


def _coded_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, SP.Vocabulary]:
    li = read_table(spark, sf, "lineitem")
    part = F.when(F.col("l_linenumber") != 7, F.concat(F.lit("P"), F.col("l_partkey").cast("string")))
    rows = staged(li.select("l_orderkey", "l_linenumber", *CODED_LINES, part.alias("part"), F.col("l_linestatus").alias("status"),
                            (F.col("l_returnflag") == "R").cast("int").alias("y")), "lines")
    return rows, SP.Vocabulary.fit(rows, CODED_LINES, ["part", "status"])


def sparse_entries(spark: SparkSession, sf: str) -> DataFrame:
    """I4 in one schema for any vocabulary: slots and values of each line."""
    rows, words = _coded_lines(spark, sf)
    coded = words.encode(rows, ["l_orderkey", "l_linenumber"])
    return _r6(coded.select("l_orderkey", "l_linenumber", F.inline("entries")))


def sparse_moments(spark: SparkSession, sf: str) -> DataFrame:
    """N1 on sparse rows: mean and deviation of every slot."""
    rows, words = _coded_lines(spark, sf)
    found = SP.moments(staged(words.encode(rows, ["y"]), "entries"), words.slots)
    return found.select("slot", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


def sparse_f_scores(spark: SparkSession, sf: str) -> DataFrame:
    """N2 on sparse rows: F of every slot against the class."""
    rows, words = _coded_lines(spark, sf)
    return _r6(SP.f_scores(staged(words.encode(rows, ["y"]), "entries"), "y", words.slots))


def top_k_features(spark: SparkSession, sf: str) -> DataFrame:
    d = _toxic(spark, sf)
    sc = N.anova_f(d, list(TOXIC_SPEC.numeric), "toxic")
    return _r6(N.top_k_features(sc, 3))


# ------------------------------------------------------------ scored frames
def _doc_rules():
    return [
        (F.lit("punct"), -F.col("punct_ratio"), (F.col("punct_ratio") < 0.1).cast("int")),
        (F.lit("length"), F.col("words").cast("double"), (F.col("words") > 300).cast("int")),
        (F.lit("digits"), F.col("digit_ratio"), (F.col("digit_ratio") > 0.001).cast("int")),
    ]


def scored_documents(spark: SparkSession, sf: str, labels: dict[str, str] | None = None) -> DataFrame:
    """Three text rules scored against a label -- one scan, rules exploded.

    ``labels`` maps a prefix to a label column to score several targets in
    the same pass (model names become ``prefix/rule``)."""
    d = _toxic(spark, sf)
    labels = labels or {"": "quality"}
    rows = []
    for prefix, lab in labels.items():
        for name, score, pred in _doc_rules():
            model = F.concat(F.lit(prefix + "/"), name) if prefix else name
            rows.append(F.struct(model.alias("model"), F.col(lab).alias("label"),
                                 pred.alias("prediction"), score.alias("score")))
    return d.select("doc_id", F.explode(F.array(*rows)).alias("r")).select(
        "r.model", "doc_id", "r.label", "r.prediction", "r.score")


def scored_encounters(spark: SparkSession, sf: str) -> DataFrame:
    e = encounters(spark, sf)
    rules = F.array(
        F.struct(F.lit("price").alias("model"), F.col("price").alias("score"),
                 (F.col("price") > 250000.0).cast("int").alias("prediction")),
        F.struct(F.lit("acctbal").alias("model"), F.coalesce(F.col("acctbal"), F.lit(0.0)).alias("score"),
                 (F.coalesce(F.col("acctbal"), F.lit(0.0)) > 4500.0).cast("int").alias("prediction")))
    return e.select("id", F.col("y").alias("label"), F.explode(rules).alias("r")).select(
        "r.model", "id", "label", "r.prediction", "r.score")


def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(G.class_balance(encounters(spark, sf), "y"))


def positive_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(G.positive_rate(_toxic(spark, sf), "toxic"))


def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(G.corr_matrix(_toxic(spark, sf), list(TOXIC_SPEC.numeric) + ["quality"]))


def class_kde(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(G.class_kde(_toxic(spark, sf), "punct_ratio", "quality", grid=200))


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return G.confusion(scored_documents(spark, sf))


def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(V.binary_metrics(scored_documents(spark, sf)))


def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(V.roc_auc(scored_encounters(spark, sf)))


def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(V.average_precision(scored_encounters(spark, sf)))


def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(V.roc_curve(scored_encounters(spark, sf)))


def pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(V.pr_curve(scored_encounters(spark, sf)))


# ------------------------------------------------------------------ kernels
GAMMA = 0.1


def selected_vectors(spark: SparkSession, sf: str, k: int = 3) -> tuple[DataFrame, list[str]]:
    """The ``k`` embedding dimensions with the best ANOVA F over the class, out
    of all of them, standardised: (vec_id, cls, e1...)."""
    v = staged(vectors(spark, sf), "vectors")
    dims = v.select(F.size("embedding").alias("d")).first()["d"]
    cols = [f"e{i + 1}" for i in range(dims)]
    wide = v.select("vec_id", "cls", *[F.col("embedding")[i].alias(c) for i, c in enumerate(cols)])
    best = [r["feature"] for r in N.top_k_features(N.anova_f(wide, cols, "cls"), k).collect()]
    return N.standardize(wide.select("vec_id", "cls", *best), best), best


def cos2_features(spark: SparkSession, sf: str) -> DataFrame:
    """K2: the explicit vector of the cos2 kernel, entry by entry."""
    df, cols = selected_vectors(spark, sf)
    return _r6(K.cos2_features(df, cols).select("vec_id", F.posexplode("vec").alias("i", "x")))


def cos2_kernel_stats(spark: SparkSession, sf: str) -> DataFrame:
    df, cols = selected_vectors(spark, sf)
    return _r6(K.kernel_stats(K.kernel_sums(K.cos2_features(df, cols), "vec", "cls")))


def cos2_kernel_blocks(spark: SparkSession, sf: str) -> DataFrame:
    df, cols = selected_vectors(spark, sf)
    return _r6(K.kernel_blocks(K.kernel_sums(K.cos2_features(df, cols), "vec", "cls")))


def cos2_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """K8: rows, trace and squared Frobenius norm of the cos2 Gram matrix, from
    the d x d matrix that has its eigenvalues."""
    df, cols = selected_vectors(spark, sf)
    return _r6(EV.eigenvalue_range(K.cos2_features(df, cols), "vec").select("n", "trace", "frobenius2"))


def cos2_eigenvalues(spark: SparkSession, sf: str) -> DataFrame:
    """K8: the range of the eigenvalues of the cos2 Gram matrix."""
    df, cols = selected_vectors(spark, sf)
    return _r6(EV.eigenvalue_range(K.cos2_features(df, cols), "vec").select("n", "rank", "largest", "smallest", "smallest_of_all"))


def _fourier(spark: SparkSession, sf: str, kernel: K.Kernel, places: int) -> DataFrame:
    """Whole embeddings with the random Fourier features of a kernel."""
    v = vectors(spark, sf)
    first = v.select(F.size("embedding")).first()
    return RM.fourier_features(v, "embedding", RM.frequencies(kernel, first[0] if first else 1, places, SEED))


def rbf_fourier_features(spark: SparkSession, sf: str) -> DataFrame:
    """K7/M1: the drawn vector of the RBF kernel, entry by entry."""
    rows = _fourier(spark, sf, K.make_kernel("rbf", gamma=GAMMA), 16)
    return _r6(rows.select("vec_id", F.posexplode("fourier").alias("i", "x")))


def cos2_fourier_features(spark: SparkSession, sf: str) -> DataFrame:
    """K2/M2: the drawn vector of the cos2 kernel over all dimensions of an
    embedding, whose exact vector no row could hold."""
    rows = _fourier(spark, sf, K.make_kernel("cos2"), 16)
    return _r6(rows.select("vec_id", F.posexplode("fourier").alias("i", "x")))


def rbf_fourier_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """K10 of the RBF kernel without pairs: mean over the rows of two classes,
    by drawn features."""
    rows = _fourier(spark, sf, K.make_kernel("rbf", gamma=GAMMA), 256)
    return _r6(K.kernel_blocks(K.kernel_sums(rows, "fourier", "cls")))


def kernel_stats(spark: SparkSession, sf: str) -> DataFrame:
    """K8 of the linear kernel over whole embeddings."""
    return _r6(K.kernel_stats(K.kernel_sums(vectors(spark, sf), "embedding", "cls")))


def kernel_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """K10 of the linear kernel over whole embeddings."""
    return _r6(K.kernel_blocks(K.kernel_sums(vectors(spark, sf), "embedding", "cls")))


def cross_gram(spark: SparkSession, sf: str) -> DataFrame:
    """K5: every embedding against every one whose id is divisible by 20."""
    v = vectors(spark, sf)
    return _r6(K.cross_gram(v, "vec_id", "embedding", v.where("vec_id % 20 = 0"), "vec_id", "embedding",
                            K.make_kernel("rbf", gamma=GAMMA)))


def cross_gram_cos2(spark: SparkSession, sf: str) -> DataFrame:
    """The kernel called by name in any case, on the three best
    dimensions: every row against every one whose id is divisible by 20."""
    df, cols = selected_vectors(spark, sf)
    v = df.select("vec_id", F.array(*cols).alias("vec"))
    return _r6(K.cross_gram(v, "vec_id", "vec", v.where("vec_id % 20 = 0"), "vec_id", "vec", K.make_kernel("Cos2")))


def kernel_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """K9: first 60 rows of the hash-shuffled table, class-sorted positions,
    full 60 x 60 Gram."""
    first = E.subsample(vectors(spark, sf), "vec_id", "cls", 60, seed=SEED, balanced=False)
    return _r6(K.heatmap(first, "vec_id", "embedding", "cls", K.make_kernel("rbf", gamma=GAMMA)))


# ------------------------------------------------------------------- models
def _bench(spark: SparkSession, sf: str):
    return Benchmark(spark, _toxic(spark, sf), replace(TOXIC_SPEC, target="quality"))


def logreg_scores(spark: SparkSession, sf: str) -> DataFrame:
    b = _bench(spark, sf)
    b.baseline(("logreg",))
    return b.scored["classical"]


def forest_scores(spark: SparkSession, sf: str) -> DataFrame:
    b = _bench(spark, sf)
    b.baseline(("random_forest",))
    return b.scored["classical"]


def svm_rbf_scores(spark: SparkSession, sf: str) -> DataFrame:
    b = _bench(spark, sf)
    b.baseline(("svm_rbf",))
    return b.scored["classical"]


def cos2_svm_scores(spark: SparkSession, sf: str) -> DataFrame:
    """M2/O3: scores of the cos2 kernel SVM on the test split."""
    b = _bench(spark, sf)
    b.kernel_svm()
    return b.scored["qsvm"]


def logreg_gradient(spark: SparkSession, sf: str) -> DataFrame:
    """M3: gradient of the fitted objective at its optimum, over all training
    rows: zero for every feature."""
    b = _bench(spark, sf)
    b.baseline(("logreg",))
    p = b.data()
    train = M.assemble(p.data.where(F.col("split") == "train"), p.features)
    g = M.logreg_gradient(b.fitted["logreg"].model, train, p.label, p.features)
    return g.select("feature", (F.round("gradient", 3) + 0.0).alias("gradient"))


def platt_gradient(spark: SparkSession, sf: str) -> DataFrame:
    """M1/M6: gradient of Platt's objective at the curve fitted to out-of-fold
    margins, over all training rows: zero."""
    b = _bench(spark, sf)
    p = b.data()
    train = staged(M.assemble(p.data.where(F.col("split") == "train"), p.features).select(p.key, p.label, "features"), "train")
    est = M.estimator("logreg", train.count()).setLabelCol(p.label)
    margins = staged(NT.out_of_fold(train, p.key, p.label, est.fit), "margins")
    slope, intercept = NT.platt_curve(margins) or (0.0, 0.0)
    rows = NT.platt_targets(margins)
    off = F.col("weight") * (sigmoid(F.col("margin") * F.lit(slope) + F.lit(intercept)) - F.col("label"))
    g = rows.agg(F.count(F.lit(1)).alias("n"), (F.sum(off * F.col("margin")) / F.sum("weight")).alias("slope"), (F.sum(off) / F.sum("weight")).alias("intercept"))
    # each row stands for both classes; all training rows have a margin
    return g.select((F.lit(train.count()) - F.col("n") / 2).cast("long").alias("missing"), (F.round("slope", 4) + 0.0).alias("slope"), (F.round("intercept", 4) + 0.0).alias("intercept"))


def loss_history(spark: SparkSession, sf: str) -> DataFrame:
    """M9/V8: the objective by iteration of the logistic regression."""
    b = _bench(spark, sf)
    b.baseline(("logreg",))
    return spark.createDataFrame(M.loss_history(b.fitted["logreg"].model, "logreg"), "model string, iter int, loss double")


def one_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of positive rows only: no curve metrics, and balanced
    accuracy is that of the one class."""
    return _r6(V.binary_metrics(scored_documents(spark, sf).where("label = 1")))


def benchmark_report(spark: SparkSession, sf: str) -> DataFrame:
    b = _bench(spark, sf)
    return b.run_all(side_by_side=True)


# ------------------------------------------------------------------ results
def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Three blocks of rule-model metrics in one frame, computed in ONE metrics
    pass over one document scan: the block is folded into the model name."""
    cols = ["model", "label", "prediction", "score"]
    docs = scored_documents(spark, sf, {"classical": "quality", "bonus": "toxic"}).select(*cols)
    enc = scored_encounters(spark, sf).select(
        F.concat(F.lit("qsvm/"), "model").alias("model"), *cols[1:])
    allm = V.binary_metrics(docs.unionByName(enc))
    parts = F.split(F.col("model"), "/", 2)
    return allm.select(parts[0].alias("block"), parts[1].alias("model"), "metric",
                       F.col("value").cast("double").alias("value"))


def upsert_results(spark: SparkSession, sf: str) -> DataFrame:
    res = staged(_results(spark, sf), "results")
    return _r6(R.upsert(res.where("block <> 'bonus'"), res.where("block = 'classical' AND model = 'punct'")))


def results_store(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs commit their blocks to the store; its latest version."""
    res = staged(_results(spark, sf), "results")
    base = _scratch(spark, "store")
    R.upsert_store(spark, base, res.where("block <> 'bonus'"))
    R.upsert_store(spark, base, res.where("block = 'classical' AND model = 'punct'"))
    return _r6(R.load_store(spark, base))


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    return R.flatten(_results(spark, sf))


def flatten_results(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(_flat(spark, sf))


def model_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(R.rank_models(_flat(spark, sf)))


def metric_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(R.pivot_metrics(_flat(spark, sf)))


def metric_bars(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(R.metric_bars(_flat(spark, sf), "roc_auc"))


def readme_table(spark: SparkSession, sf: str) -> DataFrame:
    flat = staged(_flat(spark, sf), "flat")
    return R.markdown_rows(flat.select("model", "metric", F.round("value", 6).alias("value")))


def results_json(spark: SparkSession, sf: str) -> DataFrame:
    """The nested document, values rounded to 6 digits."""
    return R.nested_json(_r6(_results(spark, sf)))


# ------------------------------------------------------- sources and sinks
def _scratch(spark: SparkSession, tag: str) -> str:
    return scratch_path(spark, tag)


def synthetic_table(spark: SparkSession, sf: str) -> DataFrame:
    """One synthetic encounter per order key."""
    keys = read_table(spark, sf, "orders").select("o_orderkey")
    return _r6(SY.synthetic_encounters(keys, "o_orderkey", seed=SEED))


def synthetic_label(spark: SparkSession, sf: str) -> DataFrame:
    keys = read_table(spark, sf, "orders").select("o_orderkey")
    s = SY.synthetic_encounters(keys, "o_orderkey", seed=SEED)
    return s.groupBy("hospital_death").agg(F.count(F.lit(1)).alias("n"))


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Encounters -> header CSV with NA markers -> read with schema."""
    enc = encounters(spark, sf)
    path = _scratch(spark, "csv")
    S.write_csv(enc, path)
    return S.read_csv(spark, path, schema=enc.schema)


def prepared_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S3: standardised rows written partitioned by split, read back."""
    path = _scratch(spark, "prepared")
    S.write_prepared(standardize(spark, sf), path)
    return S.read_prepared(spark, path)


def source_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The first source is absent, so the second is read."""
    found = S.resolve_source(spark, [_scratch(spark, "absent"), f"{sf.rstrip('/')}/customer.parquet"])
    return found.select("c_custkey", "c_mktsegment", "c_acctbal")


def gather_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem rows of the orders that fall in the test split (semi join)."""
    test_keys = E.split_hash(encounters(spark, sf).select("id"), "id", seed=SEED).where(
        F.col("split") == "test")
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return li.join(test_keys, li.l_orderkey == test_keys.id, "left_semi")


def gather_rows_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """P7/J2 on bucketed tables: the same rows, joined without a shuffle."""
    keys = E.split_hash(encounters(spark, sf).select("id"), "id", seed=SEED)
    # as many buckets as the session's shuffles have partitions
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = B.bucketed(keys, "id", n)
    li = B.bucketed(read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", n)
    test = keys.where("split = 'test'")
    return li.join(test, li["l_orderkey"] == test["id"], "left_semi")


def kernel_test_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The held-out sample that goes with 1000 training rows of a kernel
    model, by the next seed, from the test split."""
    enc = E.split_hash(encounters(spark, sf).select("id", "y"), "id", seed=SEED)
    test = staged(enc.where("split = 'test'").select("id", "y"), "test")
    return E.subsample(test, "id", "y", E.test_sample_size(1000), SEED + 1)


def balanced_subsample(spark: SparkSession, sf: str) -> DataFrame:
    """100 rows, half toxic, by hash order."""
    d = _toxic(spark, sf).select("doc_id", "toxic")
    return E.subsample(d, "doc_id", "toxic", 100, seed=SEED)


def large_subsample(spark: SparkSession, sf: str) -> DataFrame:
    """E4 beyond the heaps: two thirds of the orders by hash order."""
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return E.subsample(o, "id", "y", 2 * o.count() // 3, seed=SEED, balanced=False)


def uniform_subsample(spark: SparkSession, sf: str) -> DataFrame:
    d = _toxic(spark, sf).select("doc_id", "toxic")
    return E.subsample(d, "doc_id", "toxic", 100, seed=SEED, balanced=False)


def table_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and columns of the encounter view."""
    enc = encounters(spark, sf)
    return enc.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(enc.columns)))


def confusion_table(spark: SparkSession, sf: str) -> DataFrame:
    """V6: 2x2 counts per model with class names as rows and columns."""
    return G.confusion_long(scored_documents(spark, sf))


def streaming_standardize(spark: SparkSession, sf: str) -> DataFrame:
    """Batch-fitted preparation applied to orders arriving as a stream."""
    enc = encounters(spark, sf)
    params = P.fit_clean(enc, ENC_SPEC)
    fitted = E.split_hash(P.one_hot(P.impute(enc, params), params), "id", seed=SEED)
    scaler = {r["feature"]: (r["mean"], r["std"]) for r in N.fit_scaler(
        fitted.where(F.col("split") == "train"), params.encoded_columns).collect()}
    orders = read_table(spark, sf, "orders")
    stream = (spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet")
              .parquet(sf.rstrip("/")))
    live = encounters_from(stream, read_table(spark, sf, "customer"))
    path = run_available_now(prepare_stream(live, params, scaler, "id", SEED))
    return _r6(spark.read.parquet(path))


def synthetic_prepared(spark: SparkSession, sf: str) -> DataFrame:
    """N4 data path on the synthetic encounter table (one row per order key):
    17 numeric + elective_surgery + 11 dummies = 29 standardised features."""
    from calibra.plans.benchmark import prepare_data
    keys = read_table(spark, sf, "orders").select("o_orderkey")
    data, _ = prepare_data(SY.synthetic_encounters(keys, "o_orderkey", seed=SEED), SY.SYN_SPEC, split_mode="hash")
    return _r6(data)


def synthetic_benchmark_report(spark: SparkSession, sf: str) -> DataFrame:
    """O6 on the synthetic encounter table generated from the customer keys."""
    keys = read_table(spark, sf, "customer").select("c_custkey")
    return Benchmark(spark, SY.synthetic_encounters(keys, "c_custkey", seed=SEED), SY.SYN_SPEC).run_all(side_by_side=True)
