"""The benchmark workflow (O1, O2, O5-O8 and the kernel SVM of O3): data ->
baseline -> kernel SVM -> report.

Each stage is a method of ``Benchmark``; the prepared data is built once,
persisted, and shared by all stages (the reference re-prepares per stage).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.operators import kernels as K
from calibra.operators import metrics as V
from calibra.operators import models as M
from calibra.operators import prepare as P
from calibra.operators import random_maps as RM
from calibra.operators import results as R
from calibra.operators import scale as N
from calibra.operators import split as E
from calibra.session import staged
from calibra.spec import FeatureSpec

#: Scored rows and what each fit left.
Fits = tuple[DataFrame, list[M.Fitted]]

# Defaults of the workflow.
SEED = 42
TOP_FEATURES = 6
SUBSAMPLE = 200

#: Features up to which the cos2 kernel gets its exact vector (3^k numbers);
#: for more, frequencies are drawn.
EXACT_FEATURES = 6

#: Steps of a hinge fit on drawn features at most: they are not whitened as
#: landmark features are, so the last digits of the optimum take hundreds more.
DRAWN_STEPS = 100


@dataclass
class Prepared:
    """One persisted frame (key, split, label, features...) + metadata."""

    data: DataFrame
    features: list[str]
    selected: list[str]
    key: str
    label: str
    train_q: DataFrame      # class-balanced sample of train, selected features
    test_q: DataFrame       # class-balanced sample of test (E6 size rule)


def prepare_data(df: DataFrame, spec: FeatureSpec, seed: int = SEED, split_mode: str = "exact",
                 fit_scope: str = "all") -> tuple[DataFrame, list[str]]:
    """P1 -> I5 -> E1 -> N1: (key, split, label, encoded standardised features)."""
    # the curated projection is scanned by several fitting passes (medians,
    # category counts, moments): read and join the sources once
    df = staged(P.drop_null_target(P.select_features(df, spec), spec), "curated")

    def split(x: DataFrame) -> DataFrame:
        return (E.split_hash(x, spec.key, seed) if split_mode == "hash"
                else E.split_exact(x, spec.key, spec.target, seed))

    if fit_scope == "train":
        pre = split(df)
        cleaned, params = P.clean(pre, spec, fit_on=pre.where(F.col("split") == "train"),
                                  return_params=True)
    else:
        cleaned, params = P.clean(df, spec, return_params=True)
        cleaned = split(cleaned)
    feats = params.encoded_columns
    data = N.standardize(cleaned, feats, fit_filter=F.col("split") == "train")
    return data.select(spec.key, "split", F.col(spec.target).alias("label"), *feats), feats


def prepare(df: DataFrame, spec: FeatureSpec, k: int = TOP_FEATURES, n: int = SUBSAMPLE,
            seed: int = SEED, split_mode: str = "exact", fit_scope: str = "all") -> Prepared:
    """P1 -> I5 -> E1 -> N1 -> N3 -> E3."""
    data, feats = prepare_data(df, spec, seed, split_mode, fit_scope)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    is_train = F.col("split") == "train"
    scores = N.anova_f(data.where(is_train), feats, "label")
    selected = [r["feature"] for r in N.top_k_features(scores, k).collect()]
    # the samples are bounded (n rows) and reused by every kernel stage
    train_q = E.subsample(data.where(is_train), spec.key, "label", n, seed).persist()
    test = data.where(F.col("split") == "test")
    test_q = E.subsample(test, spec.key, "label", E.test_sample_size(n), seed + 1).persist()
    return Prepared(data, feats, selected, spec.key, "label", train_q, test_q)


def _as_vector(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumn("vec", F.array(*[F.col(c).cast("double") for c in cols]))


class Benchmark:
    """User API: ``Benchmark(spark, df, spec).run_all()``."""

    def __init__(self, spark: SparkSession, df: DataFrame, spec: FeatureSpec,
                 k: int = TOP_FEATURES, n: int = SUBSAMPLE, seed: int = SEED,
                 landmarks: int = 500, scope: str = "all",
                 split_mode: str = "exact", fit_scope: str = "all",
                 rbf_map: str = "nystroem", places: int = 128):
        """``split_mode`` ('exact' per-class quotas as in the reference, or
        'hash': one narrow pass, shares near the fractions) and ``fit_scope``
        ('all' rows as the reference does, or 'train' only: leak-free) control
        the preparation.  ``k`` features with the best ANOVA F feed the kernel
        stage, whose ``scope`` is

        * ``"all"`` (default): train on every training row with
          class-balancing weights (the expectation of balanced sampling) and
          score every test row;
        * ``"sample"``: train on the balanced sample and score the balanced
          test sample, as the reference does.

        ``rbf_map`` is the explicit map of the RBF SVM: 'nystroem' (``landmarks``
        rows of train) or 'fourier' (``places`` drawn frequencies, no rows).
        The cos2 SVM draws as many where ``k`` exceeds ``EXACT_FEATURES``.
        """
        if scope not in ("all", "sample"):
            raise ValueError("scope must be 'all' or 'sample'")
        if split_mode not in ("hash", "exact") or fit_scope not in ("all", "train"):
            raise ValueError("split_mode is 'hash' or 'exact'; fit_scope is 'all' or 'train'")
        if rbf_map not in ("nystroem", "fourier"):
            raise ValueError("rbf_map is 'nystroem' or 'fourier'")
        self.scope, self.split_mode, self.fit_scope = scope, split_mode, fit_scope
        self.rbf_map, self.places = rbf_map, places
        self.spark, self.df, self.spec = spark, df, spec
        self.k, self.n, self.seed, self.n_landmarks = k, n, seed, landmarks
        self.results: DataFrame | None = None
        self.scored: dict[str, DataFrame] = {}
        self.fitted: dict[str, M.Fitted] = {}
        self._prep: Prepared | None = None

    # O1
    def data(self) -> Prepared:
        if self._prep is None:
            self._prep = prepare(self.df, self.spec, self.k, self.n, self.seed,
                                 self.split_mode, self.fit_scope)
        return self._prep

    def _split(self, name: str) -> DataFrame:
        return self.data().data.where(F.col("split") == name)

    def _store(self, block: str, scored: DataFrame, runs: list[M.Fitted]) -> DataFrame:
        self.fitted |= {r.name: r for r in runs}
        # the metrics and the caller read the scores: rows meet the models once
        scored = staged(scored, "scored")
        rt = self.spark.createDataFrame([(r.name, r.seconds) for r in runs], "model string, train_seconds double")
        m = V.binary_metrics(scored, runs=rt)
        self.results = R.upsert(self.results, R.as_results(m, block))
        self.scored[block] = scored
        return m

    # O2
    def baseline(self, models: tuple[str, ...] = ("svm_rbf", "logreg", "random_forest")) -> DataFrame:
        return self._store("classical", *_together([fit() for fit in self._classical(models)]))

    def _classical(self, models: tuple[str, ...]) -> list[Callable[[], Fits]]:
        """The fits of the classical models, none of which needs another's result."""
        direct = {m: m for m in models if m in ("logreg", "random_forest")}
        return [*([lambda: self._direct(direct)] if direct else []), *([self._rbf] if "svm_rbf" in models else [])]

    def _assembled(self) -> tuple[DataFrame, DataFrame]:
        train, test = (M.assemble(self._split(x), self.data().features) for x in ("train", "test"))
        return train, test

    def _direct(self, families: dict[str, str]) -> Fits:
        """Models on the prepared features as they are."""
        p = self.data()
        return M.run_models(*self._assembled(), families, p.key, p.label)

    def _rbf(self) -> Fits:
        """M1: the RBF SVM through an explicit map."""
        p = self.data()
        began = time.perf_counter()
        tr, te = (_as_vector(d, p.features).drop("features") for d in self._assembled())
        kernel = K.make_kernel("rbf", gamma=K.rbf_gamma_scale(tr, "vec"))  # 'scale': 1 / (p * var of all train entries)
        if self.rbf_map == "fourier":
            tr, te = (self._drawn(d, kernel, len(p.features)) for d in (tr, te))
        else:
            lm = E.subsample(tr, p.key, p.label, self.n_landmarks, self.seed)
            ny = M.Nystroem.fit(lm, "vec", kernel, key=p.key)
            tr, te = (ny.transform(d, "vec") for d in (tr, te))
        return M.run_models(tr, te, {"svm_rbf": "svm"}, p.key, p.label, began=began,
                            max_iter=DRAWN_STEPS if self.rbf_map == "fourier" else None)

    def _drawn(self, df: DataFrame, kernel: K.Kernel, dims: int) -> DataFrame:
        """Rows with ``features``, the random Fourier features of ``vec``."""
        w = RM.frequencies(kernel, dims, self.places, self.seed)
        return RM.fourier_features(df, "vec", w).withColumn("features", array_to_vector("fourier")).drop("fourier")

    def _cos2(self, df: DataFrame) -> DataFrame:
        """Rows with the explicit vector of the cos2 kernel over the chosen
        features, or with drawn features where it would be too long."""
        chosen = self.data().selected
        if len(chosen) > EXACT_FEATURES:
            return self._drawn(_as_vector(df, chosen), K.make_kernel("cos2"), len(chosen))
        return K.cos2_features(df, chosen).withColumn("features", array_to_vector("vec"))

    def _kernel_sets(self) -> tuple[DataFrame, DataFrame, str | None]:
        """(train rows, test rows, weight column) for the kernel stage."""
        p = self.data()
        if self.scope == "sample":
            return p.train_q, p.test_q, None
        return M.class_weights(self._split("train"), p.label), self._split("test"), "weight"

    def kernel_heatmap(self, n_viz: int = 60) -> DataFrame:
        """K9: cos2 Gram of the first ``n_viz`` rows of the (hash-shuffled)
        balanced training sample, positions sorted by class: (pos_i, pos_j, k)."""
        p = self.data()
        first = E.subsample(p.train_q, p.key, p.label, n_viz, self.seed, balanced=False)
        first = _as_vector(first, p.selected)
        return K.heatmap(first, p.key, "vec", p.label, K.make_kernel("cos2"))

    # O3, M2
    def kernel_svm(self) -> DataFrame:
        """The SVM of the cos2 kernel on the chosen features, by its explicit
        vector: every training row counts, no landmarks."""
        return self._store("qsvm", *self._cos2_svm())

    def _cos2_svm(self) -> Fits:
        p = self.data()
        train, test, w = self._kernel_sets()
        began = time.perf_counter()
        if len(p.selected) > EXACT_FEATURES:
            return M.run_models(self._cos2(train), self._cos2(test), {"svm_cos2": "svm"}, p.key, p.label,
                                weight=w, began=began, max_iter=DRAWN_STEPS)
        # rows are kept with the chosen features, not with the 3^k products
        train, test = (d.select(p.key, p.label, *p.selected, *([w] if w and w in d.columns else [])) for d in (train, test))
        half = (len(p.selected) + 1) // 2
        halves = M.Halves(self._cos2, lambda df: K.cos2_features(K.cos2_features(df, p.selected[:half], "_first"), p.selected[half:], "_second"), ("_first", "_second"))
        return M.run_models(train, test, {"svm_cos2": "svm"}, p.key, p.label, weight=w, began=began, halves=halves)

    # O5
    def report(self) -> DataFrame:
        if self.results is None:
            raise RuntimeError("nothing to report yet: run baseline() or kernel_svm()")
        return R.pivot_metrics(R.flatten(self.results))

    def save(self, store_dir: str) -> str:
        """Merge this run's blocks into the versioned results store
        (blocks re-run here replace their old versions whole)."""
        if self.results is None:
            raise RuntimeError("nothing to report yet: run baseline() or kernel_svm()")
        return R.upsert_store(self.spark, store_dir, self.results)

    def markdown(self, by: str = "roc_auc") -> str:
        """Ranked comparison table as markdown text."""
        if self.results is None:
            raise RuntimeError("nothing to report yet: run baseline() or kernel_svm()")
        return R.markdown_table(R.flatten(self.results), by)

    def close(self) -> None:
        """Release what this run persisted: the prepared data and the samples."""
        if self._prep is not None:
            for df in (self._prep.data, self._prep.train_q, self._prep.test_q):
                df.unpersist()
            self._prep = None

    # O6
    def run_all(self, side_by_side: bool = False) -> DataFrame:
        """All stages.  ``side_by_side`` runs the fits at once, each from a thread
        and in a scheduler pool of its own: the small jobs of one model's steps
        fill the cores that another leaves idle.  The results are the same; a
        model's seconds then hold the time it waited for others."""
        self.data()
        if not side_by_side:
            self.baseline()
            self.kernel_svm()
            return self.report()
        fits = [*self._classical(("svm_rbf", "logreg", "random_forest")), self._cos2_svm]
        *classical, cos2 = at_once(self.spark, fits)
        self._store("classical", *_together(classical))
        self._store("qsvm", *cos2)
        return self.report()


def _together(fits: list[Fits]) -> Fits:
    """The scored rows and runs of several fits as one."""
    scored, runs = fits[0]
    for more, other in fits[1:]:
        scored, runs = scored.unionByName(more), runs + other
    return scored, runs


def at_once(spark: SparkSession, fns: list[Callable]) -> list:
    """Results of functions that start Spark jobs, run at the same time, in
    order.  The first error is raised when all have ended."""
    def pooled(i: int, fn: Callable):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"side-{i}")
        return fn()

    # bounded: one thread per function, a handful
    with ThreadPoolExecutor(max(1, len(fns))) as pool:
        run = [pool.submit(inheritable_thread_target(spark)(pooled), i, fn) for i, fn in enumerate(fns)]
    return [r.result() for r in run]
