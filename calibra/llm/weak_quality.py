"""Quality scores from weak labels.

Overlapping heuristics vote good, bad or nothing on each document.
Expectation-maximisation over the vote patterns (Dawid and Skene's model,
an abstention being a vote of its own) estimates how often each heuristic is
right on good and on bad documents.  The posterior of a document's pattern is its label.
A hashed linear model (word, word-shape and repetition features) is fitted to
posterior labels of a bounded sample and scores every document, so that it also
speaks where the heuristics are silent.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.common import SPACE, WORD, col, fresh, materialise, others, sealed, table
from calibra.llm.rules import LINE_END

#: Expected documents in the sample the linear model is fitted on (its bound).
TRAIN_DOCS = 10_000
FEATURES = 1 << 16
GOOD, BAD, NONE = 1, 0, -1


#: The heuristics, in the order of a pattern.
NAMES = ["length", "symbols", "shouts", "upper", "ends", "variety", "line_copies", "stutter"]


def vote(df: DataFrame, text: str, words: str, out: str, again: str) -> DataFrame:
    """``df`` with ``out``, each heuristic's vote (1 good, 0 bad, -1 none) on
    the column ``text`` (not null) of the words ``words``, and ``again``, how
    many words repeat the one before.  Everything that two heuristics share is
    a column first, so it is worked out once."""
    c = F.col
    n, lines, found = (fresh(x, df.columns) for x in ("_n", "_lines", "_found"))
    kinds = [r"[#*$%&|<>{}\\^~=_]", r"!", r"\p{Lu}", r"\p{L}"]
    df = df.withColumns({n: F.size(words), lines: F.filter(F.split(c(text), "\n"), lambda x: x.rlike(WORD)),
                         found: F.array(*[F.regexp_count(c(text), F.lit(k)) for k in kinds])})
    some = lambda x: F.greatest(x, F.lit(1))
    kind = lambda k: F.get(c(found), F.lit(k))
    shares, n_lines = fresh("_shares", df.columns), fresh("_n_lines", df.columns)
    df = df.withColumn(again, F.size(F.filter(c(words), lambda w, i: w == F.get(c(words), i - 1))))
    df = df.withColumns({
        n_lines: F.size(lines),
        shares: F.array(
            kind(0) / some(F.length(text)), kind(1) / some(c(n)), kind(2) / some(kind(3)),
            F.size(F.filter(c(lines), lambda x: F.rtrim(x).rlike(LINE_END))) / some(F.size(lines)),
            F.size(F.array_distinct(words)) / some(c(n)),
            1 - F.size(F.array_distinct(lines)) / some(F.size(lines)),
            c(again) / some(c(n)))})
    share = lambda k: F.get(c(shares), F.lit(k))
    one = lambda bad, good: F.when(bad, BAD).when(good, GOOD).otherwise(NONE)
    df = df.withColumn(out, F.array(
        one(c(n) < 10, c(n) >= 50), one(share(0) > 0.03, share(0) < 0.002), one(share(1) > 0.2, share(1) == 0),
        one(share(2) > 0.3, share(2) < 0.1), one(share(3) < 0.5, share(3) > 0.9),
        one((c(n) >= 20) & (share(4) < 0.25), share(4) > 0.5),
        one(share(5) > 0.3, (c(n_lines) >= 3) & (share(5) == 0)),
        one(share(6) > 0.1, (c(n) >= 20) & (share(6) < 0.01))))
    return df.drop(n, lines, found, shares, n_lines)


@dataclass(frozen=True)
class Labellers:
    """What the expectation-maximisation found."""

    prior: float
    #: [heuristic, vote + 1]: the probability of each vote on good and on bad documents
    on_good: np.ndarray
    on_bad: np.ndarray

    def accuracy(self) -> dict[str, tuple[float, float]]:
        """How often each heuristic, where it votes, is right on good and on
        bad documents."""
        right = lambda t, v: t[:, v + 1] / (t[:, GOOD + 1] + t[:, BAD + 1])
        return dict(zip(NAMES, zip(right(self.on_good, GOOD).tolist(), right(self.on_bad, BAD).tolist(), strict=True), strict=True))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of good for each row of votes."""
        at = np.arange(patterns.shape[1])
        odds = np.log(self.prior / (1 - self.prior)) + (
            np.log(self.on_good[at, patterns + 1]) - np.log(self.on_bad[at, patterns + 1])).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, steps: int = 500) -> Labellers:
    """Expectation-maximisation over vote patterns and how often each comes.
    It starts from the votes themselves: a heuristic sees one kind of fault, so
    one bad vote is enough to begin among the bad; that also settles which
    class is good."""
    n = counts.sum()
    p = np.where((patterns == BAD).any(1), 0.05, 0.95)
    each = np.stack([patterns == v for v in (NONE, BAD, GOOD)], 2)
    found = None
    for _ in range(steps):
        w1, w0 = counts * p, counts * (1 - p)
        # half a document with each vote keeps probabilities above 0
        on_good = (np.tensordot(w1, each, 1) + 0.5) / (w1.sum() + 1.5)
        on_bad = (np.tensordot(w0, each, 1) + 0.5) / (w0.sum() + 1.5)
        found = Labellers(float((w1.sum() + 1) / (n + 2)), on_good, on_bad)
        new = found.posterior(patterns)
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return found


@dataclass(frozen=True)
class QualityModel:
    labellers: Labellers
    linear: LogisticRegressionModel | None


#: Marks that stand for runs of capitals, other letters and digits in a shape.
_SHAPE = (("\\p{Lu}+", "\u0001"), ("\\p{Ll}+", "\u0002"), ("\\p{N}+", "\u0003"))


@dataclass(frozen=True)
class Voted:
    """Documents with their votes: ``rows`` has the columns ``rest`` and those
    named by the others (the text, nulls as empty; the votes; the repeats)."""

    rows: DataFrame
    rest: list[str]
    text: str
    pattern: str
    again: str


def _voted(docs: DataFrame, text: str, rest: list[str]) -> Voted:
    w, t, p, a = (fresh(n, rest) for n in ("_words", "_text", "_pattern", "_again"))
    df = docs.select(*map(col, rest), F.coalesce(col(text), F.lit("")).alias(t))
    df = df.withColumn(w, F.filter(F.split(F.col(t), SPACE), lambda v: v != ""))
    return Voted(vote(df, t, w, p, a).drop(w), rest, t, p, a)


def voted(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> Voted:
    """The votes on all documents, written once for ``fit`` and ``score``, with
    the columns ``keep`` (all if None)."""
    v = _voted(docs, text, list(docs.columns) if keep is None else keep)
    return replace(v, rows=materialise(v.rows, "votes"))


def _terms(v: Voted, rows: DataFrame) -> tuple[DataFrame, str]:
    """``rows`` of ``v`` with the terms of the linear model -- words, word
    shapes, and a term for each word that repeats the one before -- in place of
    text and repeats, and the name of these terms."""
    x = fresh("_terms", rows.columns)
    shape = F.col(v.text)
    for run, mark in _SHAPE:
        shape = F.regexp_replace(shape, run, mark)
    terms = F.concat(F.split(F.lower(F.col(v.text)), SPACE), F.split(shape, SPACE), F.array_repeat(F.lit("\u0004"), F.col(v.again)))
    return rows.withColumn(x, terms).drop(v.text, v.again), x


def _vectors(df: DataFrame, terms: str, features: str) -> DataFrame:
    raw = fresh("_raw", df.columns)
    df = HashingTF(numFeatures=FEATURES, inputCol=terms, outputCol=raw).transform(df).drop(terms)
    return Normalizer(p=2.0, inputCol=raw, outputCol=features).transform(df).drop(raw)


def _sample(docs: DataFrame, text: str, keys: list[str], share: float, seed: int) -> DataFrame:
    """A share of the rows, drawn by a hash of their keys and text, so that
    copies of a text under several keys are drawn one by one."""
    draw = F.pmod(F.xxhash64(*map(col, keys), F.coalesce(col(text), F.lit("")), F.lit(seed)), F.lit(1 << 30))
    return docs.where(draw < int(min(1.0, share) * (1 << 30)))


def fit(docs: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS, key: str = "doc_id",
        votes: Voted | None = None) -> QualityModel:
    """Estimate the heuristics from the votes on all documents; fit the linear
    model on about ``train_docs`` whole documents, drawn by a hash of key (if
    there is one) and text.  ``votes`` are those of ``docs``, if at hand."""
    even = np.full((len(NAMES), 3), 1 / 3)
    v = votes or voted(docs, text, [c for c in docs.columns if c == key])
    # bounded: at most three to the power of the heuristics
    rows = v.rows.groupBy(v.pattern).count().collect()
    if not rows:
        return QualityModel(Labellers(0.5, even, even), None)
    patterns = np.array([r[0] for r in rows])
    counts = np.array([r[1] for r in rows], float)
    labellers = estimate(patterns, counts)
    drawn = _sample(v.rows, v.text, [c for c in v.rest if c == key], train_docs / counts.sum(), 7)
    sample, terms = _terms(v, drawn.select(v.text, v.pattern, v.again))
    sample = sample.withColumn("p", _posterior(F.col(v.pattern), labellers)).drop(v.pattern)
    sample = materialise(_vectors(sample, terms, "features"), "sample")
    if not sample.count():
        return QualityModel(labellers, None)
    # both classes weigh the same, as bad documents are few
    good = float(np.clip((counts * labellers.posterior(patterns)).sum() / counts.sum(), 1e-6, 1 - 1e-6))
    both = sample.select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("p") / good).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), ((1 - F.col("p")) / (1 - good)).alias("weight")))).alias("x")).select("features", "x.*")
    linear = LogisticRegression(maxIter=300, regParam=1e-7, weightCol="weight", standardization=False).fit(both.where("weight > 1e-6"))
    return QualityModel(labellers, linear)


def _posterior(pattern: Column, labellers: Labellers) -> Column:
    """A document's posterior: the sum of its votes' log odds."""
    table = np.log(labellers.on_good / labellers.on_bad)
    odds = F.lit(float(np.log(labellers.prior / (1 - labellers.prior))))
    for i, row in enumerate(table.tolist()):
        odds = odds + F.get(F.array(*map(F.lit, row)), F.get(pattern, F.lit(i)) + 1)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None,
          threshold: float = 0.4, votes: Voted | None = None) -> DataFrame:
    """``keep`` (all columns if None) of ``docs`` with ``n_votes``,
    ``p_weak`` (the heuristics' posterior), ``quality`` (the linear score, 0 to
    1) and ``kept`` (quality of at least ``threshold``).

    A null text counts as empty: it has the votes of a short text and is scored
    by the model's intercept; without a model (empty table) scores are 0.5.
    Rows are scored alone.  Columns of these names are replaced.  ``votes`` are
    those of ``docs`` with these columns, if at hand.
    """
    made = ("n_votes", "p_weak", "quality", "kept")
    rest = others(docs.columns if keep is None else keep, *made)
    v = votes or _voted(docs, text, rest)
    df, terms = _terms(v, v.rows.select(*map(col, rest), v.text, v.pattern, v.again))
    df = df.withColumns({"n_votes": F.size(F.filter(F.col(v.pattern), lambda x: x != NONE)),
                         "p_weak": _posterior(F.col(v.pattern), model.labellers)}).drop(v.pattern)
    if model.linear is None:
        df = df.withColumn("quality", F.lit(0.5))
    else:
        features, probability = fresh("features", df.columns), fresh("probability", df.columns)
        raw, guess = fresh("rawPrediction", df.columns), fresh("prediction", df.columns)
        linear = model.linear.copy({model.linear.featuresCol: features, model.linear.probabilityCol: probability,
                                    model.linear.rawPredictionCol: raw, model.linear.predictionCol: guess})
        df = linear.transform(_vectors(df, terms, features))
        df = df.withColumn("quality", F.get(vector_to_array(F.col(probability)), F.lit(1)))
    df = df.withColumn("kept", F.col("quality") >= threshold).select(*map(col, rest), *made)
    return sealed(df, list(made))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    votes = voted(docs, keep=["doc_id"])
    return score(docs, fit(docs, votes=votes), keep=["doc_id"], votes=votes)
