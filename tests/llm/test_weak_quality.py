import numpy as np
from pyspark.sql import functions as F

from calibra.llm import weak_quality
from calibra.llm.weak_quality import BAD, GOOD, NONE, estimate, fit, score


def test_estimation_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(40_000) < 0.8
    right = [(0.95, 0.7), (0.9, 0.6), (0.85, 0.8), (0.97, 0.5)] * 2
    votes = np.stack([np.where(rng.random(len(truth)) < 0.2, NONE, np.where(
        rng.random(len(truth)) < np.where(truth, g, b), np.where(truth, GOOD, BAD), np.where(truth, BAD, GOOD))) for g, b in right], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found = estimate(patterns, counts.astype(float))
    assert abs(found.prior - 0.8) < 0.02
    for (g, b), (fg, fb) in zip(right, found.accuracy().values(), strict=True):
        assert abs(g - fg) < 0.03 and abs(b - fb) < 0.05


def test_labels_and_odd_rows(spark, docs):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(table, train_docs=1000)
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "good")
    j = score(table, model, keep=["doc_id"]).join(labels, "doc_id")
    kept = {r.good: r.k for r in j.groupBy("good").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    assert kept[1] > 0.93 and kept[0] < 0.5
    odd = docs([(1, None), (2, ""), (3, "word " * 30_000), (3, "word " * 30_000)]).withColumnRenamed("source", "quality").withColumnRenamed("lang", "features")
    rows = score(odd, model).collect()
    assert len(rows) == 4 and rows[2].quality == rows[3].quality and "features" in odd.columns
    assert score(docs([]), model).count() == 0
    assert score(odd, fit(docs([]))).first().quality == 0.5


def test_heuristics_count_all_documents_and_copies_are_drawn_one_by_one(spark):
    n = 24_000  # a third are copies of one text, a third of the rest are shouted
    text = F.when(F.col("id") % 3 == 0, "the same line again").when(F.col("id") % 9 == 1, F.concat(F.lit("BUY NOW! "), F.col("id"))).otherwise(
        F.concat_ws(" ", F.lit("one of the other lines, number"), F.col("id"), F.lit("with its own end.")))
    table = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    found = fit(table, train_docs=300).labellers
    words = table.withColumn("w", F.split("text", " "))
    rows = weak_quality.vote(words, "text", "w", "p", "a").groupBy("p").count().collect()
    want = estimate(np.array([r[0] for r in rows]), np.array([r["count"] for r in rows], float))
    assert sum(r["count"] for r in rows) == n
    assert abs(found.prior - want.prior) < 1e-9
    assert np.abs(found.on_good - want.on_good).max() < 1e-9 and np.abs(found.on_bad - want.on_bad).max() < 1e-9
    copies = table.where("doc_id % 3 = 0")
    assert 700 < weak_quality._sample(copies, "text", ["doc_id"], 0.1, 7).count() < 900
