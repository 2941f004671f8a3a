"""Table readers and the three derived views the benchmark runs on.

* ``encounters``  -- orders joined to customer: one row per order with two
  numeric features, two categoricals (3 % missing injected by key hash) and a
  0/1 outcome.  Stands in for the wide encounter table.
* ``documents_labeled`` -- documents joined to labels with numeric features
  derived from the whole text; an imbalanced real-signal classification set.
* ``vectors`` -- the embeddings table with a binary class.

All three are lazy (but for the count of the labels): Catalyst prunes columns
down to the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.spec import FeatureSpec

ENC_SPEC = FeatureSpec(key="id", numeric=("acctbal", "price"),
                       categorical=("seg", "priority"), target="y")
TOXIC_SPEC = FeatureSpec(key="doc_id",
                         numeric=("n_chars", "words", "digit_ratio", "punct_ratio", "lines"),
                         categorical=("lang",), target="toxic")

# The missing-value marker of the encounter view -- an md5 hex
# prefix below '08' (8/256 = 3.125 % of keys) blanks the value.
_MISSING_PREFIX = "08"
# The whitespace class used to count words (same in Java and RE2).
_WORD = "[^ \t\n\r]+"

#: Labels (ids of 8 bytes) up to which every task is sent the ids, to leave out
#: documents without a label before their texts are read through.
SENT_LABELS = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _blank(key: str, tag: str, value: str):
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{tag}")))
    return F.when(h < F.lit(_MISSING_PREFIX), F.lit(None)).otherwise(F.col(value))


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer -> (id, acctbal, seg, price, priority, y)."""
    return encounters_from(read_table(spark, sf_dir, "orders"),
                           read_table(spark, sf_dir, "customer"))


def encounters_from(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """The encounter view over given frames (``orders`` may be a stream:
    a stream-static inner join)."""
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    c = customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return j.select(
        F.col("o_orderkey").alias("id"),
        _blank("o_orderkey", "bal", "c_acctbal").alias("acctbal"),
        _blank("o_orderkey", "seg", "c_mktsegment").alias("seg"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"),
        (F.col("o_orderstatus") == F.lit("F")).cast("int").alias("y"),
    )


def text_features(text: str = "text"):
    """Numeric features of a whole document, all JVM-side (regex counts and
    literal replaces; no arrays are built)."""
    t = F.col(text)
    n = F.length(t)
    digits = F.regexp_count(t, F.lit("[0-9]"))
    # most characters are letters: deleting them is cheaper than counting the rest
    punct = F.length(F.regexp_replace(t, "[A-Za-z0-9 \t\n\r]", ""))
    newlines = n - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return {
        "words": F.regexp_count(t, F.lit(_WORD)).cast("long"),
        "digit_ratio": F.when(n == 0, F.lit(0.0)).otherwise(digits / n),
        "punct_ratio": F.when(n == 0, F.lit(0.0)).otherwise(punct / n),
        "lines": (newlines + 1).cast("long"),
    }


def documents_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⋈ labels with text features; targets ``toxic`` and ``quality``.

    Features are computed on the document side before the join (a narrow
    projection), so only a handful of numbers per document reach the join's
    shuffle -- the text itself never crosses the network.  Documents without a
    label are left out before that, as long as the ids of the labels (counted)
    are few enough to be sent around."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    if lab.count() <= SENT_LABELS:
        d = d.join(F.broadcast(lab.select("doc_id")), "doc_id", "left_semi")
    feats = text_features("text")
    d = d.select("doc_id", "n_chars", *[v.alias(k) for k, v in feats.items()], "lang")
    j = d.join(lab, "doc_id", "inner")
    return j.select("doc_id", "n_chars", *feats.keys(), "lang",
                    F.col("quality").cast("int").alias("quality"),
                    F.col("toxic").cast("int").alias("toxic"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> (vec_id, embedding array<double>, label, cls = label % 2)."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"),
                    "label", (F.col("label") % 2).cast("int").alias("cls"))
