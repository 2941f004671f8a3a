"""Training corpus from raw documents, in five stages.

Each stage gets the documents its predecessor kept and returns those it keeps,
with the columns they came with; the last returns the packed pieces.  ``run``
writes every stage's result to the shared folder and reads it back, so a lost
executor never reaches back beyond one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.common import materialise, table
from calibra.llm.decontaminate import decontaminate
from calibra.llm.language import fit, identify, recognised, usual
from calibra.llm.near_dup import deduplicate
from calibra.llm.packing import pack_documents
from calibra.llm.rules import quality_rules


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with numbered columns, so that no operator's column can take
    the place of a document's, and the number of each name."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), {c.lower(): n for c, n in names.items()}


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names again."""
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a recognised language go (null and
    letterless texts, and those that no learned language codes as short as it
    codes its own)."""
    rows, c = _plain(docs)
    by = (c["text"], c["lang"], c["doc_id"])
    model = fit(rows, *by)
    return _back(recognised(identify(rows, model, c["text"], c["doc_id"]), usual(model, rows, *by)), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, failing lines go from the others
    (``n_chars`` follows the cleaned text)."""
    rows, c = _plain(docs)
    kept = quality_rules(rows, c["text"], keep=[n for n in rows.columns if n != c["text"]]).where("kept")
    kept = kept.withColumn(c["text"], F.col("clean_text"))
    if "n_chars" in c:
        kept = kept.withColumn(c["n_chars"], F.length("clean_text").cast("long"))
    return _back(kept, docs)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each class one row stays, of the text with the
    smallest id."""
    rows, c = _plain(docs)
    return _back(deduplicate(rows, c["text"], c["doc_id"]), docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that overlap an item go."""
    rows, c = _plain(docs)
    found = decontaminate(rows, table(spark, sf_dir, "benchmark"), c["text"])
    return _back(found.where("NOT contaminated"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_dup", near_dup),
    ("decontaminate", clean_of_benchmark),
    ("pack", pack),
]

#: The stages learn, hash and pack: SQL cannot express them.  The tests hold
#: them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces of what is kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
