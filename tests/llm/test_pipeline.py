import re
import subprocess
import sys
import shutil
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as CP
from calibra.llm.common import materialise, table

REPO = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.01"


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def test_stages_follow_each_other(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in CP.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "pack":
            assert docs.columns == columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    assert ids["language"] >= ids["quality"] >= ids["near_dup"] >= ids["decontaminate"] == ids["pack"]
    # near duplicates: nothing kept is linked, everything dropped is linked to something
    texts = {r.doc_id: _shingles(r.text) for r in kept["quality"].collect()}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    stay = sorted(ids["near_dup"])
    for i, a in enumerate(stay):
        assert not any(near(texts[a], texts[b]) for b in stay[i + 1:] if not texts[a].isdisjoint(texts[b]))
    for d in ids["quality"] - ids["near_dup"]:
        assert any(near(texts[d], texts[o]) for o in texts if o != d)
    # benchmark: items inside a text, letter by letter, are gone
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    whole = {r.doc_id: r.text for r in kept["near_dup"].collect()}
    assert not any(i in whole[d] for d in ids["decontaminate"] for i in items)
    # clean documents stay: labelled good, and not under ten words or repetitive
    good = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}
    from calibra.llm.rules import quality_rules
    base = {r.doc_id for r in quality_rules(kept["language"]).where("NOT base_failed").select("doc_id").collect()}
    assert len(good & base - ids["quality"]) <= 0.01 * len(good)
    assert len(good & ids["language"]) == len(good & {r.doc_id for r in table(spark, SF, "documents").collect()})


def test_odd_rows_and_columns(spark, docs):
    prose = "The river runs past the old mill and the road follows it down to the town again."
    rows = [(1, prose), (1, prose), (2, prose), (None, prose + " One more sentence stands here."), (None, prose + " One more sentence stands here."),
            (3, None), (4, ""), (5, "1234")] + [(10 + i, f"A text number {i} of its own kind with words that nobody else has, say word{i}x.") for i in range(5)]
    df = docs(rows).withColumn("kept", F.lit(7)).withColumn("row", F.lit("r")).withColumn("contaminated", F.lit(False))
    for name, stage in CP.STAGES[:4]:
        df = materialise(stage(spark, df, SF), name)
    assert {"kept", "row", "contaminated"} <= set(df.columns)
    texts = [r.text for r in df.collect()]
    assert texts.count(prose) == 1 and len(texts) == len(set(texts)) and None not in texts
    empty = docs([])
    for name, stage in CP.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_the_rest_stands_without_the_subpackage(tmp_path):
    shutil.copytree(REPO / "calibra", tmp_path / "calibra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
