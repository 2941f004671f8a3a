"""Order statistics over appends, and joins of bucketed tables."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import value_blocks as VB
from calibra.plans import queries as Q
from calibra.session import checkpoint_dir


class Counting(VB.ValueBlocks):
    """Remembers how many values were read."""

    def _rows(self, chosen):
        rows = super()._rows(chosen)
        self.read = rows.count()
        return rows


@pytest.fixture
def store(spark):
    return Counting(spark, f"{checkpoint_dir(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}", block_bits=4)


def _frame(spark, a, b):
    return spark.createDataFrame([(float(x), None if y is None else float(y)) for x, y in zip(a, b)], "a double, b double")


RANKS = {"first": lambda n: F.lit(1), "tenth": lambda n: F.ceil(n / 10), "last": lambda n: n, "none": lambda n: n + 1}


@pytest.mark.parametrize("pushed", [1000, 1])
def test_ranks_stay_exact_after_each_append(spark, store, monkeypatch, pushed):
    monkeypatch.setattr(VB, "PUSHED_BLOCKS", pushed)
    rng = np.random.default_rng(5)
    all_a, all_b = [], []
    # overlapping, disjoint, tied and tiny batches
    for a in (rng.normal(0, 10, 900), rng.normal(100, 1, 300).round(1), np.full(400, 3.0), np.array([-7.0])):
        b = [None if i % 3 == 0 else float("nan") if i % 3 == 1 else x for i, x in enumerate(a)]
        store.append(_frame(spark, a, b), ["a", "b"])
        all_a += list(a)
        all_b += [x for x in b if x is not None and x == x]
    for name, values in (("a", np.sort(all_a)), ("b", np.sort(all_b))):
        n = len(values)
        got = {r["tag"]: (r["rank"], r["value"], r["group_n"]) for r in store.ranks(RANKS).where(F.col("feature") == name).collect()}
        assert got == {"first": (1, values[0], n), "tenth": (-(-n // 10), values[-(-n // 10) - 1], n), "last": (n, values[-1], n)}
    medians = dict(store.medians().collect())
    assert medians == {"a": pytest.approx(np.median(all_a)), "b": pytest.approx(np.median(all_b))}


def test_only_blocks_at_the_rank_are_read(spark, store):
    rng = np.random.default_rng(6)
    for _ in range(3):
        store.append(spark.createDataFrame([(float(x),) for x in rng.uniform(0, 1, 4000)], "a double"), ["a"])
    store.ranks({"mid": lambda n: F.ceil(n / 2)}).collect()
    # 12,000 values in blocks of 16: a few blocks of each batch
    assert 0 < store.read <= 16 * 4 * 3


def test_empty_stores_and_batches(spark, store):
    assert store.medians().count() == 0
    store.append(spark.createDataFrame([], "a double"), ["a"])
    assert store.medians().count() == 0
    store.append(spark.createDataFrame([(2,), (4,), (None,)], "a int"), ["a"])
    assert [tuple(r) for r in store.medians().collect()] == [("a", 3.0)]


def test_an_append_that_died_counts_for_nothing(spark, store):
    store.append(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "a double"), ["a"])
    # rows without an index, as a lost driver leaves them
    spark.createDataFrame([("a", 99.0, 50, 0)], "feature string, x double, n long, block long").write.parquet(
        f"{store.base}/rows/part=pdead")
    assert [tuple(r) for r in store.medians().collect()] == [("a", 2.0)]


def test_bucketed_gather_has_no_shuffle(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = Q.gather_rows_bucketed(spark, sf)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert "Exchange" in Q.gather_rows(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert sorted(rows.collect()) == sorted(Q.gather_rows(spark, sf).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
