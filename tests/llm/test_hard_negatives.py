import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.llm import hard_negatives as hn
from calibra.llm.hard_negatives import OP11_SQL, hard_negatives, op11_hard_negatives, planes_of, scores, subset_sums

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("top, dtype", [(1, np.int32), (300, np.int32), (2 ** 25, np.int64)])
def test_lookups_give_inner_products(top, dtype):
    rng = np.random.default_rng(top)
    a, c = rng.integers(-top, top + 1, (7, 24)), rng.integers(-top, top + 1, (50, 24))
    c[0], c[1] = top, -top
    bits = int(top).bit_length() + 1
    planes = planes_of(c, bits).astype(np.intp).transpose(1, 2, 0)
    assert (scores(subset_sums(a, dtype), planes) == c @ a.T).all()


def _brute(rows, positives=5, negatives=3, low=50, high=95):
    clean = []
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            clean.append((n, i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for n, i, v, label in clean:
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m, other) for m, j, w, other in clean if m != n)
        for score, j, _, _ in [s for s in scored if s[3] == label][:positives]:
            near = [s for s in scored if s[3] != label and low * -score <= 100 * -s[0] <= high * -score]
            out += [(i, j, k, s[1], -score, -s[0]) for k, s in enumerate(near[:negatives], 1)]
    return sorted(out)


def _rows(seed, n=400, dims=12):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.choice([0, 0, 0, 0, 1, 2, 3, -4])
        rows.append((i - 60, [rng.choice([0.0, 0.25, -0.5, 0.75, rng.gauss(0.2, 0.5)]) for _ in range(dims)], label))
    rows += [(1000 + k, list(rows[50][1]), rows[50][2]) for k in range(30)]  # one vector many times
    rows += [(50, [0.5] * dims, 1), (50, [0.5] * dims, 1), (7, [0.4] * dims, 0)]  # repeated ids
    rows += [(2000, None, 1), (2050, [0.5] * dims, None), (None, [0.5] * dims, 1), (2100, [], 2), (2101, [0.25], 0), (2150, [0.5, None], 1),
             (2200, [float("nan")], 1), (2250, [0.5, float("inf")], 0), (2300, [0.0] * dims, 77)]
    return rows


@pytest.mark.parametrize("seed, small", [(1, False), (2, True)])
def test_brute_force(spark, monkeypatch, seed, small):
    if small:  # many cells, strips and steps
        for name, value in (("ANCHORS", 3), ("CANDIDATES", 40), ("STRIP", 2), ("LEAST", 8), ("STEPS", (0, 2, 5))):
            monkeypatch.setattr(hn, name, value)
    rows = _rows(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", anchor string, row int").repartition(5)
    got = hard_negatives(df, F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == _brute(rows)


def test_wide_numbers_and_empty_tables(spark):
    rows = [(i, [float((i * 37 + k * 11) % 101 - 20) * 4096 for k in range(8)], i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 50 == 0).collect())) == _brute(rows)
    assert hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives(df, F.lit(False)).count() == 0
    with pytest.raises(ValueError):
        hard_negatives(spark.createDataFrame([(0, [1e30], 1)], SCHEMA), F.lit(True))


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    cur = con.execute(OP11_SQL)
    names = [d[0] for d in cur.description]
    out = op11_hard_negatives(spark, sf)
    assert out.columns == names
    want = sorted(cur.fetchall())
    assert want and sorted(map(tuple, out.collect())) == want
