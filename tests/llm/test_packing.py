import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from calibra.llm.common import materialise, running_sum
from calibra.llm.packing import classes, pack, pack_documents
from calibra.llm.tokens import load_tokenizer


def _best_fit_decreasing(lengths, capacity):
    """Sequences that plain best-fit decreasing opens."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("capacity, share, lengths", [
    (50, 50, lambda r: [r.randint(1, 50) for _ in range(600)] + [r.randint(1, 11) for _ in range(300)]),
    (4096, 400, lambda r: [min(4096, int(r.lognormvariate(6, 1.3)) + 1) for _ in range(1500)]),
    (300, 100, lambda r: [r.randint(75, 120) for _ in range(500)] + [100] * 300),
])
def test_as_many_sequences_as_best_fit(spark, capacity, share, lengths):
    """Near what best-fit decreasing opens piece by piece."""
    all_lengths = lengths(random.Random(capacity))
    df = spark.createDataFrame([(i, n) for i, n in enumerate(all_lengths)], "id long, length long")
    out = pack(df.repartition(6), capacity).collect()
    assert sorted(r.length for r in out) == sorted(all_lengths) and len({r.id for r in out}) == len(out)
    best = _best_fit_decreasing(all_lengths, capacity)
    assert _check_layout(out, capacity) <= best + best // share + 1


def test_classes():
    for capacity in (1, 2, 7, 64, 100, 4096):
        found = classes(capacity)
        assert sorted(n for a, b in found for n in range(a + 1, b + 1)) == list(range(1, capacity + 1))
    assert len(classes(4096)) <= 32


def _check_layout(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_documents(docs, word_bpe):
    rng = random.Random(1)
    rows = [(i, "cat dog " * rng.choice([0, 1, 5, 40, 40, 40, 300])) for i in range(150)] + [(500, None), (501, ""), (502, "word " * 9000), (3, "cat"), (3, "cat"), (None, "no id")]
    df = docs(rows).withColumnRenamed("lang", "length").withColumnRenamed("source", "sequence_id").repartition(5)
    out = pack_documents(df, word_bpe, capacity=64).collect()
    tok = load_tokenizer(word_bpe)
    want = []
    for d, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(d, k, 64 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(np.split(ids, range(64, len(ids), 64)))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=repr) == sorted(want, key=repr)
    best = _best_fit_decreasing([w[3] for w in want], 64)
    assert best <= _check_layout(out, 64) <= best + 1
    assert pack_documents(docs([]), word_bpe).count() == 0


def test_one_length_over_many_partitions(spark):
    out = pack(spark.range(5000).selectExpr("id", "cast(7 AS long) AS length").repartition(9), 100).collect()
    assert _check_layout(out, 100) == -(-5000 // 14)


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_running_sum_shuffles_rows_once(spark):
    rng = random.Random(2)
    rows = [(rng.randint(1, 9), i, rng.randint(-5, 5)) for i in range(700)]
    df = spark.createDataFrame(rows, "size long, id long, step long").repartition(5)
    out = running_sum(df, [F.desc("size"), F.asc("id")], "step", "depth")
    want, total = {}, 0
    for size, i, step in sorted(rows, key=lambda r: (-r[0], r[1])):
        total += step
        want[i] = (size, step, total)
    assert {r.id: (r.size, r.step, r.depth) for r in out.collect()} == want
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert running_sum(df.where("id < 0"), [F.asc("id")], "step", "depth").count() == 0


def test_written_steps_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    kept = materialise(spark.range(500).groupBy((F.col("id") % 7).alias("k")).count(), "steps")
    assert _shuffle_files(spark) <= before
    assert sorted(tuple(r) for r in kept.collect()) == sorted((k, len(range(k, 500, 7))) for k in range(7))
