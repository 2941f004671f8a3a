import itertools
import math
import random

import pytest

from calibra.llm.decontaminate import AGREE, WINDOW, Block, decontaminate, word_hashes

import numpy as np
import pyarrow as pa


@pytest.fixture(scope="module")
def world(spark, docs):
    rng = random.Random(9)
    vocab = [f"tok{i}" for i in range(4000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(13, 60))) for i in range(40)] + [(90, "six words are sought as whole"), (91, "too short"), (92, None), (93, ""),
                                                                  (None, text(30)), (3, None)]
    by = dict((k, t) for k, t in items if t and k != 3) | {3: items[3][1]}
    rows, want = [], {}
    for i in range(120):
        kind, body = i % 4, text(200).split()
        want[i] = None
        if kind == 1:      # a whole item, in other letters and with other marks
            k = i % 40
            body[50:50] = by[k].upper().replace(" ", ", ").split()
            want[i] = [k]
        elif kind == 2:    # with a tenth of its words replaced
            k = i % 40
            words = by[k].split()
            for j in range(5, len(words), 10):
                words[j] = "other"
            body[80:80] = words
            want[i] = [k]
        elif kind == 3:    # eight words of an item are no overlap
            body[20:20] = by[i % 40].split()[:8]
        rows.append((i, " ".join(body)))
    rows += [(200, None), (201, ""), (202, "He said: six words are sought as WHOLE!"), (203, "too short"), (204, items[-2][1]), (1, rows[1][1]),
             (205, text(60_000) + " " + by[7])]
    want |= {200: None, 201: None, 202: [90], 203: [91], 204: [None], 205: [7]}
    return docs(rows), spark.createDataFrame(items, "item_id long, text string"), want, len(rows)


@pytest.mark.parametrize("block_words", [100, 500_000])
def test_planted_overlaps(world, block_words):
    table, items, want, n = world
    out = decontaminate(table.withColumnRenamed("source", "agreeing").withColumnRenamed("lang", "text_"), items, block_words=block_words).collect()
    assert len(out) == n
    for r in out:
        assert (r.item_ids or None) == want[r.doc_id], r.doc_id
        assert r.contaminated == bool(want[r.doc_id]) and (r.agreeing > 0) == r.contaminated


def test_repeated_words_and_empty_tables(spark, docs, world):
    items = spark.createDataFrame([(1, "la " * 40)], "item_id long, text string")
    assert decontaminate(docs([(1, "la " * 5000)]), items).first().item_ids == [1]
    assert decontaminate(docs([]), items).count() == 0
    clean = decontaminate(world[0], items.limit(0))
    assert clean.where("contaminated").count() == 0 and clean.count() == world[3]


def test_words():
    a, at = word_hashes(pa.array(["One, two", None, "", "__ one-TWO"]))
    assert at.tolist() == [0, 2, 2, 2, 4] and a[0] == a[2] and a[1] == a[3]


@pytest.mark.parametrize("n", [*range(5, 15), 20])
def test_every_accepted_pattern_of_substitutions_is_found(n):
    rng = np.random.default_rng(n)
    item = rng.integers(1, 2 ** 63, n).astype(np.uint64)
    width = min(n, WINDOW)
    changes = width - math.ceil(AGREE * width - 1e-9)
    docs, want = [], []
    for begin in range(n - width + 1):  # one window of the item, between other words
        for at in itertools.combinations(range(width), changes):
            copy = item[begin:begin + width].copy()
            copy[list(at)] = rng.integers(1, 2 ** 63, len(at)).astype(np.uint64)
            docs.append(np.concatenate([rng.integers(1, 2 ** 63, 3).astype(np.uint64), copy, rng.integers(1, 2 ** 63, 2).astype(np.uint64)]))
            want.append(width - changes)
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    found = Block([1], item, np.array([0, n])).overlaps(np.concatenate(docs), bounds, WINDOW, AGREE)
    assert [(d, same) for d, _, same in sorted(found)] == list(enumerate(want))


def test_short_items_are_met_whole(spark, docs):
    items = spark.createDataFrame([(1, "beta gamma delta"), (2, "omega")], "item_id long, text string")
    df = docs([(1, "alpha Beta, gamma delta epsilon"), (2, "beta gamma x delta"), (3, "an omega here"), (4, "omegas betagamma delta"), (5, "beta gamma delta")])
    assert {r.doc_id: r.item_ids for r in decontaminate(df, items).collect()} == {1: [1], 2: [], 3: [2], 4: [], 5: [1]}
    assert decontaminate(df, items, min_words=5).where("contaminated").count() == 0


@pytest.mark.parametrize("chunk", [1, 2, 3, 4, 6, 7, 1000])
def test_no_hit_is_lost_between_chunks(chunk):
    item = np.arange(1, 14, dtype=np.uint64) * np.uint64(7919)
    block = Block([1], item, np.array([0, 13]))
    texts, bounds = np.concatenate([item] * 6), np.arange(0, 13 * 6 + 1, 13)
    assert sorted(block.hits(texts, bounds, chunk).tolist()) == [[d, 0, 0] for d in range(6)]
