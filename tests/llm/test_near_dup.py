import random
import re
from collections import Counter

import numpy as np
import pytest

from calibra.llm.components import components
from calibra.llm import near_dup
from calibra.llm.near_dup import deduplicate, near_duplicates, packed, prob_min_hash, similarity, unpacked


def _weighted(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def _pair(seed):
    rng = np.random.default_rng(seed)
    a = np.sort(rng.choice(2 ** 49, 150, replace=False).astype(np.uint64))
    b = np.sort(np.concatenate([a[rng.random(150) < 0.8], rng.choice(2 ** 49, 30).astype(np.uint64)]))
    return a, rng.integers(1, 5, len(a)), b, rng.integers(1, 5, len(b))


def test_signatures_estimate_the_weighted_similarity():
    for seed in range(4):
        a, x, b, y = _pair(seed)
        exact = _weighted(dict(zip(a.tolist(), x.tolist())), dict(zip(b.tolist(), y.tolist())))
        assert abs(similarity(a, x, b, y)[1] - exact) < 1e-9
        s = prob_min_hash(np.concatenate([a, b]), np.concatenate([x, y]).astype(float), np.array([0, len(a), len(a) + len(b)]), 3000)
        assert abs((s[0] == s[1]).mean() - exact) < 0.05


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)] + [(7, 7)]
    up = {}
    find = lambda v: v if up.setdefault(v, v) == v else find(up[v])
    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {v: got.get(v, v) for v in up} == {v: find(v) for v in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_grow_from_known_ones(spark):
    links = lambda rows: spark.createDataFrame(rows, "a long, b long")
    known = components(links([(5, 6), (6, 7), (1, 2)]))
    assert components(links([]), known) is known
    got = {r.id: r.component for r in components(links([(9, 7), (2, 6), (30, 31)]), known).collect()}
    assert got == {2: 1, 5: 1, 6: 1, 7: 1, 9: 1, 31: 30}


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_classes_match_brute_force(docs):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(12):  # groups whose members differ more and more
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 150))]
        for k in range(10):
            words = list(base)
            for _ in range(k // 2):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n + i, t) for i, t in enumerate(["one two", "one two", "one  two", "a b c d", "x", "line again here now ok\n" * 30, "line again here now ok\n" * 25])]
    sets = {d: _shingles(t) for d, t in rows}
    up = {d: d for d in sets}
    find = lambda v: v if up[v] == v else find(up[v])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(rows)).collect()}
    assert got == {d: find(d) for d in sets}


def test_large_groups_and_odd_rows(docs):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(200)]                         # exact copies
    for i in range(200, 400):                                                # near copies of it
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, None), (502, ""), (503, " \n"), (504, "lone text of its own words here"), (504, "lone text of its own words here"),
             (None, " ".join(base)), (None, "nothing like the others at all, is it")]
    out = near_duplicates(docs(rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "items")).collect()
    assert len(out) == len(rows)
    got = [(r.doc_id, r.class_id) for r in out]
    assert all(c == 0 for d, c in got if d is not None and d < 400)
    assert {(d, c) for d, c in got if d is not None and d >= 500} == {(d, d) for d in (500, 501, 502, 503, 504)}
    assert sorted(map(str, (c for d, c in got if d is None))) == ["0", "None"]
    assert near_duplicates(docs([])).count() == 0


def _weighted_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def _links(texts):
    """All links of texts, by brute force: (i, j), i < j."""
    sets = [_weighted_shingles(t) for t in texts]
    out = set()
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            both = len(x.keys() & y.keys())
            if both and max(both / len(x.keys() | y.keys()), _weighted(x, y)) >= 0.8 - 1e-12:
                out.add((j, i))
    return out


@pytest.mark.parametrize("group, block", [(64, 512), (2, 7)])
def test_no_link_across_components_is_lost(spark, docs, monkeypatch, group, block):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", block)
    monkeypatch.setattr(near_dup, "GROUP_ROWS", group)
    rng = random.Random(9)
    texts = []
    for i in range(40):  # similarity of exactly 0.8, on 4 and 5 shingles; every third with repeated ones
        word = lambda n: [f"t{i}_{k}" for k in range(n)]  # noqa: B023, E731
        texts += [word(8), word(9)] if i % 3 else [word(4) * 6, word(4) * 7]
    passage = [f"p{k}" for k in range(60)]  # half of each of these texts is one passage
    for i in range(60):
        own = [f"o{i // 2}_{k}" for k in range(50)]
        for _ in range(i % 4):
            own[rng.randrange(50)] = f"z{i}"
        texts.append(passage + own)
    lines = [[f"l{i}_{k}" for k in range(12)] for i in range(6)]  # texts made of few, common lines
    texts += [sum(rng.sample(lines, rng.randint(3, 6)), []) for _ in range(60)]
    texts = list(dict.fromkeys(" ".join(t) for t in texts))
    sets = near_dup.shingle_sets(docs(list(enumerate(texts))).selectExpr("doc_id AS node", "text"))
    # nothing has been compared before
    nodes = spark.createDataFrame([(i, i) for i in range(len(texts))], "id long, component long")
    none = spark.createDataFrame([], "a long, b long")
    got = {(min(r), max(r)) for r in near_dup._across(nodes, none, sets, 0.8).collect()}
    assert got <= _links(texts)
    if group == 64:
        assert got == _links(texts)
    # links inside a component that others have made are not needed
    up = lambda links: _roots(len(texts), links)
    assert up(got) == up(_links(texts))


def _roots(n, links):
    up = list(range(n))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v
    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(v) for v in range(n)]


def test_packed_numbers():
    x = np.array([0, 1, 2 ** 48 - 1, 2 ** 40 + 5], np.uint64)
    assert unpacked(packed(x)).tolist() == x.tolist()


def test_very_long_texts(docs):
    words = [f"w{i}" for i in range(300_000)]
    other = list(words)
    other[7] = "x"
    twice = [f"r{i % 500}" for i in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:150_000])), (4, " ".join(twice)), (5, " ".join(twice[:140_000]))]
    assert {r.doc_id: r.class_id for r in near_duplicates(docs(rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_ids_that_come_with_several_texts(docs):
    rows = []
    for i in range(40):
        a, b = [f"a{i}_{k}" for k in range(40)], [f"b{i}_{k}" for k in range(40)]
        rows += [(100 + i, " ".join(a)), (100 + i, " ".join(b)), (200 + i, " ".join(b[:-1] + ["new"]))]
    for parts in (1, 7):
        got = near_duplicates(docs(rows).repartition(parts)).collect()
        assert len(got) == 120
        assert {(r.doc_id, r.class_id) for r in got if r.doc_id >= 200} == {(200 + i, 100 + i) for i in range(40)}
    stay = deduplicate(docs(rows).withColumnRenamed("lang", "_digest").withColumnRenamed("source", "_id")).collect()
    assert sorted(r.text for r in stay) == sorted(t for d, t in rows if d < 200)


def test_near_copies_of_a_text_without_an_id(docs):
    base = [f"n{k}" for k in range(50)]
    rows = [(None, " ".join(base)), (None, " ".join(base[:-1])), (9, " ".join(base[1:])), (None, None), (4, "")]
    got = near_duplicates(docs(rows)).collect()
    assert sorted(map(str, ((r.doc_id, r.class_id) for r in got))) == sorted(map(str, [(None, 9), (None, 9), (9, 9), (None, None), (4, 4)]))
    stay = deduplicate(docs(rows + [(9, " ".join(base[1:]))])).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in stay))) == sorted(map(str, [(9, " ".join(base[1:])), (None, None), (4, "")]))


def test_a_bucket_of_unlike_texts_that_share_a_passage(docs):
    """Texts that are one half alike meet in many buckets; only planted pairs
    are links."""
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, passage + " " + " ".join(f"u{i // 2 if i < 20 else i}_{k}" for k in range(40 + (i < 20 and i % 2)))) for i in range(1500)]
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(rows).repartition(8)).collect()}
    assert got == {i: i - i % 2 if i < 20 else i for i in range(1500)}
