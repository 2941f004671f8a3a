import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from calibra.llm import language
from calibra.llm.language import BEFORE, build, code_bits, fit, identify, recognised, remainder, usual


def _grams(text):
    b = bytes([BEFORE] * 3) + text.encode()
    return [tuple(b[i:i + 4]) for i in range(len(b) - 3)]


def _ppm(train, text, contexts):
    """Plain PPM with escape C and exclusion; ``contexts`` says which are used."""
    counts = {}
    for t in train:
        for a, b, c, s in _grams(t):
            for ctx in ((a, b, c), (b, c), (c,), ()):
                counts.setdefault(ctx, {}).setdefault(s, 0)
                counts[ctx][s] += 1
    bits = 0.0
    for a, b, c, s in _grams(text):
        out = set()
        started = False
        for ctx in ((a, b, c), (b, c), (c,), ()):
            if not started and ctx and ctx not in contexts:
                continue
            started = True
            left = {k: n for k, n in counts.get(ctx, {}).items() if k not in out}
            scale = sum(left.values()) + len(left)
            if s in left:
                bits -= math.log2(left[s] / scale)
                break
            if left:
                bits -= math.log2(len(left) / scale)
            out |= set(left)
        else:
            bits += math.log2(256 - len(out))
    return bits


def test_code_lengths_match_a_plain_tree():
    rng = random.Random(1)
    train = {"x": ["abcab dab" * 3, "bad cab"], "y": ["zyx yzé" * 4, "yx zy", "xxéz"]}
    counts, total = {}, {}
    for name, texts in train.items():
        grams = [g for t in texts for g in _grams(t)]
        keys = [a << 24 | b << 16 | c << 8 | s for a, b, c, s in grams]
        values, n = np.unique(keys, return_counts=True)
        counts[name] = (values, n)
        for a, b, c, _ in grams:
            for ctx in ((a, b, c), (b, c), (c,)):
                total[ctx] = total.get(ctx, 0) + 1
    model = build(counts, min_context=3)
    contexts = {c for c, n in total.items() if n >= 3}
    texts = ["", "abc", "q!", "zyx", "é"] + ["".join(rng.choice("abcdxyzé q") for _ in range(40)) for _ in range(20)]
    got = code_bits(model, pa.array(texts), block=16)
    for t, row in zip(texts, got, strict=True):
        for name, bits in zip(model.languages, row, strict=True):
            assert abs(bits - _ppm(train[name], t, contexts)) < 1e-2, (t, name)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify(docs, fit(docs, train_docs=200)).where("held_out")
    right = out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.97
    assert out.where("score < 0 OR score > 1").count() == 0


def test_odd_rows(spark, docs):
    base = [(i, f"the house and the garden number {i}", "en") for i in range(40)] + [
        (100 + i, f"das haus und der garten nummer {i}", "de") for i in range(40)]
    model = fit(docs(base))
    odd = docs([(1, None), (2, ""), (3, "123 !!"), (None, "der garten und das haus"), (5, "the garden " * 50_000), (5, "the garden " * 50_000)])
    odd = odd.withColumnRenamed("source", "lang_pred").withColumnRenamed("n_chars", "text_")
    rows = identify(odd, model).collect()
    got = [(r.doc_id, r.held_out, r.lang_pred) for r in rows]
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    assert got == [(1, held(1), "und"), (2, held(2), "und"), (3, held(3), "und"), (None, False, "de"), (5, held(5), "en"), (5, held(5), "en")]
    assert [r.score for r in rows[:3]] == [0.0, 0.0, 0.0]
    assert identify(odd, fit(docs([]))).first().lang_pred == "und"
    assert identify(docs([]), model).count() == 0


def test_remainder_is_crc32(spark):
    rows = spark.range(200).select("id", remainder(F.col("id")).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def _speech(seed, n=60):
    """Texts of an invented language: its own syllables, in its own order."""
    rng = random.Random(seed)
    syllables = ["".join(rng.choice(x) for x in ("bcdfghklmnprstvwz", "aeiou", "nrsl ")) for _ in range(40)]
    return [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 60))) for _ in range(n)]


def test_every_label_is_learned(docs, monkeypatch):
    monkeypatch.setattr(language, "TABLE_LANGUAGES", 16)
    rows = [(1000 * k + i, t, f"l{k:02d}") for k in range(70) for i, t in enumerate(_speech(k, 12))]
    model = fit(docs(rows))
    assert len(model.languages) == 70
    got = identify(docs(rows), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    bits = code_bits(model, pa.array([r.text for r in got]))
    assert [r.lang_pred for r in got] == [model.languages[k] for k in bits.argmin(1)]
    assert all(math.isclose(r.bits, b, rel_tol=1e-6) for r, b in zip(got, bits.min(1)))


def test_what_is_no_learned_language_is_not_recognised(docs):
    rng = random.Random(5)
    rows = [(100 * k + i, t, f"l{k}") for k in range(2) for i, t in enumerate(_speech(k, 90))]
    df = docs(rows)
    model = fit(df)
    known = usual(model, df)
    assert sorted(known) == ["l0", "l1"]
    odd = [(1, "zqx vwk xqz jjj qqq xwv kkq zzx"), (2, "Это русский текст, которого никто не учил, и он довольно длинный."), (3, " ".join(_speech(77, 3))),
           (4, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400))), (5, None), (6, ""), (7, "123"), (8, rows[3][1]), (9, rows[100][1])]
    stay = {r.doc_id for r in recognised(identify(docs(odd), model), known).collect()}
    assert stay == {8, 9}
    assert recognised(identify(df, model), known).count() >= 0.99 * len(rows)
    assert recognised(identify(docs([]), fit(docs([]))), {}).count() == 0


def test_limits_come_from_all_documents(docs):
    """Not from the sample that the trees were counted on."""
    rows = [(i, t, "l0") for i, t in enumerate(_speech(0, 120))]
    df = docs(rows)
    model = fit(df, train_docs=30)
    mean, variance = usual(model, df)["l0"]
    coded = [r for r in identify(df, model).collect() if not r.held_out]
    assert math.isclose(mean, sum(r.bits for r in coded) / sum(r.n_bytes for r in coded), rel_tol=1e-9)
    assert math.isclose(variance, np.var([r.bits / r.n_bytes for r in coded if r.n_bytes >= language.LONG_BYTES], ddof=1), rel_tol=1e-6)
