import hashlib
import random
import re

import duckdb

from calibra.llm.fim import OP12_SQL, fill_in_middle, op12_fill_in_middle, restored, transform

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _brute(text, key):
    """By findall over single units."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def _texts():
    rng = random.Random(8)
    pieces = ["a", "word", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", " ", "é", "漢字", "😀", "<", "<P", "S>", "\\", "<S", ">"]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(600)] + ["", " ", "\n\n", "x", " x ", "has <P> in it", "<M>", "<S<S>", None]


def test_transform_matches_brute_force():
    for k, t in enumerate(_texts()):
        for key in (k, -k, None):
            assert transform(t, key) == _brute(t, key), (t, key)


def test_very_long_texts():
    words = "some words \n" * 500_000
    key = next(k for k in range(100) if _brute("x y z", k)[1] != "plain")
    assert transform(words, key) == _brute(words, key)
    blank = " " * 2_000_000
    assert transform(blank, key) == _brute(blank, key)


def test_rows(spark, docs):
    rows = [(k, t) for k, t in enumerate(_texts())] + [(None, "a b c"), (None, None), (7, "one two three four"), (7, "one two three four")]
    df = docs(rows).withColumnRenamed("lang", "output").withColumnRenamed("source", "form").repartition(3)
    out = fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "n_chars", "n", "form", "output", "prefix_chars", "middle_chars"]
    got = out.select("doc_id", "text", "n", "form", "output", "prefix_chars", "middle_chars", restored(out["output"], out["form"]).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[2:7]) == _brute(r.text, r.doc_id)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs([])).count() == 0
    # neither key nor text is kept, or the text is called like a column made
    assert fill_in_middle(df, keep=["n_chars"]).columns == ["n_chars", "n", "form", "output", "prefix_chars", "middle_chars"]
    odd = docs([(7, "one two three four")]).withColumnRenamed("text", "output")
    assert [tuple(r)[-5:] for r in fill_in_middle(odd, "output").collect()] == [_brute("one two three four", 7)]


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    cur = con.execute(OP12_SQL)
    names = [d[0] for d in cur.description]
    out = op12_fill_in_middle(spark, sf)
    assert out.columns == names
    assert sorted(map(tuple, out.collect())) == sorted(cur.fetchall())
