import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from calibra.llm.chat import OP13_SQL, escape, format_chats, op13_chat_formatting, read_loss, read_turns, unescape

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["", "\\", "\\\\", "\\l", "\\\\l", "<", ">", "<end>\n", "<sep>\n", "<|user|>\n", "a<b>c\\g\n", "|>\n", "\\l\\\\g\\", "é漢😀 <|", "line\n\nline "]


def _rows(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "a|>\nb", "end", "", None]), "".join(rng.choices(ODD, k=rng.randint(0, 4)))))
    rows += [(99, k, "assistant", f"turn {k}") for k in range(500)]                     # one role, many turns
    rows += [(100, None, "user", None), (100, 1, None, "x"), (None, 1, "user", "no id"), (None, 2, "assistant", "no id"), (101, 1, "user", "word " * 200_000)]
    rows += [(102, 5, "assistant", "b"), (102, 5, "assistant", "a"), (102, 5, "assistant", "a"), (102, 5, "user", "z")]  # ties and repeated rows
    rng.shuffle(rows)
    return rows


def _plain(rows):
    """The turns of each conversation by brute force."""
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in out.items()}


def _format(turns):
    esc = lambda s: s.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g")
    out, last = "", None
    for r, x in turns:
        out += "<sep>\n" + esc(x) if r == last else ("<end>\n" if last is not None else "") + f"<|{esc(r)}|>\n{esc(x)}"
        last = r
    return out + "<end>\n"


def test_escapes_are_undone(spark):
    df = spark.createDataFrame([(x + y,) for x in ODD for y in ODD], "s string")
    assert df.where(unescape(escape(F.col("s"))) != F.col("s")).count() == 0
    assert df.where(escape(F.col("s")).rlike("[<>]")).count() == 0


def test_formatting_and_reading_back(spark):
    rows = _rows(spark)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", turns string, runs int").repartition(5)
    want = _plain(rows)
    got = (format_chats(df).select("*", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
           .collect())
    assert len(got) == len(want)
    for r in got:
        assert r.formatted == _format(want[r.conv_id])
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.loss == "".join(x for role, x in want[r.conv_id] if role == "assistant")
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_renamed_columns(spark):
    df = spark.createDataFrame([(1, 1, "user", "q"), (1, 2, "assistant", "a")], "`c.id` long, n long, who string, what string")
    assert format_chats(df, "c.id", "n", "who", "what").first().formatted == "<|user|>\nq<end>\n<|assistant|>\na<end>\n"


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    cur = con.execute(OP13_SQL)
    names = [d[0] for d in cur.description]
    want = {r[0]: r for r in cur.fetchall()}
    out = op13_chat_formatting(spark, sf)
    assert out.columns == names
    assert {r[0]: tuple(r) for r in out.collect()} == want
    both = "</s>[INST] ok [/INST]"
    assert want[-1][1:5] == (2, hashlib.sha256(f"user\n{both}\nassistant\n{both}\n".encode()).hexdigest(), len(both), hashlib.sha256(both.encode()).hexdigest())


def test_no_python_in_the_plan(spark, sf):
    plan = op13_chat_formatting(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ScalaUDF"))
