import random
import re

import pytest

from calibra.llm.rules import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_statistics_match_brute_force(docs):
    rng = random.Random(3)
    pool = ["a", "b", "The", "é漢", "x|y", "***", " z", "end."]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\t", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", " \n\t ", "one", "a b c d", "a b c d e", "a " * 20_000, "word " * 3 + "\n" * 50]
    rows = quality_rules(docs(list(enumerate(texts)))).collect()
    for r in rows:
        assert tuple(r[c] for c in BASE) == brute(texts[r.doc_id]), texts[r.doc_id]


PROSE = "The river runs past the old mill and the road follows it down to the town."


@pytest.mark.parametrize("text, kept, clean", [
    (PROSE + "\nThen it turns, and more follows.", True, PROSE + "\nThen it turns, and more follows."),
    (PROSE + "\nHome | About | Contact | Help", True, PROSE),
    (PROSE + "\nLicensed under the Apache License, Version 2.0.", True, PROSE),
    (PROSE.rstrip("."), True, PROSE.rstrip(".")),                       # long prose cut short is prose
    ("alpha | beta | gamma\n" * 3 + "one | two | three | four five", False, ""),
    ("Er*** reed*** ndsh*** ing&&& erhe*** of%%% to%%% inrent$$$ antionhe&&& ou%%%.", False, ""),
    ("Short one.", False, "Short one."),                                # under ten words
])
def test_verdicts(docs, text, kept, clean):
    r = quality_rules(docs([(1, text)])).first()
    assert (r.kept, r.clean_text) == (kept, clean)


def test_rows_columns_and_empty_table(spark, docs):
    df = docs([(1, PROSE), (1, PROSE), (None, None)]).withColumnRenamed("source", "n_words").withColumnRenamed("lang", "_t")
    out = quality_rules(df)
    assert out.columns.count("n_words") == 1 and "_t" in out.columns
    assert sorted(r.n_words for r in out.collect()) == [0, 16, 16]
    assert quality_rules(docs([])).count() == 0


def test_filter_stays_above(docs):
    """A filter on the verdict must not repeat the steps inside each other."""
    text = " ".join(f"w{i}" for i in range(20_000)) + "."
    assert quality_rules(docs([(1, text)])).where("kept").count() == 1
