"""Line-first quality rules, in DataFrame functions only.

Every line of a text is judged by itself (punctuation, navigation,
boilerplate); failing lines are removed; a document that loses too much of its
text is rejected.  Document-wide statistics of the uncleaned text give the base
verdict.  All work is narrow: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.common import SPACE, WORD, col, fresh, others, sealed, table

#: How a finished line may end, what divides menu entries, and
#: phrases of page furniture (lower case; en, de, fr, es).
LINE_END = r"[.!?…:;。！？][\"'”’»)\]]*$"
MENU_MARK = r"[|»›·•]"
BOILERPLATE = (
    "licensed under|all rights reserved|terms of use|terms of service|privacy policy|cookie policy|"
    "uses cookies|use of cookies|javascript is disabled|enable javascript|lorem ipsum|sign up for|"
    "subscribe to our|click here|alle rechte vorbehalten|datenschutzerkl|nutzungsbedingungen|"
    "tous droits réservés|politique de confidentialité|conditions d'utilisation|"
    "todos los derechos reservados|política de privacidad|términos de uso"
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the method."""

    #: a line with a larger share of marks (neither letters, digits nor white space) fails
    max_marks: float = 0.25
    #: a line with at least so many menu dividers, of one to ``menu_words`` words each, fails
    menu_marks: int = 2
    menu_words: int = 4
    #: a line without an end mark fails if it has fewer words (longer ones are prose that was cut)
    min_open_words: int = 12
    #: a document that keeps less than this share of its characters in lines with a word is rejected
    min_kept: float = 0.5


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    """Whether one line (with a word) fails a rule."""
    stripped = F.rtrim(line)
    size = F.length(line)
    marks = F.regexp_count(line, F.lit(r"[^\p{L}\p{M}\p{N}\s]"))
    dividers = F.regexp_count(line, F.lit(MENU_MARK))
    words = F.regexp_count(line, F.lit(WORD))
    unfinished = ~stripped.rlike(LINE_END) & (words < rules.min_open_words)
    noisy = marks > size * F.lit(rules.max_marks)
    menu = (dividers >= rules.menu_marks) & (
        words - dividers <= (dividers + 1) * rules.menu_words)
    boiler = F.lower(line).rlike(BOILERPLATE)
    return unfinished | noisy | menu | boiler


def quality_rules(docs: DataFrame, text: str = "text", rules: LineRules = LineRules(),
                  keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if None) of ``docs`` with the statistics and verdicts

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (long), ``base_failed``, ``kept`` (boolean), ``n_lines``
    (lines with a word), ``n_lines_kept``, ``chars_kept`` (long) and
    ``clean_text`` (the lines kept, in order, joined by a line feed).

    A null or word-less text has 0 everywhere, fails the base rules and has an
    empty ``clean_text``.  Rows are judged alone, so repeated rows agree.
    Columns of the names above are replaced.  Windows of five words are
    compared by a 64-bit hash within their own text.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            "n_lines", "n_lines_kept", "chars_kept", "clean_text"]
    rest = others(docs.columns if keep is None else keep, *made)
    t, words, hashes, order, lines, good, whole = (fresh(n, [*rest, *made]) for n in (
        "_t", "_words", "_hashes", "_order", "_lines", "_good", "_whole"))
    c = F.col
    df = docs.select(*map(col, rest), F.coalesce(col(text), F.lit("")).alias(t))
    df = df.withColumns({
        words: _words(c(t)),
        lines: F.filter(F.split(c(t), "\n"), lambda x: x.rlike(WORD)),
        "n_symbols": F.regexp_count(c(t), F.lit(r"[#*$%&|<>]")).cast("long"),
    })
    df = df.select(
        *map(col, rest), "n_symbols", words, lines,
        F.filter(c(lines), lambda x: ~line_fails(x, rules)).alias(good),
        F.when(F.size(words) >= 5, F.transform(
            F.sequence(F.lit(0), F.size(words) - 5),
            lambda i: F.xxhash64(*[F.get(c(words), i + k) for k in range(5)])))
        .otherwise(F.array().cast("array<long>")).alias(hashes))
    # (hash, place) in order, only where a window comes twice
    df = df.withColumn(order, F.when(
        F.size(F.array_distinct(c(hashes))) < F.size(c(hashes)),
        F.sort_array(F.transform(c(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(c(order), lambda x, k: (x["h"] == F.get(c(order), k - 1)["h"])
                     | (x["h"] == F.get(c(order), k + 1)["h"]))
    places = fresh("_places", [*rest, *made])
    df = df.withColumn(places, F.sort_array(F.transform(
        F.when(F.size(c(order)) > 0, twice), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(c(places), lambda p, k: F.least(F.lit(5), F.coalesce(F.get(c(places), k + 1) - p, F.lit(5)))),
        F.lit(0), lambda a, x: a + x)
    df = df.select(
        *map(col, rest),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(good).cast("long").alias("n_lines_kept"),
        F.length(F.array_join(lines, "")).cast("long").alias(whole),
        F.length(F.array_join(good, "")).cast("long").alias("chars_kept"),
        F.array_join(good, "\n").alias("clean_text"))
    base = (c("n_words") < 10) | (F.lit(100) * c("n_repeat_words") > F.lit(20) * c("n_words"))
    df = df.withColumn("base_failed", base)
    df = df.withColumn("kept", ~c("base_failed") & (c("chars_kept") >= c(whole) * F.lit(rules.min_kept)))
    return sealed(df.select(*map(col, rest), *made), made)


_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            "n_lines", "n_lines_kept", "chars_kept"]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(*_COLUMNS)


#: The same from rows instead of arrays: words, windows and lines are unnested.
OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
      FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
ws AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
g AS (SELECT r, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' ||
             lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS five
      FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM g WHERE five IS NOT NULL
        QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(5) AS ks(k) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT r, line, length(line) AS size,
         length(regexp_replace(line, '[\pL\pM\pN\s]', '', 'g')) AS marks,
         length(regexp_replace(line, '[^|»›·•]', '', 'g')) AS dividers,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
j AS (SELECT *, NOT (
         (NOT regexp_matches(rtrim(line, ' '), '[.!?…:;。！？]["''”’»)\]]*$') AND n < 12)
         OR marks > size * 0.25
         OR (dividers >= 2 AND n - dividers <= (dividers + 1) * 4)
         OR regexp_matches(lower(line), 'BOILER')) AS ok FROM lw),
ls AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, sum(size) AS all_chars,
         count(*) FILTER (ok) AS n_lines_kept, coalesce(sum(size) FILTER (ok), 0) AS chars_kept
       FROM j GROUP BY r),
s AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_lines_kept, 0)::BIGINT AS n_lines_kept,
         coalesce(chars_kept, 0)::BIGINT AS chars_kept, coalesce(all_chars, 0) AS all_chars
      FROM d LEFT JOIN ws USING (r) LEFT JOIN cov USING (r) LEFT JOIN ls USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND chars_kept >= all_chars * 0.5 AS kept,
       n_lines, n_lines_kept, chars_kept
FROM s
""".replace("BOILER", BOILERPLATE.replace("'", "''"))
