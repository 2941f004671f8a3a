"""Fill-in-middle transformation by repeated-capture matching.

A text is a row of units: a word with the white space before it, or the white
space at the end.  One ``fullmatch`` of ``(unit)*`` by the regex library keeps
every repetition of the group, so ``match.ends(1)`` is the number of units and
the place of every possible cut at once; no loop goes over the units.

Cuts and form are drawn from a hash of the key, so they do not depend on
partitions, retries or the order of rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.common import col, ddl, fresh, map_arrow, others, table, with_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
SEED = 42
#: Per cent of texts that are transformed, and of these in the form spm.
RATE, SPM = 50, 80
#: Possessive, as no unit ever gives back what it has taken: the match keeps
#: the captures and no way back.
UNITS = regex.compile(r"((?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++))*+")
MADE = ("n", "form", "output", "prefix_chars", "middle_chars")


def draws(key: object, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a key (a null key counts as the empty string)."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4))


def transform(text: str | None, key: object, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, str, int | None, int | None]:
    """(units, form, output, characters of the prefix, of the middle)."""
    text = text or ""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or any(mark in text for mark in MARKS) or h3 % 100 >= rate:
        return n, "plain", text, None, None
    a, b = (ends[u - 1] if u else 0 for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", a, b - a
    return n, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", a, b - a


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None,
                   seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``keep`` (all columns if None) of ``docs`` with ``n`` (units), ``form``
    (plain, psm or spm), ``output``, ``prefix_chars`` and ``middle_chars`` (code
    points; null if plain).

    A null text is empty, and empty texts are plain, as are texts that hold a
    mark.  A null key is drawn for as the empty string; repeated rows give
    equal rows; texts are matched whole, however long.  Columns called like
    those made are replaced (so is a text column called ``output``).
    """
    rest = others(docs.columns if keep is None else keep, *MADE)
    src, at = with_text(docs.withColumn(fresh("key", docs.columns), col(key).cast("string")), [*rest, fresh("key", docs.columns)], text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [transform(t.as_py(), k.as_py(), seed, rate, spm) for t, k in zip(batch.column(at), batch.column(len(rest)), strict=True)]
        n, form, output, prefix, middle = zip(*made, strict=True)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:len(rest)], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(output, pa.string()),
             pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())], names=[*batch.schema.names[:len(rest)], *MADE])

    return map_arrow(src, run, ddl(src, len(rest)) + "n long, form string, output string, prefix_chars long, middle_chars long")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    part = F.split(output, "<[PSM]>", -1)  # what stands before the first mark, and after each
    return (F.when(form == "psm", F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2))))
            .when(form == "spm", F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1))))
            .otherwise(output))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-middle form: lengths, and digests of the output
    and of the text rebuilt from it."""
    made = fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
with hashed as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), drawn as (
  select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
    ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
    ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from hashed
), cut as (
  select doc_id, text, cast(len(units) as bigint) as n, units,
    least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
         when h4 % 100 < 80 then 'spm' else 'psm' end as form from drawn
), parts as (
  select doc_id, text, n, form, array_to_string(list_slice(units, 1, a), '') as prefix,
    array_to_string(list_slice(units, a + 1, b), '') as middle, array_to_string(list_slice(units, b + 1, n), '') as suffix from cut
)
select doc_id, n, form,
  case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""
