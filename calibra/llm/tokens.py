"""Token counts of whole texts, huge texts by overlap resynchronisation.

A text up to ``chunk`` characters is encoded at once.  A longer one is encoded
in chunks that overlap.  Each chunk comes back with offsets and pre-token
numbers; two neighbours are spliced at a *proven* common boundary:

* pre-tokenisation reads left to right without look-behind, so once both
  encodings start a pre-token at the same character, they agree from there on;
* the end of a chunk can only disturb its last ``GUARD`` pre-tokens, or those
  within reach of a special string cut off at the end (``reach`` characters).

So a boundary in both encodings, before the guarded end of the left one, is
where the whole text's encoding has a boundary too.  If the overlap has none
(one endless word, say), it is doubled, and at last the chunks are merged.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.common import col, ddl, fresh, map_arrow, others, table

GUARD = 4
CHUNK = 1 << 16
OVERLAP = 256
#: Characters given to the tokenizer in one call.
CALL_CHARS = 1 << 20


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer at ``path``, single-threaded, without padding or cuts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


def _reach(tok) -> int:
    return max([0, *(len(t.content) for t in tok.get_added_tokens_decoder().values())])


class _Chunk:
    """An encoded range [start, end) of a text: its ids and where its
    pre-tokens begin (absolute character -> index of the first token)."""

    def __init__(self, tok, text: str, start: int, end: int):
        e = tok.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.ids = start, end, e.ids
        self.at: dict[int, int] = {}
        self.order: list[int] = []
        before = None
        for i, (word, span) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if word is None or word != before:
                self.at[start + span[0]] = i
                self.order.append(start + span[0])
            before = word


def _splice(left: _Chunk, right: _Chunk, reach: int) -> int | None:
    """The first proven common boundary at or after ``right.start``."""
    if len(left.order) <= GUARD:
        return None
    last = min(left.order[-GUARD], left.end - reach)
    return next((p for p in right.order if p <= last and p in left.at), None)


def encode_chunked(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
    """The ids of ``text`` in order, a list per chunk; the same ids as
    ``tok.encode(text)`` gives, in memory that follows the chunk."""
    reach, n = _reach(tok), len(text)
    left = _Chunk(tok, text, 0, min(chunk, n))
    begin = 0  # index in left.ids of the first id not given out
    while left.end < n:
        width = overlap
        while True:
            start = max(left.start, left.end - width)
            right = _Chunk(tok, text, start, min(n, left.end + chunk))
            p = _splice(left, right, reach) if start > left.start else None
            # the place must lie at or after what has been given out already
            if p is not None and left.at[p] >= begin:
                yield left.ids[begin:left.at[p]]
                left, begin = right, right.at[p]
                break
            if start == left.start:
                # no common boundary in the whole chunk: merge the two
                at = next((c for c, i in left.at.items() if i == begin), left.start)
                left = _Chunk(tok, text, at, right.end)
                begin = 0
                break
            width *= 2
    yield left.ids[begin:]


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text",
                 limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP,
                 keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if None) of ``docs`` with ``n_bytes``, ``n_tokens`` (long) and ``over_limit``.

    Null and empty texts have 0 bytes and 0 tokens; rows are never dropped,
    merged or reordered, so repeated rows each keep their count.  Columns of
    these names are replaced; all others are kept as they are.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        tok = load_tokenizer(tokenizer_path)
        texts = batch.column(batch.num_columns - 1).to_pylist()
        out = [0] * len(texts)
        call: list[int] = []
        size = 0

        def flush():
            for i, e in zip(call, tok.encode_batch_fast([texts[i] for i in call], add_special_tokens=False), strict=True):
                out[i] = len(e)
            call.clear()

        for i, t in enumerate(texts):
            if not t:
                continue
            if len(t) > chunk:
                out[i] = sum(map(len, encode_chunked(tok, t, chunk, overlap)))
                continue
            call.append(i)
            size += len(t)
            if size >= CALL_CHARS:
                flush()
                size = 0
        flush()
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int64())],
                                          names=[*batch.schema.names[:-1], "n_tokens"])

    rest = others(docs.columns if keep is None else keep, "n_bytes", "n_tokens", "over_limit")
    src = docs.select(*map(col, rest), F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long").alias("n_bytes"),
                      col(text).alias(fresh("text", [*rest, "n_bytes"])))
    out = map_arrow(src, count, ddl(src, len(rest) + 1) + "n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of ``documents`` under the byte-level vocabulary."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
