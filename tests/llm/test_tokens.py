import random

import pyarrow as pa
import pytest

from calibra.llm.tokens import count_tokens, encode_chunked, load_tokenizer
from calibra.llm.wordcode import WordEncoder

PIECES = ["a", "b", " ", "  ", "\n", "'", "ll", "'s", "<|endoftext|>", "<|", "endoftext|>", "é", "漢", "1", "!", "́", "🎉"]


@pytest.mark.parametrize("chunk, overlap", [(20, 1), (40, 4), (64, 16), (200, 64)])
def test_chunks_splice_to_the_whole_encoding(byte_bpe, chunk, overlap):
    tok, rng = load_tokenizer(byte_bpe), random.Random(chunk)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    texts += ["a" * 3000, " " * 2000, "ab " * 1500, "\n" * 90 + "x" * 900, "<|endoftext|>" * 60]
    for t in texts:
        got = [x for part in encode_chunked(tok, t, chunk, overlap) for x in part]
        assert got == tok.encode(t, add_special_tokens=False).ids, t


def test_counts(docs, byte_bpe):
    tok = load_tokenizer(byte_bpe)
    texts = [None, "", "hello <|endoftext|> wörld", "x" * 5000, "the cat sat. " * 3000, "same", "same"]
    df = docs(list(enumerate(texts))).withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "text_")
    for r in count_tokens(df, byte_bpe, chunk=1000, overlap=32).collect():
        t = texts[r.doc_id] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
    assert count_tokens(docs([]), byte_bpe).count() == 0


def test_word_encoder_equals_the_library(word_bpe):
    enc, rng = WordEncoder(word_bpe), random.Random(8)
    pool = list("abcXYZ é漢Σσς1.,!?'\n\t\r\x0b\x0c\x1c\x85　İ🎉ﬁ…»`’−") + [
        "<|endoftext|>", "<|startoftext|>", "́", " ", "'s", " 'LL", "가", "ᄀ", "ᅡ"]
    for _ in range(400):
        texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(6)] + [None, ""]
        ids, at = enc.encode(pa.array(texts), 1)
        for k, t in enumerate(texts):
            assert ids[at[k]:at[k + 1]].tolist() == enc.tok.encode(t or "", add_special_tokens=False).ids + [1], t
