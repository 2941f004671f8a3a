"""Batch encoding for tokenizers that never join across ASCII white space.

The white-space-dropping BPE vocabulary treats each word by itself, so a batch
is encoded by its distinct words: Arrow splits and dictionary-encodes the
texts, the tokenizer sees each new word once, and numpy gathers the ids.  A
bounded memo keeps words between batches of one Python worker.
"""

from __future__ import annotations

from itertools import repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from calibra.llm.tokens import load_tokenizer

#: Words kept between batches, and the longest one kept.
MEMO_WORDS = 400_000
MEMO_BYTES = 48
#: New words given to the tokenizer in one text.
JOINED = 256
#: Marks that may end a plain word; a run of them is one pre-token.
MARKS = r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~…»«”“]"""


class WordEncoder:
    """Encodes as the tokenizer file says.

    New words that are letters, perhaps followed by marks, are two pre-tokens
    at most.  They go to the library many at a time, in a text with blanks
    between the pre-tokens, through the same model with the same lower-casing
    but without the search for pre-tokens; every pre-token's last id is marked
    as the end of a word, which parts them again.  All other words go through
    the whole tokenizer one by one.
    """

    def __init__(self, path: str):
        from tokenizers.normalizers import Lowercase
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tok = load_tokenizer(path)
        # one model in memory, with two ways in
        self.full = (self.tok.normalizer, self.tok.pre_tokenizer)
        self.short = (Lowercase(), Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)]))
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.memo: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first, self.count, self.uses = (np.zeros(1 << 16, np.int32) for _ in range(3))
        self.n_flat = self.n_words = 0

    def _shrink(self) -> None:
        """Forget all but the words used most: at most half of the memo stays."""
        places = np.fromiter(self.memo.values(), np.int64, len(self.memo))
        uses = self.uses[places]
        least = 2
        while np.count_nonzero(uses >= least) > MEMO_WORDS // 2:
            least *= 2
        keep = uses >= least
        words = [w for w, k in zip(self.memo, keep.tolist(), strict=True) if k]
        places = places[keep]
        counts = self.count[places]
        ids = self._gather(places, counts)
        self.n_flat = self.n_words = 0
        self._store(ids, counts)
        self.uses[:len(words)] = 1
        self.memo = dict(zip(words, range(len(words)), strict=True))

    def _gather(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of the words at these places, one word after the other."""
        upto = np.cumsum(counts, dtype=np.int32) if counts.sum() < 1 << 31 else np.cumsum(counts, dtype=np.int64)
        source = np.repeat(self.first[places] - (upto - counts), counts)
        source += np.arange(len(source), dtype=source.dtype)
        return self.flat[source]

    def _store(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Keep the ids of some words, one word after the other; the first's place."""
        at, n = self.n_words, len(counts)
        while self.n_flat + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while at + n > len(self.first):
            self.first, self.count, self.uses = (np.resize(a, 2 * len(a)) for a in (self.first, self.count, self.uses))
        self.flat[self.n_flat:self.n_flat + len(ids)] = ids
        self.first[at:at + n] = self.n_flat + np.cumsum(counts) - counts
        self.count[at:at + n] = counts
        self.uses[at:at + n] = 0
        self.n_flat += len(ids)
        self.n_words += n
        return at

    def _way(self, way) -> None:
        self.tok.normalizer, self.tok.pre_tokenizer = way

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words by the whole tokenizer."""
        ids = [e.ids for i in range(0, len(words), 8192)
               for e in self.tok.encode_batch_fast(words[i:i + 8192], add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for one in ids for x in one), np.uint32, int(counts.sum())), counts

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of plain words."""
        parts = pc.replace_substring_regex(words, rf"^(\pL+)({MARKS}+)$", r"\1 \2")
        many = 1 + (pc.binary_length(parts).to_numpy() > pc.binary_length(words).to_numpy())
        cuts = np.append(np.arange(0, len(parts), JOINED), len(parts))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), parts), pa.scalar(" ", parts.type)).to_pylist()
        self._way(self.short)
        try:
            ids = np.concatenate([np.array(e.ids, np.uint32) for i in range(0, len(texts), 32)
                                  for e in self.tok.encode_batch_fast(texts[i:i + 32], add_special_tokens=False)])
        finally:
            self._way(self.full)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != many.sum():
            return self._whole(words.to_pylist())
        upto = last[np.cumsum(many) - 1] + 1
        return ids, np.diff(upto, prepend=0)

    def _add(self, words: pa.Array) -> np.ndarray:
        """Encode words and keep them; their places."""
        plain = pc.and_(pc.match_substring_regex(words, rf"^\pL*{MARKS}*$"), pc.greater(pc.binary_length(words), 0))
        for odd in [*self.specials, "\u0130"]:  # special strings; the one letter whose lower case is not a letter alone
            plain = pc.and_not(plain, pc.match_substring(words, odd))
        plain = plain.to_numpy(zero_copy_only=False).copy()
        for i in np.flatnonzero(plain & ~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)).tolist():
            plain[i] = is_normalized("NFC", words[i].as_py())
        place = np.zeros(len(words), np.int64)
        if plain.any():
            at = self._store(*self._joined(words.filter(pa.array(plain))))
            place[plain] = at + np.arange(plain.sum())
        if not plain.all():
            at = self._store(*self._whole(words.filter(pa.array(~plain)).to_pylist()))
            place[~plain] = at + np.arange((~plain).sum())
        return place

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (uint32) and where each text begins (one entry
        more than texts).  A null text is empty; ``end_id`` closes each."""
        if self.n_words > MEMO_WORDS:
            self._shrink()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(lists.flatten())
        words = coded.dictionary.to_pylist()
        place = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = coded.dictionary.take(pa.array(new))
            place[new] = self._add(fresh)
            short = new[pc.less_equal(pc.binary_length(fresh), MEMO_BYTES).to_numpy(zero_copy_only=False)]
            self.memo.update(zip(map(words.__getitem__, short.tolist()), place[short].tolist(), strict=True))
        self.uses[place] += 1
        codes = place[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        counts = self.count[codes]
        ids = self._gather(codes, counts)
        total = len(ids)
        upto = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=upto[1:])
        offsets = lists.offsets.to_numpy().astype(np.int64)
        bounds = upto[offsets - offsets[0]]
        if end_id is None:
            return ids, bounds
        n = len(texts)
        out = np.full(total + n, end_id, np.uint32)
        keep = np.ones(total + n, bool)
        ends = bounds[1:] + np.arange(n)
        keep[ends] = False
        out[keep] = ids
        return out, np.concatenate([[0], ends + 1])


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
