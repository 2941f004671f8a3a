"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts (up to three bytes back) is counted
on labelled documents and frozen.  A byte's code length is that of PPM with
escape method C and exclusion: where the longest context has not seen the byte,
it pays for an escape -- distinct bytes over occurrences plus distinct bytes --
and goes on to the next shorter context without the bytes already ruled out,
down to a uniform code.  A text's language is the one that codes it shortest.

With frozen counts the code length depends on the context and the byte alone.
So the trees are unrolled once into a table (context, byte) -> bits per
language, and executors score whole texts by looking bytes up, no loop per
byte.  The table's size follows the bounded training sample and the number of
languages; of many languages a task holds the tables of a few at a time.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.common import col, ddl, fresh, map_arrow, others, scratch_path, table, with_text
from calibra.llm.sharedfs import open_fs, write_file

ORDER = 3
#: Expected documents per language in the training sample (its bound).
TRAIN_DOCS = 1500
#: Languages in a table; each table is a file in the shared folder.
TABLE_LANGUAGES = 16
#: What is no language: bits per byte above the mean of the training documents
#: by so many standard deviations, of which documents make one part and, as
#: texts are short, single bytes (of this variance) the other, and by so many
#: bits at least.
DEVIATIONS, BYTE_VARIANCE, LONG_BYTES, MARGIN = 6.0, 9.0, 200, 2.5
#: Contexts seen less often in the sample are left to the shorter ones.
MIN_CONTEXT = 8
#: The byte that is taken to stand before a text.
BEFORE = 10
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: byte -> class; 0 is for bytes never seen
    classes: np.ndarray
    #: classes of the three bytes before -> context
    context: np.ndarray
    #: [context * classes + class, language] -> bits
    bits: np.ndarray

    def tables(self, folder: str, languages: int = TABLE_LANGUAGES) -> list[str]:
        """Write the model as files of so many languages each; their paths."""
        paths = []
        for a in range(0, max(1, len(self.languages)), languages):
            raw = io.BytesIO()
            np.savez(raw, languages=np.array(self.languages[a:a + languages], str), classes=self.classes, context=self.context,
                     bits=np.ascontiguousarray(self.bits[:, a:a + languages]))
            paths.append(f"{folder}/languages-{a:06d}.npz")
            write_file(paths[-1], [raw.getvalue()])
        return paths


_HELD: OrderedDict[str, Model] = OrderedDict()


def _load(path: str) -> Model:
    """A table, from this worker's memory or the shared folder."""
    if path not in _HELD:
        fs, p = open_fs(path)
        with fs.open_input_stream(p, compression=None) as f, np.load(io.BytesIO(f.read())) as z:
            model = Model(z["languages"].tolist(), z["classes"], z["context"], z["bits"])
        _HELD.clear()  # one at a time
        _HELD[path] = model
    return _HELD[path]


def remainder(key: Column) -> Column:
    """crc32 of a document's id as text, modulo 4; 2 marks held-out documents.
    A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one entry more)."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def _before(values: np.ndarray, bounds: np.ndarray, pad: int) -> list[np.ndarray]:
    """The value one, two and three places before each, ``pad`` before a text."""
    out = []
    begins = bounds[:-1]
    ends = bounds[1:]
    for k in range(1, ORDER + 1):
        v = np.empty_like(values)
        v[k:] = values[:-k]
        v[:k] = pad
        for j in range(k):
            at = begins + j
            v[at[at < ends]] = pad
        out.append(v)
    return out


def count_contexts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``gram`` (three bytes and the next, as a number), ``n``:
    occurrences, summed within each slice before they are shuffled."""

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs = np.asarray(batch.column(1).to_pylist(), object)
        for name in sorted(set(langs)):
            values, bounds = _texts(batch.column(0).filter(pa.array(langs == name)))
            if not len(values):
                continue
            one, two, three = (b.astype(np.uint32) for b in _before(values, bounds, BEFORE))
            grams, n = np.unique(three << 24 | two << 16 | one << 8 | values, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(n), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                names=["lang", "gram", "n"])

    src = docs.select(col(text).alias("text"), col(lang).cast("string").alias("lang"))
    return (map_arrow(src, count, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _code_lengths(tables: list[np.ndarray]) -> np.ndarray:
    """Bits of each class in each context.  ``tables``: counts [context, class]
    from the longest order to order 0, row for row the same context."""
    rows, width = tables[0].shape
    bits = np.zeros((rows, width), np.float32)
    done = np.zeros((rows, width), bool)  # coded or excluded
    done[:, 0] = True  # bytes never seen are left to the uniform code
    escape = np.zeros(rows)
    for counts in tables:
        left = np.where(done, 0, counts)
        total, distinct = left.sum(1), (left > 0).sum(1)
        seen = left > 0
        scale = total + distinct
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = escape[:, None] - np.log2(left / scale[:, None])
            out = np.where(distinct > 0, -np.log2(distinct / scale), 0.0)
        bits[seen] = cost[seen]
        done |= seen
        escape += np.nan_to_num(out)
    excluded = done.sum(1) - 1
    uniform = escape + np.log2(np.maximum(256 - excluded, 1))
    rest = ~done
    rest[:, 0] = True
    bits[rest] = np.broadcast_to(uniform[:, None], bits.shape)[rest]
    return bits


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], min_context: int = MIN_CONTEXT) -> Model:
    """The model of the counted grams: {language: (grams, occurrences)}."""
    languages = sorted(counts)
    seen = np.zeros(256, bool)
    for grams, _ in counts.values():
        seen[grams & 255] = True
    seen[BEFORE] = True
    classes = np.zeros(256, np.int32)
    classes[seen] = 1 + np.arange(seen.sum())
    w = int(seen.sum()) + 1
    split = {}
    total = np.zeros(w ** 3, np.int64)
    for name, (grams, n) in counts.items():
        a, b, c, s = (classes[grams >> k & 255].astype(np.int64) for k in (24, 16, 8, 0))
        split[name] = ((a * w + b) * w + c, s, n)
        total += np.bincount(split[name][0], n, w ** 3).astype(np.int64)
    # states: the contexts of each order seen often enough, then the empty one
    number = [np.zeros(1, np.int64)]  # by order: context -> state, shorter where unknown
    members: list[np.ndarray] = [np.zeros(1, np.int64)]
    states = 1
    for order in range(1, ORDER + 1):
        many = total.reshape(-1, w ** order).sum(0)
        known = np.flatnonzero(many >= min_context)
        up = np.tile(number[-1], w)  # the newest byte is the last digit
        up[known] = states + np.arange(len(known))
        states += len(known)
        number.append(up)
        members.append(known)
    bits = np.zeros((states, w, len(languages)), np.float32)
    for l, name in enumerate(languages):
        ctx, s, n = split[name]
        at = 0
        for order, known in enumerate(members):
            tables = []
            for k in range(order, -1, -1):
                own = known % w ** k
                rows, back = np.unique(own, return_inverse=True)
                slot = np.full(w ** k, -1)
                slot[rows] = np.arange(len(rows))
                place = slot[ctx % w ** k]
                ok = place >= 0
                dense = np.bincount(place[ok] * w + s[ok], n[ok], len(rows) * w).reshape(-1, w)
                tables.append(dense[back].astype(np.float32))
            for i in range(0, len(known), 4096):
                bits[at + i:at + min(i + 4096, len(known)), :, l] = _code_lengths([t[i:i + 4096].astype(float) for t in tables])
            at += len(known)
    return Model(languages, classes, number[-1].astype(np.int32), bits.reshape(states * w, -1))


def learned_from(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """``text``, ``lang`` and ``key`` of the documents that have text and label
    and are not held out."""
    return (docs.select(col(text).alias("text"), col(lang).cast("string").alias("lang"), col(key).alias("key"))
            .where((remainder(F.col("key")) != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull()))


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS) -> DataFrame | None:
    """``text`` and ``lang`` of about ``train_docs`` whole documents per label
    that have text and label and are not held out, chosen by a hash of id and
    length; None if there are none."""
    train = learned_from(docs, text, lang, key)
    sizes = train.groupBy("lang").count().collect()
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], train_docs / r["count"])])
    draw = F.pmod(F.xxhash64("key", F.octet_length("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return train.where(draw < share[F.col("lang")]).select("text", "lang")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model:
    """Learn every label from the sample of its documents."""
    train = sample(docs, text, lang, key, train_docs)
    if train is None:
        return Model([], np.zeros(256, np.int32), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    rows = count_contexts(train).toArrow()
    counts = {}
    langs = rows["lang"].to_numpy()
    grams, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
    for name in sorted(set(langs)):
        own = langs == name
        counts[name] = (grams[own], n[own])
    return build(counts)


def usual(model: Model, docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, tuple[float, float]]:
    """By language, the mean bits per byte of all its documents that are not
    held out under their own tree and the variance of long documents around it."""
    train = learned_from(docs, text, lang, key).select("text", "lang")
    if not model.languages:
        return {}
    coded = identify(train.withColumn("k", F.lit(0)), model, "text", "k", ["lang"]).where("lang_pred = lang AND n_bytes > 0")
    rate = F.col("bits") / F.col("n_bytes")
    long = F.when(F.col("n_bytes") >= LONG_BYTES, rate)
    rows = coded.groupBy("lang").agg((F.sum("bits") / F.sum("n_bytes")).alias("mean"), F.var_samp(long).alias("variance")).collect()
    return {r["lang"]: (r["mean"], 0.25 if r["variance"] is None or r["variance"] != r["variance"] else r["variance"]) for r in rows}


def recognised(found: DataFrame, known: dict[str, tuple[float, float]]) -> DataFrame:
    """The rows of ``found`` (from ``identify``) whose text costs no more bits
    per byte than texts of the predicted language do; others are of a language
    that was not learned, or of none."""
    if not known:
        return found.where(F.lit(False))
    limits = found.sparkSession.createDataFrame([(name, *v) for name, v in known.items()], "_lang string, _mean double, _variance double")
    at_most = F.col("_mean") + F.greatest(DEVIATIONS * F.sqrt(F.col("_variance") + BYTE_VARIANCE / F.col("n_bytes")), F.lit(MARGIN))
    return (found.join(F.broadcast(limits), F.col("lang_pred") == F.col("_lang"))
            .where(F.col("bits") / F.col("n_bytes") <= at_most).drop("_lang", "_mean", "_variance"))


def code_bits(model: Model, column: pa.Array, block: int = 1 << 19) -> np.ndarray:
    """Code length in bits of each text under each language."""
    values, bounds = _texts(column)
    out = np.zeros((len(column), len(model.languages)))
    if not len(values):
        return out
    w = int(model.classes.max()) + 1
    coded = model.classes[values].astype(np.int32)
    one, two, three = _before(coded, bounds, int(model.classes[BEFORE]))
    for a in range(0, len(coded), block):
        b = min(a + block, len(coded))
        state = model.context[(three[a:b] * w + two[a:b]) * w + one[a:b]]
        bits = model.bits[state * np.int64(w) + coded[a:b]]
        first = np.searchsorted(bounds, a, side="right") - 1
        last = np.searchsorted(bounds, b, side="left")
        own = np.flatnonzero(bounds[first + 1:last + 1] > bounds[first:last]) + first  # texts with bytes here
        cuts = np.maximum(bounds[own], a) - a
        out[own] += np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id",
             keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if None) of ``docs`` with ``held_out``,
    ``lang_pred``, ``score`` (the share of the prediction among all learned
    languages' likelihoods, 0 to 1), ``bits`` (the text's code length under the
    prediction) and ``n_bytes``.

    A text that is null or has no letter, or a model without languages, gives
    ``und`` and 0.  Equal code lengths go to the first language by name.
    Columns of these names are replaced.
    """
    made = ("held_out", "lang_pred", "score", "bits", "n_bytes")
    rest = others(docs.columns if keep is None else keep, *made)
    letter = fresh("letter", rest)
    docs = docs.withColumn(letter, F.coalesce(col(text).rlike(r"\p{L}"), F.lit(False)))
    held = (remainder(col(key)) == 2).alias("held_out")
    src, at = with_text(docs.select("*", held), [*rest, "held_out", letter], text)
    paths = model.tables(scratch_path(docs.sparkSession, "languages"))
    n_out = len(rest) + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        lang = np.full(n, UNDETERMINED, object)
        score = np.zeros(n)
        has = batch.column(n_out).to_numpy(zero_copy_only=False)
        texts = batch.column(at)
        least, total = np.full(n, np.inf), np.zeros(n)
        for path in paths:
            model = _load(path)
            if not model.languages:
                continue
            bits = code_bits(model, texts)
            best = bits.argmin(1)
            low = bits[np.arange(n), best]
            lang = np.where(has & (low < least), np.asarray(model.languages, object)[best], lang)
            # likelihoods so far, as shares of the best one
            now = np.minimum(least, low)
            total = total * np.exp2(np.minimum(now - least, 0)) + np.exp2(np.minimum(now[:, None] - bits, 0)).sum(1)
            least = now
        if np.isfinite(least).all() and n:
            score[has] = 1 / total[has]
        least = np.where(np.isfinite(least) & has, least, 0.0)
        size = pc.binary_length(texts.fill_null("")).cast(pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[:n_out], pa.array(lang, pa.string()), pa.array(score), pa.array(least), size],
                                          names=[*batch.schema.names[:n_out], "lang_pred", "score", "bits", "n_bytes"])

    return map_arrow(src, run, ddl(src, n_out) + "lang_pred string, score double, bits double, n_bytes long",
                     max_bytes=(2 if len(paths) == 1 else 32) << 20)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs), keep=["doc_id"])
