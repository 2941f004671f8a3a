"""Near duplicates by ProbMinHash over weighted five-word shingles.

A shingle's weight is how often it comes in the text.  Each shingle sends a
Poisson process of that rate to the registers of the text's signature; a
register keeps the shingle that arrives first.  A shingle whose next arrival is
later than every register's is done (early termination).  Two registers agree
with the probability Jaccard similarity of the texts.

Links are found without comparing all texts of a group:

1. equal texts are one node (a row per digest, summed before the shuffle);
2. signatures are cut into bands; nodes with an equal band meet in a bucket;
3. each bucket's first node is compared with its others, and links make
   components;
4. buckets that still hold several components compare them again with another,
   randomly drawn node;
5. the nodes of buckets that are still undecided are joined by the rarest
   shingles of each (prefix filter): two texts that are similar enough must
   share one of those, whatever bucket they come from.  A shingle that few
   nodes hold gives its pairs; one that many hold is cut into blocks, and each
   two blocks meet in one task.

No step drops a pair by an estimate: what step 5 leaves out, bounds on the
shared weight exclude.  Copies of one text never meet each other.  A link:
probability Jaccard of the weighted shingles or plain Jaccard of the shingles,
computed from the texts' whole sets of 48-bit shingle hashes, is 0.8 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.common import WORD, col, fresh, map_arrow, materialise, release, small_batches, table
from calibra.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 48, 7
#: Pairs, each with both shingle sets, given to Python at once.
PAIRS = 200
#: Nodes with a shingle in their prefixes up to which their pairs are rows.
GROUP_ROWS = 64
#: Rows of a larger group, and bytes of their shingle sets, in a block (expected).
BLOCK_ROWS = 512
BLOCK_BYTES = 2 << 20
#: Bits, and bytes, of a shingle's hash within a text.
_BITS, _BYTES = 48, 6
_PLACE = np.array([xxhash.xxh64_intdigest(f"shingle {k}") | 1 for k in range(WORDS)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending: (hashes, counts, bounds).

    A text of fewer words is one shingle, a text without words has none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    coded = pc.dictionary_encode(lists.flatten())
    vocabulary = coded.dictionary.to_pylist()
    of = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    hashes = of[codes] if len(of) else np.zeros(0, np.uint64)
    empty = pc.index_in(pa.scalar("", pa.large_string()), coded.dictionary).as_py()
    if empty is not None:
        real = codes != empty
        upto = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(real, out=upto[1:])
        hashes, bounds = hashes[real], upto[bounds]
    sizes = np.diff(bounds)
    n = len(sizes)
    many = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    doc = np.repeat(np.arange(n), many)
    begin = np.repeat(bounds[:-1], many) + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    long = (sizes >= words)[doc]
    value = np.zeros(len(doc), np.uint64)
    last = max(0, len(hashes) - 1)
    for k in range(words):
        inside = long | (k < sizes[doc])
        value += np.where(inside, hashes[np.minimum(begin + k, last)] * _PLACE[k], np.uint64(k)) if len(hashes) else 0
    key = np.sort(doc.astype(np.uint64) << np.uint64(_BITS) | _mix(value) >> np.uint64(64 - _BITS))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(key)))
    key = key[first]
    doc = (key >> np.uint64(_BITS)).astype(np.int64)
    return key & np.uint64((1 << _BITS) - 1), counts, np.searchsorted(doc, np.arange(n + 1))


def prob_min_hash(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Signatures [text, register] of weighted shingles; all texts at once.

    Shingles without a chance in any register of their text drop out after
    each turn; the fewer are left, the more arrivals a turn draws.
    """
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    first = np.full(n * size, np.inf)
    owner = np.zeros(n * size, np.uint64)
    alive = np.arange(len(hashes))
    time = np.zeros(len(hashes))
    latest = np.full(n, np.inf)
    turn = 0
    while len(alive):
        draws = int(np.clip(30_000 // len(alive), 1, 64))
        step = (np.arange(turn, turn + draws, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        turn += draws
        h = _mix(hashes[alive, None] + step)
        gaps = -np.log(((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53) / weights[alive, None]
        times = time[alive, None] + np.cumsum(gaps, 1)
        time[alive] = times[:, -1]
        where = doc[alive, None] * size + (_mix(h) % np.uint64(size)).astype(np.int64)
        soon = times < latest[doc[alive], None]
        t, w = times[soon], where[soon]
        np.minimum.at(first, w, t)
        won = first[w] == t
        owner[w[won]] = np.broadcast_to(hashes[alive, None], soon.shape)[soon][won]
        texts = np.unique(doc[alive])
        latest[texts] = first.reshape(n, size)[texts].max(1)
        alive = alive[times[:, -1] < latest[doc[alive]]]
    return owner.reshape(n, size)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per text and band."""
    parts = _mix(signatures.reshape(len(signatures), bands, rows))
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out.view(np.int64)


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(plain Jaccard, probability Jaccard) of two weighted sets: distinct
    elements in ascending order and their weights."""
    if not len(a) or not len(b):
        return 0.0, 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    i = np.flatnonzero(b[at] == a)
    j = at[i]
    union = len(a) + len(b) - len(i)
    if not len(i):
        return 0.0, 0.0
    plain = len(i) / union
    if x.max() == 1 == y.max():
        return plain, plain
    # sum over shared elements of 1 / sum_j max(x_j / x_i, y_j / y_i), by ratio r = x_i / y_i
    xs, ys = x[i].astype(float), y[j].astype(float)
    alone_x, alone_y = x.sum() - xs.sum(), y.sum() - ys.sum()
    total = 0.0
    for r in np.unique(xs / ys):
        total += xs[xs / ys == r].sum() / (np.maximum(xs, r * ys).sum() + alone_x + r * alone_y)
    return plain, float(total)


def packed(hashes: np.ndarray) -> bytes:
    """48-bit numbers as six bytes each."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _BYTES, 8), np.uint8)
    out[:, :_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, _BYTES)
    return out.view("<u8").ravel()


def _weights(counts: bytes | None, n: int) -> np.ndarray:
    return np.ones(n, np.int64) if counts is None else np.frombuffer(counts, "<u4").astype(np.int64)


def sketch(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS,
           bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``digest`` and ``keys`` (bands of the signature; null for a
    text without a word) of every document.  A text with repeated shingles also
    gets the bands of its unweighted signature, so that no plain-Jaccard link
    is missed."""
    src = docs.select(col(key).cast("long").alias("doc_id"), F.unhex(F.md5(col(text))).alias("digest"), col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, counts, bounds = shingles(batch.column(2), words)
        keys = band_keys(prob_min_hash(hashes, counts.astype(float), bounds, bands * rows), bands, rows)
        n = batch.num_rows
        most = np.zeros(n, np.int64)
        has = np.flatnonzero(np.diff(bounds))
        if len(has):
            most[has] = np.maximum.reduceat(counts, bounds[has])
        repeats = np.flatnonzero(most > 1)
        out = [k if m else None for k, m in zip(keys, most, strict=True)]
        if len(repeats):
            part = np.concatenate([hashes[bounds[d]:bounds[d + 1]] for d in repeats])
            upto = np.concatenate([[0], np.cumsum(np.diff(bounds)[repeats])])
            for d, k in zip(repeats, band_keys(prob_min_hash(part, np.ones(len(part)), upto, bands * rows), bands, rows), strict=True):
                out[d] = np.unique(np.concatenate([keys[d], k]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "digest", "keys"])

    return map_arrow(src, run, "doc_id long, digest binary, keys array<bigint>", max_bytes=2 << 20)


def shingle_sets(nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """``node``, ``items`` and ``counts`` (the distinct shingles as 48-bit
    numbers, and how often each comes; null if once each) of the texts of
    ``nodes`` (``node``, ``text``)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, counts, bounds = shingles(batch.column(1), words)
        parts = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        times = [counts[p].astype("<u4").tobytes() if counts[p].max(initial=0) > 1 else None for p in parts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(hashes[p]) for p in parts], pa.binary()), pa.array(times, pa.binary())],
                                          names=["node", "items", "counts"])

    return map_arrow(nodes.select("node", "text"), run, "node long, items binary, counts binary", max_bytes=2 << 20)


def _texts(docs: DataFrame, nodes: DataFrame, text: str, key: str) -> DataFrame:
    """``node`` and ``text`` of ``nodes`` (``node``, ``digest``, ``first``), from
    a row of ``docs`` that has both the digest and the id.  The texts of a large
    group of copies go by their ids, hence to many tasks."""
    number = lambda c: F.coalesce(c.cast("long"), F.lit(-(1 << 63)))
    src = docs.select(F.unhex(F.md5(col(text))).alias("digest"), number(col(key)).alias("id"), col(text).alias("text"))
    return (src.join(nodes.select("node", "digest", number(F.col("first")).alias("id")), ["digest", "id"])
            .dropDuplicates(["digest", "id"]).select("node", "text"))


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b) that are links."""
    side = lambda n: sets.select(F.col("node").alias(n), F.col("items").alias(f"i{n}"), F.col("counts").alias(f"c{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ia", "ca", "ib", "cb")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        linked = []
        for ia, ca, ib, cb in zip(*batch.columns[2:], strict=True):
            a, b = unpacked(ia.as_py()), unpacked(ib.as_py())
            linked.append(max(similarity(a, _weights(ca.as_py(), len(a)), b, _weights(cb.as_py(), len(b)))) >= threshold)
        keep = pa.array(linked, pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return map_arrow(both, run, "a long, b long", max_bytes=4 << 20)


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD,
            words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(the written sketch of every row, a row per different text that has a
    word: ``digest``, ``node``, ``first`` -- the smallest id with that text --,
    ``component`` -- the smallest node of its class)."""
    # a row's number is fixed once the sketch is written
    sk = materialise(sketch(docs, text, key, words, bands, rows).withColumn("row", F.monotonically_increasing_id()), "sketch")
    nodes = materialise(sk.where("keys IS NOT NULL").groupBy("digest")
                        .agg(F.min("row").alias("node"), F.min("doc_id").alias("first")), "nodes")
    only = nodes.select(F.col("node").alias("row"))
    hits = sk.select("row", "keys").join(only, "row", "left_semi").select(F.explode("keys").alias("key"), F.col("row").alias("id"))
    leaders = (hits.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"))
               .where("leader < last").select("key", "leader"))
    buckets = materialise(hits.join(leaders, "key").distinct(), "buckets")
    # whole shingle sets only of texts that meet another one
    wanted = nodes.join(buckets.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    sets = materialise(shingle_sets(_texts(docs, wanted, text, key), words), "sets")

    pairs = buckets.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = materialise(_verify(pairs, sets, threshold), "tested", PAIRS)
    groups = components(links)

    def mixed() -> DataFrame:
        """The rows of buckets that hold several components."""
        rows = _labelled(buckets, groups)
        several = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        return materialise(rows.join(several, "key", "left_semi"), "mixed")

    left = mixed()
    if not left.isEmpty():
        # another node of the bucket, drawn at random
        draw = F.xxhash64("id", "key")
        others = left.groupBy("key").agg(F.min_by("id", draw).alias("a"), F.min_by("component", draw).alias("ca"))
        pairs = left.join(others, "key").where("component <> ca").select("a", F.col("id").alias("b")).distinct()
        groups = components(materialise(_verify(pairs, sets, threshold), "again", PAIRS), groups)
        left = mixed()
    if not left.isEmpty():
        groups = components(_across(left.select("id", "component").distinct(), groups, sets, threshold), groups)
    return sk, _labelled(nodes.withColumnRenamed("node", "id"), groups).withColumnRenamed("id", "node")


def _labelled(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (with ``id``) and the component of each."""
    return rows.join(groups.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD,
                    words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``class_id`` (the smallest id of
    its class) and ``copy_of`` (the smallest id with the very same text).

    Classes are made of texts: an id that comes with several texts has a row
    for each, in the class of that text, and rows without an id take part like
    others (null where no member of a class has an id).  Null texts and texts
    without a word are near nothing: each is its own class.  Columns other than
    key and text are not read.
    """
    sk, found = classes(docs, text, key, threshold, words, bands, rows)
    low = found.groupBy("component").agg(F.min("first").alias("low"))
    named = found.join(low, "component").select("digest", F.col("first").alias("copy_of"), F.col("low").alias("class_id"))
    out = sk.select("doc_id", F.when(F.col("keys").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    worded = F.col("digest").isNotNull()
    pick = lambda c: F.when(worded, F.col(c)).otherwise(F.col("doc_id")).alias(c)
    return out.select("doc_id", pick("class_id"), pick("copy_of"))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: of each class one row of the text with
    the smallest id (the smallest digest among equal ids; rows without an id
    come last).  Null texts and texts without a word all stay."""
    _, found = classes(docs, text, key, threshold)
    order = F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), F.col("digest").alias("digest"))
    d, i, e, j = (fresh(c, docs.columns) for c in ("_digest", "_id", "_stay", "_first"))
    stay = found.groupBy("component").agg(F.min(order).alias("m")).select(F.col("m.digest").alias(e), F.col("m.id").alias(j))
    worded = F.coalesce(col(text).rlike(WORD), F.lit(False))
    made = docs.withColumn(d, F.unhex(F.md5(col(text)))).withColumn(i, col(key).cast("long"))
    best = made.where(worded).join(stay, (F.col(d) == F.col(e)) & F.col(i).eqNullSafe(F.col(j)), "left_semi")
    return best.dropDuplicates([d]).unionByName(made.where(~worded)).drop(d, i)


def _tokens(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """A row per node (``id``, ``component``) and shingle: ``token``, ``part``
    (its share of the text's weight), ``size`` (shingles of the text) and
    ``flat`` (no shingle repeats)."""
    src = nodes.join(sets.withColumnRenamed("node", "id"), "id").select("id", "component", "items", "counts")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [unpacked(x.as_py()) for x in batch.column(2)]
        counts = [x.as_py() for x in batch.column(3)]
        weights = [_weights(c, len(t)) for c, t in zip(counts, tokens, strict=True)]
        sizes = np.array([len(t) for t in tokens], np.int64)
        each = lambda x: pa.array(np.repeat(x, sizes))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(tokens).view(np.int64)), each(batch.column(0).to_numpy()), each(batch.column(1).to_numpy()),
             pa.array(np.concatenate([w / w.sum() for w in weights])), each(sizes), each(np.array([c is None for c in counts]))],
            names=["token", "id", "component", "part", "size", "flat"])

    return map_arrow(src, run, "token long, id long, component long, part double, size long, flat boolean")


def _prefixes(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``token``, ``id``, ``component``, ``size``, ``flat``: the shingles of
    each node one of which it must share with any node of another component
    that it links to, with ``many`` (nodes that have it there).

    Shingles are ordered by how many nodes hold them, those that only one
    component holds first.  Either similarity is at most the weight that the
    two texts share, as a part of either (plain: of the counts of distinct
    shingles).  So the part of a text from its first shared shingle on is at
    least the threshold: shingles with less than that from them on cannot be
    first, and the first shared one is in the prefixes of both texts."""
    tokens = materialise(_tokens(nodes, sets), "tokens")
    held = (tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
            .where("lo < hi").select("token", "n"))
    own = (tokens.join(held, "token").groupBy("id", "component", "size", "flat")
           .agg(F.collect_list(F.struct("n", "token", "part")).alias("shared"), F.sum("part").alias("weight"))
           .where((F.size("shared") >= F.col("size") * threshold - 1e-6) | (F.col("weight") >= threshold - 1e-6)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        firsts = []
        for size, rows in zip(batch.column(2).to_pylist(), batch.column(4), strict=True):
            n, token, part = (rows.values.field(f).to_numpy(zero_copy_only=False) for f in range(3))
            order = np.lexsort((token, n))[::-1]  # the most common first
            onward = np.maximum(np.cumsum(part[order]), np.arange(1, len(order) + 1) / size)
            firsts.append(token[order[onward >= threshold - 1e-6]])
        doc = pa.array(np.repeat(np.arange(len(firsts)), [len(f) for f in firsts]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts)), *(batch.column(c).take(doc) for c in range(4))],
                                          names=["token", "id", "component", "size", "flat"])

    first = materialise(map_arrow(own.select("id", "component", "size", "flat", "shared"), run,
                                  "token long, id long, component long, size long, flat boolean"), "prefixes")
    meet = (first.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min("component").alias("lo"), F.max("component").alias("hi"))
            .where("lo < hi").select("token", "many"))
    return materialise(first.join(meet, "token"), "meetings")


def _across(nodes: DataFrame, groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """All further links (a, b) between ``nodes`` (``id``, ``component``) of
    different components; ``groups`` (id, component) are those so far."""
    meetings = _prefixes(nodes, sets, threshold)
    few = meetings.where(F.col("many") <= GROUP_ROWS).select("token", "id", "component", "size", "flat")
    side = lambda n: few.select("token", *[F.col(c).alias(c + n) for c in ("id", "component", "size", "flat")])
    near = ~(F.col("flat1") & F.col("flat2")) | (F.least("size1", "size2") >= F.greatest("size1", "size2") * threshold - 1e-6)
    pairs = (side("1").join(side("2"), "token").where((F.col("id1") < F.col("id2")) & (F.col("component1") != F.col("component2")) & near)
             .select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct())
    found = materialise(_verify(pairs, sets, threshold), "rare", PAIRS)
    many = meetings.where(F.col("many") > GROUP_ROWS)
    if many.isEmpty():
        return found
    # shingles that many nodes hold, though none of those nodes has rarer ones:
    # first against one drawn node, then what is still apart block by block
    groups = components(found, groups.toDF("id", "component"))
    many = _labelled(many.drop("component"), groups)
    draw = F.xxhash64("id", "token")
    one = many.groupBy("token").agg(F.min_by("id", draw).alias("a"), F.min_by("component", draw).alias("ca"))
    pairs = many.join(one, "token").where("component <> ca").select("a", F.col("id").alias("b")).distinct()
    common = materialise(_verify(pairs, sets, threshold), "common", PAIRS)
    many = _labelled(many.drop("component"), components(common, groups))
    return found.union(common).union(materialise(_in_blocks(many, sets, threshold), "blocks", PAIRS))


def _in_blocks(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different components among the rows (``token``,
    ``id``, ``component``, ``size``) of each token.  A token's rows are cut
    into blocks of bounded size, and each two blocks meet in one task: pairs
    are no rows of a table."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("size") * _BYTES / BLOCK_BYTES)).cast("long")
    parts = (rows.groupBy("token").agg(blocks.alias("blocks"), F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low < high").select("token", "blocks"))
    cut = rows.join(parts, "token").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    cut = cut.select("token", "id", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cut = cut.select("token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "component")
    cut = cut.join(sets.withColumnRenamed("node", "id"), "id")
    cut = cut.select("token", "lo", "hi", "own", "id", "component", "items", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        links: list[tuple[int, int]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero((block[:, 1:] != block[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(block[:, a].tolist())
                if held and here != last:
                    links += _block_links(pa.Table.from_batches(held), threshold)
                    held = []
                held.append(batch.slice(a, b - a))
                last = here
            if links:
                yield _pairs(links)
                links = []
        if held:
            yield _pairs(_block_links(pa.Table.from_batches(held), threshold))
        release()

    small_batches(rows.sparkSession)
    return (cut.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
            .mapInArrow(run, "a long, b long").distinct())


def _block_links(block: pa.Table, threshold: float) -> list[tuple[int, int]]:
    """Links between the two parts of a block, of different components; each
    pair that the bounds do not exclude is compared exactly."""
    least = threshold - 1e-9
    lo, hi, own, ids, component = (block.column(c).to_numpy() for c in ("lo", "hi", "own", "id", "component"))
    parts = [unpacked(x) for x in block.column("items").to_pylist()]
    times = block.column("counts").to_pylist()
    weights = [_weights(t, len(p)) for p, t in zip(parts, times, strict=True)]
    sizes = np.array([len(p) for p in parts])
    flat = np.array([t is None for t in times])
    left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    same = lo[0] == hi[0]
    codes = None
    out = []
    for n, i in enumerate(left):
        js = right[n + 1:] if same else right
        ok = component[js] != component[i]
        small, large = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
        js = js[ok & ((small >= least * large) | ~(flat[js] & flat[i]))]
        if len(js) > 8:
            if codes is None:
                # numbers of the shingles, row by row, and the weight of each in its text
                words, codes = np.unique(np.concatenate(parts), return_inverse=True)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                shares = np.concatenate([w / w.sum() for w in weights])
                mark, mine = np.zeros(len(words)), np.zeros(len(words))
            begin = np.concatenate([[0], np.cumsum(sizes[js])])
            at = np.arange(begin[-1]) + np.repeat(bounds[js] - begin[:-1], sizes[js])
            own_codes = codes[bounds[i]:bounds[i + 1]]
            mark[own_codes], mine[own_codes] = 1, shares[bounds[i]:bounds[i + 1]]
            both = mark[codes[at]]
            shared = np.add.reduceat(both, begin[:-1])
            # the probability Jaccard similarity is at most the shared weight
            # of either text, and the plain one if no shingle repeats
            weight = np.minimum(np.add.reduceat(mine[codes[at]], begin[:-1]), np.add.reduceat(both * shares[at], begin[:-1]))
            mark[own_codes], mine[own_codes] = 0, 0
            js = js[(shared / (sizes[js] + sizes[i] - shared) >= least) | ((weight >= least) & ~(flat[js] & flat[i]))]
        for j in js:
            if max(similarity(parts[i], weights[i], parts[j], weights[j])) >= threshold:
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
