"""Hard negatives by Four-Russians scoring.

Vectors are rows of integers.  For each anchor and each group of eight
dimensions a table holds the sum of every subset of the anchor's eight numbers
(256 entries).  A candidate is cut into bit planes (two's complement); the eight
bits of a plane in a group are a byte, and that byte is the place in the
anchor's table.  The sum of a plane's lookups over the groups, shifted by the
plane and added up (the sign plane taken off), is the exact inner product.

Anchors and candidates are cut into groups and blocks of bounded size.  A cell
of the grid, one anchor group and one block, is scored by one task: it holds
the anchors, reads the candidates batch by batch, and keeps for each anchor
only what can still be among its first ones.  Two sweeps go over the grid:

1. positives: within each label, the first ``positives`` of each anchor;
2. negatives: for each anchor and positive the first ``negatives`` of another
   label whose scores lie in the positive's window.

What cells keep is merged by a window over at most a few rows per cell.  A
label that holds most rows is cut into blocks like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.llm.common import col, materialise, release, small_batches, table

#: Dimensions of a table: its entries are the subsets of so many numbers.
GROUP = 8
#: Anchors of a cell, candidates of a cell, and anchors scored at once, at most.
ANCHORS, CANDIDATES, STRIP = 16384, 65536, 128
#: Cells that a sweep is cut into at least, where there are rows for it.
CELLS, LEAST = 24, 1024
#: Candidates of a batch are looked at from these places on.
STEPS = (0, 128, 640)


def quantise(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component; null if the vector or one of its
    components is null or not finite."""
    x = lambda v: v.cast("double")
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) != float("inf")))
    return F.when(good, F.transform(vector, lambda v: F.floor(x(v) * scale).cast("long")))


def planes_of(values: np.ndarray, bits: int) -> np.ndarray:
    """[row, plane, group] bytes of rows of integers, in two's complement."""
    n, dims = values.shape
    wide = values.astype(np.int64) & ((1 << bits) - 1)
    split = (wide[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(split.astype(np.uint8).reshape(n, bits, dims // GROUP, GROUP), axis=3, bitorder="little")[..., 0]


def subset_sums(anchors: np.ndarray, dtype: type) -> np.ndarray:
    """[group, subset, anchor]: the sum of every subset of eight numbers."""
    n, dims = anchors.shape
    parts = anchors.T.reshape(dims // GROUP, GROUP, n).astype(dtype)
    out = np.zeros((dims // GROUP, 1, n), dtype)
    for k in range(GROUP):
        out = np.concatenate([out, out + parts[:, k:k + 1]], axis=1)
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[row, anchor] inner products of ``planes`` [plane, group, row], from the
    sign plane down: what has been added up is doubled for each further plane."""
    bits, _, n = planes.shape
    total = np.zeros((n, tables.shape[2]), tables.dtype)
    found = np.empty_like(total)
    for b in range(bits - 1, -1, -1):
        if b < bits - 1:
            np.add(total, total, out=total)
        for g in range(tables.shape[0]):
            np.take(tables[g], planes[b, g], axis=0, out=found, mode="clip")
            if b == bits - 1:
                np.subtract(total, found, out=total)
            else:
                np.add(total, found, out=total)
    return total


class _First:
    """The first ``k`` (score, id, row) of many lists, best first: higher
    scores, then smaller ids, then smaller rows."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.score = np.full((lists, k), -np.iinfo(np.int64).max)  # its negative is a number too
        self.id = np.full((lists, k), np.iinfo(np.int64).max)
        self.row = np.full((lists, k), -1)

    def least(self) -> np.ndarray:
        """Scores below these cannot enter any more."""
        return self.score[:, -1]

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Merge entries of the lists ``at``."""
        lists = np.unique(at)
        old = np.repeat(lists, self.k)
        at = np.concatenate([old, at])
        score, ids, rows = (np.concatenate([own[lists].ravel(), new]) for own, new in ((self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score, at))
        at = at[order]
        start = np.searchsorted(at, lists)
        take = order[(start[:, None] + np.arange(self.k)).ravel()]
        for own, new in ((self.score, score), (self.id, ids), (self.row, rows)):
            own[lists] = new[take].reshape(-1, self.k)


def _matrix(column: pa.Array, dims: int, dtype: type = np.int64) -> np.ndarray:
    """Rows of little-endian 64-bit numbers, filled up with zeros."""
    out = np.zeros((len(column), dims), dtype)
    for k, raw in enumerate(column):
        row = np.frombuffer(raw.as_buffer(), "<i8")
        out[k, :len(row)] = row
    return out


def _sweep(anchors: DataFrame, candidates: DataFrame, by_label: bool, dims: int, bits: int, wide: bool, k: int, cells: int) -> DataFrame:
    """``anchor`` (row), ``slot``, ``cand`` (row), ``cand_id``, ``score``: the
    first ``k`` candidates of each slot that a cell has.

    ``anchors``: row, label, vec, and slots -- (low, high) each: bounds of the
    scores, null for none; ``candidates``: row, id, label, planes.  Candidates
    are of the anchor's label (``by_label``, then the grid is cut within
    labels, and the anchor itself is left out) or of another."""
    dtype = np.int64 if wide else np.int32
    label = F.col("label") if by_label else F.lit(0)
    anchors, candidates = anchors.withColumn("part", label), candidates.withColumn("part", label)
    many = anchors.groupBy("part").agg(F.count(F.lit(1)).alias("anchors")).join(
        candidates.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "part")
    parts = many.agg(F.count(F.lit(1)), F.sum("rows")).first()
    share = max(LEAST, -(-(parts[1] or 0) // cells))
    many = many.select("part", F.ceil(F.col("anchors") / ANCHORS).cast("long").alias("groups"),
                       F.ceil(F.col("rows") / min(CANDIDATES, share)).cast("long").alias("blocks"))
    total = many.agg(F.sum(F.col("groups") * F.col("blocks"))).first()[0] or 1
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = (anchors.join(many, "part").withColumn("group", own("groups")).withColumn("block", each("blocks"))
         .select("part", "group", "block", F.lit(0).alias("kind"), "row", F.lit(None).cast("long").alias("id"), "label", F.col("vec").alias("data"), "slots"))
    c = (candidates.join(many, "part").withColumn("block", own("blocks")).withColumn("group", each("groups"))
         .select("part", "group", "block", F.lit(1).alias("kind"), "row", "id", "label", F.col("planes").alias("data"),
                 F.lit(None).cast("array<struct<low:bigint,high:bigint>>").alias("slots")))
    groups = dims // GROUP
    limit = np.iinfo(dtype)

    def fit(bounds: np.ndarray) -> np.ndarray:
        return np.clip(bounds, limit.min, limit.max).astype(dtype)

    def cell(state: dict | None) -> Iterator[pa.RecordBatch]:
        if state and "first" in state:
            f = state["first"]
            lists, place = np.nonzero(f.row >= 0)
            slots = state["slots"].shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(state["row"][lists // slots]), pa.array((lists % slots).astype(np.int32)), pa.array(f.row[lists, place]),
                 pa.array(f.id[lists, place]), pa.array(f.score[lists, place])], names=["anchor", "slot", "cand", "cand_id", "score"])

    def score(state: dict, batch: pa.RecordBatch) -> None:
        planes = np.frombuffer(b"".join(batch.column("data").to_pylist()), np.uint8).reshape(batch.num_rows, bits, groups)
        planes = np.ascontiguousarray(planes.transpose(1, 2, 0), np.intp)
        rows, ids, labels = (batch.column(x).to_numpy() for x in ("row", "id", "label"))
        if "first" not in state:
            parts = state.pop("batches")
            state["row"], state["label"] = (np.concatenate([b.column(x).to_numpy() for b in parts]) for x in ("row", "label"))
            state["vec"] = np.concatenate([_matrix(b.column("data"), dims) for b in parts])
            limits = [s for b in parts for s in b.column("slots").to_pylist()]
            least = np.iinfo(np.int64).min
            slots = max(map(len, limits))
            # an anchor with fewer slots gets windows that hold nothing
            state["slots"] = np.array([[(least if s["low"] is None else s["low"], -least - 1 if s["high"] is None else s["high"]) for s in x]
                                       + [(1, 0)] * (slots - len(x)) for x in limits], np.int64).reshape(len(limits), slots, 2)
            state["first"] = _First(len(limits) * slots, k)
        first, slots = state["first"], state["slots"]
        count = slots.shape[1]
        for at in range(0, len(state["row"]), STRIP):
            strip = slice(at, at + STRIP)
            found = scores(subset_sums(state["vec"][strip], dtype), planes)
            # rows come in growing steps: the first few set the bar for the others
            for begin, end in zip(STEPS, (*STEPS[1:], len(rows)), strict=True):
                some = slice(begin, end)
                if by_label:
                    apart = rows[some, None] != state["row"][strip]
                else:
                    apart = labels[some, None] != state["label"][strip]
                floor = first.least().reshape(-1, count)[strip]
                low, high = np.maximum(slots[strip, :, 0], floor), slots[strip, :, 1]
                # one look at all slots, then at each slot where something is left
                near = (found[some] >= fit(low.min(1))) & (found[some] <= fit(high.max(1))) & apart
                i, j = np.nonzero(near)
                value = found[some][i, j].astype(np.int64)
                for s in range(count):
                    ok = (value >= low[j, s]) & (value <= high[j, s])
                    if ok.any():
                        first.add((at + j[ok]) * count + s, value[ok], ids[some][i[ok]], rows[some][i[ok]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, here = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(x).to_numpy() for x in ("part", "group", "block", "kind")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[:3, lo].tolist())
                if key != here:
                    yield from cell(state)
                    state, here = {"batches": []}, key
                piece = batch.slice(lo, hi - lo)
                if keys[3, lo] == 0:
                    state["batches"].append(piece)
                elif state.get("batches") or "first" in state:
                    score(state, piece)
        yield from cell(state)
        release()

    small_batches(anchors.sparkSession)
    return (a.unionByName(c).repartition(int(min(max(total, 1), 100_000)), "part", "group", "block")
            .sortWithinPartitions("part", "group", "block", "kind")
            .mapInArrow(run, "anchor long, slot int, cand long, cand_id long, score long"))


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The first ``k`` rows of each list, with ``rank`` from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "cand_id", "cand")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | None = None,
                   scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``: for the rows that ``is_anchor``
    holds for, their first ``positives`` other rows of the same ``label``, and
    for each of these the first ``negatives`` rows of another label that have
    ``low`` to ``high`` per cent of its score.

    Scores are inner products of ``floor(scale * component)``; a shorter vector
    counts as filled up with zeros, an empty one scores 0.  Higher scores come
    first, ties by smaller key.  Rows with a null key or label, a null vector
    or a component that is null or not finite take no part.  Repeated rows are
    rows each: a second row with an anchor's key is another row (and another
    anchor).  Components so large that a score could leave 64 bits raise
    ValueError.  Columns other than these are not read.
    """
    spark = rows.sparkSession
    label = F.col("label") if label is None else label
    clean = (rows.select(col(key).cast("long").alias("id"), label.cast("long").alias("label"), quantise(col(vector), scale).alias("v"),
                         F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
             .where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL"))
    # a row's number is fixed once it is written
    clean = materialise(clean.withColumn("row", F.monotonically_increasing_id()), "vectors")
    top, bottom, dims = clean.agg(F.max(F.array_max("v")), F.min(F.array_min("v")), F.max(F.size("v"))).first()
    most, dims = max(int(top or 0), -int(bottom or 0)), max(GROUP, -(-(dims or 0) // GROUP) * GROUP)
    bits = most.bit_length() + 1
    if 100 * dims * most * most >= 1 << 63 or most >= 1 << 31:
        raise ValueError(f"components of up to {most} in {dims} dimensions: scores may leave 64 bits")
    # what is added up on the way stays below twice the largest score there can be
    wide = dims * most << bits >= 1 << 31

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            values = np.zeros((batch.num_rows, dims), np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            values[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy()
            planes = planes_of(values, bits)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([x.astype("<i8").tobytes() for x in values], pa.binary()), pa.array([x.tobytes() for x in planes], pa.binary())],
                names=["row", "id", "label", "anchor", "vec", "planes"])

    small_batches(spark)
    all_rows = materialise(clean.select("row", "id", "label", "anchor", "v")
                           .mapInArrow(pack, "row long, id long, label long, anchor boolean, vec binary, planes binary"), "planes")
    anchors = all_rows.where("anchor").select("row", "id", "label", "vec")
    candidates = all_rows.select("row", "id", "label", "planes")
    bound = lambda lo, hi: F.struct(lo.cast("long").alias("low"), hi.cast("long").alias("high"))
    open_slot = F.array(bound(F.lit(None), F.lit(None)))
    near = _sweep(anchors.withColumn("slots", open_slot), candidates, True, dims, bits, wide, positives, CELLS)
    best = materialise(_ranked(near, positives, "anchor").select("anchor", F.col("cand_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "positives")
    # whole numbers, rounded up and down: low * p <= 100 * n <= high * p
    window = (F.when(F.col("positive_score") < 0, bound(F.expr(f"-(-{low} * positive_score div 100)"), F.expr(f"-((-{high} * positive_score + 99) div 100)")))
              .otherwise(bound(F.expr(f"({low} * positive_score + 99) div 100"), F.expr(f"{high} * positive_score div 100"))))
    slots = (best.withColumn("w", window).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "w"))).alias("s"))
             .select("anchor", F.transform("s", lambda x: x["w"]).alias("slots")))
    far = _sweep(anchors.join(slots, F.col("row") == F.col("anchor")).drop("anchor"), candidates, False, dims, bits, wide, negatives, CELLS)
    chosen = _ranked(far, negatives, "anchor", "slot").withColumnRenamed("rank", "place")
    return (chosen.join(best.withColumn("slot", F.col("rank") - 1).drop("rank"), ["anchor", "slot"])
            .join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("cand_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th row among all rows of ``embeddings``; the
    label of every seventh is moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0, label=label)


OP11_SQL = """
with clean as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as materialized (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
    cast(list_inner_product(cast(a.v as double[]), cast(b.v as double[])) as bigint) as score
  from clean as a, clean as b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, p.positive_id, cast(row_number() over w as integer) as rank, n.other_id as negative_id, p.positive_score, n.score as negative_score
from positives as p join scored as n on n.anchor_id = p.anchor_id and not n.same
  and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by n.score desc, n.other_id)
qualify row_number() over w <= 3
"""
