"""Sparse encoded rows (I4) and what is fitted on them.

A row's features are its numeric columns and one entry per string column: the
slot of its value.  Slots come from a vocabulary table, so the schema is the
same for ten values and for ten million, and no vocabulary is held by the
driver.  The first value of each column (in order) has no slot, as among dummy
columns.

* ``Vocabulary.fit``: values counted by column, numbered by running sums.
* ``encode``: the slot of each value by a join; ``entries`` is the array of
  (slot, x) of what is not zero, ``features`` the sparse MLlib vector.
* ``moments`` and ``f_scores``: sums over entries only.  Zeros are counted, not
  visited, so the work follows the entries and not slots x rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.operators.cumulative import dist_cumsum
from calibra.operators.prepare import category_counts, modes_from_counts
from calibra.session import staged


#: A slot is frequent that has an entry in one of so many rows.
FREQUENT = 100


@dataclass
class Vocabulary:
    """Slots of the values of string columns, after those of numeric columns."""

    numeric: list[str]
    strings: list[str]
    #: feature, value, index (0 is the dropped one), slot (null for it)
    table: DataFrame
    #: values of each string column, and the most frequent one
    sizes: dict[str, int]
    fill: dict[str, str]

    @classmethod
    def fit(cls, df: DataFrame, numeric: list[str], strings: list[str]) -> Vocabulary:
        """One pass over ``df``; missing values count as the column's most
        frequent value (a column without any value as the text Unknown)."""
        if not strings:
            empty = df.sparkSession.createDataFrame([], "feature string, value string, index long, slot long")
            return cls(numeric, [], empty, {}, {})
        counts = staged(category_counts(df, strings), "categories")
        sizes = {r["feature"]: r["k"] for r in counts.groupBy("feature").agg(F.count(F.lit(1)).alias("k")).collect()}
        fill = {r["feature"]: r["mode"] for r in modes_from_counts(counts).collect()}
        first, begin = {}, len(numeric)
        for c in strings:
            first[c] = begin
            begin += max(sizes.get(c, 1) - 1, 0)
        begins = F.create_map(*[F.lit(x) for c in strings for x in (c, first[c])])
        numbered = dist_cumsum(counts.select("feature", "value", F.lit(1).alias("one")), ["feature"], [("value", True)], {"upto": "one"})
        index = (F.col("upto") - 1).cast("long")
        table = numbered.select("feature", "value", index.alias("index"),
                                F.when(index > 0, begins[F.col("feature")] + index - 1).alias("slot"))
        return cls(numeric, strings, staged(table, "vocabulary"), {c: sizes.get(c, 1) for c in strings}, {c: fill.get(c, "Unknown") for c in strings})

    @property
    def slots(self) -> int:
        return len(self.numeric) + sum(n - 1 for n in self.sizes.values())

    def indexed(self, df: DataFrame) -> DataFrame:
        """``df`` with ``<column>_index`` of each string column.  A value that
        was not fitted has none.  The planner broadcasts a column's values if
        they are few, else both sides are shuffled by value, and a value that a
        third of the rows share is split by the adaptive join."""
        for c in self.strings:
            values = self.table.where(F.col("feature") == c).select(F.col("value").alias(f"_{c}"), F.col("index").alias(f"{c}_index"))
            df = df.withColumn(f"_v_{c}", F.coalesce(F.col(c).cast("string"), F.lit(self.fill[c])))
            df = df.join(values, F.col(f"_v_{c}") == F.col(f"_{c}"), "left").drop(f"_{c}", f"_v_{c}")
        return df

    def entries(self) -> Column:
        """What is not zero in an indexed row: (slot, x), by slot."""
        parts = [F.struct(F.lit(i).cast("long").alias("slot"), F.col(c).cast("double").alias("x")) for i, c in enumerate(self.numeric)]
        begin = len(self.numeric)
        for c in self.strings:
            at = F.col(f"{c}_index")
            parts.append(F.struct(F.when(at > 0, begin + at - 1).alias("slot"), F.lit(1.0).alias("x")))
            begin += self.sizes[c] - 1
        return F.filter(F.array(*parts), lambda e: e["slot"].isNotNull() & (e["x"] != 0))

    def encode(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns and ``entries`` of each row of ``df``."""
        return self.indexed(df).select(*keep, self.entries().alias("entries"))

    def vectors(self, df: DataFrame, keep: list[str], out: str = "features") -> DataFrame:
        """``keep`` columns and the sparse MLlib vector of each row.  Values
        that were not fitted are all zero."""
        rows = self.indexed(df)
        wide = [c for c in self.strings if self.sizes[c] > 1]
        if wide:
            # the encoder drops the last category: put the first one there, and what is unknown beside it
            place = lambda c: F.pmod(F.coalesce(F.col(f"{c}_index"), F.lit(0)) - 1, F.lit(self.sizes[c])).cast("double")
            rows = rows.withColumns({f"{c}_place": place(c) for c in wide})
            sizes = df.sparkSession.createDataFrame([tuple(float(self.sizes[c] - 1) for c in wide)], ", ".join(f"`{c}_place` double" for c in wide))
            rows = OneHotEncoder(inputCols=[f"{c}_place" for c in wide], outputCols=[f"{c}_hot" for c in wide], dropLast=True).fit(sizes).transform(rows)
        rows = rows.withColumns({f"{c}_number": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.numeric})
        inputs = [f"{c}_number" for c in self.numeric] + [f"{c}_hot" for c in wide]
        return VectorAssembler(inputCols=inputs, outputCol=out).transform(rows).select(*keep, out)


def moments(rows: DataFrame, slots: int) -> DataFrame:
    """``slot``, ``mean``, ``std`` (population) over all rows of ``entries``;
    slots without an entry have 0 and 0."""
    n = rows.count()
    sums = rows.select(F.explode("entries").alias("e")).groupBy(F.col("e.slot").alias("slot")).agg(
        F.sum("e.x").alias("s"), F.sum(F.col("e.x") * F.col("e.x")).alias("q"), F.count(F.lit(1)).alias("m"))
    full = rows.sparkSession.range(slots).select(F.col("id").alias("slot")).join(sums, "slot", "left").na.fill(0, ["s", "q", "m"])
    mean = F.col("s") / F.lit(float(max(n, 1)))
    return full.select("slot", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.lit(float(max(n, 1))) - mean * mean, F.lit(0.0))).alias("std"))


def f_scores(rows: DataFrame, label: str, slots: int) -> DataFrame:
    """``slot``, ``f_score``: one-way ANOVA F of each slot against ``label``,
    from sums per slot and class over the entries and the class sizes (bounded:
    a row per class).  Numbers are shifted by the slot's mean over all rows
    before they are squared, so shifted data keep their digits."""
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    n, k = sum(sizes.values()), len(sizes)
    mean = moments(rows, slots).select("slot", F.col("mean").alias("grand"))
    entry = rows.select(F.col(label).alias("y"), F.explode("entries").alias("e")).select("y", F.col("e.slot").alias("slot"), F.col("e.x").alias("x"))
    # entries are summed up before they meet all the means: a slot of very many
    # would be one task's in a join.  Such slots, which are few, are shifted by
    # their mean at once; in others nearly all rows are zero, so is the mean
    # beside an entry, and the shift can follow
    many = entry.groupBy("slot").count().where(F.col("count") * FREQUENT >= n).select("slot")
    pivots = F.broadcast(mean.join(F.broadcast(many), "slot").withColumnRenamed("grand", "pivot"))
    d = F.col("x") - F.col("pivot")
    own = entry.join(pivots, "slot", "left").na.fill(0.0, ["pivot"]).groupBy("slot", "pivot", "y").agg(
        F.sum(d).alias("s"), F.sum(d * d).alias("q"), F.count(F.lit(1)).alias("m"))
    far = F.col("pivot") - F.col("grand")
    part = own.join(mean, "slot").select("slot", "grand", "y", "m", (F.col("s") + F.col("m") * far).alias("s"),
                                         (F.col("q") + far * (2 * F.col("s") + F.col("m") * far)).alias("q"))
    rest = F.create_map(*[F.lit(x) for c, size in sizes.items() for x in (c, float(size))])[F.col("y")]
    # the rows of the class without an entry hold a zero, that is minus the mean
    zeros = rest - F.col("m")
    part = part.select("slot", "grand", "y", (F.col("s") - zeros * F.col("grand")).alias("s"),
                       (F.col("q") + zeros * F.col("grand") * F.col("grand")).alias("q"), rest.alias("size"))
    held = part.groupBy("slot", "grand").agg(F.sum(F.col("s") * F.col("s") / F.col("size")).alias("b"), F.sum("q").alias("q"), F.sum("size").alias("size"))
    # classes that have no entry in a slot at all hold only zeros
    other = F.lit(float(n)) - F.col("size")
    grand2 = F.col("grand") * F.col("grand")
    between, total = F.col("b") + other * grand2, F.col("q") + other * grand2
    within = F.greatest(total - between, F.lit(0.0))
    f = (F.when(F.lit(k < 2 or n <= k), F.lit(None).cast("double"))
         .when(within > 1e-12 * total, (between / (k - 1)) / (within / max(n - k, 1)))
         .when(between > 0, F.lit(float("inf"))))
    return held.select("slot", f.alias("f_score"))
