"""Results tables.

Results are long rows ``(block, model, metric, value)``; the nested JSON
document of the reference is a rendering of that table.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.scalar import fmt_num

# Block precedence when flattening (later wins) and the columns
# of the comparison table, in display order.
BLOCK_ORDER = ("classical", "qsvm", "bonus")
TABLE_METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1",
                 "roc_auc", "pr_auc", "train_seconds")


def as_results(metrics: DataFrame, block: str, by: str = "model") -> DataFrame:
    return metrics.select(F.lit(block).alias("block"), F.col(by).alias("model"), "metric",
                          F.col("value").cast("double").alias("value"))


def upsert(old: DataFrame | None, updates: DataFrame) -> DataFrame:
    """Every block present in ``updates`` replaces the old block whole;
    other old blocks are kept.  An absent store (None) is empty."""
    if old is None:
        return updates
    keep = old.join(updates.select("block").distinct(), "block", "left_anti")
    return keep.unionByName(updates)


def flatten(results: DataFrame, block_order: tuple[str, ...] = BLOCK_ORDER) -> DataFrame:
    """One metric map per model; on equal model names the later block wins.

    Blocks not in ``block_order`` rank after it, alphabetically."""
    rank = F.array_position(F.array(*[F.lit(b) for b in block_order]), F.col("block"))
    place = F.struct(F.when(rank == 0, F.lit(len(block_order) + 1)).otherwise(rank).alias("r"), F.col("block").alias("b"))
    # a model's rows are its metrics: a window of a few dozen rows, no self join
    best = F.max("_p").over(Window.partitionBy("model"))
    return (results.withColumn("_p", place).withColumn("_b", best).where(F.col("_p") == F.col("_b"))
            .select("model", "metric", "value"))


def pivot_metrics(flat: DataFrame, metrics: tuple[str, ...] = TABLE_METRICS) -> DataFrame:
    """Model x metric table; a metric nobody has is a NULL column."""
    return flat.groupBy("model").pivot("metric", list(metrics)).agg(F.first("value"))


def rank_models(flat: DataFrame, by: str = "roc_auc") -> DataFrame:
    """L3: models ordered by a metric descending (missing -> 0), then name."""
    v = flat.where(F.col("metric") == by).select("model", F.col("value").alias("_v"))
    models = flat.select("model").distinct().join(v, "model", "left")
    s = F.coalesce(F.col("_v"), F.lit(0.0))
    # one row per model: a bounded window
    w = Window.orderBy(s.desc(), F.col("model"))
    return models.select("model", s.alias(by), F.row_number().over(w).alias("rank"))


def metric_bars(flat: DataFrame, metric: str) -> DataFrame:
    """V7: one metric across models; models without it are skipped."""
    return flat.where(F.col("metric") == metric).select("model", "value")


def markdown_rows(flat: DataFrame, by: str = "roc_auc") -> DataFrame:
    """Ranked markdown table rows (NaN-default .3f, seconds .2f)."""
    ranked = rank_models(flat, by).select("model", "rank")
    wide = flat.groupBy("model").pivot("metric", list(TABLE_METRICS)).agg(F.first("value"))
    j = ranked.join(wide, "model", "left")
    cells = [F.col("model")] + [
        fmt_num(F.col(m), 2 if m == "train_seconds" else 3) for m in TABLE_METRICS]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return j.select("rank", line.alias("line"))


def markdown_table(flat: DataFrame, by: str = "roc_auc") -> str:
    """Header + rows as text (the rows are bounded by the number of models)."""
    head = "| model | " + " | ".join(TABLE_METRICS) + " |"
    sep = "|" + "---|" * (len(TABLE_METRICS) + 1)
    rows = [r["line"] for r in markdown_rows(flat, by).orderBy("rank").collect()]
    return "\n".join([head, sep, *rows])


def splice_table(text: str, table: str, begin: str, end: str) -> str:
    """Replace the text between two markers (raise if either is absent)."""
    i, j = text.find(begin), text.find(end)
    if i < 0 or j < 0 or j < i:
        raise ValueError("table markers not found")
    return text[: i + len(begin)] + "\n" + table + "\n" + text[j:]


def nested_json(results: DataFrame) -> DataFrame:
    """One row per block: ``{model: {metric: value}}`` as JSON text, keys
    sorted.  Each collected list is bounded by the models / metrics count."""
    per_model = results.groupBy("block", "model").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("m"))
    per_block = per_model.groupBy("block").agg(
        F.map_from_entries(F.array_sort(
            F.collect_list(F.struct("model", "m")),
            lambda a, b: F.when(a["model"] < b["model"], -1).when(a["model"] > b["model"], 1)
            .otherwise(0))).alias("mm"))
    return per_block.select("block", F.to_json("mm").alias("json"))


def write_results(results: DataFrame, path: str) -> None:
    """The long table as JSON lines (overwrite = replace the store)."""
    results.coalesce(1).write.mode("overwrite").json(path)


def read_results(spark, path: str) -> DataFrame:
    """Read the store; a missing path raises ``AnalysisException``."""
    return spark.read.schema("block string, model string, metric string, value double").json(path)


_RESULTS_SCHEMA = "block string, model string, metric string, value double"


def _versions(spark, base: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("v=") and name[2:].isdigit() and fs.exists(
                jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def load_store(spark, base: str) -> DataFrame | None:
    """S9 on a versioned store: the latest complete version, or None."""
    v = _versions(spark, base)
    return read_results(spark, f"{base.rstrip('/')}/v={v[-1]}") if v else None


def upsert_store(spark, base: str, updates: DataFrame, wait: float = 30.0) -> str:
    """S10 on storage: read the latest version, replace the updated blocks,
    write the result as the next version.  Returns its path.

    Commits are optimistic.  The merged rows are first written whole to a folder
    of their own.  Then the next number is taken by creating its commit file,
    which only one run can do, and the folder becomes that version.  A run that
    comes second waits for the first one's version, merges again on top of it
    and tries the number after, so no run's blocks are lost.  A commit file
    without a version after ``wait`` seconds is one of a run that died: its
    number is skipped (a run that finds itself slower than half of that after
    taking a number does not use it)."""
    jvm = spark.sparkContext._jvm
    path = lambda name: jvm.org.apache.hadoop.fs.Path(base, name)
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(root)
    skip = 0
    while True:
        v = _versions(spark, base)
        number = max((v[-1] + 1) if v else 0, skip)
        work = f"_work-{uuid.uuid4().hex}"
        write_results(upsert(load_store(spark, base), updates), f"{base.rstrip('/')}/{work}")
        began = time.monotonic()
        if _versions(spark, base) == v and fs.createNewFile(path(f"_commit-{number}")):
            # nothing can have come between: a later version needs this number's first
            if time.monotonic() - began < wait / 2 and fs.rename(path(work), path(f"v={number}")):
                return f"{base.rstrip('/')}/v={number}"
            skip = number + 1
        else:
            until = time.monotonic() + wait
            while number not in _versions(spark, base) and _versions(spark, base) == v:
                if time.monotonic() > until:
                    skip = number + 1
                    break
                time.sleep(0.05)
        fs.delete(path(work), True)
