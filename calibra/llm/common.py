"""Helpers shared by the operators: tables, scratch tables, Arrow mapping."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.session import checkpoint_dir

#: Words of a text: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, deleted when the driver's
    JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p.getParent())
    return p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


#: Rows of an Arrow batch at most, as rows carry whole texts.
BATCH_ROWS = 2000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Where the shared folder is a mounted one (file:), scratch files are written
#: without checksum files and without the chmod process that Hadoop starts for
#: each file it creates.  Other file systems do not read these settings.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


#: Shuffle files go when the query that made them ends; else they stay until
#: the driver collects its garbage, long after many short steps.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut,
    a lost executor costs no recomputation of what came before, and the shuffle
    files of what came before are no longer needed.

    ``arrow_rows`` sets the rows of a batch for Python while it runs."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before, cleanup = spark.conf.get(_SETTING), spark.conf.get(_CLEANUP, "false")
    if arrow_rows:
        spark.conf.set(_SETTING, str(arrow_rows))
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**_PLAIN_FILES).parquet(path)
    finally:
        spark.conf.set(_SETTING, before)
        spark.conf.set(_CLEANUP, cleanup)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give memory that a task has freed back to the system, as Python workers
    live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to ``BATCH_ROWS`` (it is
    never raised): Spark bounds batches by rows, and ours carry whole texts."""
    rows = int(spark.conf.get(_SETTING))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(_SETTING, str(BATCH_ROWS))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]],
              schema: str, max_bytes: int = 2 << 20) -> DataFrame:
    """Apply ``fn`` to slices of at most about ``max_bytes`` of Arrow data (a
    slice has one row at least), so that memory does not follow batch size."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_bytes):
                out = fn(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        release()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Halve a batch until each part is under ``max_bytes``."""
    n = batch.num_rows
    if n == 0:
        return
    if n == 1 or batch.get_total_buffer_size() <= max_bytes or batch.nbytes <= max_bytes:
        yield batch
        return
    yield from slices(batch.slice(0, n // 2), max_bytes)
    yield from slices(batch.slice(n // 2), max_bytes)


def running_sum(df: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the inclusive running sum of the whole numbers
    ``value`` in the given order (of unique keys).

    Rows are dealt by ranges, each summed as it is written: one shuffle.  The
    sums start from the totals of the ranges before, of which there is one each."""
    small_batches(df.sparkSession)
    at = df.columns.index(value)
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto, held = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield _summed(*held, False)
            sums = upto + np.cumsum(batch.column(at).to_numpy(), dtype=np.int64)
            held, upto = (batch, sums), int(sums[-1])
        if held is not None:
            yield _summed(*held, True)

    def _summed(batch: pa.RecordBatch, sums: np.ndarray, ends: bool) -> pa.RecordBatch:
        last = np.zeros(len(sums), bool)
        last[-1] = ends
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums), pa.array(last)], names=[*batch.schema.names, out, "_last"])

    ranged = materialise(ranged.mapInArrow(run, f"{ddl(ranged, len(ranged.columns))}`{out}` long, _last boolean"), "ranges")
    upto, offsets = 0, []
    for part, total in sorted(tuple(r) for r in ranged.where("_last").select("_part", out).collect()):
        offsets.append((part, upto))
        upto += total
    starts = ranged.sparkSession.createDataFrame(offsets, "_part int, _start long")
    return (ranged.join(F.broadcast(starts), "_part").withColumn(out, F.col(out) + F.col("_start"))
            .drop("_part", "_start", "_last"))


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(columns: Iterable[str], *names: str) -> list[str]:
    """The columns not called any of ``names`` (case does not count)."""
    drop = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in drop]


def col(name: str):
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def sealed(df: DataFrame, made: list[str]) -> DataFrame:
    """``df`` with the columns ``made`` last, given out by a generator of one
    row.  The optimiser moves filters on them no further down, where it would
    repeat the steps that made them within each other."""
    rest = [c for c in df.columns if c not in made]
    return df.select(*map(col, rest), F.inline(F.array(F.struct(*map(col, made)))))


def with_text(docs: DataFrame, rest: list[str], text: str) -> tuple[DataFrame, int]:
    """The columns ``rest`` and, if it is not among them, ``text`` after them
    (under a free name); the text's place."""
    if text in rest:
        return docs.select(*map(col, rest)), rest.index(text)
    return docs.select(*map(col, rest), col(text).alias(fresh("text", rest))), len(rest)


def ddl(df: DataFrame, n: int) -> str:
    """The first ``n`` columns of ``df`` as a schema string, each with a comma."""
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields[:n])
