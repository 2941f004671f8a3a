"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "calibra",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    Master, resources and partition counts are those of ``spark-submit`` or the
    environment; ``master`` and ``shuffle_partitions`` are only for local runs
    and tests that ask for them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", os.environ.get("CALIBRA_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_spark(cpus: int | None = None) -> SparkSession:
    """A session for tools and the bench: ``local[BENCH_CPUS]`` (8 if unset)."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return get_spark(f"local[{n}]", shuffle_partitions=n)


def _local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/S3/...) folder there and we use it as is.
    Only where executors run in the driver's process may it be unset: then we
    make our own.  Elsewhere that is an error, since executors could not read
    what another machine wrote to its own disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not _local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="calibra-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, deleted when the driver's
    JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{path}/data"


def shared_uri(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, for readers other than Spark's."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: whatever is fitted
    on it in several passes reads the sources once, and a lost executor costs
    no recomputation of what came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``calibra`` importable on local-mode Python workers (Arrow
    functions reference its modules): zip the package once and add it to the
    context, as ``--py-files`` does on a cluster.  Needed when the driver
    imported it from a path the workers do not have."""
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    if not _local(spark):
        # clusters ship the package with spark-submit --py-files; no
        # machine-local scratch on the driver is used there
        _SHIPPED.add(id(sc))
        return
    import shutil

    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="calibra-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "calibra"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir="calibra")
    sc.addPyFile(archive)
    _SHIPPED.add(id(sc))
