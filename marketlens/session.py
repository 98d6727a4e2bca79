"""Spark session helpers.

The library never creates a cluster configuration of its own on a real
cluster: it reads what the session already has (shuffle partitions, the
shared ``spark.checkpoint.dir``) and only fills gaps for local runs and tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package relies on. AQE re-plans joins from
# runtime sizes, coalesces small shuffle partitions and splits skewed join
# partitions; the session zone is pinned so epoch <-> timestamp conversions
# are the same on every executor.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Spark's setting to drop an execution's shuffle files when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's limit on the size of a batch that it sends to a Python worker.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "marketlens") -> SparkSession:
    """A local session for tests and benchmarks (cluster jobs bring their own)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", "8g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set to a path that the driver and all executors
    share; where it is unset, only a purely local master (one machine) gets a
    scratch folder and any other master is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="marketlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    try:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
    except Exception:  # sessions without a local SparkContext (Spark Connect)
        pass
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder, removed when the
    application ends (Hadoop's delete-on-exit)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/marketlens/{name}-{uuid.uuid4().hex}"
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    except Exception:  # sessions without a JVM handle (Spark Connect)
        pass
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file of UTF-8 text on the file system that ``path`` names; an older one is replaced."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: one job computes it, later steps read files with known sizes, and
    a lost executor re-reads the files instead of recomputing the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # the written table replaces the shuffle files behind it; long texts go to Python in small batches
    wanted = {FREE_SHUFFLES: "true", ARROW_BYTES: str(16 << 20)}
    old = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
