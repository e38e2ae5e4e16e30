"""SparkSession construction for local runs and tests.

On a cluster the session comes from the platform; ``ensure_checkpoint_dir``
only sets a checkpoint folder when the cluster has not named one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, partitions: int = 8, app: str = "freightlens") -> SparkSession:
    """A session; the master is the submit command's unless one is named here."""
    builder = SparkSession.builder if master is None else SparkSession.builder.master(master)
    builder = (
        builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.executorEnv.PYTHONWARNINGS", "ignore::FutureWarning")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch one only where driver and
    executors are one process (``local``).  Elsewhere an unset folder is an error:
    executors would write to their own disks."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not is_local(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="freightlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


#: Folders of the tables that ``materialize`` wrote, by session.
_TABLES: dict[int, list[str]] = {}

#: Bytes of input for each partition that a written frame's shuffles start with.
INPUT_PER_PARTITION = 8 << 20


def input_bytes(df: DataFrame) -> int:
    """The bytes of the files and other leaves that ``df`` is planned from."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(b for b in sizes if b < 1 << 60)  # a leaf of unknown size counts for nothing


@contextmanager
def lean_shuffles(df: DataFrame) -> Iterator[None]:
    """For an action that nothing else shares the shuffles of: their files go when it ends, and they start with
    partitions in proportion to the input, of which AQE puts small ones together.  So a task's sort fits into its memory
    however large the input is, rather than being spilled to disk beside the shuffle's files."""
    conf = df.sparkSession.conf
    least = int(conf.get("spark.sql.shuffle.partitions"))
    wanted = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(max(least, -(-input_bytes(df) // INPUT_PER_PARTITION))),
    }
    before = {k: conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a Parquet table under the cluster's checkpoint folder
    and read it back: lineage is cut, a lost executor re-reads files, and
    later jobs get column pruning and true size statistics (so Catalyst's
    broadcast decisions see the real size).  ``release_tables`` removes them."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    with lean_shuffles(df):
        df.write.mode("overwrite").parquet(path)
    _TABLES.setdefault(id(spark), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_tables(spark: SparkSession) -> None:
    """Remove the tables written in this session; frames that read them can't be used any more."""
    for path in _TABLES.pop(id(spark), []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
