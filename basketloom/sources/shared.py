"""The folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What the session names in ``spark.checkpoint.dir``.

    Where that is unset and all runs in one process on this machine, a temporary folder, made once per application; on
    a cluster an error, as each machine would write to its own disk.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} is unset: name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="basketloom-")
        folder = _OWN[app]
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table below the shared folder, for what is read more than once."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and ``path`` as it takes it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str):
    held = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)


def shuffles_dropped(spark: SparkSession):
    """Meanwhile a query's shuffle files go when it ends; for steps that are each written to the shared folder."""
    return _set(spark, CLEAN_CONF, "true")


def row_by_row(spark: SparkSession):
    """Meanwhile Parquet is read by the row, not by 4,096 of them, as for rows of some MB."""
    return _set(spark, "spark.sql.parquet.enableVectorizedReader", "false")
