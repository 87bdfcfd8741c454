"""The session, and tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task sorts or joins at once, about: a few hundred bytes each.
TASK_ROWS = 1 << 17


def session(name: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``master`` only where none is configured."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir; one is set here only where it is unset, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="lodestone-checkpoint-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read back: lineage ends here, and lost executors cost nothing."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over so many tasks that what one holds does not grow with ``rows``.

    Few rows stay as they are: then Spark's own number of partitions will do.
    """
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def swept(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing holds any more, rather than when the driver's memory fills."""
    for pause in (0.2, 0.2, 0):  # the first round only lets go of what Python held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def removed(spark: SparkSession, *folders: str) -> None:
    """Delete folders of a file system that Spark reads."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing that is still to be computed reads it."""
    for df in tables:
        removed(df.sparkSession, df.stored_path)
