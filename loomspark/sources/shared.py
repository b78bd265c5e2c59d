"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local master may go without, with a folder of its own, set once."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def ready(spark: SparkSession) -> None:
    """Makes checkpoints go to the shared folder."""
    shared_dir(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in a folder of its own in the shared one, read again: what several plans start from is computed once and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return never_sent(spark.read.schema(df.schema).parquet(path))


def never_sent(df: DataFrame) -> DataFrame:
    """``df``, joined by sorting: a table that packs well is far smaller on disk than in memory, and Spark sends by the size on disk."""
    return df.hint("merge")


def dealt(df: DataFrame, name: str, key: str, parts: int, lies: bool = False) -> DataFrame:
    """``written``, in ``parts`` buckets by ``key``: windows, groups and joins by keys that begin with it move no rows.

    That joins by more keys do not is a setting of the session, off unless asked for. ``lies``: the rows lie so already
    (Spark forgets it behind a Python function), and are written where they are; were it not so, buckets had more files.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    table = f"{name}_{uuid.uuid4().hex}"
    spread = df if lies else df.repartition(parts, key)
    spread.write.bucketBy(parts, key).option("path", f"{shared_dir(spark).rstrip('/')}/{table}").saveAsTable(table, format="parquet")
    return never_sent(spark.table(table))


def removed(df: DataFrame) -> None:
    """Deletes the table that ``written`` wrote and ``df`` reads."""
    session = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = session._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(session._jsc.hadoopConfiguration()).delete(folder, True)
