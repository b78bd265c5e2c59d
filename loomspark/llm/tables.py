"""Reading a test table and writing intermediate tables to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomspark.sources.shared import shared_dir


#: Rows of whole texts that an Arrow batch holds.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Sends Python workers at most ``BATCH_ROWS`` texts at once, unless the session asks for fewer.

    A batch is held by the executor and its worker; Spark's 10,000 rows of long texts are
    tens of MB, in each of them, for each running task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, not yet made."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy", group: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe from lost executors.

    ``group``: rows of a row group, for rows of megabytes. A task holds a row group when it writes, and its rows
    decoded when it reads; Parquet's own bounds are 128 MB packed, and 4,096 rows.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    out = df.write if group is None else df.write.option("parquet.block.row.count.limit", group)
    out.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the table that ``stored`` wrote and ``df`` reads."""
    session = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = session._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(session._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder, for small tables in loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, its texts to be sent to Python in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
