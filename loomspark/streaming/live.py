"""Streaming forms: secret findings of arriving files, windowed event counts, and live outcome rates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import report, secrets
from loomspark.sources.shared import shared_dir


def stream_findings(corpus: DataFrame) -> DataFrame:
    """Findings of a streaming corpus: the batch operator is stateless and serves as it is."""
    return secrets.findings(corpus)


def event_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """``start, event_type, n, total`` by tumbling window; rows later than ``late`` are dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    sums = timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def requests_in_window(requests: DataFrame, budget: int, window: str = "1 minute") -> DataFrame:
    """``start, provider, n, over``: how many requests a provider got in a window, and whether over its budget."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", window) if requests.isStreaming else requests
    counts = timed.groupBy(F.window("ts", window), "provider").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "provider", "n", (F.col("n") > budget).alias("over"))


def replay(spark: SparkSession, path: str, schema, transform, mode: str = "append", glob: str = "*", per_batch: int | None = None) -> DataFrame:
    """Run ``transform`` over a Parquet folder as a stream until it is drained; the rows it put out.

    Rows and the stream's progress are in a folder of their own below the shared one, so a
    run that is begun again goes on where it was. In ``complete`` mode each batch replaces
    the rows of the one before. ``per_batch``: how many files a batch takes, if not all.
    """
    root = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    out = transform((source.option("maxFilesPerTrigger", per_batch) if per_batch else source).parquet(path))
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{root}/rows")
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/rows")


def live_outcomes(files: DataFrame, artifacts: DataFrame, root: str, seen=None) -> DataFrame:
    """The best tier of each source or template so far, kept below ``root`` while ``artifacts`` arrive; drained, then the outcomes of ``files``.

    ``artifacts`` is a stream of ``artifact_id, source_file, template_source, tier``. Batch ``n`` is merged with the
    table of batch ``n - 1`` into one of its own, so a batch that is run again writes the same table, and the
    best of two tiers does not depend on their order: late and repeated rows change nothing else. Older
    tables are deleted when the next but one is there. ``seen(outcomes)``, if given, is called after each batch.
    """
    spark, rank = files.sparkSession, report.tier_rank(F.col("tier"))
    table = lambda n: f"{root.rstrip('/')}/best-{n}"

    def best(n: int) -> DataFrame:
        return spark.read.schema("path string, rank int").parquet(table(n))

    def outcomes(n: int) -> DataFrame:
        told = best(n).select("path", F.get(F.lit(list(report.TIERS)), F.col("rank") - 1).alias("best"))
        joined = files.select("path", "matched").join(told, "path", "left")
        return joined.select("path", F.coalesce("best", F.when(F.col("matched"), "NOT_EMITTED").otherwise("NO_MATCH")).alias("outcome"))

    def merge(batch: DataFrame, n: int) -> None:
        named = F.array_distinct(F.array_compact(F.array("source_file", "template_source")))
        new = batch.select(F.explode(named).alias("path"), rank.cast("int").alias("rank"))
        every = new.unionByName(best(n - 1)) if n else new
        every.groupBy("path").agg(F.min("rank").alias("rank")).write.mode("overwrite").parquet(table(n))
        if n > 1:
            folder = spark._jvm.org.apache.hadoop.fs.Path(table(n - 2))
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        if seen is not None:
            seen(outcomes(n))

    writer = artifacts.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root.rstrip('/')}/progress").trigger(availableNow=True)
    writer.start().awaitTermination()
    there = spark._jvm.org.apache.hadoop.fs.Path(table(0)).getParent()
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    made = [s.getPath().getName() for s in system.listStatus(there)] if system.exists(there) else []
    last = max((int(name[5:]) for name in made if name.startswith("best-")), default=None)  # of an earlier run too
    return outcomes(last) if last is not None else report.file_outcomes(files, spark.createDataFrame([], "artifact_id string, source_file string, template_source string, tier string"))
