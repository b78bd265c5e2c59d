"""From files to a report in one run whose stages are stored, so that a run that broke goes on where it was.

A stage's rows are Parquet in a folder of its own; when they are all there, an empty file marks
it as done. A run that is begun again in the same folder reads what is done and does over the stage
that was not. The first stage keeps a digest of what the run is over, and a run over anything else is refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import calls, report, secrets
from loomspark.sources.corpus import IGNORED, with_scope

#: The kinds of files that a run is to migrate.
IN_SCOPE = ("script", "template")


class Stages:
    """Results below ``root``, each computed once; ``after(name)``, if given, is called when a stage has been stored."""

    def __init__(self, spark: SparkSession, root: str, after: Callable[[str], None] | None = None):
        self.spark, self.root, self.after = spark, root.rstrip("/"), after

    def marker(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}.done")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def done(self, name: str) -> bool:
        system, path = self.marker(name)
        return system.exists(path)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        table = f"{self.root}/{name}"
        if not self.done(name):
            make().write.mode("overwrite").parquet(table)
            system, path = self.marker(name)
            system.create(path, True).close()
            if self.after is not None:
                self.after(name)
        return self.spark.read.parquet(table)


def digest(rows: DataFrame, name: str) -> DataFrame:
    """``name, n, digest`` of the rows in any order: their number and the sum of their hashes."""
    return rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest"))


def whole_run(files: DataFrame, evidence: DataFrame, root: str, after: Callable[[str], None] | None = None) -> DataFrame:
    """``path, kind, registrations, secrets, outcome`` of every file that is not ignored, stored below ``root`` with all that leads there.

    ``files``: ``path, content``. ``evidence``: ``path, name, compiled, tests, characterization`` of what has been emitted
    for a registration; one without it has not been emitted. ``outcome`` is null for files out of scope.
    A path given twice is one file, with the greatest content.
    """
    run = Stages(files.sparkSession, root, after)
    over = digest(files.select("path", "content"), "files").union(digest(evidence, "evidence"))
    kept = run.stage("inputs", lambda: over)
    if kept.exceptAll(over).count():
        raise ValueError(f"{root} holds a run over other inputs")
    scanned = run.stage("scanned", lambda: with_scope(files.where("path IS NOT NULL AND content IS NOT NULL").where(~F.col("path").rlike(IGNORED)).groupBy("path").agg(F.max("content").alias("content"))))
    found = run.stage("registrations", lambda: calls.registrations(scanned.where("kind = 'script'").select("path", "content")))
    leaks = run.stage("secrets", lambda: secrets.findings(scanned.select("path", "content")))

    def artifacts() -> DataFrame:
        emitted = found.select("path", "name", F.col("kind").alias("artifact_type")).join(evidence, ["path", "name"])
        taken = [F.col(c) for c in ("compiled", "tests", "characterization")]
        return emitted.select(F.concat_ws("#", "path", "name").alias("artifact_id"), "artifact_type", F.col("path").alias("source_file"), F.lit(None).cast("string").alias("template_source"), report.decide_tier(*taken).alias("tier"))

    made = run.stage("artifacts", artifacts)
    in_scope = scanned.where(F.col("kind").isin(*IN_SCOPE)).select("path")
    matched = found.select("path").distinct().withColumn("matched", F.lit(True))
    outcomes = run.stage("outcomes", lambda: report.file_outcomes(in_scope.join(matched, "path", "left").na.fill({"matched": False}), made))
    counted = lambda rows, name: rows.groupBy("path").agg(F.count("*").alias(name))
    whole = lambda: scanned.select("path", "kind").join(counted(found, "registrations"), "path", "left").join(counted(leaks, "secrets"), "path", "left").na.fill(0).join(outcomes, "path", "left")
    return run.stage("report", whole)
