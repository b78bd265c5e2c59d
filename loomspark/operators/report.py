"""Reports over artifacts and files: resolution of templates, tiers, rates and name claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.text import rate

#: The tiers from best to worst, and the artifact types that every summary lists.
TIERS = ("MEDIUM", "LOW", "REJECTED")
ARTIFACT_TYPES = ("controller", "service", "filter", "directive", "route")


def resolve_templates(declarations: DataFrame, files: DataFrame, candidates: list[Column]) -> DataFrame:
    """``declaration_id, template``: the first candidate path that is a file, else null.

    Candidates become rows, meet the files in one equi-join, and the smallest rank is kept.
    """
    tried = declarations.select("declaration_id", F.posexplode(F.array(*candidates)).alias("rank", "path"))
    found = tried.join(files.select("path").distinct(), "path")
    first = found.groupBy("declaration_id").agg(F.min_by("path", "rank").alias("template"))
    return declarations.select("declaration_id").join(first, "declaration_id", "left")


def orphan_templates(templates: DataFrame, resolved: DataFrame) -> DataFrame:
    """The rows of ``templates`` that no declaration owns."""
    owned = resolved.where("template IS NOT NULL").select(F.col("template").alias("path")).distinct()
    return templates.join(owned, "path", "left_anti")


def artifacts_of_files(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """``path, artifact_id, tier`` where a file is an artifact's source or its template.

    An OR in a join condition would need a nested loop; an artifact's paths become rows instead.
    """
    paths = files.select("path").distinct()
    named = F.array_distinct(F.array_compact(F.array("source_file", "template_source")))
    return artifacts.select(F.explode(named).alias("path"), "artifact_id", "tier").join(paths, "path")


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.lit(list(TIERS)), tier)


def file_outcomes(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``path, outcome``: the best tier of a file's artifacts, else NOT_EMITTED if it matched, else NO_MATCH."""
    best = artifacts_of_files(artifacts, files).groupBy("path").agg(F.min_by("tier", tier_rank(F.col("tier"))).alias("best"))
    joined = files.select("path", "matched").join(best, "path", "left")
    return joined.select("path", F.coalesce("best", F.when(F.col("matched"), "NOT_EMITTED").otherwise("NO_MATCH")).alias("outcome"))


def tiers_by_type(artifacts: DataFrame) -> DataFrame:
    """``artifact_type, total, medium, low, rejected``; every type has a row, also at zero."""
    counts = artifacts.groupBy("artifact_type").agg(F.count("*").alias("total"), *[F.count_if(F.col("tier") == t).alias(t.lower()) for t in TIERS])
    types = artifacts.sparkSession.range(1, numPartitions=1).select(F.explode(F.lit(list(ARTIFACT_TYPES))).alias("artifact_type"))
    return types.join(counts, "artifact_type", "left").na.fill(0)


def honest_rates(outcomes: DataFrame) -> DataFrame:
    """``in_scope, matched, compiled, match_rate, compile_rate`` over files, in one aggregation."""
    out = F.col("outcome")
    counts = outcomes.agg(F.count("*").alias("in_scope"), F.count_if(out != "NO_MATCH").alias("matched"), F.count_if(out.isin("MEDIUM", "LOW")).alias("compiled"))
    return counts.withColumns({"match_rate": rate(F.col("matched"), F.col("in_scope")), "compile_rate": rate(F.col("compiled"), F.col("in_scope"))})


def decide_tier(compiled: Column, tests: Column, characterization: Column) -> Column:
    """The tier from evidence, in the order of the checks; null evidence was not taken."""
    return (
        F.when(~compiled, "REJECTED")
        .when(~tests, "REJECTED")
        .when(characterization.isNull(), "LOW")
        .when(characterization == "ineligible", "LOW")
        .when(characterization == "mismatch", "REJECTED")
        .otherwise("MEDIUM")
    )


def failed_check(compiled: Column, tests: Column, characterization: Column) -> Column:
    return F.when(~compiled, "compile").when(~tests, "tests").when(characterization == "mismatch", "characterization")


def unique_paths(rows: DataFrame, base: str, order: str) -> DataFrame:
    """``rows`` with ``unique_path``: the second and later of a path get ``-2``, ``-3``, ... before ``.<kind>.ts``."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    numbered = F.regexp_replace(F.col(base), F.lit(r"(\.[a-z]+\.ts)$"), F.concat(F.lit("-"), n.cast("string"), F.lit("$1")))
    return rows.withColumn("unique_path", F.when(n == 1, F.col(base)).otherwise(numbered))


def first_claims(rows: DataFrame, scope: list[str], order: str) -> DataFrame:
    """``rows`` with ``kept`` and ``reason``: the first of a name is kept, later ones are skipped."""
    n = F.row_number().over(Window.partitionBy(*scope).orderBy(order))
    return rows.withColumns({"kept": n == 1, "reason": F.when(n > 1, F.concat(F.lit("duplicate name "), F.col(scope[-1])))})


def last_to_end(rows: DataFrame, key: str, fallback: Column, order: str, value: str) -> DataFrame:
    """Per key, the last fallback's value and how many there were; more than one is worth a warning."""
    return rows.where(fallback).groupBy(key).agg(F.max_by(value, order).alias("fallback"), F.count("*").alias("n"), (F.count("*") > 1).alias("warned"))


def first_place_last_value(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Duplicates keep the place of the first and the value of the last."""
    return rows.groupBy(*key).agg(F.min(order).alias("first_at"), F.max_by(value, order).alias("last_value"))


def apply_edits(text: Column, edits: Column) -> Column:
    """``text`` with disjoint ``edits`` (``start``, ``stop``, ``replacement``) made, last one first."""
    last_first = F.array_sort(edits, lambda a, b: b["start"] - a["start"])

    def step(acc: Column, e: Column) -> Column:
        return F.concat(F.left(acc, e["start"]), e["replacement"], F.substring(acc, e["stop"] + 1, F.length(acc)))

    return F.aggregate(last_first, text, step)
