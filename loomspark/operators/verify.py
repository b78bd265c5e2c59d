"""Verification over tables of evidence: compiler logs, compile rounds, characterisation cases.

Compilers and tests run elsewhere; what they printed or returned is a table here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the diagnostics look like, and after how many rounds all that is left is rejected.
ANSI = r"\x{1b}\[[0-9;]*m"
DIAGNOSTIC = r"^(.+?)(?::\d+:\d+ - |\(\d+,\d+\): )error (TS-?\d+|NG\d+): (.*)$"
MAX_ROUNDS = 25

#: Boundary inputs by parameter type as JSON, and the default of each type.
BOUNDARY = {
    "string": ('""', '"x"', '" <b>Hello</b>, World 42! "'),
    "number": ("0", "1", "-1"),
    "boolean": ("true", "false"),
    "array": ("[]", "[1]", "null"),
    "object": ("{}", '{"k":"v"}', "null"),
}
DEFAULTS = {"string": '"x"', "number": "1", "boolean": "true", "array": "[1]", "object": '{"k":"v"}'}


def diagnostics(logs: DataFrame) -> DataFrame:
    """``log_id, ordinal, file, code, message`` of every diagnostic line of ``logs`` (``log_id``, ``log``)."""
    lines = logs.select("log_id", F.posexplode(F.split(F.regexp_replace("log", ANSI, ""), "\n")).alias("ordinal", "line"))
    line = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    found = lines.select("log_id", "ordinal", line.alias("line")).where(F.col("line").rlike(DIAGNOSTIC))
    part = lambda k: F.regexp_extract("line", DIAGNOSTIC, k)
    return found.select("log_id", "ordinal", part(1).alias("file"), F.replace(part(2), F.lit("TS-99"), F.lit("NG")).alias("code"), part(3).alias("message"))


def owners(found: DataFrame, pending: DataFrame) -> DataFrame:
    """``file, item``: each diagnosed file with the first pending item that emits it or has it as template."""
    paths = pending.select("item", "ordinal", F.explode(F.array_compact(F.array("emitted_path", "template_path"))).alias("file"))
    return found.join(paths, "file").groupBy("file").agg(F.min_by("item", "ordinal").alias("item"))


def compile_rounds(pending: DataFrame, log_of_round: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``item, failed_round`` (null: it compiled) of every pending item.

    ``log_of_round``: diagnostics as ``round, file``. In each round the items that own a
    diagnosed file are rejected; a round with diagnostics that nobody left owns, or the last
    round, rejects all that is left; a round without diagnostics ends it. The state between
    rounds is only a column of the items, cut by a checkpoint in the shared folder.
    """
    state = pending.withColumn("failed_round", F.lit(None).cast("int"))
    for k in range(1, max_rounds + 1):
        log = log_of_round.where(F.col("round") == k)
        if log.isEmpty():
            break
        left = state.where("failed_round IS NULL")
        failed = owners(log, left).select("item").distinct().withColumn("_now", F.lit(True))
        if failed.isEmpty() or k == max_rounds:
            state = state.withColumn("failed_round", F.coalesce("failed_round", F.lit(k)))
            break
        now = F.when(F.col("failed_round").isNull() & F.col("_now"), k).otherwise(F.col("failed_round"))
        state = state.join(failed, "item", "left").withColumn("failed_round", now).drop("_now").checkpoint()
    return state.select("item", "failed_round")


def boundary_rows(targets: DataFrame) -> DataFrame:
    """``target_id, parameter, arguments``: one parameter at a time goes through its boundary values.

    ``targets``: ``target_id`` and ``types``, an array in which null is an unknown type.
    Arguments are JSON texts; unknown types contribute ``null`` and are not varied.
    """
    of = lambda table, t: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), t), F.lit("null"))
    values = F.create_map(*[x for t, vs in BOUNDARY.items() for x in (F.lit(t), F.lit(list(vs)))])
    varied = targets.select("target_id", "types", F.posexplode("types").alias("parameter", "type")).where("type IS NOT NULL")
    rows = varied.select("target_id", "types", "parameter", F.posexplode(F.element_at(values, F.col("type"))).alias("ordinal", "value"))
    arguments = F.transform("types", lambda t, i: F.when(i == F.col("parameter"), F.col("value")).otherwise(F.when(t.isNull(), "null").otherwise(of(DEFAULTS, t))))
    return rows.select("target_id", "parameter", "ordinal", arguments.alias("arguments"))


def same_outcome(kind_a: Column, key_a: Column, kind_b: Column, key_b: Column) -> Column:
    """Whether two outcomes agree; one that could not run agrees with nothing."""
    ran = (kind_a != "unrunnable") & (kind_b != "unrunnable")
    return F.coalesce(ran & (kind_a == kind_b) & key_a.eqNullSafe(key_b), F.lit(False))


def characterized(cases: DataFrame, reason: Column | None = None) -> DataFrame:
    """``target_id, verdict, cases`` from ``ordinal`` and outcomes of the original, its rerun and the migrated function.

    The earliest offending input decides: an original that does not repeat itself, or a migrated
    function that could not run, makes the target ineligible; another outcome of the migrated
    function is a mismatch. If no input returned, the target is ineligible. With ``reason``, a
    column of the cases, ``why`` is the earliest one.
    """
    out = lambda n: (F.col(f"{n}_kind"), F.col(f"{n}_key"))
    verdict = F.when(~same_outcome(*out("original"), *out("rerun")), "ineligible").when(F.coalesce(F.col("migrated_kind"), F.lit("unrunnable")) == "unrunnable", "ineligible").when(~same_outcome(*out("original"), *out("migrated")), "mismatch")
    bad = F.when(verdict.isNotNull(), F.col("ordinal"))
    sums = cases.groupBy("target_id").agg(
        F.min_by(verdict, bad).alias("first_bad"), F.count_if(F.col("original_kind") == "return").alias("returned"), F.count("*").alias("cases"),
        *([] if reason is None else [F.min_by(reason, F.when(reason.isNotNull(), F.col("ordinal"))).alias("why")]),
    )
    decided = F.coalesce("first_bad", F.when(F.col("returned") == 0, "ineligible").otherwise("matched"))
    return sums.select("target_id", decided.alias("verdict"), "cases", *([] if reason is None else ["why"]))


def parameter_types(usages: DataFrame) -> DataFrame:
    """``target_id, parameter, type``: the one type that usage shows; boolean yields to another, two others give none."""
    kinds = F.collect_set("evidence")
    found = usages.groupBy("target_id", "parameter").agg(kinds.alias("kinds"))  # a set over the five type names
    firm = F.when(F.size("kinds") > 1, F.array_remove("kinds", "boolean")).otherwise(F.col("kinds"))
    return found.select("target_id", "parameter", F.when(F.size(firm) == 1, F.get(firm, F.lit(0))).alias("type"))
