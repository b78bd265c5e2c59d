"""Characterisation from inputs to verdict: which inputs are run, what their outcomes come to, and what follows.

Functions are run elsewhere; ``outcomes`` is the table of what they did on each input.
"""

from __future__ import annotations

import json
import math
import re
from datetime import datetime, timezone
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.verify import boundary_rows, characterized

#: The reason of the threshold, and of functions that never return.
TOO_FEW = "fewer than two distinct call-site examples and no inferable parameter types (§6.5)"
ALL_THREW = "original function threw on every generated input — no return value to compare"
UNSTABLE = "original function is non-deterministic — two runs on the same input disagree"
#: Why a value that is not what its kind says cannot be compared, and what a number's text looks like.
UNREADABLE = "an unreadable value"
NUMBER = r"-?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?|-?Infinity|NaN"
#: Kinds of values with a plain text form.
TAGGED = ("bigint", "Date", "Error", "RegExp", "String", "Number", "Boolean", "Map", "Set")


def first_of_each(rows: DataFrame) -> DataFrame:
    """``target_id, arguments, first_at``: distinct argument tuples, each at its first place."""
    return rows.groupBy("target_id", "arguments").agg(F.min("at").alias("first_at"))


def call_inputs(targets: DataFrame, calls: DataFrame) -> DataFrame:
    """``target_id, ordinal, arguments`` (JSON): calls seen in the code, then boundary rows, each tuple once.

    ``targets``: ``target_id, types``; ``calls``: ``target_id, ordinal, arguments``. Calls of
    other targets are left out. Places follow from parameter and value, so nothing is sorted
    but each target's own inputs.
    """
    place = lambda source, *parts: F.struct(F.lit(source).alias("source"), *[p.cast("long").alias(f"p{k}") for k, p in enumerate(parts)])
    seen = calls.join(targets.select("target_id"), "target_id", "left_semi").select("target_id", "arguments", place(0, F.col("ordinal"), F.lit(0)).alias("at"))
    made = boundary_rows(targets.where("types IS NOT NULL")).select(
        "target_id", F.concat(F.lit("["), F.array_join("arguments", ","), F.lit("]")).alias("arguments"), place(1, F.col("parameter"), F.col("ordinal")).alias("at")
    )
    distinct = first_of_each(seen.union(made))
    lists = distinct.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct(F.col("first_at").alias("at"), "arguments"))).alias("rows"))
    return lists.select("target_id", F.posexplode(F.transform("rows", lambda r: r["arguments"])).alias("ordinal", "arguments"))


def below_threshold(targets: DataFrame, calls: DataFrame) -> DataFrame:
    """``target_id, too_few``: fewer than two distinct call tuples and no known parameter type."""
    tuples = calls.groupBy("target_id").agg(F.countDistinct("arguments").alias("tuples"))
    typed = F.coalesce(F.exists("types", lambda t: t.isNotNull()), F.lit(False))
    return targets.join(tuples, "target_id", "left").select("target_id", (~typed & (F.coalesce("tuples", F.lit(0)) < 2)).alias("too_few"))


def canonical_number(value: float | int) -> object:
    """Whole numbers without a point, as they are printed where they come from."""
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return {"$": "number", "v": "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"}
        if value == 0 and math.copysign(1, value) < 0:
            return {"$": "number", "v": "-0"}
        return int(Decimal(repr(value))) if value.is_integer() and abs(value) < 1e21 else value
    return value


def canonical_json(value: object) -> object:
    """Entries in code-unit order of their keys, numbers in one form."""
    if isinstance(value, dict):
        return {"$": "Object", "v": [[k, canonical_json(value[k])] for k in sorted(value, key=lambda k: k.encode("utf-16-be"))]}
    if isinstance(value, list):
        return [canonical_json(x) for x in value]
    return value if value is None or isinstance(value, (bool, str)) else canonical_number(value)


def number_of(value: str | None) -> float:
    """The double that a number's text stands for; raises ``ValueError`` for other texts."""
    if value is None or not re.fullmatch(NUMBER, value):
        raise ValueError(value)
    return float(value.replace("Infinity", "inf"))


def canonical_text(kind: str | None, value: str | None) -> tuple[str | None, str | None]:
    """The canonical form of a value, or why it has none; what cannot be read has ``UNREADABLE`` for a reason."""
    try:
        return canonical_form(kind, value)
    except (ValueError, RecursionError):
        return None, UNREADABLE


def canonical_form(kind: str | None, value: str | None) -> tuple[str | None, str | None]:
    read = lambda text: canonical_json(json.loads(text, parse_int=float))
    if kind == "undefined":
        out: object = {"$": "undefined"}
    elif kind == "number":
        out = canonical_number(number_of(value))
    elif kind == "json":
        out = read(value or "")
    elif kind == "Date":
        try:
            at = datetime.fromisoformat((value or "").replace("Z", "+00:00")).astimezone(timezone.utc)
            out = {"$": "Date", "v": f"{at:%Y-%m-%dT%H:%M:%S}.{at.microsecond // 1000:03d}Z"}
        except ValueError:
            out = {"$": "Date", "v": "Invalid"}
    elif kind in ("Map", "Set", "RegExp", "Error"):
        out = {"$": kind, "v": read(value or "[]")}
    elif kind in TAGGED:
        out = {"$": kind, "v": value}
    else:
        return None, f"a {kind}"
    return json.dumps(out, ensure_ascii=False, separators=(",", ":")), None


def canonical(kind: Column, value: Column) -> Column:
    """``key`` and ``reason`` of columns of kinds and texts: equal values have equal keys whatever the order of their entries."""

    @F.pandas_udf("key string, reason string")
    def found(kinds: pd.Series, values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([canonical_text(k, v) for k, v in zip(kinds, values, strict=True)], columns=["key", "reason"])

    return found(kind, value)


def keyed_outcomes(outcomes: DataFrame, sides: tuple[str, ...] = ("original", "rerun", "migrated")) -> DataFrame:
    """``outcomes`` with ``<side>_key`` and ``<side>_fault`` for each side.

    A side has ``<side>_kind`` (return, throw, unrunnable), ``<side>_type`` and ``<side>_value``; what
    was thrown is compared by its text.
    """
    out = outcomes
    for s in sides:
        returned = F.col(f"{s}_kind") == "return"
        out = out.withColumn(f"_{s}", canonical(F.when(returned, F.col(f"{s}_type")).otherwise("String"), F.col(f"{s}_value")))
        which = "original" if s == "rerun" else s
        fault = F.when(F.coalesce(F.col(f"{s}_kind"), F.lit("unrunnable")) == "unrunnable", F.concat(F.lit(f"{which} function could not run standalone ("), F.coalesce(f"{s}_value", F.lit("no outcome")), F.lit(")"))).when(
            F.col(f"_{s}.reason").isNotNull(), F.concat(F.lit(f"{which} function returned "), F.col(f"_{s}.reason"), F.lit(", which cannot be compared structurally"))
        )
        out = out.withColumns({f"{s}_key": F.col(f"_{s}.key"), f"{s}_fault": fault}).drop(f"_{s}")
    return out


def run_characterization(targets: DataFrame, calls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``target_id, eligible, matched, reason, cases`` of every target.

    ``targets``: ``target_id, types`` and ``fault`` (why the source cannot be run, else null);
    ``outcomes``: what each side did by ``target_id, arguments``. The order is: fault of the
    source, threshold, then the earliest input that decides; if no input returned, the target
    is ineligible. ``cases`` is null unless all inputs matched.
    """
    inputs = call_inputs(targets.where("fault IS NULL"), calls)
    ran = inputs.join(keyed_outcomes(outcomes), ["target_id", "arguments"], "left")
    fault = F.coalesce("original_fault", F.when(F.col("rerun_fault").isNotNull(), F.lit(UNSTABLE)))
    unstable = F.when((F.col("original_kind") != F.col("rerun_kind")) | ~F.col("original_key").eqNullSafe(F.col("rerun_key")), F.lit(UNSTABLE))
    ran = ran.withColumn("_why", F.coalesce(fault, unstable, F.col("migrated_fault")))
    for s in ("original", "rerun", "migrated"):
        ran = ran.withColumn(f"{s}_kind", F.when(F.col(f"{s}_fault").isNotNull() | F.col(f"{s}_kind").isNull(), "unrunnable").otherwise(F.col(f"{s}_kind")))
    told = targets.join(below_threshold(targets, calls), "target_id").join(characterized(ran, F.col("_why")), "target_id", "left")
    why = F.coalesce("fault", F.when(F.col("too_few"), F.lit(TOO_FEW)), F.when(F.coalesce("verdict", F.lit("ineligible")) == "ineligible", F.coalesce("why", F.lit(ALL_THREW))))
    eligible = why.isNull()
    return told.select(
        "target_id", eligible.alias("eligible"), F.when(eligible, F.col("verdict") == "matched").alias("matched"), why.alias("reason"), F.when(eligible & (F.col("verdict") == "matched"), F.col("cases")).alias("cases")
    )
