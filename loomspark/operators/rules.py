"""Rules as rows: expressions from a table against every file; one that fails becomes a note, the others go on."""

from __future__ import annotations

import json

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that one job takes; they are held by every task.
MOST = 10_000
RULE = "array<struct<ordinal:int,rule:string,expression:string,scope:string,message:string>>"


def checked(rules: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """The rules that can be used, in the order of ``ordinal`` and name, and ``rule, note`` of those that cannot."""
    rows = rules.select("ordinal", "rule", "expression", "scope", "message").orderBy("ordinal", "rule", "expression").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rules")
    good, bad, seen = [], [], set()
    compiled = rules.sparkSession._jvm.java.util.regex.Pattern.compile
    for r in rows:
        note = None
        try:
            if r.rule is None or r.expression is None or r.expression == "":
                note = "no name or no expression"
            elif r.rule in seen:
                note = "a rule of this name comes before"
            else:
                for expression in (r.expression, r.scope or ""):
                    compiled(expression)
        except IllegalArgumentException as e:
            note = "not an expression: " + str(e).splitlines()[0]
        seen.add(r.rule)
        (bad if note else good).append((r.rule, note) if note else tuple(r))
    return good, bad


def applied(corpus: DataFrame, rules: DataFrame) -> DataFrame:
    """``path, rule, hits, first_line, note``: each file with each rule that it has to do with, and a row without a path for a rule that cannot be used.

    ``rules``: ``ordinal, rule, expression, scope, message``. A rule looks at files whose path its ``scope``
    (an expression, null for all) finds; ``note`` is its ``message`` and how often it was found. Rules are one
    array that every task holds, so files are neither shuffled nor paired with a table; a null content has no hits.
    """
    spark = corpus.sparkSession
    good, bad = checked(rules)
    listed = F.from_json(F.lit(json_of(good)), RULE)
    rule = corpus.select("path", "content", F.explode(F.filter(listed, lambda r: r["scope"].isNull() | F.regexp_like(F.coalesce("path", F.lit("")), r["scope"]))).alias("r"))
    count = F.size(F.regexp_extract_all("content", F.col("r.expression"), F.lit(0)))
    found = rule.withColumn("hits", count).where("hits > 0")
    line = first_line(F.col("content"), F.col("r.expression"))
    told = F.concat(F.coalesce("r.message", F.col("r.rule")), F.lit(" ("), F.col("hits").cast("string"), F.lit(")"))
    rows = found.select("path", F.col("r.rule").alias("rule"), "hits", line.alias("first_line"), told.alias("note"))
    failed = spark.createDataFrame([(None, r, 0, None, n) for r, n in bad], rows.schema)
    return rows.unionByName(failed)


def first_line(text: Column, expression: Column) -> Column:
    """The line of the first place where ``expression`` is found."""
    before = F.left(text, F.regexp_instr(text, expression) - 1)
    return 1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def json_of(rules: list[tuple]) -> str:
    return json.dumps([dict(zip(("ordinal", "rule", "expression", "scope", "message"), r, strict=True)) for r in rules])
