"""What is emitted for a declaration: its class, path, imports, template, reasons and notes; and edits that meet.

All are column expressions or one grouped aggregation. Texts are searched as text: an
identifier in a comment counts as used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators.rewrite import in_order
from loomspark.sources.shared import written

#: Where the symbols come from, in the order in which they are imported.
IMPORT_SOURCES = {
    "Component": "@angular/core",
    "Directive": "@angular/core",
    "Pipe": "@angular/core",
    "Injectable": "@angular/core",
    "Input": "@angular/core",
    "Inject": "@angular/core",
    "HttpClient": "@angular/common/http",
    "Routes": "@angular/router",
    "Observable": "rxjs",
    "Subject": "rxjs",
}
#: Artifact type and file suffix by decorator.
DECORATED = {"Component": ("directive", "component"), "Directive": ("directive", "directive"), "Pipe": ("filter", "pipe"), "Injectable": ("service", "service")}

TEMPLATE_URL = r"""\btemplateUrl\s*:\s*(?:'([^'\\]*)'|"([^"\\]*)")\s*(?=[,}\n]|$)"""
PIPE = r"""@Pipe\s*\(\s*\{[^{}]*?\bname\s*:\s*['"]([^'"]*)['"]"""


def artifact_class(is_class: Column, decorator: Column, registration: Column) -> Column:
    """``artifact_type`` and ``suffix`` of a declaration as a struct; what is no class is a route table."""
    kind = lambda t, s: F.struct(F.lit(t).alias("artifact_type"), F.lit(s).alias("suffix"))
    undecorated = F.when(registration == "controller", kind("controller", "controller")).otherwise(kind("service", "service"))
    out = reduce(lambda acc, d: F.when(decorator == d[0], kind(*d[1])).otherwise(acc), DECORATED.items(), undecorated)
    return F.when(~is_class, kind("route", "routes")).otherwise(out)


def uses(text: Column, symbol: str) -> Column:
    """Whether ``text`` has ``symbol`` as an identifier."""
    return text.rlike(rf"(?<![A-Za-z0-9_$]){symbol}(?![A-Za-z0-9_$])")


def import_lines(text: Column) -> Column:
    """One line a module whose symbols ``text`` uses, modules and symbols in their fixed order."""

    def line(source: str) -> Column:
        symbols = [s for s, of in IMPORT_SOURCES.items() if of == source]
        used = F.array_compact(F.array(*[F.when(uses(text, s), F.lit(s)) for s in symbols]))
        return F.when(F.size(used) > 0, F.concat(F.lit("import { "), F.array_join(used, ", "), F.lit(f" }} from '{source}';\n"))).otherwise("")

    return F.concat(*[line(source) for source in dict.fromkeys(IMPORT_SOURCES.values())])


def symbols_by_source(declarations: DataFrame, key: str, text: str = "content") -> DataFrame:
    """``<key>, source, symbols``: the symbols of each module that a declaration uses."""
    table = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(s).alias("symbol"), F.lit(of).alias("source"), uses(F.col(text), s).alias("used")) for k, (s, of) in enumerate(IMPORT_SOURCES.items())])
    used = declarations.select(key, F.explode(F.filter(table, lambda x: x["used"])).alias("u"))
    return used.groupBy(key, F.col("u.source").alias("source")).agg(in_order(F.col("u.place"), F.col("u.symbol"), ", ").alias("symbols"))


def template_url(text: Column) -> Column:
    """The first ``templateUrl`` that is a string literal; null if there is none."""
    part = lambda k: F.regexp_extract(text, TEMPLATE_URL, k)
    return F.when(text.rlike(TEMPLATE_URL), F.concat(part(1), part(2)))


def tier_reason(tier: Column, cases: Column, reason: Column) -> Column:
    """Why an artifact has its tier: for the best one how many inputs matched."""
    return F.when(tier == "MEDIUM", F.concat(F.lit("characterization matched on "), cases.cast("string"), F.lit(" inputs"))).otherwise(reason)


def filters_with_pipes(registrations: DataFrame, emitted: DataFrame) -> DataFrame:
    """``path, name, ordinal, emitted_path``: each emitted pipe with the first filter of its name in its source file.

    ``emitted``: ``source_path, emitted_path, content``.
    """
    name = F.regexp_extract("content", PIPE, 1)
    pipes = emitted.where(F.col("content").rlike(PIPE)).select(F.col("source_path").alias("path"), "emitted_path", name.alias("name"))
    filters = registrations.where("kind = 'filter'").groupBy("path", "name").agg(F.min("ordinal").alias("ordinal"))
    return pipes.join(filters, ["path", "name"]).select("path", "name", "ordinal", "emitted_path")


def notes(results: DataFrame) -> DataFrame:
    """``path, ordinal, note``: why patterns did not apply and what those that did warn of.

    ``results``: ``path, ordinal, pattern, matched, reason, warnings``.
    """
    told = F.when(F.col("matched"), F.coalesce("warnings", F.array().cast("array<string>"))).otherwise(F.array("reason"))
    return results.select("path", "ordinal", F.explode(F.transform(told, lambda t: F.concat(F.col("pattern"), F.lit(": "), t))).alias("note"))


def combined_inserts(edits: DataFrame) -> DataFrame:
    """``path, start, stop, replacement``: insertions at one place become one, in the order they came in; other edits stay.

    ``edits`` has an ``ordinal`` besides.
    """
    inserts = (F.col("start") == F.col("stop")) & (F.col("replacement") != "")
    joined = edits.where(inserts).groupBy("path", "start", "stop").agg(in_order(F.col("ordinal"), F.col("replacement"), "").alias("replacement"))
    return edits.where(~inserts).select("path", "start", "stop", "replacement").union(joined.select("path", "start", "stop", "replacement"))


def nesting_conflicts(items: DataFrame) -> DataFrame:
    """``path, item`` of which a deleted range strictly holds another item's protected place.

    ``items``: ``path, item, ranges`` (``start``, ``stop``), ``places``; rows without path or item are left out.
    Ranges' ends and places are swept in order. A range holds as many places as have passed at
    its stop less those at its start; if that is more than of its own item, one is another's. No
    range meets a place, so the work is that of sorting a file's rows.
    """
    known = items.where("path IS NOT NULL AND item IS NOT NULL")
    ranges = known.select("path", "item", F.explode("ranges").alias("r")).where("r.start < r.stop")
    passed = lambda at, order, sign: F.struct(at.cast("long").alias("at"), F.lit(order).alias("order"), F.lit(sign).alias("sign"))
    # at one place a range that stops comes first and one that starts last, so that neither holds it
    ends = ranges.select("path", "item", "r.start", "r.stop", F.explode(F.array(passed(F.col("r.stop"), 0, 1), passed(F.col("r.start"), 2, -1))).alias("e"))
    none = F.lit(None).cast("long")
    places = known.select("path", "item", none.alias("start"), none.alias("stop"), F.explode("places").alias("p")).where("p IS NOT NULL")
    rows = ends.union(places.select("path", "item", "start", "stop", passed(F.col("p"), 1, 0)))
    is_place = (F.col("e.sign") == 0).cast("long")
    so_far = lambda *keys: F.sum(is_place).over(W.partitionBy(*keys).orderBy("e.at", "e.order").rowsBetween(W.unboundedPreceding, 0))
    others = rows.withColumn("others", (so_far("path") - so_far("path", "item")) * F.col("e.sign")).where("e.sign <> 0")
    return others.groupBy("path", "item", "start", "stop").agg(F.sum("others").alias("others")).where("others > 0").select("path", "item").distinct()


def two_phase_claims(claims: DataFrame) -> DataFrame:
    """``path, ordinal, survives, kept``: names count as taken only if the whole registration survives.

    ``claims``: ``path, ordinal, variable, fails, names``. In order, a registration is left with
    the names that no one before it (nor itself) has taken; it survives if it does not fail, has
    a name left and its variable is free. A fold over each file's list.
    """
    rows = claims.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "variable", "fails", "names"))).alias("rows"))
    none = F.array().cast("array<string>")
    result = "array<struct<ordinal:bigint,survives:boolean,kept:array<string>>>"

    def step(acc: Column, r: Column) -> Column:
        kept = F.array_except(r["names"], acc["used"])
        survives = ~r["fails"] & (F.size(kept) > 0) & ~F.array_contains(acc["used"], r["variable"])
        used = F.when(survives, F.array_union(acc["used"], F.array_append(kept, r["variable"]))).otherwise(acc["used"])
        out = F.struct(r["ordinal"].cast("long").alias("ordinal"), survives.alias("survives"), F.when(survives, kept).otherwise(none).alias("kept"))
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(out)).alias("out"))

    folded = F.aggregate("rows", F.struct(none.alias("used"), F.array().cast(result).alias("out")), step, lambda acc: acc["out"])
    return rows.select("path", F.explode(folded).alias("r")).select("path", "r.ordinal", "r.survives", "r.kept")


def in_locale_order(rows: DataFrame, column: str, locale: str = "UNICODE") -> DataFrame:
    """``rows`` sorted by a text as people order it, case and accents last; a range-partitioned sort."""
    return rows.orderBy(F.collate(F.col(column), locale), column)


def with_place(rows: DataFrame, column: str, ties: tuple[str, ...] = (), locale: str = "UNICODE") -> DataFrame:
    """``rows`` with ``place``, their number from 0 in the locale's order of a text; equal texts in the order of ``ties``, nulls first.

    Partitions hold ranges of the order. A row's place is that within its partition and the rows
    of the partitions before, whose counts alone are summed in one task.
    """
    order = (F.collate(F.col(column), locale), F.col(column), *map(F.col, ties))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    numbered = written(ranged.withColumn("_id", F.monotonically_increasing_id()).withColumns({"_part": part, "_inside": inside}), "ranged")
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return numbered.join(F.broadcast(before), "_part").select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_before") + F.col("_inside")).alias("place"))
