"""Elements of templates: how they nest, what is wrong with them, and control-flow attributes turned into blocks.

A template is cut into tags, comments, raw elements and text by one expression that tiles it;
elements nest like brackets (``nesting.nested``), so depth, parent and end tag come from windows
over the file's own rows. What stands between ``{{`` and ``}}`` is no tag.

Names are compared without capitals. An end tag closes the innermost open element; if their names
differ, both are told as errors and the file is not rewritten. Elements that never close are told
too; nothing is closed by guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.matching import hits
from loomspark.operators.nesting import nested
from loomspark.operators.templates import DUPLICATE, masked_interpolations
from loomspark.operators.tokens import files_of, token_parts
from loomspark.sources.shared import written

#: Elements without an end tag, and those whose content is no markup.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
RAW = ("script", "style", "textarea", "title")
QUOTES = r"""(?:"[^"]*"|'[^']*')"""
OPEN = rf"<[A-Za-z][^\s/>\"']*[^>\"']*(?:{QUOTES}[^>\"']*)*+>"
PIECE = "|".join([r"<!--[\s\S]*?-->", r"<!--[\s\S]*", *[rf"(?i:<{n}\b[^>]*>[\s\S]*?</{n}\s*>)" for n in RAW], r"<![^>]*>", OPEN, r"</[A-Za-z][^>]*>", r"[^<]+", "<"])
ATTRIBUTE = rf"""([^\s"'<>/=]+)(?:\s*=\s*({QUOTES}|[^\s"'=<>`]+))?"""
#: Why a repeat is left as it is.
PIPE = "contains a filter/orderBy pipe — no Angular equivalent, not safely transformable"
GRAMMAR = 'does not match the "item in collection [track by expr]" grammar — not safely transformable'
ALIAS = 'uses an "as" alias clause — no Angular equivalent built, zero real fixture evidence'
PAIRS = "(key, value) destructuring form is not supported — zero real fixture evidence"
NO_VALUE = "no value — not safely transformable"
REPEAT = r"^\s*([\s\S]+?)\s+in\s+([\s\S]+?)(?:\s+as\s+([\s\S]+?))?(?:\s+track\s+by\s+([\s\S]+?))?\s*$"
DIRECTIVES = ("ng-repeat", "ng-if", "ng-show")


def pieces(corpus: DataFrame) -> DataFrame:
    """``file, path, place, start, line, kind, tag, text`` of every piece but text: open, close, void, comment, raw, or broken (a ``<`` that begins no whole tag)."""
    files = files_of(corpus, token_parts(corpus))
    shape = F.regexp_extract_all(masked_interpolations(F.col("content")), F.lit(PIECE), F.lit(0))
    rows = files.select("file", "path", "content", F.posexplode(shape).alias("place", "masked"))
    at = W.partitionBy("file").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    length = F.length("masked")
    breaks = length - F.length(F.replace(F.col("masked"), F.lit("\n"), F.lit("")))
    tag = F.lower(F.regexp_extract("masked", r"^</?([A-Za-z][^\s/>]*)", 1))
    placed = rows.withColumns({"start": (F.sum(length).over(at) - length).cast("int"), "line": (F.sum(breaks).over(at) - breaks + 1).cast("int"), "tag": tag})
    kind = (
        F.when(F.col("masked").startswith("<!"), "comment").when(F.col("masked").startswith("</"), "close").when(F.col("masked") == "<", "broken").when(~F.col("masked").startswith("<"), "text")
        .when(F.col("tag").isin(*RAW) & F.col("masked").rlike(r"</[^<]*>$"), "raw").when(F.col("tag").isin(*VOID), "void").otherwise("open")
    )
    told = placed.withColumn("kind", kind)
    # a sign like "a < b" is text; one before a letter was to be a tag
    broken = (F.col("kind") != "broken") | F.lead("masked").over(W.partitionBy("file").orderBy("place")).rlike(r"^[A-Za-z]")
    return told.withColumn("_kept", broken).where("kind <> 'text' AND _kept").select("file", "path", "place", "start", "line", "kind", "tag", F.substring(F.col("content"), F.col("start") + 1, length).alias("text"))


def attributes_of(tag: Column) -> Column:
    """The attributes of an open tag's text: ``start`` and ``whole`` within it, ``name``, ``value`` (with its quotes)."""
    head = F.length(F.regexp_extract(tag, r"^<[A-Za-z][^\s/>]*", 0))
    found = hits(F.substring(tag, head + 1, F.length(tag)), ATTRIBUTE, all=0, name=1, value=2)
    return F.transform(found, lambda a: F.struct((a["start"] + head).alias("start"), a["all"].alias("whole"), F.lower(a["name"]).alias("name"), a["value"].alias("value")))


def elements(corpus: DataFrame) -> DataFrame:
    """``file, path, place, tag, kind, start, stop, line, depth, parent, end_start, end_stop, fault, text``.

    ``start``, ``stop``: offsets of the start tag; ``end_start``, ``end_stop``: of the end tag (of a void or raw element
    both are ``stop``; null if there is none). ``fault``: ``unclosed-element``, ``end-tag-mismatch``, ``stray-end-tag``, ``unfinished-tag`` or null.
    """
    rows = nested(pieces(corpus).where("kind <> 'comment'"), ["file"], "place", F.col("kind") == "open", F.col("kind") == "close")
    ends = rows.where("kind = 'close' AND partner IS NOT NULL").select("file", F.col("partner").alias("place"), F.col("tag").alias("_tag"), F.col("start").alias("_start"), (F.col("start") + F.length("text")).alias("_stop"))
    joined = rows.where("kind <> 'close' OR partner IS NULL").join(ends, ["file", "place"], "left")
    stop = F.col("start") + F.length("text")
    alone = F.col("kind").isin("void", "raw")
    fault = (
        F.when(F.col("kind") == "broken", "unfinished-tag").when(F.col("kind") == "close", "stray-end-tag").when((F.col("kind") == "open") & F.col("_tag").isNull(), "unclosed-element")
        .when(F.col("_tag") != F.col("tag"), "end-tag-mismatch")
    )
    return joined.select(
        "file", "path", "place", "tag", "kind", "start", stop.alias("stop"), "line", "depth", "parent",
        F.when(alone, stop).otherwise(F.col("_start")).alias("end_start"), F.when(alone, stop).otherwise(F.col("_stop")).alias("end_stop"), fault.alias("fault"), "text",
    )


def faults(corpus: DataFrame) -> DataFrame:
    """``path, start, line, code``: what is wrong with a template, attributes given twice too."""
    return faults_of(elements(corpus))


def faults_of(found: DataFrame) -> DataFrame:
    """``faults``, from ``elements``; their ``attributes`` are cut anew if they are no column."""
    attributes = F.col("attributes") if "attributes" in found.columns else attributes_of(F.col("text"))
    names = F.transform(attributes, lambda a: a["name"])
    twice = F.when(F.col("kind").isin("open", "void") & (F.size(F.array_distinct(names)) < F.size(names)), "duplicate-attribute")
    codes = F.array_compact(F.array("fault", twice))
    return found.select("path", "start", "line", F.explode(codes).alias("code"))


def unbound(expression: Column) -> Column:
    """An expression without one-time marks; those in strings stay."""
    cut = F.regexp_extract_all(expression, F.lit(rf"{QUOTES}|::|[^\"':]+|[\s\S]"), F.lit(0))
    return F.array_join(F.filter(cut, lambda t: t != "::"), "")


def value_of(attributes: Column, name: str) -> Column:
    """An attribute's value without quotes; empty if it has none, null if it is not there."""
    own = F.get(F.filter(attributes, lambda a: a["name"] == name), F.lit(0))
    value = F.coalesce(own["value"], F.lit(""))
    plain = F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return F.when(own.isNotNull(), F.when(F.trim(plain) == "", "").otherwise(plain))


def repeat_fault(value: Column) -> Column:
    part = lambda k: F.trim(F.regexp_extract(value, REPEAT, k))
    return (
        F.when(value == "", NO_VALUE).when(F.contains(value, F.lit("|")), PIPE).when(~value.rlike(REPEAT), GRAMMAR).when(part(3) != "", ALIAS).when(part(1).rlike(r"^\(.*,.*\)$"), PAIRS)
        .when(~part(1).rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"), F.concat(F.lit('loop variable "'), part(1), F.lit('" is not a simple identifier — not safely transformable')))
    )


def without(tag: Column, gone: Column) -> Column:
    """A start tag without the attributes ``gone``, each with the blanks behind it, or else those before it."""

    def step(acc: Column, a: Column) -> Column:
        behind = F.substring(acc, a["start"] + F.length(a["whole"]) + 1, F.length(acc))
        rest = F.regexp_replace(behind, r"^\s+", "")
        before = F.left(acc, a["start"])
        return F.when(F.length(rest) < F.length(behind), F.concat(before, rest)).otherwise(F.concat(F.regexp_replace(before, r"\s+$", ""), behind))

    return F.aggregate(F.reverse(gone), tag, step)


def planned(corpus: DataFrame) -> DataFrame:
    """Elements with control-flow attributes: their ``headers``, their rewritten start tag ``opened``, and ``told`` reasons."""
    return planned_of(with_attributes(corpus))


def with_attributes(corpus: DataFrame) -> DataFrame:
    """``elements`` and their ``attributes``, stored: Spark puts an expression's text wherever its column is named, and so would cut each tag some twenty times."""
    return written(elements(corpus).withColumn("attributes", attributes_of(F.col("text"))), "elements")


def planned_of(rows: DataFrame) -> DataFrame:
    """``planned``, from ``with_attributes``."""
    found = rows.where(F.col("kind").isin("open", "void") & F.col("fault").isNull())
    values = {d: value_of(F.col("attributes"), d) for d in DIRECTIVES}
    rows = found.withColumns({"_repeat": values["ng-repeat"], "_if": values["ng-if"], "_show": values["ng-show"]}).where("_repeat IS NOT NULL OR _if IS NOT NULL OR _show IS NOT NULL")
    rows = rows.withColumn("_why", repeat_fault(F.col("_repeat")))
    part = lambda k: F.trim(F.regexp_extract("_repeat", REPEAT, k))
    track = F.when(part(4) == "", part(1)).otherwise(unbound(part(4)))
    repeat = F.when(F.col("_repeat").isNotNull() & F.col("_why").isNull(), F.concat(F.lit("@for ("), part(1), F.lit(" of "), unbound(part(2)), F.lit("; track "), track, F.lit(") {")))
    condition = F.when(F.col("_if") != "", F.concat(F.lit("@if ("), unbound(F.trim("_if")), F.lit(") {")))
    hidden = F.when(F.col("_show") != "", F.concat(F.lit('[hidden]="!('), unbound(F.trim("_show")), F.lit(')"')))
    goes = lambda a: ((a["name"] == "ng-repeat") & repeat.isNotNull()) | ((a["name"] == "ng-if") & condition.isNotNull())
    show = F.get(F.filter("attributes", lambda a: a["name"] == "ng-show"), F.lit(0))
    # the one that is replaced is marked first, so that removals before and behind it cannot move it
    marked = F.when(hidden.isNotNull(), F.concat(F.left(F.col("text"), show["start"]), F.repeat(F.lit("\x00"), F.length(show["whole"])), F.substring(F.col("text"), show["start"] + F.length(show["whole"]) + 1, F.length("text")))).otherwise(F.col("text"))
    cut = without(marked, F.filter("attributes", goes))
    at = F.instr(cut, F.lit("\x00"))
    opened = F.when(hidden.isNotNull(), F.concat(F.left(cut, at - 1), hidden, F.substring(cut, at + F.length(show["whole"]), F.length(cut)))).otherwise(cut)
    reason = lambda name, why: F.when(why.isNotNull(), F.concat(F.lit(name), why))
    empty = lambda d, c: F.when(F.col(c) == "", F.lit(f"{d}: {NO_VALUE}"))
    told = F.array(empty("ng-repeat", "_repeat"), F.when(F.col("_repeat") != "", F.concat(F.lit('ng-repeat="'), F.col("_repeat"), F.lit('": '), F.col("_why"))), empty("ng-if", "_if"), empty("ng-show", "_show"))
    return rows.withColumns({"headers": F.array_compact(F.array(repeat, condition)), "opened": opened, "told": F.array_compact(told), "changed": repeat.isNotNull() | condition.isNotNull() | hidden.isNotNull()})


def control_flow(corpus: DataFrame) -> DataFrame:
    """``path, matched, output, reason`` of every template: repeats and conditions as blocks around their elements, whatever they hold.

    A file with an attribute twice in one element is left as it is, and so is one whose elements do not nest.
    ``reason``: why nothing was done; reasons of single attributes are in ``planned``.
    """
    found = with_attributes(corpus)
    plans = planned_of(found)
    blocks = F.size("headers")
    before = F.array_join(F.transform("headers", lambda h: F.concat(h, F.lit("\n"))), "")
    edits = plans.where("changed").select(
        "file",
        F.explode(F.array(F.struct("start", "stop", F.concat(before, F.col("opened")).alias("replacement")), F.struct(F.col("end_stop").alias("start"), F.col("end_stop").alias("stop"), F.repeat(F.lit("\n}"), blocks).alias("replacement")))).alias("e"),
    )
    # a void element's end is its start tag's: what is put there comes behind the tag
    order = F.struct(F.col("e.start").alias("start"), F.col("e.stop").alias("stop"), F.col("e.replacement").alias("replacement"))
    lists = edits.groupBy("file").agg(F.array_sort(F.collect_list(order)).alias("edits"))
    wrong = faults_of(found).groupBy("path").agg(F.bool_or(F.col("code") == "duplicate-attribute").alias("twice"), F.bool_or(F.col("code").isin("unclosed-element", "end-tag-mismatch", "stray-end-tag")).alias("open"))
    files = files_of(corpus).join(lists, "file", "left").join(wrong, "path", "left")
    stops = F.concat(F.array(F.lit(0)), F.transform("edits", lambda e: e["stop"]))
    parts = F.transform("edits", lambda e, i: F.concat(F.substring(F.col("content"), F.get(stops, i) + 1, e["start"] - F.get(stops, i)), e["replacement"]))
    output = F.concat(F.array_join(parts, ""), F.substring(F.col("content"), F.element_at(stops, -1) + 1, F.length("content")))
    reason = F.when(F.coalesce("twice", F.lit(False)), DUPLICATE).when(F.coalesce("open", F.lit(False)), "elements do not nest — which end tag closes which is not safely told").when(F.col("edits").isNull(), "no control-flow attribute that can be rewritten")
    return files.select("path", reason.isNull().alias("matched"), F.when(reason.isNull(), output).alias("output"), reason.alias("reason"))
