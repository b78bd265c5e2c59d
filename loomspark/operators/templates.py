"""Markup: attributes with their offsets, tag counts, and control-flow rewrites of simple shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.matching import hits

TAG = r"<([a-zA-Z][a-zA-Z0-9-]*)((?:\s+[^<>]*)?)/?>"
ATTRIBUTE = r"""\s([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*"([^"]*)\""""
CONDITION = r'<([a-z][a-z0-9-]*)([^<>]*?)\s+(?:data-)?ng-if="\s*([^"<>|]+?)\s*"([^<>]*)>([^<>]*)</\1>'
REPEAT = r'<([a-z][a-z0-9-]*)([^<>]*?)\s+(?:data-)?ng-repeat="\s*([A-Za-z_$][\w$]*)\s+in\s+([^"<>|\s]+)(?:\s+track by\s+([^"<>|]+?))?\s*"([^<>]*)>([^<>]*)</\1>'
SHOW = r'\s(?:data-)?ng-show="\s*([^"|]+?)\s*"'


def tag_counts(pages: DataFrame, text: str = "html") -> DataFrame:
    """``tag, n`` over all pages; only names are exploded, and counts combine before the shuffle."""
    names = F.transform(F.regexp_extract_all(F.col(text), F.lit(TAG), F.lit(1)), F.lower)
    return pages.select(F.explode(names).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def attributes(pages: DataFrame, key: str, text: str = "html") -> DataFrame:
    """``<key>, name, value, line``: every double-quoted attribute; a blank value is null."""
    rows = pages.select(key, F.explode(hits(F.col(text), ATTRIBUTE, "", name=1, value=2)).alias("h"))
    return rows.select(key, F.lower("h.name").alias("name"), F.nullif(F.trim(F.col("h.value")), F.lit("")).alias("value"), F.col("h.line").alias("line"))


#: Fixed value: why a file with an attribute twice in an element is left as it is.
DUPLICATE = "input HTML has a duplicate attribute somewhere in the file — ambiguous which occurrence is real, not safely transformable"
NAMED = r"""\s([^\s"'<>/=]+)(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""
OPENED = r"""<[a-zA-Z][^\s/>]*((?:[^>"']|"[^"]*"|'[^']*')*)>"""


def masked_interpolations(template: Column) -> Column:
    """``<`` and ``>`` between ``{{`` and ``}}`` as blanks, so that comparisons are not taken for tags; same length."""

    def part(text: Column, k: Column) -> Column:
        close = F.instr(text, F.lit("}}"))
        inside = F.when(close > 0, F.left(text, close - 1)).otherwise(text)
        rest = F.when(close > 0, F.substr(text, close)).otherwise("")
        return F.when(k == 0, text).otherwise(F.concat(F.translate(inside, "<>", "  "), rest))

    return F.array_join(F.transform(F.split(template, r"\{\{"), part), "{{")


def has_duplicate_attribute(template: Column) -> Column:
    """Whether an element names an attribute twice, capitals or not; the first one would win unseen."""
    tags = F.regexp_extract_all(masked_interpolations(template), F.lit(OPENED), F.lit(1))
    names = F.transform(tags, lambda t: F.transform(F.regexp_extract_all(F.concat(F.lit(" "), t), F.lit(NAMED), F.lit(1)), F.lower))
    return F.exists(names, lambda n: F.size(n) > F.size(F.array_distinct(n)))


def rewritten(template: Column) -> Column:
    """Conditions and repeats on elements that hold text alone become blocks, ``ng-show`` becomes ``hidden``.

    Piped expressions, aliases and elements with children are left as they are.
    """
    repeated = F.regexp_replace(template, REPEAT, "@for ($3 of $4; track $5) {<$1$2$6>$7</$1>}")
    tracked = F.regexp_replace(repeated, r"; track \) \{", "; track $index) {".replace("$", r"\$"))
    conditional = F.regexp_replace(tracked, CONDITION, "@if ($3) {<$1$2$4>$5</$1>}")
    return F.regexp_replace(conditional, SHOW, ' [hidden]="!($1)"')


def rewrite_templates(corpus: DataFrame) -> DataFrame:
    """``path, matched, output, reason`` of every template."""
    output, twice = rewritten(F.col("content")), has_duplicate_attribute(F.col("content"))
    matched = (output != F.col("content")) & ~twice
    return corpus.select(
        "path",
        matched.alias("matched"),
        F.when(matched, output).alias("output"),
        F.when(twice, DUPLICATE).when(~matched, "no element with a simple control-flow attribute").alias("reason"),
    )


QUOTED = r"""(?:'[^'\\]*(?:\\[\s\S][^'\\]*)*+'|"[^"\\]*(?:\\[\s\S][^"\\]*)*+")"""


def balanced(depth: int) -> str:
    """What stands between two parentheses, others ``depth`` deep in it; those in quotes do not count."""
    return rf"(?:[^()'\"]|{QUOTED}" + (rf"|\({balanced(depth - 1)}\)" if depth else "") + ")*+"


#: Headers of blocks, with up to eight parentheses around a place; one that does not end is no header.
HEADER = rf"@(?:for|if) \({balanced(8)}\)"


def masked_headers(template: Column) -> Column:
    """``<`` and ``>`` within the headers of blocks as blanks, so that comparisons are not taken for tags; same length."""
    inside = F.transform(F.regexp_extract_all(template, F.lit(HEADER), F.lit(0)), lambda h: F.translate(h, "<>", "  "))
    parts = F.arrays_zip(F.split(template, HEADER, -1).alias("gap"), inside.alias("header"))
    return F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(p["header"], F.lit("")))), "")
