"""Code that follows from facts: router tables, event buses, input classes, and call inventories.

Facts of a file are gathered by one grouped aggregation and put together as text in order. What
cannot be rewritten is reported with its reason, never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.matching import hits
from loomspark.functions.text import camel_words, pascal_case, route_component, router_path, routes_constant, single_quoted

#: Verbs with and without a body, services and members that make a function impure.
BODY_VERBS, PLAIN_VERBS = ("post", "put", "patch"), ("get", "delete", "head")
BANNED = r"\$(?:http|q|timeout|interval|animate)\b"
RANDOM = r"\bMath\s*\.\s*random\b|\bDate\s*\.\s*now\b|\bnew\s+Date\s*\(\s*\)"
IDENTIFIER = r"^[A-Za-z_$][A-Za-z0-9_$]*$"
RESERVED = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if implements import in "
    "instanceof interface let new null package private protected public return static super switch this throw true try typeof var void while with yield"
).split()

COMPONENT = r"""\.\s*component\s*\(\s*['"]([^'"]+)['"]\s*,\s*\{[^{}]*?\bbindings\s*:\s*\{([^{}]*)\}"""
BINDING = r"""([\w$]+)\s*:\s*['"]([^'"]*)['"]"""
HTTP = r"""\$http\s*\.\s*(get|delete|head|post|put|patch|jsonp)\s*\(\s*(?:'([^']*)'|"([^"]*)"|([^,)]*))"""
CALL = r"\b([A-Za-z_$][\w$]*)\s*\(\s*((?:'[^']*'|\"[^\"]*\"|\d+(?:\.\d+)?|true|false|null)(?:\s*,\s*(?:'[^']*'|\"[^\"]*\"|\d+(?:\.\d+)?|true|false|null))*)\s*\)"


def valid_identifier(name: Column) -> Column:
    return name.rlike(IDENTIFIER) & ~name.isin(RESERVED)


def in_order(order: Column, text: Column, separator: str) -> Column:
    """The texts of a group, joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


def router_tables(routes: DataFrame, modules: DataFrame) -> DataFrame:
    """``path, constant, output, skipped``: one table of routes a file, wildcard last.

    ``routes``: ``path, ordinal, path_or_state, otherwise``. Paths that give no component name are
    skipped and counted; the last ``otherwise`` wins.
    """
    name = F.first(routes_constant(F.col("name")), ignorenulls=True)
    constants = modules.groupBy("path").agg(F.min_by("name", "ordinal").alias("name")).groupBy("path").agg(name.alias("constant"))
    component = route_component(F.col("path_or_state"))
    entry = F.concat(F.lit("  { path: '"), single_quoted(router_path(F.col("path_or_state"))), F.lit("', component: "), component, F.lit(" },"))
    usable = ~F.col("otherwise") & component.isNotNull()
    target = F.max_by("path_or_state", F.when(F.col("otherwise"), F.col("ordinal")))
    made = routes.groupBy("path").agg(
        in_order(F.when(usable, F.col("ordinal")), F.when(usable, entry), "\n").alias("entries"),
        F.count_if(usable).alias("n"),
        F.count_if(~F.col("otherwise") & component.isNull()).alias("skipped"),
        target.alias("fallback"),
    )
    wildcard = F.concat(F.lit("\n  { path: '**', redirectTo: '"), single_quoted(router_path(F.col("fallback"))), F.lit("' },"))
    text = F.concat(F.lit("export const "), F.col("constant"), F.lit(": Routes = [\n"), F.col("entries"), F.coalesce(wildcard, F.lit("")), F.lit("\n];"))
    return made.join(constants, "path", "left").withColumn("constant", F.coalesce("constant", F.lit("AppRoutes"))).where("n > 0").select("path", "constant", text.alias("output"), "skipped")


def event_buses(pairs: DataFrame) -> DataFrame:
    """``path, output``: one service a file with a subject for each paired event, in order of first use.

    ``pairs``: ``path, event, first_at``. Events whose names collide as identifiers, or give none,
    make the file skipped, with the reason.
    """
    named = pairs.withColumn("member", camel_words(F.col("event")))
    field = F.concat(F.lit("  readonly "), F.col("member"), F.lit("$ = new Subject<any>();"))
    made = named.groupBy("path").agg(
        in_order(F.col("first_at"), field, "\n").alias("fields"),
        (F.count("*") > F.countDistinct("member")).alias("collides"),
        F.bool_or(~valid_identifier(F.col("member"))).alias("bad"),
    )
    reason = F.when(F.col("bad"), "an event gives no identifier").when(F.col("collides"), "two events give one identifier")
    text = F.concat(F.lit("@Injectable({ providedIn: 'root' })\nexport class EventBusService {\n"), F.col("fields"), F.lit("\n}"))
    return made.select("path", reason.isNull().alias("matched"), F.when(reason.isNull(), text).alias("output"), reason.alias("reason"))


def input_classes(corpus: DataFrame) -> DataFrame:
    """``path, name, matched, output, reason``: a class with inputs for each component with one-way bindings alone.

    Of a name in several places of a file, the first that can be rewritten claims it.
    """
    found = corpus.select("path", F.posexplode(hits(F.col("content"), COMPONENT, name=1, bindings=2)).alias("ordinal", "h"))
    rows = found.select("path", "ordinal", F.col("h.name").alias("name"), hits(F.col("h.bindings"), BINDING, key=1, mode=2).alias("b"))
    one_way = F.forall("b", lambda x: x["mode"].rlike(r"^<\??[\w$]*$"))
    keys_fit = F.forall("b", lambda x: valid_identifier(x["key"]))
    distinct = F.size(F.array_distinct(F.transform("b", lambda x: x["key"]))) == F.size("b")
    fault = F.when(F.size("b") == 0, "no bindings").when(~one_way, "a binding is not one-way").when(~keys_fit, "a key is no identifier").when(~distinct, "a key is there twice")
    rows = rows.withColumn("fault", fault)
    claim = F.row_number().over(Window.partitionBy("path", "name", F.col("fault").isNull()).orderBy("ordinal"))
    reason = F.coalesce("fault", F.when(claim > 1, "duplicate name"))
    alias = lambda x: F.regexp_extract(x["mode"], r"^<\??([\w$]*)$", 1)
    argument = lambda x: F.when(alias(x) == "", "").otherwise(F.concat(F.lit("'"), alias(x), F.lit("'")))
    fields = F.array_join(F.transform("b", lambda x: F.concat(F.lit("  @Input("), argument(x), F.lit(") "), x["key"], F.lit(": any;"))), "\n")
    text = F.concat(F.lit("export class "), pascal_case(F.col("name")), F.lit("Component {\n"), fields, F.lit("\n}"))
    return rows.withColumn("reason", reason).select("path", "name", F.col("reason").isNull().alias("matched"), F.when(F.col("reason").isNull(), text).alias("output"), "reason")


def http_calls(corpus: DataFrame) -> DataFrame:
    """``path, line, verb, url, has_body, reason``: calls of the HTTP service; a url that is no literal is a reason to skip."""
    rows = corpus.select("path", F.explode(hits(F.col("content"), HTTP, "", verb=1, single=2, double=3, raw=4)).alias("h"))
    text = lambda c: F.coalesce(F.col(f"h.{c}"), F.lit(""))
    url = F.nullif(F.concat(text("single"), text("double")), F.lit(""))
    reason = F.when(F.col("h.verb") == "jsonp", "jsonp").when(url.isNull(), "the url is not a literal")
    return rows.select("path", F.col("h.line").alias("line"), F.col("h.verb").alias("verb"), url.alias("url"), F.col("h.verb").isin(list(BODY_VERBS)).alias("has_body"), reason.alias("reason"))


def literal_calls(corpus: DataFrame) -> DataFrame:
    """``path, ordinal, callee, arguments``: calls of which every argument is a literal."""
    rows = corpus.select("path", F.posexplode(hits(F.col("content"), CALL, callee=1, arguments=2)).alias("ordinal", "h"))
    return rows.select("path", "ordinal", F.col("h.callee").alias("callee"), F.regexp_replace("h.arguments", r"\s*,\s*", ",").alias("arguments"))


def ineligible_reason(source: Column) -> Column:
    """Why a function cannot be characterised by running it; null if nothing speaks against it."""
    return (
        F.when(~source.rlike(r"\bfunction\b|=>"), "not a function")
        .when(source.rlike(r"\basync\b|\bfunction\s*\*|\byield\b"), "async or generator")
        .when(source.rlike(r"\bthis\b|\.\s*constructor\b"), "uses this or constructor")
        .when(source.rlike(RANDOM), "not deterministic")
        .when(source.rlike(BANNED), "uses a service")
        .when(~source.rlike(r"\breturn\b|=>\s*[^{\s]"), "returns nothing")
    )
