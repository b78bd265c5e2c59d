"""Method calls, their chains and arguments, and the facts that follow from them, from the token table.

Tokens beside each other within one bracket are siblings. A chain ``a.b(x).c(y)`` is a run of
siblings each of which goes on with the one before, so its root and its links come from one
running maximum and one running count, however long it is. Names in comments and strings are
no tokens of their own and so no calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators.facts import ARITY, KINDS, WATCH_TEXT, WATCHES
from loomspark.operators.tokens import bracketed_tokens, files_of, literal, token_parts
from loomspark.sources.shared import dealt, never_sent

#: Words that no call or index goes on from.
KEYWORDS = (
    "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "export", "extends", "finally", "for", "function", "if", "import", "in", "instanceof", "let",
    "new", "return", "switch", "throw", "try", "typeof", "var", "void", "while", "with", "yield",
)
INSIDE = "array<struct<place:int,text:string,kind:string,partner:int,start:int>>"


def siblings(*more: str) -> W:
    return W.partitionBy("file", "parent", *more).orderBy("place")


def chained(rows: DataFrame) -> DataFrame:
    """Tokens of ``bracketed`` with ``chain``, the place where their chain of members and calls begins, and the sibling before (``was``)."""
    was = lambda c: F.lag(c).over(siblings())
    beside = rows.withColumns({"was": was("text"), "was_kind": was("kind")})
    ends = F.col("was_kind").isin("string", "template", "pattern", "number") | F.col("was").isin(")", "]") | ((F.col("was_kind") == "name") & (~F.col("was").isin(*KEYWORDS) | (F.lag("text", 2).over(siblings()) == ".")))
    going_on = F.coalesce(
        F.when(F.col("text") == ".", ends).when(F.col("kind") == "name", F.col("was") == ".").when(F.col("text").isin("(", "["), ends).when(F.col("text").isin(")", "]"), F.lit(True)), F.lit(False)
    )
    marked = beside.withColumn("_on", going_on)
    start = F.max(F.when(~F.col("_on"), F.col("place"))).over(siblings().rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("chain", start)


def method_calls(rows: DataFrame) -> DataFrame:
    """Every ``receiver.method(...)`` of tokens of ``bracketed``.

    ``file, path, at`` (place of the method's name), ``line`` (its line), ``method``, ``open``, ``close``, ``root`` and
    ``root_line`` (the chain's first token), ``link`` (the how-manieth call of its chain it is), ``links`` (how many
    the chain has), ``plain`` (whether the chain up to here is a name and calls of members alone), and
    ``receiver_start``, ``receiver_stop`` (offsets of the receiver's text), ``close_start`` (that of the closing bracket).
    """
    back = lambda c, n: F.lag(c, n).over(siblings())
    seen = chained(rows).withColumns({"name": back("text", 1), "at": back("place", 1), "name_line": back("line", 1), "dot": back("text", 2), "dot_start": back("start", 2), "next_start": F.lead("start").over(siblings())})
    chain = W.partitionBy("file", "chain").orderBy("place")
    so_far = chain.rowsBetween(W.unboundedPreceding, 0)
    call, first = (F.col("text") == "(") & F.col("_on"), F.col("place") == F.col("chain")
    told = seen.withColumns(
        {
            "link": F.sum(call.cast("int")).over(so_far), "links": F.sum(call.cast("int")).over(W.partitionBy("file", "chain")),
            "dots": F.sum((F.col("text") == ".").cast("int")).over(so_far), "indexed": F.sum((F.col("text") == "[").cast("int")).over(so_far),
            "root": F.max(F.when(first, F.col("text"))).over(W.partitionBy("file", "chain")), "root_kind": F.max(F.when(first, F.col("kind"))).over(W.partitionBy("file", "chain")),
            "root_line": F.max(F.when(first, F.col("line"))).over(W.partitionBy("file", "chain")), "receiver_start": F.max(F.when(first, F.col("start"))).over(W.partitionBy("file", "chain")),
        }
    )
    plain = (F.col("root_kind") == "name") & (F.col("dots") == F.col("link")) & (F.col("indexed") == 0)
    return told.where(call & (F.col("dot") == ".") & (F.col("was_kind") == "name")).select(
        "file", "path", "at", F.col("name_line").alias("line"), F.col("name").alias("method"), F.col("place").alias("open"), F.col("partner").alias("close"),
        "chain", "root", "root_line", "link", "links", plain.alias("plain"), "receiver_start", F.col("dot_start").alias("receiver_stop"),
        F.when(F.col("partner").isNotNull(), F.col("next_start")).alias("close_start"),
    )


def brackets(rows: DataFrame) -> DataFrame:
    """``file, open, inside``: each bracket's own tokens in order (a bracket within it by its two ends)."""
    token = F.struct("place", "text", "kind", "partner", "start")
    return rows.where("parent IS NOT NULL").groupBy("file", F.col("parent").alias("open")).agg(F.array_sort(F.collect_list(token)).cast(INSIDE).alias("inside"))


def string_elements(inside: Column) -> Column:
    """The elements of a list that are strings alone."""
    alone = lambda t, i: (t["kind"] == "string") & (F.coalesce(F.get(inside, i - 1)["text"], F.lit(",")) == ",") & (F.coalesce(F.get(inside, i + 1)["text"], F.lit(",")) == ",")
    return F.transform(F.filter(inside, alone), lambda t: literal(t["text"]))


def parameter_names(inside: Column) -> Column:
    """The names at the beginning of each parameter, dots of a rest before it or not."""
    begins = lambda t, i: (t["kind"] == "name") & F.coalesce(F.get(inside, i - 1)["text"], F.lit(",")).isin(",", ".")
    return F.transform(F.filter(inside, begins), lambda t: t["text"])


def definition(inside: Column, at: Column) -> Column:
    """What the value that begins at token ``at`` of ``inside`` asks for: ``list`` (the place of its list), ``parameters`` (of its parameter list), or ``single`` (its one bare parameter)."""
    t = lambda k: F.get(inside, at + k)
    text = lambda k: F.coalesce(t(k)["text"], F.lit(""))
    skip = F.when(text(0) == "async", 1).otherwise(0)
    head = F.when(F.get(inside, at + skip)["text"] == "function", F.get(F.filter(F.slice(inside, at + skip + 2, F.lit(3)), lambda x: x["text"] == "("), F.lit(0))["place"])
    arrow = F.when((F.get(inside, at + skip)["text"] == "(") & (F.get(inside, at + skip + 2)["text"] == "=>"), F.get(inside, at + skip)["place"])
    single = F.when((F.get(inside, at + skip)["kind"] == "name") & (F.get(inside, at + skip + 1)["text"] == "=>"), F.get(inside, at + skip)["text"])
    return F.struct(F.when(text(0) == "[", t(0)["place"]).alias("list"), F.coalesce(head, arrow).alias("parameters"), single.alias("single"))


def asked_for(defined: DataFrame, found: DataFrame) -> DataFrame:
    """``defined`` (with ``definition``) with its ``dependencies``; ``found``: the table of ``brackets``."""
    at = F.coalesce("definition.list", "definition.parameters")
    named = found.select(F.col("file").alias("_file"), F.col("open").alias("_at"), F.col("inside").alias("_inside"))
    joined = defined.withColumn("_place", at).join(named, (F.col("file") == F.col("_file")) & (F.col("_place") == F.col("_at")), "left")
    names = F.when(F.col("definition.list").isNotNull(), string_elements(F.col("_inside"))).when(F.col("definition.single").isNotNull(), F.array("definition.single")).otherwise(parameter_names(F.col("_inside")))
    return joined.withColumn("dependencies", F.coalesce(names, F.array().cast("array<string>"))).drop("_file", "_at", "_inside", "_place")


class Script:
    """The token table of a corpus, written once, dealt by file, and what is taken from it."""

    def __init__(self, corpus: DataFrame):
        self.corpus, self.parts = corpus, token_parts(corpus)
        self.rows = dealt(bracketed_tokens(corpus, self.parts), "tokens", "file", self.parts, lies=True)
        self.calls, self.brackets = method_calls(self.rows), brackets(self.rows)

    @classmethod
    def of(cls, corpus: DataFrame | Script) -> Script:
        return corpus if isinstance(corpus, Script) else cls(corpus)

    def with_arguments(self, calls: DataFrame) -> DataFrame:
        """Calls with ``inside``, the tokens of their arguments; empty lists have an empty array."""
        return calls.join(self.brackets, ["file", "open"], "left").withColumn("inside", F.coalesce("inside", F.array().cast(INSIDE)))

    def with_content(self, calls: DataFrame) -> DataFrame:
        return calls.join(never_sent(files_of(self.corpus, self.parts).select("file", "content")), "file")


def named_by_string(inside: Column) -> Column:
    """Whether the first argument is a string alone."""
    return F.coalesce((F.get(inside, F.lit(0))["kind"] == "string") & (F.coalesce(F.get(inside, F.lit(1))["text"], F.lit(",")) == ","), F.lit(False))


def name_of(inside: Column) -> Column:
    return literal(F.get(inside, F.lit(0))["text"])


def modules(corpus: DataFrame | Script) -> DataFrame:
    """``path, at, line, name, depends_on`` of ``angular.module(name, list)``; with one argument it is a look-up, no declaration."""
    script = Script.of(corpus)
    calls = script.with_arguments(script.calls.where("method = 'module' AND root = 'angular' AND plain AND link = 1"))
    declared = calls.where(named_by_string(F.col("inside")) & (F.size("inside") > 2))
    listed = F.struct(F.when(F.get("inside", F.lit(2))["text"] == "[", F.get("inside", F.lit(2))["place"]).alias("list"), F.lit(None).cast("int").alias("parameters"), F.lit(None).cast("string").alias("single"))
    named = asked_for(declared.withColumn("definition", listed), script.brackets)
    return named.select("path", "at", F.col("root_line").alias("line"), name_of(F.col("inside")).alias("name"), F.col("dependencies").alias("depends_on"))


def registrations(corpus: DataFrame | Script) -> DataFrame:
    """``path, at, line, kind, name, dependencies``; any receiver counts. A component's are those of its controller."""
    script = Script.of(corpus)
    calls = script.with_arguments(script.calls.where(F.col("method").isin(*KINDS))).where(named_by_string(F.col("inside")))
    config = script.brackets.select(F.col("file").alias("_f"), F.col("open").alias("_o"), F.col("inside").alias("_config"))
    second = F.get("inside", F.lit(2))
    calls = calls.withColumn("_second", F.when((F.col("method") == "component") & (second["text"] == "{"), second["place"]))
    calls = calls.join(config, (F.col("file") == F.col("_f")) & (F.col("_second") == F.col("_o")), "left")
    c = F.col("_config")
    key = F.get(F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(c) - 1)), lambda i: (F.get(c, i)["text"].isin("controller", "'controller'", '"controller"')) & (F.coalesce(F.get(c, i - 1)["text"], F.lit(",")) == ",") & F.get(c, i + 1)["text"].isin(":", "(")), F.lit(0))
    method = F.struct(F.lit(None).cast("int").alias("list"), F.get(c, key + 1)["place"].alias("parameters"), F.lit(None).cast("string").alias("single"))
    of_component = F.when(F.get(c, key + 1)["text"] == "(", method).otherwise(definition(c, key + 2))
    calls = calls.withColumn("definition", F.when(F.col("method") == "component", of_component).otherwise(definition(F.col("inside"), F.lit(2))))
    return asked_for(calls, script.brackets).select("path", "at", "line", F.col("method").alias("kind"), name_of(F.col("inside")).alias("name"), "dependencies")


def first_argument(inside: Column, close: Column) -> Column:
    """The offsets of the first argument's first token and of what ends it; ``close``: the closing bracket's."""
    comma = F.get(F.filter(inside, lambda t: t["text"] == ","), F.lit(0))["start"]
    return F.struct(F.get(inside, F.lit(0))["start"].alias("from"), F.coalesce(comma, close).alias("to"))


def with_first_text(script: Script, calls: DataFrame) -> DataFrame:
    """Calls with ``receiver`` and ``first``, the texts of what is called and of its first argument ('' if there is none)."""
    placed = script.with_arguments(calls).withColumn("_spot", first_argument(F.col("inside"), F.col("close_start")))
    text = lambda a, b: F.substring(F.col("content"), a + 1, b - a)
    found = script.with_content(placed)
    return found.withColumns({"receiver": text(F.col("receiver_start"), F.col("receiver_stop")), "first": F.coalesce(F.regexp_replace(text(F.col("_spot.from"), F.col("_spot.to")), r"\s+$", ""), F.lit(""))})


def routes(corpus: DataFrame | Script) -> DataFrame:
    """``path, at, line, provider, path_or_state``: calls whose receiver names the provider, earlier links of the chain included."""
    script = Script.of(corpus)
    found = with_first_text(script, script.calls.where("method IN ('when', 'state')"))
    provider = F.when((F.col("method") == "when") & F.contains("receiver", F.lit("$routeProvider")), "ngRoute").when((F.col("method") == "state") & F.contains("receiver", F.lit("$stateProvider")), "ui-router")
    state = F.when(named_by_string(F.col("inside")), name_of(F.col("inside"))).otherwise(F.col("first"))
    return found.select("path", "at", "line", provider.alias("provider"), state.alias("path_or_state")).where("provider IS NOT NULL")


def watches(corpus: DataFrame | Script) -> DataFrame:
    """``path, at, line, method, expression``: watchers of a scope; the expression is cut at 200 characters."""
    script = Script.of(corpus)
    found = with_first_text(script, script.calls.where(F.col("method").isin(*WATCHES))).where(F.col("receiver").rlike(r"\$scope|\$rootScope"))
    return found.select("path", "at", F.col("root_line").alias("line"), "method", F.left("first", F.lit(WATCH_TEXT)).alias("expression"))


def array_injections(corpus: DataFrame | Script) -> DataFrame:
    """``path, ordinal, line, kind, name, dependencies, parameters, reason`` of registrations by a list of names that ends in a function.

    Names are bound to parameters by place; ``reason`` says why that is not possible. A list with
    anything but strings before its function, or with none, is no such registration.
    """
    script = Script.of(corpus)
    calls = script.with_arguments(script.calls.where(F.col("method").isin(*KINDS))).where(named_by_string(F.col("inside")))
    lists = script.brackets.select(F.col("file").alias("_f"), F.col("open").alias("_o"), F.col("inside").alias("_list"))
    second = F.get("inside", F.lit(2))
    calls = calls.withColumn("_second", F.when(second["text"] == "[", second["place"])).join(lists, (F.col("file") == F.col("_f")) & (F.col("_second") == F.col("_o")))
    commas = F.filter(F.sequence(F.lit(0), F.size("_list") - 1), lambda k: (F.get("_list", k)["text"] == ",") & (k < F.size("_list") - 1))
    calls = calls.withColumns({"_names": F.size(commas), "_value": F.array_max(commas) + 1}).where("_names > 0")
    names = string_elements(F.slice("_list", F.lit(1), F.col("_value")))
    defined = calls.withColumns({"_strings": names, "definition": definition(F.col("_list"), F.col("_value"))}).where("size(_strings) = _names AND definition.list IS NULL AND (definition.parameters IS NOT NULL OR definition.single IS NOT NULL)")
    found = asked_for(defined, script.brackets)
    n, m = F.size("_strings"), F.size("dependencies")
    before, between, after = ARITY.split("{}")
    reason = F.when(n != m, F.concat(F.lit(before), n.cast("string"), F.lit(between), m.cast("string"), F.lit(after)))
    ordinal = (F.row_number().over(W.partitionBy("file").orderBy("at")) - 1).cast("int")
    return found.select("path", ordinal.alias("ordinal"), "line", F.col("method").alias("kind"), name_of(F.col("inside")).alias("name"), F.col("_strings").alias("dependencies"), F.col("dependencies").alias("parameters"), reason.alias("reason"))


#: Receivers that are taken for a scope, and methods that send an event.
SCOPES, SENDING = ("$scope", "$rootScope", "scope", "rootScope"), ("$emit", "$broadcast")


def event_usages(corpus: DataFrame | Script) -> DataFrame:
    """``path, ordinal, start, line, receiver, event, kind`` (emit or on) of event calls of a scope itself, named by a string alone."""
    script = Script.of(corpus)
    own = F.col("root").isin(*SCOPES) & (F.col("at") == F.col("chain") + 2)
    calls = script.with_arguments(script.calls.where(F.col("method").isin(*SENDING, "$on") & own)).where(named_by_string(F.col("inside")))
    ordinal = (F.row_number().over(W.partitionBy("file").orderBy("at")) - 1).cast("int")
    kind = F.when(F.col("method") == "$on", "on").otherwise("emit")
    return calls.select("path", ordinal.alias("ordinal"), F.col("receiver_start").alias("start"), F.col("root_line").alias("line"), F.col("root").alias("receiver"), name_of(F.col("inside")).alias("event"), kind.alias("kind"))


def module_edges(corpus: DataFrame | Script) -> DataFrame:
    return modules(corpus).select("path", F.col("name").alias("module"), F.explode("depends_on").alias("depends_on"))


def inventory(corpus: DataFrame) -> DataFrame:
    """``path, modules, registrations, routes, watches``: how many of each a file has, from one table of tokens."""
    script = Script.of(corpus)
    found = {"modules": modules(script), "registrations": registrations(script), "routes": routes(script), "watches": watches(script)}
    rows = script.corpus.select("path", F.lit("none").alias("_what"))
    for what, facts in found.items():
        rows = rows.union(facts.select("path", F.lit(what)))
    return rows.groupBy("path").agg(*[F.count_if(F.col("_what") == what).cast("int" if what in ("modules", "registrations") else "long").alias(what) for what in found])


#: Fixed value: the deepest chain of promise calls that is rewritten.
DEEPEST = 2


def promise_chains(corpus: DataFrame, roots: tuple[str, ...] = ("$http",)) -> DataFrame:
    """``path, at, line, verb, depth, reason`` of calls on ``roots`` that ``then`` or ``catch`` follows directly.

    ``depth``: how many of them; more than ``DEEPEST`` have a reason against a rewrite.
    """
    calls = Script.of(corpus).calls
    chain = W.partitionBy("file", "chain").orderBy("link")
    after = calls.withColumn("_breaks", F.sum((~F.col("method").isin("then", "catch") & (F.col("link") > 1)).cast("int")).over(chain)).where("_breaks = 0")
    told = after.withColumn("depth", F.max("link").over(W.partitionBy("file", "chain")) - 1)
    first = told.where(F.col("root").isin(*roots) & (F.col("link") == 1) & F.col("plain") & (F.col("depth") > 0))
    reason = F.when(F.col("depth") > DEEPEST, F.concat(F.lit("chain of "), F.col("depth").cast("string"), F.lit(f" calls, more than {DEEPEST}")))
    return first.select("path", "at", "line", F.col("method").alias("verb"), F.col("depth").cast("int").alias("depth"), reason.alias("reason"))
