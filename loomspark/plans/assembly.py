"""Queries of assembly, edits and characterisation, each with its SQL for DuckDB.

Where a corpus is built by formula, it holds what text matching can get wrong as well:
comments, other quotes, nested brackets, duplicates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import text as fx
from loomspark.operators import assemble, calls, evidence, facts, report, rewrite, templates
from loomspark.plans import oracle
from loomspark.plans.tables import FACT_CORPUS, SCOPE_CORPUS, SECRET_CORPUS, fresh_dir, read, sql, texts
from loomspark.plans.whole_run import whole_run
from loomspark.streaming import live
from loomspark.streaming.allowances import Allowance, decisions

#: Emitted declarations: some use a symbol only as part of another identifier, or twice.
EMITTED = """
SELECT concat('out/p', cast(p_partkey AS string), '.ts') AS emitted_path, concat('app/c', cast(p_partkey % 500 AS string), '.js') AS source_path, p_partkey,
       CASE p_partkey % 5
         WHEN 0 THEN concat('@Pipe({ name: "flt', cast(p_partkey % 500 AS string), '", pure: true }) export class P { my$Pipe; Injectables }')
         WHEN 1 THEN '@Component({ selector: "a", templateUrl: ''a.html'' }) export class C { @Input() x; @Input() y; http: HttpClient; s = new Subject<any>(); }'
         WHEN 2 THEN concat('@Directive({ template: "<b>", /* templateUrl */ templateUrl: make(), other: { templateUrl: "t', cast(p_partkey AS string), '.html" } }) export class D {}')
         WHEN 3 THEN 'export const AppRoutes: Routes = [];'
         ELSE 'class PlainObservables { constructor(private o: Observable<any>, i: Inject) {} }' END AS content
FROM part"""

#: Scripts with filters, array-style injection of right and wrong length, and events, some inside other objects.
INJECTED = """
SELECT concat('app/c', cast(c_custkey AS string), '.js') AS path,
       concat('m.controller("A', cast(c_custkey AS string), '", [''$scope'', "svc", function ($scope', CASE c_custkey % 3 WHEN 0 THEN '' ELSE ', svc' END, ') {', chr(10),
              CASE c_custkey % 4 WHEN 0 THEN '  $scope.$emit(''a:b'', { x: [1] });' WHEN 1 THEN '  bus.$scope.$emit(''a:b'');' ELSE '  rootScope . $broadcast("c", 1);' END, chr(10),
              CASE c_custkey % 5 WHEN 0 THEN '  $rootScope.$on("a:b", f);' WHEN 1 THEN '  $scope.$on(name, f);' ELSE '  scope.$on(''c'', f);' END, chr(10),
              '}]);', chr(10), 'm.filter("flt', cast(c_custkey AS string), '", F);', chr(10), 'm.filter(''flt', cast(c_custkey AS string), ''', G);') AS content
FROM customer"""

#: Templates with duplicates of an attribute, comparisons in interpolations, and names that only look alike.
MARKUP = """
SELECT concat('t', cast(s_suppkey AS string), '.html') AS path,
       CASE s_suppkey % 6 WHEN 0 THEN '<p ng-if="a" ng-if="b">x</p>' WHEN 1 THEN '{{ a <b ng-if="x" ng-if="y"> }}<p ng-if="a">x</p>' WHEN 2 THEN '<p class="a" CLASS="b" ng-if="z">y</p>'
         WHEN 3 THEN concat('<p ng-if="k', cast(s_suppkey AS string), '" data-ng-if2="k">z</p>') WHEN 4 THEN '<p title="ng-if ng-if" ng-if="a">x</p>{{ b > c' ELSE '<p>none</p>' END AS content
FROM supplier"""

#: Components with controllers of every form, some behind other objects or under names that only look alike.
COMPONENTS = """
SELECT concat('k', cast(s_suppkey AS string), '.js') AS path,
       concat('m', chr(10), ' .component("x', cast(s_suppkey AS string), '", { controllerAs: "c", bindings: { controller: "<" }, ',
       CASE s_suppkey % 6 WHEN 0 THEN 'controller: function ($scope, a) { f(1); }' WHEN 1 THEN 'controller: ["$q", ''b'', function (q, c) {}]' WHEN 2 THEN 'controller($http) { g({}); }'
         WHEN 3 THEN 'controller: "NamedCtrl"' WHEN 4 THEN 'controller: (d) => 1' ELSE 'template: "t"' END, ' });') AS content
FROM supplier"""

EDITS = """
SELECT l_suppkey % 50 AS path, l_partkey % 40 AS start, CASE WHEN l_linenumber < 5 THEN l_partkey % 40 ELSE l_partkey % 40 + 2 END AS stop,
       l_orderkey * 10 + l_linenumber AS ordinal, CASE WHEN l_linenumber = 4 THEN '' ELSE concat('<', cast(l_orderkey AS string), '>') END AS replacement
FROM lineitem"""

RESULTS = """
SELECT concat('f', cast(o_custkey AS string), '.js') AS path, o_orderkey AS ordinal, concat('#', cast(o_orderkey % 10 AS string)) AS pattern, o_orderstatus <> 'F' AS matched,
       concat('no ', o_orderpriority) AS reason, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS warning
FROM orders"""

NESTED = """
SELECT l_orderkey AS path, l_linenumber AS item, l_partkey % 100 AS start, l_partkey % 100 + cast(l_quantity AS int) AS stop, l_suppkey % 150 AS place FROM lineitem"""

TARGETS = """
SELECT p_partkey AS target_id, p_size,
       CASE p_partkey % 6 WHEN 0 THEN 'function (a) { return a.trim(); }' WHEN 1 THEN 'function (a) { return Math.random(); }' WHEN 2 THEN 'function (a) { a = 1; }'
         WHEN 3 THEN 'var a = 1' ELSE 'function (a, b) { return a + b; }' END AS source
FROM part"""

CALLS = """
SELECT l_partkey AS target_id, l_orderkey * 10 + l_linenumber AS ordinal, CASE WHEN l_partkey % 5 < 3 THEN concat('[', cast(cast(l_quantity AS int) % 3 AS string), ',', cast(l_linenumber % 2 AS string), ']') ELSE '[0,0]' END AS arguments
FROM lineitem"""

#: What the two functions did on an input: entries in another order the second time, some unlike, some that cannot be compared.
OUTCOMES = """
SELECT target_id, arguments,
       CASE WHEN target_id % 7 = 0 THEN 'throw' ELSE 'return' END AS original_kind, 'json' AS original_type, concat('{"b":', cast(length(arguments) AS string), ',"a":', arguments, '}') AS original_value,
       CASE WHEN target_id % 7 = 0 THEN 'throw' ELSE 'return' END AS rerun_kind, 'json' AS rerun_type,
       CASE WHEN target_id % 7 = 0 THEN concat('{"b":', cast(length(arguments) AS string), ',"a":', arguments, '}')
            ELSE concat('{ "a": ', arguments, ', "b": ', CASE WHEN target_id % 11 = 0 AND arguments LIKE '%null%' THEN '0' ELSE cast(length(arguments) AS string) END, '.0 }') END AS rerun_value,
       CASE WHEN target_id % 19 = 0 THEN 'unrunnable' WHEN target_id % 7 = 0 THEN 'throw' ELSE 'return' END AS migrated_kind,
       CASE WHEN target_id % 17 = 0 THEN 'function' ELSE 'json' END AS migrated_type,
       CASE WHEN target_id % 19 = 0 THEN 'no module' WHEN target_id % 13 = 0 AND length(arguments) > 6 THEN '{"a":1}' ELSE concat('{"b":', cast(length(arguments) AS string), ',"a":', arguments, '}') END AS migrated_value
FROM {inputs}"""

VALUES = """
SELECT s_suppkey,
       CASE s_suppkey % 8 WHEN 0 THEN 'json' WHEN 1 THEN 'number' WHEN 2 THEN 'undefined' WHEN 3 THEN 'Date' WHEN 4 THEN 'function' WHEN 5 THEN 'bigint' WHEN 6 THEN 'Map' ELSE 'json' END AS kind,
       CASE s_suppkey % 8 WHEN 0 THEN concat('{"z":[', cast(s_suppkey AS string), '.0,{"b":null,"a":true}],"Z":"', s_name, '","é":1.5}') WHEN 1 THEN CASE WHEN s_suppkey % 16 = 1 THEN '-0' ELSE 'NaN' END WHEN 2 THEN NULL
         WHEN 3 THEN '2020-01-02T03:04:05+01:00' WHEN 4 THEN 'f' WHEN 5 THEN cast(s_suppkey AS string) WHEN 6 THEN '[["b",1],["a",2]]' ELSE '[1, 2.0, "x"]' END AS value
FROM supplier"""


def artifact_classes(spark, sf_dir):
    decorator = F.get(F.lit(["Component", "Directive", "Pipe", "Injectable", None, "Other"]), (F.col("p_partkey") % 6).cast("int"))
    kind = assemble.artifact_class(F.col("p_size") % 9 != 0, decorator, F.when(F.col("p_size") % 2 == 0, "controller").otherwise("factory"))
    return read(spark, sf_dir, "part").select("p_partkey", kind.alias("k")).select("p_partkey", "k.artifact_type", "k.suffix")


def emitted_imports(spark, sf_dir):
    rows = sql(spark, sf_dir, EMITTED)
    return rows.select("emitted_path", assemble.import_lines(F.col("content")).alias("imports"), assemble.template_url(F.col("content")).alias("template_url"))


def import_symbols(spark, sf_dir):
    return assemble.symbols_by_source(sql(spark, sf_dir, EMITTED), "emitted_path")


def emitted_paths(spark, sf_dir):
    suffix = F.get(F.lit(["pipe", "component", "service"]), (F.col("p_partkey") % 3).cast("int"))
    name = F.concat(fx.pascal_case(F.col("p_brand")), F.when(F.col("p_size") % 2 == 0, fx.pascal_case(suffix)).otherwise(F.lit("Item")))
    return read(spark, sf_dir, "part").select("p_partkey", fx.emitted_path(F.lit("src"), F.regexp_replace(name, "#", ""), suffix).alias("path"))


def filter_pipes(spark, sf_dir):
    return assemble.filters_with_pipes(calls.registrations(texts(spark, sf_dir, INJECTED)).withColumnRenamed("at", "ordinal"), sql(spark, sf_dir, EMITTED)).select("path", "name", "emitted_path")


def component_registrations(spark, sf_dir):
    found = calls.registrations(texts(spark, sf_dir, COMPONENTS))
    return found.select("path", "line", "kind", "name", F.array_join("dependencies", ",").alias("dependencies"))


def injections(spark, sf_dir):
    return calls.array_injections(texts(spark, sf_dir, INJECTED)).select("path", "name", F.size("dependencies").alias("n_names"), F.size("parameters").alias("n_parameters"), "reason")


def bound_parameters(spark, sf_dir):
    return facts.bound_parameters(calls.array_injections(texts(spark, sf_dir, INJECTED))).groupBy("dependency", "parameter").agg(F.count("*").alias("n"))


def scope_events(spark, sf_dir):
    return calls.event_usages(texts(spark, sf_dir, INJECTED)).select("path", "line", "receiver", "event", "kind")


def scope_event_buses(spark, sf_dir):
    return rewrite.event_buses(facts.paired_events(calls.event_usages(texts(spark, sf_dir, INJECTED)).select("path", "event", "kind", F.col("start").alias("ordinal"))))


def markup_checks(spark, sf_dir):
    rows = sql(spark, sf_dir, MARKUP)
    return templates.rewrite_templates(rows).withColumn("twice", F.col("reason") == templates.DUPLICATE)


def combined_inserts(spark, sf_dir):
    return assemble.combined_inserts(sql(spark, sf_dir, EDITS))


def nesting_conflicts(spark, sf_dir):
    rows = sql(spark, sf_dir, NESTED)
    items = rows.groupBy("path", "item").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"), F.collect_list("place").alias("places"))
    return assemble.nesting_conflicts(items)


def pattern_notes(spark, sf_dir):
    rows = sql(spark, sf_dir, RESULTS)
    return assemble.notes(rows.withColumn("warnings", F.when(F.col("warning").isNotNull(), F.array("warning")))).select("path", "ordinal", "note")


def name_claims(spark, sf_dir):
    rows = sql(spark, sf_dir, "SELECT l_orderkey AS path, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem")
    names = F.transform(F.array(F.col("l_partkey") % 7, F.col("l_suppkey") % 5), lambda x: x.cast("string"))
    claims = rows.select("path", F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("v"), (F.col("l_partkey") % 3).cast("string")).alias("variable"), (F.col("l_returnflag") == "R").alias("fails"), F.array_distinct(names).alias("names"))
    return assemble.two_phase_claims(claims).withColumn("kept", F.array_join("kept", ","))


def spliced_texts(spark, sf_dir):
    edit = lambda a, b, t: F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), t.alias("replacement"))
    edits = F.array(edit(0, 1, F.lit("[")), edit(3, 3, F.col("p_brand")), edit(4, 5, F.lit("")))
    return read(spark, sf_dir, "part").select("p_partkey", report.apply_edits(F.col("p_name"), edits).alias("output"))


def tier_reasons(spark, sf_dir):
    rows = sql(spark, sf_dir, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'REJECTED' END AS tier, o_custkey % 9 AS cases, o_orderpriority AS reason FROM orders")
    return rows.select("o_orderkey", assemble.tier_reason(F.col("tier"), F.col("cases"), F.col("reason")).alias("reason"))


def characterization_targets(spark, sf_dir):
    types = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("string"), F.lit(None))).when(F.col("p_size") % 3 == 1, F.array(F.lit("number"), F.lit("boolean"))).otherwise(F.array(F.lit(None).cast("string"), F.lit(None).cast("string")))
    return sql(spark, sf_dir, TARGETS).select("target_id", types.alias("types"), rewrite.ineligible_reason(F.col("source")).alias("fault"))


def call_inputs(spark, sf_dir):
    return evidence.call_inputs(characterization_targets(spark, sf_dir), sql(spark, sf_dir, CALLS))


def characterization(spark, sf_dir):
    """From sources, types and calls to a verdict; ``outcomes`` follow from the inputs by formula."""
    targets, calls = characterization_targets(spark, sf_dir), sql(spark, sf_dir, CALLS)
    text = OUTCOMES.replace("{", "{{").replace("}", "}}").replace("{{inputs}}", "{inputs}")
    outcomes = spark.sql(text, inputs=evidence.call_inputs(targets.where("fault IS NULL"), calls).select("target_id", "arguments"))
    return evidence.run_characterization(targets, calls, outcomes)


def canonical_values(spark, sf_dir):
    rows = sql(spark, sf_dir, VALUES)
    return rows.select("s_suppkey", evidence.canonical(F.col("kind"), F.col("value")).alias("c")).select("s_suppkey", "c.key", "c.reason")


#: Names that people and computers sort otherwise: accents and capitals count after all letters and digits.
WORDS = """
SELECT s_suppkey, concat(CASE s_suppkey % 7 WHEN 0 THEN 'ecole' WHEN 1 THEN 'École' WHEN 2 THEN 'école' WHEN 3 THEN 'Ecole' WHEN 4 THEN 'zebra' WHEN 5 THEN 'Äpfel' ELSE 'apfel' END, cast(s_nationkey AS string)) AS name
FROM supplier"""


def locale_order(spark, sf_dir):
    return assemble.with_place(sql(spark, sf_dir, WORDS), "name", ("s_suppkey",))


#: What has been emitted for the controllers and services of scripts, as the customers' orders have it.
EVIDENCE = """
SELECT concat('app/c', cast(o_custkey AS string), '.js') AS path, concat('C', cast(o_custkey AS string)) AS name, max(o_orderstatus) <> 'P' AS compiled, count(*) % 3 > 0 AS tests,
       CASE min(o_orderkey) % 4 WHEN 1 THEN 'ineligible' WHEN 2 THEN 'mismatch' WHEN 3 THEN 'matched' END AS characterization FROM orders GROUP BY o_custkey
UNION ALL SELECT concat('app/c', cast(o_custkey AS string), '.js'), concat('S', cast(o_custkey AS string)), true, max(o_orderkey) % 2 = 0, CAST(NULL AS string) FROM orders GROUP BY o_custkey HAVING count(*) > 8"""


def whole_run_report(spark, sf_dir):
    """From scripts, templates and evidence to a report of every file, all stages stored."""
    files = texts(spark, sf_dir, FACT_CORPUS).unionByName(sql(spark, sf_dir, SCOPE_CORPUS)).unionByName(sql(spark, sf_dir, SECRET_CORPUS))
    return whole_run(files, sql(spark, sf_dir, EVIDENCE), fresh_dir(spark, "run"))


def request_budgets(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("ts", F.col("event_type").alias("provider"))
    return live.requests_in_window(rows, 3, "1 hour")


#: Two providers: one request each half hour, two at once, twenty a day; one each hour, ten a day.
ALLOWED = (Allowance("fast", 2, 1_800_000_000, 20), Allowance("slow", 1, 3_600_000_000, 10))


def request_decisions(spark, sf_dir):
    """Which provider serves each event of each type, or when one could."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("pool"), F.col("event_id").alias("request_id"), "ts")
    return decisions(rows, ALLOWED).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "retry_at")})


def streamed_counts(spark, sf_dir):
    """The same windows as ``event_windows``, from a stream that is drained into the shared folder."""
    schema = read(spark, sf_dir, "events").schema
    out = live.replay(spark, sf_dir, schema, lambda events: live.event_counts(events, "1 hour", "1 day"), "complete", glob="events.parquet")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})


QUERIES = {
    f.__name__: f
    for f in (
        artifact_classes, emitted_imports, import_symbols, emitted_paths, filter_pipes, component_registrations, injections, bound_parameters, scope_events, scope_event_buses, markup_checks, combined_inserts,
        nesting_conflicts, pattern_notes, name_claims, spliced_texts, tier_reasons, call_inputs, characterization, canonical_values, locale_order, whole_run_report, request_budgets, request_decisions, streamed_counts,
    )
}

PATH = "'app/c' || c_custkey || '.js'"
USED = "regexp_matches(content, '(?:^|[^A-Za-z0-9_$]){}(?:[^A-Za-z0-9_$]|$)')"
SYMBOLS = " UNION ALL ".join(f"SELECT emitted_path, {k} AS place, '{s}' AS symbol, '{of}' AS source FROM e WHERE {USED.format(s)}" for k, (s, of) in enumerate(assemble.IMPORT_SOURCES.items()))
ARITY = "'dependency array has 2 names but the function declares 1 parameter(s) — ambiguous binding, not safely transformable'"

#: Inputs of the targets that can be run, with their places: seen calls first, then boundary rows.
INPUTS = f"""
t AS (SELECT target_id, CASE p_size % 3 WHEN 0 THEN ['string', NULL] WHEN 1 THEN ['number', 'boolean'] ELSE [NULL::VARCHAR, NULL] END AS types,
        CASE target_id % 6 WHEN 1 THEN 'not deterministic' WHEN 2 THEN 'returns nothing' WHEN 3 THEN 'not a function' END AS fault FROM ({TARGETS})),
calls AS ({CALLS}),
made(shape, parameter, ordinal, arguments) AS (VALUES (0, 0, 0, '["",null]'), (0, 0, 1, '["x",null]'), (0, 0, 2, '[" <b>Hello</b>, World 42! ",null]'),
  (1, 0, 0, '[0,true]'), (1, 0, 1, '[1,true]'), (1, 0, 2, '[-1,true]'), (1, 1, 0, '[1,true]'), (1, 1, 1, '[1,false]')),
every AS (
  SELECT target_id, arguments, 0 AS a, ordinal AS b, 0 AS c FROM calls SEMI JOIN t USING (target_id)
  UNION ALL SELECT target_id, arguments, 1, parameter, ordinal FROM t JOIN made ON shape = CASE types[1] WHEN 'string' THEN 0 WHEN 'number' THEN 1 END),
inputs AS (SELECT target_id, arguments, cast(row_number() OVER (PARTITION BY target_id ORDER BY a, b, c) - 1 AS INTEGER) AS ordinal
  FROM (SELECT *, row_number() OVER (PARTITION BY target_id, arguments ORDER BY a, b, c) AS n FROM every) WHERE n = 1)"""

SQL = {
    "artifact_classes": """
SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'route' WHEN d IN (0, 1) THEN 'directive' WHEN d = 2 THEN 'filter' WHEN d = 3 THEN 'service' WHEN p_size % 2 = 0 THEN 'controller' ELSE 'service' END AS artifact_type,
       CASE WHEN p_size % 9 = 0 THEN 'routes' WHEN d = 0 THEN 'component' WHEN d = 1 THEN 'directive' WHEN d = 2 THEN 'pipe' WHEN d = 3 THEN 'service' WHEN p_size % 2 = 0 THEN 'controller' ELSE 'service' END AS suffix
FROM (SELECT *, p_partkey % 6 AS d FROM part)""",
    "emitted_imports": """
SELECT emitted_path, CASE p_partkey % 5 WHEN 0 THEN 'import { Pipe } from ''@angular/core'';' || chr(10)
    WHEN 1 THEN 'import { Component, Input } from ''@angular/core'';' || chr(10) || 'import { HttpClient } from ''@angular/common/http'';' || chr(10) || 'import { Subject } from ''rxjs'';' || chr(10)
    WHEN 2 THEN 'import { Directive } from ''@angular/core'';' || chr(10) WHEN 3 THEN 'import { Routes } from ''@angular/router'';' || chr(10)
    ELSE 'import { Inject } from ''@angular/core'';' || chr(10) || 'import { Observable } from ''rxjs'';' || chr(10) END AS imports,
  CASE p_partkey % 5 WHEN 1 THEN 'a.html' WHEN 2 THEN 't' || p_partkey || '.html' END AS template_url
FROM (SELECT 'out/p' || p_partkey || '.ts' AS emitted_path, p_partkey FROM part)""",
    "import_symbols": f"WITH e AS ({EMITTED}), used AS ({SYMBOLS}) SELECT emitted_path, source, string_agg(symbol, ', ' ORDER BY place) AS symbols FROM used GROUP BY 1, 2",
    "emitted_paths": """
SELECT p_partkey, 'src/' || CASE WHEN short = '' THEN kebab ELSE short END || '.' || suffix || '.ts' AS path
FROM (SELECT *, regexp_replace(kebab, '-?' || suffix || '$', '') AS short FROM (
  SELECT p_partkey, suffix, lower(regexp_replace(replace(upper(left(p_brand, 1)) || substr(p_brand, 2) || CASE WHEN p_size % 2 = 0 THEN upper(left(suffix, 1)) || substr(suffix, 2) ELSE 'Item' END, '#', ''), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) AS kebab
  FROM (SELECT *, ['pipe', 'component', 'service'][(p_partkey % 3 + 1)::INTEGER] AS suffix FROM part)))""",
    "filter_pipes": f"SELECT {PATH} AS path, 'flt' || c_custkey AS name, 'out/p' || p_partkey || '.ts' AS emitted_path FROM customer JOIN part ON p_partkey % 500 = c_custkey AND p_partkey % 5 = 0",
    "component_registrations": """
SELECT 'k' || s_suppkey || '.js' AS path, 2 AS line, 'component' AS kind, 'x' || s_suppkey AS name,
       CASE s_suppkey % 6 WHEN 0 THEN '$scope,a' WHEN 1 THEN '$q,b' WHEN 2 THEN '$http' WHEN 4 THEN 'd' ELSE '' END AS dependencies FROM supplier""",
    "injections": f"SELECT {PATH} AS path, 'A' || c_custkey AS name, 2 AS n_names, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS n_parameters, CASE WHEN c_custkey % 3 = 0 THEN {ARITY} END AS reason FROM customer",
    "bound_parameters": "SELECT d AS dependency, d AS parameter, count(*) AS n FROM customer, (VALUES ('$scope'), ('svc')) AS v(d) WHERE c_custkey % 3 <> 0 GROUP BY d",
    "scope_events": f"""
SELECT {PATH} AS path, 2 AS line, CASE c_custkey % 4 WHEN 0 THEN '$scope' ELSE 'rootScope' END AS receiver, CASE c_custkey % 4 WHEN 0 THEN 'a:b' ELSE 'c' END AS event, 'emit' AS kind FROM customer WHERE c_custkey % 4 <> 1
UNION ALL SELECT {PATH}, 3, CASE c_custkey % 5 WHEN 0 THEN '$rootScope' ELSE 'scope' END, CASE c_custkey % 5 WHEN 0 THEN 'a:b' ELSE 'c' END, 'on' FROM customer WHERE c_custkey % 5 <> 1""",
    "scope_event_buses": f"""
SELECT {PATH} AS path, true AS matched, '@Injectable({{ providedIn: ''root'' }})' || chr(10) || 'export class EventBusService {{' || chr(10) || '  readonly ' || CASE c_custkey % 5 WHEN 0 THEN 'aB' ELSE 'c' END || '$ = new Subject<any>();' || chr(10) || '}}' AS output, NULL::VARCHAR AS reason
FROM customer WHERE (c_custkey % 4 = 0 AND c_custkey % 5 = 0) OR (c_custkey % 4 > 1 AND c_custkey % 5 > 1)""".replace("{{", "{").replace("}}", "}"),
    "markup_checks": f"""
SELECT 't' || s_suppkey || '.html' AS path, s_suppkey % 6 IN (1, 3, 4) AS matched,
       CASE s_suppkey % 6 WHEN 1 THEN '{{{{ a <b ng-if="x" ng-if="y"> }}}}@if (a) {{<p>x</p>}}' WHEN 3 THEN '@if (k' || s_suppkey || ') {{<p data-ng-if2="k">z</p>}}' WHEN 4 THEN '@if (a) {{<p title="ng-if ng-if">x</p>}}{{{{ b > c' END AS output,
       CASE s_suppkey % 6 WHEN 0 THEN '{templates.DUPLICATE}' WHEN 2 THEN '{templates.DUPLICATE}' WHEN 5 THEN 'no element with a simple control-flow attribute' END AS reason,
       CASE s_suppkey % 6 WHEN 0 THEN true WHEN 2 THEN true WHEN 5 THEN false END AS twice
FROM supplier""",
    "combined_inserts": f"""
WITH e AS ({EDITS})
SELECT path, start, stop, replacement FROM e WHERE NOT (start = stop AND replacement <> '')
UNION ALL SELECT path, start, stop, string_agg(replacement, '' ORDER BY ordinal) FROM e WHERE start = stop AND replacement <> '' GROUP BY path, start, stop""",
    "nesting_conflicts": f"WITH n AS ({NESTED}) SELECT DISTINCT a.path, a.item FROM n a JOIN n b ON a.path = b.path AND a.item <> b.item AND b.place > a.start AND b.place < a.stop",
    "pattern_notes": f"SELECT path, ordinal, pattern || ': ' || CASE WHEN matched THEN warning ELSE reason END AS note FROM ({RESULTS}) WHERE NOT matched OR warning IS NOT NULL",
    "spliced_texts": "SELECT p_partkey, '[' || substr(p_name, 2, 2) || p_brand || substr(p_name, 4, 1) || substr(p_name, 6) AS output FROM part",
    "tier_reasons": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'characterization matched on ' || o_custkey % 9 || ' inputs' ELSE o_orderpriority END AS reason FROM orders",
    "call_inputs": f"WITH {INPUTS} SELECT target_id, ordinal, arguments FROM inputs",
    "characterization": f"""
WITH {INPUTS},
judged AS (
  SELECT target_id, ordinal, target_id % 7 = 0 AS threw,
    CASE WHEN target_id % 7 <> 0 AND target_id % 11 = 0 AND arguments LIKE '%null%' THEN '{evidence.UNSTABLE}'
         WHEN target_id % 19 = 0 THEN 'migrated function could not run standalone (no module)'
         WHEN target_id % 7 <> 0 AND target_id % 17 = 0 THEN 'migrated function returned a function, which cannot be compared structurally' END AS why,
    CASE WHEN target_id % 13 = 0 AND length(arguments) > 6 THEN 'mismatch' END AS unlike
  FROM inputs),
v AS (SELECT target_id, count(*) AS cases, count(*) FILTER (NOT threw) AS returned, arg_min(coalesce(why, unlike), ordinal) FILTER (coalesce(why, unlike) IS NOT NULL) AS first FROM judged GROUP BY target_id),
n AS (SELECT target_id, count(DISTINCT arguments) AS tuples FROM calls GROUP BY target_id),
r AS (SELECT t.target_id, v.cases, v.first, CASE WHEN t.fault IS NOT NULL THEN t.fault WHEN coalesce(n.tuples, 0) < 2 AND types[1] IS NULL AND types[2] IS NULL THEN '{evidence.TOO_FEW}'
        WHEN v.first <> 'mismatch' THEN v.first WHEN v.first IS NULL AND coalesce(v.returned, 0) = 0 THEN '{evidence.ALL_THREW}' END AS reason
      FROM t LEFT JOIN v USING (target_id) LEFT JOIN n USING (target_id))
SELECT target_id, reason IS NULL AS eligible, CASE WHEN reason IS NULL THEN first IS NULL END AS matched, reason, CASE WHEN reason IS NULL AND first IS NULL THEN cases END AS cases FROM r""",
    "canonical_values": """
SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN '{"$":"Object","v":[["Z","' || s_name || '"],["z",[' || s_suppkey || ',{"$":"Object","v":[["a",true],["b",null]]}]],["é",1.5]]}'
    WHEN 1 THEN '{"$":"number","v":"' || CASE WHEN s_suppkey % 16 = 1 THEN '-0' ELSE 'NaN' END || '"}' WHEN 2 THEN '{"$":"undefined"}' WHEN 3 THEN '{"$":"Date","v":"2020-01-02T02:04:05.000Z"}'
    WHEN 5 THEN '{"$":"bigint","v":"' || s_suppkey || '"}' WHEN 6 THEN '{"$":"Map","v":[["b",1],["a",2]]}' WHEN 7 THEN '[1,2,"x"]' END AS key,
  CASE WHEN s_suppkey % 8 = 4 THEN 'a function' END AS reason
FROM supplier""",
    "locale_order": f"""
SELECT s_suppkey, name, row_number() OVER (ORDER BY lower(strip_accents(name)), strip_accents(name) <> name, lower(name) <> name, s_suppkey) - 1 AS place FROM ({WORDS})""",
    "request_budgets": "SELECT date_trunc('hour', ts) AS start, event_type AS provider, count(*) AS n, count(*) > 3 AS over FROM events GROUP BY 1, 2",
    "whole_run_report": f"""
WITH {oracle.SPANS}, ev AS ({EVIDENCE}),
best AS (SELECT path, min(CASE {oracle.TIER} WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END) AS rank FROM ev GROUP BY path),
leaks AS (SELECT path, count(*) AS n FROM found GROUP BY path),
scoped AS (SELECT path, s_suppkey AS k FROM ({SCOPE_CORPUS}) JOIN supplier ON regexp_extract(path, '/f([0-9]+)', 1) = s_suppkey::VARCHAR WHERE s_suppkey % 9 > 1 AND s_suppkey % 5 NOT IN (1, 2)),
kinds AS (SELECT path, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 4 = 0 THEN 'template' ELSE 'out' END WHEN k % 4 = 1 THEN 'vendored' WHEN k % 4 = 2 THEN 'script' ELSE 'out' END AS kind FROM scoped)
SELECT {PATH} AS path, 'script' AS kind, 2::BIGINT AS registrations, 0::BIGINT AS secrets, coalesce(['MEDIUM', 'LOW', 'REJECTED'][rank], 'NOT_EMITTED') AS outcome FROM customer LEFT JOIN best ON best.path = {PATH}
UNION ALL SELECT path, kind, 0, 0, CASE WHEN kind IN ('script', 'template') THEN 'NO_MATCH' END FROM kinds
UNION ALL SELECT corpus.path, 'out', 0, coalesce(n, 0), NULL FROM corpus LEFT JOIN leaks ON leaks.path = corpus.path""",
    "request_decisions": """
WITH RECURSIVE e AS (
  SELECT event_type AS pool, event_id, ts, epoch_us(ts) AS moment, epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) AS day_end,
         row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events),
w AS (
  SELECT DISTINCT pool, day_end, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, 0::BIGINT AS moment, 3600000000::BIGINT AS l1, 3600000000::BIGINT AS l2, 0 AS u1, 0 AS u2, 0 AS served, 0::BIGINT AS retry FROM e
  UNION ALL
  SELECT pool, day_end, n, event_id, ts, moment, f1 - CASE served WHEN 1 THEN 1800000000 ELSE 0 END, f2 - CASE served WHEN 2 THEN 3600000000 ELSE 0 END, u1 + (served = 1)::INTEGER, u2 + (served = 2)::INTEGER, served,
         least(day_end, CASE WHEN u1 < 20 THEN moment + 1800000000 - f1 ELSE day_end END, CASE WHEN u2 < 10 THEN moment + 3600000000 - f2 ELSE day_end END)
  FROM (SELECT *, CASE WHEN u1 < 20 AND f1 >= 1800000000 THEN 1 WHEN u2 < 10 AND f2 >= 3600000000 THEN 2 ELSE 0 END AS served
    FROM (SELECT e.*, w.u1, w.u2, least(3600000000, w.l1 + e.moment - w.moment) AS f1, least(3600000000, w.l2 + e.moment - w.moment) AS f2 FROM w JOIN e ON e.pool = w.pool AND e.day_end = w.day_end AND e.n = w.n + 1)))
SELECT pool, event_id AS request_id, ts, CASE served WHEN 1 THEN 'fast' WHEN 2 THEN 'slow' END AS provider, CASE WHEN served = 0 THEN make_timestamp(retry) END AS retry_at FROM w WHERE n > 0""",
    "streamed_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
