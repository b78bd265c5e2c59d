"""Queries over the token table: tokens, brackets, calls, bindings and what declarations need, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import calls, constants, declared, fields, reach, scopes, tokens
from loomspark.plans.tables import sql, texts

#: Scripts with what text search takes for calls: comments, strings with the other quote, patterns with quotes, templates, and shadowed names.
SCRIPTS = """
SELECT concat('s/c', cast(c_custkey AS string), '.js') AS path,
       concat('// m.controller("no', cast(c_custkey AS string), '", f)', chr(10),
              'var shared = ', cast(c_custkey AS string), ', text = ".service(''no'', f)", re = /[''"]', chr(92), '/', cast(c_nationkey AS string), '/g, half = shared / 2 / 1;', chr(10),
              'angular.module("m', cast(c_custkey AS string), '", ["it''s", ''n', cast(c_nationkey AS string), '''])', chr(10),
              '  .controller("C', cast(c_custkey AS string), '", [''$scope'', "svc", function ($scope, svc) { /* $scope.$watch(''no'') */', chr(10),
              '    $scope.$watch("v', cast(c_custkey AS string), '", function (', CASE c_custkey % 3 WHEN 0 THEN 'shared' WHEN 1 THEN 'svc' ELSE 'other' END, ') { return shared + svc + helper', cast(c_custkey % 4 AS string), '(other); }); }])', chr(10),
              '  .', CASE c_custkey % 2 WHEN 0 THEN 'service' ELSE 'factory' END, '(''S', chr(92), '''', cast(c_custkey AS string), ''', ',
              CASE c_custkey % 4 WHEN 0 THEN 'function (a, /* , no */ b) { return [a, b]; }' WHEN 1 THEN '(a, b) => a / b' WHEN 2 THEN 'x => x' ELSE 'Named' END, ');', chr(10),
              'function helper0(x) { return helper1(x); }', chr(10), 'function helper1(x) { return x ? helper2(x) : 0; }', chr(10),
              'function helper2(q) { var helper3 = 1; return helper1(q) + helper3; }', chr(10), 'function helper3(q) { return `${ {a: `}`} } helper0(q)`; }', chr(10),
              CASE c_custkey % 4 WHEN 0 THEN '$routeProvider.when("/r", {}).otherwise({}).when(HOME + 1, {});' WHEN 1 THEN '$http.get(u).then(f).catch(g);'
                WHEN 2 THEN '$http.post(u, [1]).then(f).then(g).catch(h);' ELSE '// $http.get(u).then(f)' END) AS content
FROM customer"""

#: A small graph for each order: from line number to line number.
EDGES = "SELECT l_orderkey, l_linenumber AS a, cast(l_partkey % 7 + 1 AS int) AS b FROM lineitem"

#: A script for each order: a variable for each line, whose value names others, some not there, some in a circle, some written to again; a request by each.
VALUES = """
SELECT concat('o', cast(l_orderkey AS string), '.js') AS path,
       array_join(array_sort(collect_list(concat(
         'var v', cast(l_linenumber AS string), ' = ', CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('v', cast(l_partkey % 7 + 1 AS string), ' + ') ELSE concat('v', cast(l_partkey % 7 + 1 AS string), ' + v', cast(l_suppkey % 7 + 1 AS string), ' + ') END,
         '"/p', cast(l_partkey AS string), '"', CASE WHEN l_suppkey % 2 = 0 THEN ';' ELSE '' END, chr(10),
         CASE WHEN l_returnflag = 'R' AND l_partkey % 2 = 0 THEN concat('v', cast(l_linenumber AS string), ' += 1;') ELSE concat('if (v', cast(l_linenumber AS string), ' == 1) {}') END, chr(10),
         CASE WHEN l_linestatus = 'O' THEN concat('$http.get(v', cast(l_linenumber AS string), ' + ''/o'', {});')
              ELSE concat('function f', cast(l_partkey AS string), '(v', cast(l_linenumber AS string), ') { return $http.get(v', cast(l_linenumber AS string), '); }') END))), chr(10)) AS content
FROM lineitem GROUP BY l_orderkey"""

#: A controller for each order, that assigns a field for each line: by itself, by a variable that stands for it, in an arrow, or not at all.
ASSIGNED = """
SELECT concat('k', cast(l_orderkey AS string), '.js') AS path,
       concat('m.controller("C', cast(l_orderkey AS string), '", function ($scope) {', chr(10), CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE 'var $scopeless, vm = this' END, chr(10),
         array_join(array_sort(collect_list(concat(
           CASE l_partkey % 6 WHEN 0 THEN 'this.f' WHEN 1 THEN 'vm.f' WHEN 2 THEN 'g(function () { this.f' WHEN 3 THEN 'g(() => { vm.h = 2; this.f' WHEN 4 THEN 'g(function (vm) { vm.f' ELSE 'if (vm.f' END, cast(l_linenumber AS string),
           CASE l_partkey % 6 WHEN 0 THEN ' = 1' WHEN 1 THEN ' = { a: 1 }' WHEN 5 THEN ' == 1) { this.no.f = vm.no }' ELSE ' = 1; });' END))), chr(10)), chr(10), '});') AS content
FROM lineitem GROUP BY l_orderkey"""


#: A file of four customers in five, with declarations at any depth and words that only look like some.
ORIGINALS = """
SELECT concat('s/c', cast(c_custkey AS string), '.js') AS path,
       concat('// class B', chr(10), 'class Old {}', chr(10), 'f(function () { var inner = "class A0 {}"; if (inner) { class Deep {} } });', chr(10), 'x.class; var y = { AppRoutes: 1 };') AS content
FROM customer WHERE c_custkey % 5 <> 0"""

#: What rewrites made of them, an order each: new classes and tables, old ones, and the same again.
OUTPUTS = """
SELECT concat('s/c', cast(o_custkey AS string), '.js') AS path, o_orderkey AS ordinal,
       CASE o_orderkey % 4 WHEN 0 THEN concat('/* class Ghost {} */ class A', cast(o_orderkey % 3 AS string), ' { m() { return "class Str {}"; } }')
         WHEN 1 THEN 'class Deep {} export class B extends A0 {}' WHEN 2 THEN 'const AppRoutes: Routes = []; const other: Route = 1; let inner: Routes = [];'
         ELSE 'var x = a.class, o = { class: Ghost }; class Old { class() {} }' END AS content
FROM orders"""


def script_tokens(spark, sf_dir):
    return tokens.all_tokens(texts(spark, sf_dir, SCRIPTS)).where("kind <> 'space'").select("path", "start", "line", "kind", "text")


def script_brackets(spark, sf_dir):
    rows = tokens.bracketed_tokens(texts(spark, sf_dir, SCRIPTS))
    return rows.select("path", "place", "text", "depth", "partner", "parent")


def script_registrations(spark, sf_dir):
    found = calls.registrations(texts(spark, sf_dir, SCRIPTS))
    return found.select("path", "line", "kind", "name", F.array_join("dependencies", ",").alias("dependencies"))


def script_watches(spark, sf_dir):
    return calls.watches(texts(spark, sf_dir, SCRIPTS)).select("path", "line", "method", "expression")


def script_routes(spark, sf_dir):
    return calls.routes(texts(spark, sf_dir, SCRIPTS)).select("path", "line", "provider", "path_or_state")


def promise_chains(spark, sf_dir):
    return calls.promise_chains(texts(spark, sf_dir, SCRIPTS)).select("path", "line", "verb", "depth", "reason")


def name_bindings(spark, sf_dir):
    """How often each name of each file is bound to the file, to a function in it, and to nothing."""
    found = scopes.Scopes.of(texts(spark, sf_dir, SCRIPTS)).counts()
    return found.groupBy("path", "name").agg(*[F.sum(c).alias(c) for c in ("of_file", "of_function", "free")])


def lifted_helpers(spark, sf_dir):
    """What each controller's definition needs of its file, directly or through other functions."""
    return reach.lifted(scopes.Scopes.of(texts(spark, sf_dir, SCRIPTS)), "controller").select("path", "name", "line", "steps")


def reachable_lines(spark, sf_dir):
    edges = sql(spark, sf_dir, EDGES)
    return reach.reachable(edges, edges.select("l_orderkey", F.col("a").alias("source")), ["l_orderkey"])


def script_values(spark, sf_dir):
    return constants.Constants(scopes.Scopes.of(sql(spark, sf_dir, VALUES)))


def constant_values(spark, sf_dir):
    return constants.constants(script_values(spark, sf_dir)).select("path", "name", "value", "reason")


def request_urls(spark, sf_dir):
    return constants.request_urls(script_values(spark, sf_dir)).select("path", "verb", "url", "reason")


def assigned_fields(spark, sf_dir):
    """The fields of each function that assigns some."""
    found = fields.assigned_fields(scopes.Scopes.of(sql(spark, sf_dir, ASSIGNED)))
    return found.groupBy("path", "start").agg(F.array_join(F.sort_array(F.collect_list("field")), ",").alias("fields")).select("path", "fields")


def added_declarations(spark, sf_dir):
    return declared.added_declarations(texts(spark, sf_dir, OUTPUTS), texts(spark, sf_dir, ORIGINALS))


QUERIES = {f.__name__: f for f in (added_declarations, script_tokens, script_brackets, script_registrations, script_watches, script_routes, promise_chains, name_bindings, lifted_helpers, reachable_lines, constant_values, request_urls, assigned_fields)}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


RE2 = quoted(tokens.TOKEN.replace("*+", "*"))
JOINED = quoted(f"^(?:{tokens.PATTERN})$".replace("*+", "*"))
HEAD = r"regexp_replace(split_part(t, '/', 1), '\s+$', '')"
#: Tokens as DuckDB cuts them: the same alternatives, patterns taken apart from what they were known by.
CUT = rf"""
lists AS (
  SELECT path, flatten(list_transform(regexp_extract_all(content, {RE2}), lambda t:
    CASE WHEN instr(t, '/') > 1 AND regexp_matches(t, {JOINED}) AND NOT regexp_matches(t, '^[/''"`]')
         THEN list_filter([{HEAD}, substr(split_part(t, '/', 1), length({HEAD}) + 1), substr(t, instr(t, '/'))], lambda x: x <> '')
         ELSE [t] END)) AS found
  FROM ({SCRIPTS})),
cut AS (SELECT path, unnest(found) AS text, generate_subscripts(found, 1) AS n FROM lists),
placed AS (
  SELECT path, n, text, cast(sum(length(text)) OVER w - length(text) AS INTEGER) AS start,
         cast(sum(length(text) - length(replace(text, chr(10), ''))) OVER w - (length(text) - length(replace(text, chr(10), ''))) + 1 AS INTEGER) AS line,
         CASE WHEN regexp_matches(text, '^\s') THEN 'space' WHEN starts_with(text, '//') OR starts_with(text, '/*') THEN 'comment' WHEN text[1] IN ('''', '"') AND length(text) > 1 THEN 'string'
              WHEN text[1] = '`' AND length(text) > 1 THEN 'template' WHEN text[1] = '/' AND length(text) > 1 THEN 'pattern' WHEN regexp_matches(text, '^\.?[0-9]') THEN 'number'
              WHEN regexp_matches(text, '^[A-Za-z_$\x{{80}}-\x{{10FFFF}}]') THEN 'name' ELSE 'sign' END AS kind
  FROM cut WINDOW w AS (PARTITION BY path ORDER BY n))"""

#: Values by writing out the first name that is left, until none is: what goes round in a circle is never done.
WRITTEN_OUT = r"""
WITH RECURSIVE defs AS (
  SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS c, bool_or(l_returnflag = 'R' AND l_partkey % 2 = 0) AS again,
         any_value(CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '{' || (l_partkey % 7 + 1) || '}' ELSE '{' || (l_partkey % 7 + 1) || '}{' || (l_suppkey % 7 + 1) || '}' END || '/p' || l_partkey) AS sum
  FROM lineitem GROUP BY 1, 2),
usable AS (SELECT k, n, sum FROM defs WHERE c = 1 AND NOT again),
e AS (
  SELECT k, n, sum AS t, 0 AS i FROM usable
  UNION ALL SELECT e.k, e.n, regexp_replace(e.t, '\{[0-9]+\}', u.sum), i + 1 FROM e JOIN usable u ON u.k = e.k AND u.n = TRY_CAST(regexp_extract(e.t, '\{([0-9]+)\}', 1) AS INTEGER) WHERE i < 130),
v AS (SELECT k, n, t FROM e WHERE NOT contains(t, '{'))"""

PATH = "'s/c' || c_custkey || '.js'"
SQL = {
    "script_tokens": f"WITH {CUT} SELECT path, start, line, kind, text FROM placed WHERE kind <> 'space'",
    "script_brackets": f"""WITH {CUT},
t AS (SELECT path, text, cast(row_number() OVER (PARTITION BY path ORDER BY n) - 1 AS INTEGER) AS place FROM placed WHERE kind NOT IN ('space', 'comment')),
s AS (SELECT *, sum(CASE WHEN text IN ('(', '[', '{{') THEN 1 WHEN text IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY place) AS depth FROM t),
pairs AS (SELECT a.path, a.place AS opened, min(b.place) AS closed FROM s a JOIN s b ON a.path = b.path AND b.place > a.place AND b.depth = a.depth - 1 AND b.text IN (')', ']', '}}') WHERE a.text IN ('(', '[', '{{') GROUP BY 1, 2),
held AS (SELECT s.path, s.place, max(p.opened) AS parent, count(p.opened) AS depth FROM s LEFT JOIN pairs p ON p.path = s.path AND p.opened < s.place AND s.place < p.closed GROUP BY 1, 2)
SELECT s.path, s.place, s.text, cast(h.depth AS INTEGER) AS depth, coalesce(o.closed, c.opened) AS partner, h.parent
FROM s JOIN held h USING (path, place) LEFT JOIN pairs o ON o.path = s.path AND o.opened = s.place LEFT JOIN pairs c ON c.path = s.path AND c.closed = s.place""",
    "script_registrations": f"""
SELECT {PATH} AS path, 4 AS line, 'controller' AS kind, 'C' || c_custkey AS name, '$scope,svc' AS dependencies FROM customer
UNION ALL SELECT {PATH}, 6, CASE c_custkey % 2 WHEN 0 THEN 'service' ELSE 'factory' END, 'S''' || c_custkey, CASE c_custkey % 4 WHEN 2 THEN 'x' WHEN 3 THEN '' ELSE 'a,b' END FROM customer""",
    "script_watches": f"SELECT {PATH} AS path, 5 AS line, '$watch' AS method, '\"v' || c_custkey || '\"' AS expression FROM customer",
    "script_routes": f"SELECT {PATH} AS path, 11 AS line, 'ngRoute' AS provider, v.s AS path_or_state FROM customer, (VALUES ('/r'), ('HOME + 1')) AS v(s) WHERE c_custkey % 4 = 0",
    "promise_chains": f"""
SELECT {PATH} AS path, 11 AS line, CASE c_custkey % 4 WHEN 1 THEN 'get' ELSE 'post' END AS verb, cast(CASE c_custkey % 4 WHEN 1 THEN 2 ELSE 3 END AS INTEGER) AS depth, CASE c_custkey % 4 WHEN 2 THEN 'chain of 3 calls, more than 2' END AS reason
FROM customer WHERE c_custkey % 4 IN (1, 2)""",
    "lifted_helpers": f"""
SELECT {PATH} AS path, v.name, v.line, v.steps FROM customer, (VALUES
  (0, 'helper0', 7, 1), (0, 'helper1', 8, 2), (0, 'helper2', 9, 3), (1, 'helper1', 8, 1), (1, 'helper2', 9, 2), (2, 'helper2', 9, 1), (2, 'helper1', 8, 2), (3, 'helper3', 10, 1)) AS v(k, name, line, steps) WHERE c_custkey % 4 = v.k
UNION ALL SELECT {PATH}, 'shared', 2, 1 FROM customer WHERE c_custkey % 3 <> 0""",
    "constant_values": f"""{WRITTEN_OUT}
SELECT 'o' || k || '.js' AS path, 'v' || n AS name, t AS value, CASE WHEN c > 1 THEN '{constants.MANY}' WHEN again THEN '{constants.WRITTEN}' WHEN t IS NULL THEN '{constants.NO_VALUE}' END AS reason FROM defs LEFT JOIN v USING (k, n)""",
    "request_urls": f"""{WRITTEN_OUT}
SELECT 'o' || l_orderkey || '.js' AS path, 'get' AS verb, t || '/o' AS url, CASE WHEN t IS NULL THEN '{constants.NO_VALUE}' END AS reason FROM lineitem LEFT JOIN v ON k = l_orderkey AND n = l_linenumber AND l_linestatus = 'O'""",
    "assigned_fields": """
WITH a AS (SELECT l_orderkey AS k, l_partkey % 6 AS form, 'f' || l_linenumber AS field FROM lineitem),
own AS (SELECT k, field FROM a WHERE form IN (0, 3) UNION SELECT k, field FROM a WHERE form = 1 AND k % 5 <> 0 UNION SELECT k, 'h' FROM a WHERE form = 3 AND k % 5 <> 0)
SELECT 'k' || k || '.js' AS path, string_agg(field, ',' ORDER BY field) AS fields FROM own GROUP BY k UNION ALL SELECT 'k' || k || '.js', field FROM a WHERE form = 2""",
    "reachable_lines": f"""
WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({EDGES})),
r AS (SELECT l_orderkey, a AS source, b AS node, 1 AS steps FROM e UNION SELECT r.l_orderkey, r.source, e.b, r.steps + 1 FROM r JOIN e ON e.l_orderkey = r.l_orderkey AND e.a = r.node WHERE r.steps < 8)
SELECT l_orderkey, source, node, min(steps) AS steps FROM r GROUP BY 1, 2, 3""",
    "added_declarations": f"""
WITH d AS (SELECT o_custkey AS c, o_orderkey AS ordinal, v.place, CASE name WHEN 'A' THEN 'A' || o_orderkey % 3 ELSE name END AS name
           FROM orders JOIN (VALUES (0, 0, 'A'), (1, 0, 'Deep'), (1, 1, 'B'), (2, 0, 'AppRoutes'), (2, 1, 'inner'), (3, 0, 'Old')) AS v(k, place, name) ON o_orderkey % 4 = v.k),
r AS (SELECT *, row_number() OVER (PARTITION BY c, name ORDER BY ordinal, place) = 1 AS emitted FROM d WHERE c % 5 = 0 OR name NOT IN ('Deep', 'inner', 'Old'))
SELECT 's/c' || c || '.js' AS path, ordinal, name, emitted, CASE WHEN NOT emitted THEN name || ' {declared.TAKEN}' END AS reason FROM r""",
}
