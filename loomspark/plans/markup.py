"""Queries over nested templates, and rules that are rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import elements, rules, templates
from loomspark.plans.scripts import quoted
from loomspark.plans.tables import sql

#: Templates with elements in elements, several directives at once, void elements, and some that do not nest.
NESTED_MARKUP = """
SELECT concat('t/p', cast(p_partkey AS string), '.html') AS path,
       concat('<div id="d', cast(p_partkey AS string), '">', chr(10),
              CASE p_partkey % 6 WHEN 0 THEN concat('<ul><li ng-repeat="x in xs', cast(p_size AS string), '" ng-if="x.on"><b>{{x}}</b></li></ul>')
                WHEN 1 THEN '<section ng-repeat="b in ::bs"><p class="c" ng-repeat="c in b.cs track by c.id">{{c}}</p><br></section>'
                WHEN 2 THEN '<p ng-if="a"><b>t</p></b>' WHEN 3 THEN concat('<img ng-if="k', cast(p_size AS string), '" title=''>''><li>') WHEN 4 THEN concat('<p ng-show="a" ng-show="b">', p_name, '</p>')
                ELSE concat('<p>', p_name, '</p><!-- <p ng-if="no"> --><input>') END,
              '</div>') AS content
FROM part"""

#: Texts with headers of blocks that compare, in quotes and out of them.
HEADERS = """
SELECT s_suppkey, concat('it''s <b>@if (a', cast(s_suppkey AS string), ' < f(b > 1, '')<'')) {<i>', CASE s_suppkey % 3 WHEN 0 THEN '@for (x of g((y)); track x > 0) {z < 1}' WHEN 1 THEN '@if (open < ' ELSE '@else (a < b)' END, '</i>}') AS content
FROM supplier"""

#: A rule for each nation: some are no expressions, one name comes twice.
RULES = """
SELECT cast(n_nationkey AS int) AS ordinal, concat('r', cast(CASE WHEN n_nationkey = 24 THEN 3 ELSE n_nationkey END AS string)) AS rule,
       CASE WHEN n_nationkey % 5 = 4 THEN concat('(', n_name) ELSE concat('Supplier#0*', cast(n_nationkey AS string), '[0-9]') END AS expression,
       CASE n_nationkey % 3 WHEN 0 THEN 'f[0-9]*0[.]js$' END AS scope, CASE n_nationkey % 2 WHEN 0 THEN concat('nation ', n_name) END AS message
FROM nation"""
RULED = "SELECT concat('f', cast(s_suppkey AS string), '.js') AS path, concat('x', chr(10), s_name, ' ', s_name) AS content FROM supplier"


def dom_elements(spark, sf_dir):
    return elements.elements(sql(spark, sf_dir, NESTED_MARKUP)).where("kind <> 'close'").select("path", "tag", "start", "stop", "depth", "fault")


def template_faults(spark, sf_dir):
    return elements.faults(sql(spark, sf_dir, NESTED_MARKUP)).select("path", "line", "code")


def nested_control_flow(spark, sf_dir):
    return elements.control_flow(sql(spark, sf_dir, NESTED_MARKUP))


def masked_headers(spark, sf_dir):
    return sql(spark, sf_dir, HEADERS).select("s_suppkey", templates.masked_headers(F.col("content")).alias("masked"))


def ruled_files(spark, sf_dir):
    found = rules.applied(sql(spark, sf_dir, RULED), sql(spark, sf_dir, RULES))
    return found.withColumn("note", F.regexp_replace("note", r"^(not an expression): .*$", "$1"))


QUERIES = {f.__name__: f for f in (dom_elements, template_faults, nested_control_flow, masked_headers, ruled_files)}

PIECE = quoted(elements.PIECE.replace("*+", "*"))
VOID = ", ".join(map(quoted, elements.VOID))
SQL = {
    "dom_elements": rf"""
WITH cut AS (SELECT path, unnest(found) AS text, generate_subscripts(found, 1) AS n FROM (SELECT path, regexp_extract_all(content, {PIECE}) AS found FROM ({NESTED_MARKUP}))),
placed AS (SELECT *, cast(sum(length(text)) OVER (PARTITION BY path ORDER BY n) - length(text) AS INTEGER) AS start, regexp_extract(text, '^</?([A-Za-z][^\s/>]*)', 1) AS tag FROM cut),
t AS (SELECT *, CASE WHEN starts_with(text, '</') THEN -1 WHEN tag IN ({VOID}) THEN 0 ELSE 1 END AS step FROM placed WHERE tag <> ''),
s AS (SELECT *, sum(step) OVER (PARTITION BY path ORDER BY n) AS depth FROM t),
pairs AS (SELECT a.path, a.n, min(b.n) AS closed FROM s a JOIN s b ON a.path = b.path AND b.n > a.n AND b.depth = a.depth - 1 AND b.step = -1 WHERE a.step = 1 GROUP BY 1, 2)
SELECT s.path, s.tag, s.start, cast(s.start + length(s.text) AS INTEGER) AS stop, cast(s.depth - s.step AS INTEGER) AS depth,
       CASE WHEN s.step = 1 AND p.closed IS NULL THEN 'unclosed-element' WHEN e.tag <> s.tag THEN 'end-tag-mismatch' END AS fault
FROM s LEFT JOIN pairs p ON p.path = s.path AND p.n = s.n LEFT JOIN s e ON e.path = p.path AND e.n = p.closed WHERE s.step >= 0""",
    "template_faults": """
SELECT 't/p' || p_partkey || '.html' AS path, cast(v.line AS INTEGER) AS line, v.code FROM part, (VALUES (2, 2, 'end-tag-mismatch'), (2, 2, 'end-tag-mismatch'), (3, 1, 'unclosed-element'), (3, 2, 'end-tag-mismatch'), (4, 2, 'duplicate-attribute')) AS v(k, line, code)
WHERE p_partkey % 6 = v.k""",
    "nested_control_flow": f"""
SELECT 't/p' || p_partkey || '.html' AS path, p_partkey % 6 IN (0, 1) AS matched,
       CASE p_partkey % 6 WHEN 0 THEN '<div id="d' || p_partkey || '">' || chr(10) || '<ul>@for (x of xs' || p_size || '; track x) {{' || chr(10) || '@if (x.on) {{' || chr(10) || '<li><b>{{{{x}}}}</b></li>' || chr(10) || '}}' || chr(10) || '}}</ul></div>'
         WHEN 1 THEN '<div id="d' || p_partkey || '">' || chr(10) || '@for (b of bs; track b) {{' || chr(10) || '<section>@for (c of b.cs; track c.id) {{' || chr(10) || '<p class="c">{{{{c}}}}</p>' || chr(10) || '}}<br></section>' || chr(10) || '}}</div>' END AS output,
       CASE p_partkey % 6 WHEN 4 THEN '{templates.DUPLICATE}' WHEN 5 THEN 'no control-flow attribute that can be rewritten' WHEN 2 THEN v.r WHEN 3 THEN v.r END AS reason
FROM part, (VALUES ('elements do not nest — which end tag closes which is not safely told')) AS v(r)""",
    "masked_headers": """
SELECT s_suppkey, 'it''s <b>@if (a' || s_suppkey || '   f(b   1, '') '')) {<i>' || CASE s_suppkey % 3 WHEN 0 THEN '@for (x of g((y)); track x   0) {z < 1}' WHEN 1 THEN '@if (open < ' ELSE '@else (a < b)' END || '</i>}' AS masked
FROM supplier""",
    "ruled_files": f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY ordinal) AS n FROM ({RULES})),
good AS (SELECT * FROM r WHERE n = 1 AND ordinal % 5 <> 4),
found AS (SELECT f.path, rule, len(regexp_extract_all(content, expression)) AS hits, message FROM ({RULED}) f JOIN good ON scope IS NULL OR regexp_matches(path, scope))
SELECT path, rule, cast(hits AS INTEGER) AS hits, 2 AS first_line, coalesce(message, rule) || ' (' || hits || ')' AS note FROM found WHERE hits > 0
UNION ALL SELECT NULL, rule, 0, NULL, CASE WHEN n > 1 THEN 'a rule of this name comes before' ELSE 'not an expression' END FROM r WHERE n > 1 OR ordinal % 5 = 4""",
}
