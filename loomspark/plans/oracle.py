"""The catalogue's queries as SQL for DuckDB, stated independently of the operators.

Facts that the built corpora hold by formula are stated from the keys, not found by matching.
"""

from __future__ import annotations

from loomspark.operators.secrets import RULES
from loomspark.plans.tables import ARTIFACTS, DECLARATIONS, FILES, LISTING, SCAN, SCOPE_CORPUS, SECRET_CORPUS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


RULE_ROWS = ", ".join(f"({k}, {quoted(r.id)}, {quoted(r.description)}, {r.after})" for k, r in enumerate(RULES))

CANDIDATES = " UNION ALL ".join(
    f"SELECT path, content, {k} AS ordinal, regexp_extract_all(content, {quoted(r.regex)}) AS m, regexp_extract_all(content, {quoted(r.regex)}, {r.group}) AS g, "
    f"regexp_split_to_array(content, {quoted(r.regex)}) AS gaps FROM corpus"
    for k, r in enumerate(RULES)
)

SPANS = f"""
corpus AS ({SECRET_CORPUS}),
rules(ordinal, id, description, after) AS (VALUES {RULE_ROWS}),
candidates AS (
  SELECT path, content, c.ordinal, g[k] AS secret,
         list_sum(list_transform(gaps[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:k], lambda x: len(x))), 0) - after AS stop
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM ({CANDIDATES})) c JOIN rules USING (ordinal)
  WHERE len(g[k]) > 0),
lists AS (
  SELECT path, content, list([{{'ordinal': ordinal, 'start': stop - len(secret), 'stop': stop}}] ORDER BY ordinal, stop) AS all_spans
  FROM candidates GROUP BY path, content),
accepted AS (
  SELECT path, content,
         list_reduce(all_spans, lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: x[1].start < a.stop AND a.start < x[1].stop)) > 0 THEN acc ELSE list_concat(acc, x) END) AS spans
  FROM lists),
found AS (
  SELECT path, content, s.start AS start, s.stop AS stop, id, description, substr(content, (s.start + 1)::BIGINT, (s.stop - s.start)::BIGINT) AS secret
  FROM (SELECT path, content, unnest(spans) AS s FROM accepted) JOIN rules ON s.ordinal = rules.ordinal)"""

MASK = "CASE WHEN len({0}) <= 8 THEN repeat('*', len({0})) ELSE left({0}, 4) || repeat('*', len({0}) - 8) || right({0}, 4) END"
LINE = "cast(1 + len(substr(content, 1, start::BIGINT)) - len(replace(substr(content, 1, start::BIGINT), chr(10), '')) AS INTEGER)"
TIER = "CASE WHEN NOT compiled OR NOT tests THEN 'REJECTED' WHEN characterization IS NULL OR characterization = 'ineligible' THEN 'LOW' WHEN characterization = 'mismatch' THEN 'REJECTED' ELSE 'MEDIUM' END"
TIERED = f"tiered AS (SELECT *, {TIER} AS tier, CASE WHEN NOT compiled THEN 'compile' WHEN NOT tests THEN 'tests' WHEN characterization = 'mismatch' THEN 'characterization' END AS failed FROM ({ARTIFACTS}))"
OUTCOMES = f"""{TIERED}, files AS ({FILES}),
outcomes AS (
  SELECT f.path, coalesce(CASE min(CASE t.tier WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 WHEN 'REJECTED' THEN 3 END) WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' WHEN 3 THEN 'REJECTED' END,
         CASE WHEN any_value(f.matched) THEN 'NOT_EMITTED' ELSE 'NO_MATCH' END) AS outcome
  FROM files f LEFT JOIN (SELECT source_file AS path, tier FROM tiered UNION ALL SELECT template_source, tier FROM tiered) t ON t.path = f.path
  GROUP BY f.path)"""

RATE = "CASE WHEN {1} = 0 THEN 0.0::DOUBLE ELSE floor({0}::DOUBLE / {1} * 1000 + 0.5) / 1000 END"

CUSTOMER = "cast(c_custkey AS VARCHAR)"

RESOLVED = f"""
d AS (SELECT declaration_id, l_partkey AS p, l_suppkey AS s FROM ({DECLARATIONS})),
f AS (SELECT 't/' || p_partkey || '.html' AS path FROM part WHERE p_size > 40),
resolved AS (
  SELECT d.declaration_id, coalesce(a.path, b.path, c.path) AS template
  FROM d LEFT JOIN f a ON a.path = 't/' || 2 * s || '.html' LEFT JOIN f b ON b.path = 't/' || 2 * p || '.html' LEFT JOIN f c ON c.path = 't/' || 2 * (s + p) || '.html')"""

NAME = "upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), ' ', 'X') || ':' || p_brand"


def statements() -> dict[str, str]:
    out = {
        "secret_findings": f"WITH {SPANS} SELECT path, id AS pattern_id, description, {LINE} AS line, {MASK.format('secret')} AS redacted_preview, cast(start AS INTEGER) AS start, cast(stop AS INTEGER) AS stop FROM found",
        "secret_findings_by_rule": f"WITH {SPANS} SELECT id AS pattern_id, count(*) AS findings, count(DISTINCT path) AS files FROM found GROUP BY 1",
        "secret_redacted": f"""WITH {SPANS},
pieces AS (SELECT path, content, id, start, stop, coalesce(lag(stop) OVER w, 0) AS prior, row_number() OVER w AS n, count(*) OVER (PARTITION BY path) AS size FROM found WINDOW w AS (PARTITION BY path ORDER BY start)),
joined AS (SELECT path, string_agg(substr(content, (prior + 1)::BIGINT, (start - prior)::BIGINT) || '[REDACTED:' || id || ']' || CASE WHEN n = size THEN substr(content, (stop + 1)::BIGINT) ELSE '' END, '' ORDER BY n) AS redacted, count(*) AS n FROM pieces GROUP BY path)
SELECT c.path, coalesce(j.redacted, c.content) AS redacted, cast(coalesce(j.n, 0) AS INTEGER) AS n_findings, j.n IS NOT NULL AS has_secrets FROM corpus c LEFT JOIN joined j USING (path)""",
        "document_tokens": r"""
SELECT path, cast(1 + len(before) - len(replace(before, chr(10), '')) AS INTEGER) AS line, left(secret, 4) || repeat('*', 32) || right(secret, 4) AS redacted_preview, cast(start AS INTEGER) AS start
FROM (SELECT *, substr(text, 1, start::BIGINT) AS before FROM (
  SELECT 'doc/' || doc_id AS path, text, g[k] AS secret,
         list_sum(list_transform(gaps[1:k], lambda x: len(x))) + list_sum(list_transform(m[1:k], lambda x: len(x))) - 40 AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (
    SELECT doc_id, text, regexp_extract_all(text, '(?i)\btoken\s*=\s*[''"]?([0-9a-f]{40})') AS m, regexp_extract_all(text, '(?i)\btoken\s*=\s*[''"]?([0-9a-f]{40})', 1) AS g,
           regexp_split_to_array(text, '(?i)\btoken\s*=\s*[''"]?([0-9a-f]{40})') AS gaps FROM documents))))""",
        "document_scope": r"""
SELECT CASE WHEN regexp_matches(substr(text, 1, 200), '@license AngularJS v') THEN 'vendored' WHEN regexp_matches(text, '\bangular\s*\.\s*module\s*\(') THEN 'script' ELSE 'out' END AS kind,
       count(*) AS files, cast(sum(len(text)) AS BIGINT) AS chars FROM documents GROUP BY 1""",
        "scope_counts": rf"""
SELECT kind, count(*) AS files FROM (
  SELECT CASE WHEN path LIKE '%.html' THEN CASE WHEN regexp_matches(content, '\b(?:data-)?ng-[a-z]|\{{\{{') THEN 'template' ELSE 'out' END
         WHEN regexp_matches(substr(content, 1, 200), '@license AngularJS v') THEN 'vendored'
         WHEN regexp_matches(content, '\bangular\s*\.\s*module\s*\(') THEN 'script' ELSE 'out' END AS kind
  FROM ({SCOPE_CORPUS}) WHERE NOT (path LIKE 'node\_modules/%' ESCAPE '\' OR path LIKE '%/dist/%' OR path LIKE 'app/dist/%' OR path LIKE '%.spec.js' OR path LIKE '%.min.js'))
GROUP BY kind""",
        "modules": f"SELECT 'app/c' || {CUSTOMER} || '.js' AS path, 1 AS line, 'm' || {CUSTOMER} AS name, 'n' || c_nationkey || ',seg' AS depends_on FROM customer",
        "module_edges": "SELECT 'n' || c_nationkey AS depends_on, count(*) AS modules FROM customer GROUP BY 1 UNION ALL SELECT 'seg', count(*) FROM customer",
        "registrations": f"""
SELECT 'app/c' || {CUSTOMER} || '.js' AS path, 2 AS line, 'controller' AS kind, 'C' || {CUSTOMER} AS name, '$scope,svc' AS dependencies FROM customer
UNION ALL SELECT 'app/c' || {CUSTOMER} || '.js', 5, CASE WHEN c_custkey % 2 = 0 THEN 'service' ELSE 'factory' END, 'S' || {CUSTOMER}, 'http,q' FROM customer""",
        "routes": f"""
SELECT 'app/c' || {CUSTOMER} || '.js' AS path, 8 AS line, 'ngRoute' AS provider, '/r' || {CUSTOMER} AS path_or_state FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT 'app/c' || {CUSTOMER} || '.js', 9, 'ngRoute', 'HOME' FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT 'app/c' || {CUSTOMER} || '.js', 7, 'ui-router', 's' || {CUSTOMER} FROM customer WHERE c_custkey % 4 = 1""",
        "watches": f"SELECT 'app/c' || {CUSTOMER} || '.js' AS path, 3 AS line, '$watch' AS method, '''v' || {CUSTOMER} || '''' AS expression FROM customer WHERE c_custkey % 3 = 0",
        "inventory_counts": f"""
SELECT 'app/c' || {CUSTOMER} || '.js' AS path, 1 AS modules, 2 AS registrations,
       CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS routes, CASE c_custkey % 3 WHEN 0 THEN 1 ELSE 0 END::BIGINT AS watches FROM customer""",
        "event_pairs": """
SELECT cast(user_id AS VARCHAR) AS path, json_extract_string(props, '$.k') AS event, min(event_id) AS first_at FROM events WHERE event_type <> 'signup'
GROUP BY 1, 2 HAVING count(*) FILTER (event_type IN ('click', 'view')) > 0 AND count(*) FILTER (event_type IN ('purchase', 'error')) > 0""",
        "repository_facts": f"""
WITH l AS ({LISTING}),
v AS (SELECT repo, path, CASE path WHEN 'bower.json' THEN 1 ELSE 2 END AS rank,
       CASE WHEN json_valid(content) THEN coalesce(json_extract_string(content, '$.dependencies.angular'), json_extract_string(content, '$.devDependencies.angular')) END AS version
     FROM l WHERE path IN ('bower.json', 'package.json')),
vs AS (SELECT repo, arg_min(version, rank) AS version, arg_min(path, rank) AS version_source FROM v WHERE version IS NOT NULL GROUP BY repo)
SELECT r.repo, vs.version, vs.version_source,
       CASE WHEN EXISTS (FROM l WHERE l.repo = r.repo AND path = 'webpack.config.js') THEN 'webpack' WHEN EXISTS (FROM l WHERE l.repo = r.repo AND path = 'gulpfile.js') THEN 'gulp'
            WHEN EXISTS (FROM l WHERE l.repo = r.repo AND lower(path) = 'gruntfile.js') THEN 'grunt' ELSE 'none' END AS build_tool,
       k.path AS test_config, coalesce(k.content LIKE '%''PhantomJS''%', false) AS uses_phantom
FROM (SELECT DISTINCT repo FROM l) r LEFT JOIN vs USING (repo) LEFT JOIN (SELECT * FROM l WHERE path LIKE '%karma.conf.js') k USING (repo)""",
        "remediated_configs": f"SELECT repo, path, replace(content, '''PhantomJS''', '''ChromeHeadless''') AS content, content LIKE '%PhantomJS%' AS changed FROM ({LISTING}) WHERE path LIKE '%karma.conf.js'",
        "tiers_by_type": f"""WITH {TIERED}
SELECT artifact_type, count(artifact_id) AS total, count(*) FILTER (tier = 'MEDIUM') AS medium, count(*) FILTER (tier = 'LOW') AS low, count(*) FILTER (tier = 'REJECTED') AS rejected
FROM (VALUES ('controller'), ('service'), ('filter'), ('directive'), ('route')) AS d(artifact_type) LEFT JOIN tiered USING (artifact_type) GROUP BY 1""",
        "failed_checks": f"WITH {TIERED} SELECT artifact_type, failed, count(*) AS n FROM tiered WHERE failed IS NOT NULL GROUP BY 1, 2",
        "file_outcomes": f"WITH {OUTCOMES} SELECT path, outcome FROM outcomes",
        "honest_rates": f"""WITH {OUTCOMES},
n AS (SELECT count(*) AS in_scope, count(*) FILTER (outcome <> 'NO_MATCH') AS matched, count(*) FILTER (outcome IN ('MEDIUM', 'LOW')) AS compiled FROM outcomes)
SELECT *, {RATE.format("matched", "in_scope")} AS match_rate, {RATE.format("compiled", "in_scope")} AS compile_rate FROM n""",
        "gate_results": f"""WITH {TIERED}
SELECT artifact_id, '{{"artifact_type":"' || artifact_type || '","tier":"' || tier || '","compiled":' || compiled || ',"tests":' || tests || '}}' AS result, (tier = 'REJECTED')::INTEGER AS exit_code FROM tiered""",
        "written_report": f"WITH {OUTCOMES} SELECT path, outcome FROM outcomes",
        "written_texts": f"""WITH {SPANS},
gone AS (SELECT path, sum(stop - start - length('[REDACTED:' || id || ']')) AS chars FROM found GROUP BY path)
SELECT 'src' AS directory, count(*) AS files, cast(sum(length(content) - coalesce(gone.chars, 0)) AS BIGINT) AS chars FROM corpus LEFT JOIN gone USING (path)""",
        "scanned_corpus": f"""WITH s AS ({SCAN})
SELECT name, folder, replace(content, chr(10), ' ') AS content FROM s WHERE folder = 'app' UNION ALL SELECT 'single', 'one', cast(length(content) + 1 AS VARCHAR) FROM s WHERE folder = 'app' AND name = 'f1'""",
        "template_resolution": f"WITH {RESOLVED} SELECT declaration_id, template FROM resolved",
        "orphan_templates": f"WITH {RESOLVED} SELECT path FROM f WHERE path NOT IN (SELECT template FROM resolved WHERE template IS NOT NULL)",
        "unique_paths": """
SELECT p_partkey, 'out/' || replace(p_name, ' ', '-') || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.pipe.ts' AS unique_path
FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""",
        "first_claims": """
SELECT p_partkey, p_brand, p_name AS name, n = 1 AS kept, CASE WHEN n > 1 THEN 'duplicate name ' || p_name END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)""",
        "fallback_routes": """
SELECT l_suppkey, arg_max(l_partkey, l_orderkey * 10 + l_linenumber) AS fallback, count(*) AS n, count(*) > 1 AS warned FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey""",
        "first_place_last_value": "SELECT user_id, event_type, min(event_id) AS first_at, arg_max(value, event_id) AS last_value_of FROM events GROUP BY 1, 2",
        "names": f"""
WITH n AS (SELECT p_partkey, {NAME} AS name, p_name FROM part),
w AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> '') AS words,
      list_transform(string_split(replace(name, ':', '/'), '/'), lambda s: list_filter(regexp_split_to_array(regexp_replace(s, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> '')) AS segments FROM n)
SELECT p_partkey, lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) AS kebab, upper(left(name, 1)) || substr(name, 2) AS pascal,
       array_to_string(list_transform(words, lambda x, i: CASE WHEN i = 1 THEN lower(x) ELSE upper(left(x, 1)) || lower(substr(x, 2)) END), '') AS camel,
       array_to_string(list_transform(flatten(segments), lambda x: upper(left(x, 1)) || substr(x, 2)), '') || 'Component' AS component,
       replace(name, ':', '/') AS route, {MASK.format("name")} AS masked,
       CASE WHEN p_partkey % 4 = 0 THEN '[' || name || ']' ELSE lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) END AS selector
FROM w""",
        "page_attributes": r"""
SELECT lower(name) AS name, count(*) AS n, count(DISTINCT page_id) AS pages, cast(max(line) AS INTEGER) AS last_line FROM (
  SELECT page_id, names[k] AS name, 1 + len(before) - len(replace(before, chr(10), '')) AS line FROM (
    SELECT page_id, names, k, substr(html, 1, (list_sum(list_transform(gaps[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: len(x))), 0))::BIGINT) AS before
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (
      SELECT page_id, html, regexp_extract_all(html, '\s([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*"([^"]*)"') AS m, regexp_extract_all(html, '\s([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*"([^"]*)"', 1) AS names,
             regexp_split_to_array(html, '\s([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*"([^"]*)"') AS gaps FROM pages))))
GROUP BY 1""",
        "page_tags": r"SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9-]*)((?:\s+[^<>]*)?)/?>', 1)) AS tag FROM pages) GROUP BY 1",
        "rewritten_templates": """
SELECT 't' || s_suppkey || '.html' AS path, s_suppkey % 4 < 3 AS matched,
       CASE s_suppkey % 4 WHEN 0 THEN '@if (x' || s_suppkey || ') {<p class="a">' || s_name || '</p>}' WHEN 1 THEN '@for (i of items' || s_suppkey || '; track $index) {<li>{{i}}</li>}'
         WHEN 2 THEN '<b [hidden]="!(on)">' || s_name || '</b>' END AS output,
       CASE WHEN s_suppkey % 4 = 3 THEN 'no element with a simple control-flow attribute' END AS reason
FROM supplier""",
        "diagnostics": """
SELECT o_orderkey AS log_id, 1 AS ordinal, CASE o_orderkey % 4 WHEN 0 THEN 'src/a' || o_custkey || '.ts' WHEN 1 THEN 'src/b.ts' ELSE 'src/c' || (o_custkey % 7) || '.ts' END AS file,
       CASE o_orderkey % 4 WHEN 0 THEN 'TS2304' WHEN 1 THEN 'NG2003' ELSE 'NG8001' END AS code,
       CASE o_orderkey % 4 WHEN 0 THEN 'Cannot find name ''x''.' WHEN 1 THEN 'No suitable token.' ELSE 'unknown element' END AS message
FROM orders WHERE o_orderkey % 4 < 3""",
        "boundary_rows": """
WITH kinds AS (SELECT p_partkey AS target_id, [['string', 'number', 'boolean', 'array', 'object', NULL][(1 + (p_partkey + k * p_size) % 6)::INTEGER] for k in [0, 1, 2]] AS types FROM part),
b(type, ordinal, value, usual) AS (VALUES ('string', 0, '""', '"x"'), ('string', 1, '"x"', '"x"'), ('string', 2, '" <b>Hello</b>, World 42! "', '"x"'),
  ('number', 0, '0', '1'), ('number', 1, '1', '1'), ('number', 2, '-1', '1'), ('boolean', 0, 'true', 'true'), ('boolean', 1, 'false', 'true'),
  ('array', 0, '[]', '[1]'), ('array', 1, '[1]', '[1]'), ('array', 2, 'null', '[1]'), ('object', 0, '{}', '{"k":"v"}'), ('object', 1, '{"k":"v"}', '{"k":"v"}'), ('object', 2, 'null', '{"k":"v"}')),
d AS (SELECT DISTINCT type, usual FROM b),
flat AS (SELECT target_id, types, unnest([0, 1, 2]) AS i FROM kinds)
SELECT v.target_id, v.i AS parameter, b.ordinal,
       array_to_string([CASE WHEN j = v.i THEN b.value ELSE coalesce(list_extract(us.u, j + 1), 'null') END for j in [0, 1, 2]], '|') AS arguments
FROM flat v JOIN b ON b.type = v.types[v.i + 1]
JOIN (SELECT target_id, list(coalesce(d.usual, 'null') ORDER BY i) AS u FROM flat LEFT JOIN d ON d.type = types[i + 1] GROUP BY target_id) us ON us.target_id = v.target_id""",
        "characterized": """
SELECT l_orderkey AS target_id,
       coalesce(arg_min(bad, l_linenumber * 100000 + l_partkey) FILTER (bad IS NOT NULL), CASE WHEN count(*) FILTER (l_tax <= 0.06) = 0 THEN 'ineligible' ELSE 'matched' END) AS verdict, count(*) AS cases
FROM (SELECT *, CASE WHEN l_quantity > 48 THEN 'ineligible' WHEN l_discount > 0.09 THEN 'mismatch' END AS bad FROM lineitem) GROUP BY l_orderkey""",
        "parameter_types": """
SELECT l_orderkey AS target_id, l_linenumber AS parameter,
       CASE WHEN count(DISTINCT l_returnflag) FILTER (l_returnflag <> 'R') = 1 THEN CASE max(l_returnflag) FILTER (l_returnflag <> 'R') WHEN 'A' THEN 'string' ELSE 'number' END
            WHEN count(*) FILTER (l_returnflag <> 'R') = 0 THEN 'boolean' END AS type
FROM lineitem GROUP BY 1, 2""",
        "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "input_classes": """
WITH k AS (SELECT s_suppkey AS k, 'r' || s_suppkey || '.js' AS path, 'box' || s_suppkey AS name FROM supplier)
SELECT path, name, k % 3 <> 1 AS matched, CASE k % 3 WHEN 0 THEN 'export class Box' || k || 'Component {' || chr(10) || '  @Input() a: any;' || chr(10) || '  @Input(''other'') b: any;' || chr(10) || '}'
  WHEN 2 THEN 'export class Box' || k || 'Component {' || chr(10) || '  @Input() a: any;' || chr(10) || '  @Input() b: any;' || chr(10) || '}' END AS output,
  CASE WHEN k % 3 = 1 THEN 'a binding is not one-way' END AS reason FROM k
UNION ALL SELECT path, name, k % 3 = 1, CASE WHEN k % 3 = 1 THEN 'export class Box' || k || 'Component {' || chr(10) || '  @Input() c: any;' || chr(10) || '}' END, CASE WHEN k % 3 <> 1 THEN 'duplicate name' END FROM k""",
        "http_calls": """
SELECT 'r' || s_suppkey || '.js' AS path, 3 AS line, CASE s_suppkey % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'post' WHEN 2 THEN 'jsonp' ELSE 'put' END AS verb,
       CASE WHEN s_suppkey % 2 = 0 THEN '/u/' || s_suppkey END AS url, s_suppkey % 4 IN (1, 3) AS has_body,
       CASE WHEN s_suppkey % 4 = 2 THEN 'jsonp' WHEN s_suppkey % 2 = 1 THEN 'the url is not a literal' END AS reason FROM supplier""",
        "literal_calls": "SELECT 'r' || s_suppkey || '.js' AS path, 'fmt' AS callee, '''' || s_name || ''',3' AS arguments FROM supplier",
        "event_buses": """
WITH p AS (
  SELECT cast(user_id AS VARCHAR) AS path, json_extract_string(props, '$.k') AS event, min(event_id) AS first_at FROM events WHERE event_type <> 'signup'
  GROUP BY 1, 2 HAVING count(*) FILTER (event_type IN ('click', 'view')) > 0 AND count(*) FILTER (event_type IN ('purchase', 'error')) > 0)
SELECT path, true AS matched, '@Injectable({ providedIn: ''root'' })' || chr(10) || 'export class EventBusService {' || chr(10) ||
       string_agg('  readonly userEv' || event || '$ = new Subject<any>();', chr(10) ORDER BY first_at) || chr(10) || '}' AS output, NULL::VARCHAR AS reason
FROM p GROUP BY path""",
        "router_tables": """
WITH r AS (SELECT c_custkey % 40 AS f, c_custkey AS k, c_custkey % 7 = 0 AS nameless, c_custkey % 11 = 3 AS otherwise FROM customer),
g AS (SELECT f, string_agg('  { path: ''list/item-' || k || ''', component: ListItem' || k || 'Component },', chr(10) ORDER BY k) FILTER (NOT otherwise AND NOT nameless) AS entries,
        count(*) FILTER (NOT otherwise AND nameless) AS skipped, arg_max(CASE WHEN nameless THEN '/' ELSE 'list/item-' || k END, k) FILTER (otherwise) AS fallback FROM r GROUP BY f)
SELECT 'app' || f AS path, CASE WHEN f < 25 THEN 'Mod' || f || 'Routes' ELSE 'AppRoutes' END AS constant,
       'export const ' || CASE WHEN f < 25 THEN 'Mod' || f || 'Routes' ELSE 'AppRoutes' END || ': Routes = [' || chr(10) || entries || coalesce(chr(10) || '  { path: ''**'', redirectTo: ''' || fallback || ''' },', '') || chr(10) || '];' AS output,
       skipped FROM g WHERE entries IS NOT NULL""",
        "compile_rounds": """
WITH RECURSIVE pending AS (SELECT c_custkey AS item, 'e' || c_custkey AS a, CASE WHEN c_custkey % 3 = 0 THEN 'h' || (c_custkey % 50) END AS b FROM customer),
logs AS (SELECT DISTINCT 1 + c_custkey % 4 AS round, CASE WHEN c_custkey % 2 = 0 THEN 'e' || c_custkey ELSE 'h' || (c_custkey % 50) END AS file FROM customer WHERE c_custkey % 10 IN (2, 5, 7) AND c_custkey % 4 <> 3),
r1 AS (SELECT DISTINCT first AS item FROM (SELECT file, min(item) AS first FROM logs JOIN pending ON file = a OR file = b WHERE round = 1 GROUP BY file)),
p2 AS (FROM pending WHERE item NOT IN (FROM r1)),
r2 AS (SELECT DISTINCT first AS item FROM (SELECT file, min(item) AS first FROM logs JOIN p2 ON file = a OR file = b WHERE round = 2 GROUP BY file)),
p3 AS (FROM p2 WHERE item NOT IN (FROM r2)),
r3 AS (SELECT DISTINCT first AS item FROM (SELECT file, min(item) AS first FROM logs JOIN p3 ON file = a OR file = b WHERE round = 3 GROUP BY file))
SELECT item, CASE WHEN item IN (FROM r1) THEN 1 WHEN NOT EXISTS (FROM logs WHERE round = 1) THEN NULL WHEN NOT EXISTS (FROM r1) THEN 1
  WHEN item IN (FROM r2) THEN 2 WHEN NOT EXISTS (FROM logs WHERE round = 2) THEN NULL WHEN NOT EXISTS (FROM r2) THEN 2
  WHEN item IN (FROM r3) THEN 3 WHEN NOT EXISTS (FROM logs WHERE round = 3) THEN NULL WHEN NOT EXISTS (FROM r3) THEN 3 END::INTEGER AS failed_round FROM pending""",
    }
    return out
