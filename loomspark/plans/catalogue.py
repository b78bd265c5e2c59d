"""The registered queries: operators over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as fx
from loomspark.operators import calls, facts, listing, report, rewrite, secrets, templates, verify
from loomspark.plans import assembly, markup, oracle, scripts
from loomspark.plans.tables import ARTIFACTS, DECLARATIONS, FACT_CORPUS, FILES, LISTING, SCAN, SCOPE_CORPUS, SECRET_CORPUS, fresh_dir, read, sql, texts
from loomspark.sources import corpus
from loomspark.sources.files import read_files, write_files
from loomspark.streaming import live

#: A rule that the driver's documents do hold: a token of 40 hexadecimal digits.
TOKEN_RULE = (secrets.Rule("hex-token", "token of 40 hexadecimal digits", r"(?i)\btoken\s*=\s*['\"]?([0-9a-f]{40})", group=1),)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by rule, and how many files they are in, over the built corpus and the documents."""
    texts = sql(spark, sf_dir, SECRET_CORPUS).unionByName(document_corpus(spark, sf_dir))
    return secrets.findings_by_rule(secrets.findings(texts, secrets.RULES + TOKEN_RULE))


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


def secret_findings(spark, sf_dir):
    return secrets.findings(texts(spark, sf_dir, SECRET_CORPUS))


def secret_findings_by_rule(spark, sf_dir):
    return secrets.findings_by_rule(secret_findings(spark, sf_dir))


def secret_redacted(spark, sf_dir):
    return secrets.redact(texts(spark, sf_dir, SECRET_CORPUS))


def document_tokens(spark, sf_dir):
    return secrets.findings(document_corpus(spark, sf_dir), TOKEN_RULE).select("path", "line", "redacted_preview", "start")


def document_scope(spark, sf_dir):
    found = corpus.with_scope(document_corpus(spark, sf_dir))
    return found.groupBy("kind").agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars"))


def scope_counts(spark, sf_dir):
    return corpus.scope_counts(sql(spark, sf_dir, SCOPE_CORPUS))


def modules(spark, sf_dir):
    found = calls.modules(texts(spark, sf_dir, FACT_CORPUS))
    return found.select("path", "line", "name", F.array_join("depends_on", ",").alias("depends_on"))


def module_edges(spark, sf_dir):
    return calls.module_edges(texts(spark, sf_dir, FACT_CORPUS)).groupBy("depends_on").agg(F.count("*").alias("modules"))


def registrations(spark, sf_dir):
    found = calls.registrations(texts(spark, sf_dir, FACT_CORPUS))
    return found.select("path", "line", "kind", "name", F.array_join("dependencies", ",").alias("dependencies"))


def routes(spark, sf_dir):
    return calls.routes(texts(spark, sf_dir, FACT_CORPUS)).select("path", "line", "provider", "path_or_state")


def watches(spark, sf_dir):
    return calls.watches(texts(spark, sf_dir, FACT_CORPUS)).select("path", "line", "method", "expression")


def inventory_counts(spark, sf_dir):
    return calls.inventory(texts(spark, sf_dir, FACT_CORPUS))


def event_pairs(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "emit").when(F.col("event_type").isin("purchase", "error"), "on")
    usages = events.select(F.col("user_id").cast("string").alias("path"), F.get_json_object("props", "$.k").alias("event"), kind.alias("kind"), F.col("event_id").alias("ordinal"))
    return facts.paired_events(usages.where("kind IS NOT NULL"))


def repository_facts(spark, sf_dir):
    return listing.repository_facts(sql(spark, sf_dir, LISTING))


def remediated_configs(spark, sf_dir):
    configs = sql(spark, sf_dir, LISTING).where(F.col("path").endswith("karma.conf.js"))
    fixed = listing.without_phantom(F.col("content"))
    return configs.select("repo", "path", fixed.alias("content"), (fixed != F.col("content")).alias("changed"))


def artifacts(spark, sf_dir):
    rows = sql(spark, sf_dir, ARTIFACTS)
    evidence = [F.col(c) for c in ("compiled", "tests", "characterization")]
    return rows.withColumn("tier", report.decide_tier(*evidence)).withColumn("failed", report.failed_check(*evidence))


def tiers_by_type(spark, sf_dir):
    return report.tiers_by_type(artifacts(spark, sf_dir))


def failed_checks(spark, sf_dir):
    rows = artifacts(spark, sf_dir).where("failed IS NOT NULL")
    return rows.groupBy("artifact_type", "failed").agg(F.count("*").alias("n"))


def file_outcomes(spark, sf_dir):
    return report.file_outcomes(sql(spark, sf_dir, FILES), artifacts(spark, sf_dir))


def honest_rates(spark, sf_dir):
    return report.honest_rates(file_outcomes(spark, sf_dir))


def gate_results(spark, sf_dir):
    """A JSON report and an exit code for each artifact."""
    result = F.to_json(F.struct("artifact_type", "tier", "compiled", "tests"))
    return artifacts(spark, sf_dir).select("artifact_id", result.alias("result"), (F.col("tier") == "REJECTED").cast("int").alias("exit_code"))


def written_report(spark, sf_dir):
    """The file report, written as JSON lines over an older one and read again."""
    root = fresh_dir(spark, "report")
    report_rows = file_outcomes(spark, sf_dir)
    corpus.write_report(report_rows.limit(1), root)
    corpus.write_report(report_rows, root)
    return spark.read.schema(report_rows.schema).json(root)


def written_texts(spark, sf_dir):
    """Redacted texts, each written to a file of its own, and the files read again."""
    root = fresh_dir(spark, "texts")
    corpus.write_texts(secret_redacted(spark, sf_dir).select("path", F.col("redacted").alias("content")), root)
    found = read_files(spark, root).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory"), F.col("content").cast("string").alias("content"))
    return found.groupBy("directory").agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars"))


def scanned_corpus(spark, sf_dir):
    """Text files in folders of their own, scanned: ignored folders and names are not read."""
    root = fresh_dir(spark, "scan")
    line = F.concat(F.coalesce("content", F.lit("")), F.lit("\n"))
    path = F.concat("folder", F.lit("/name="), F.coalesce("name", F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit("/lines.txt"))
    lines = texts(spark, sf_dir, SCAN).groupBy(path.alias("path")).agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("content"))
    write_files(lines.repartition(spark.sparkContext.defaultParallelism, "path"), root)  # Spark's own writer opens, asks after and renames several folders for each of its files
    found = corpus.read_corpus(spark, root, ("txt",))
    name = F.regexp_extract("path", "name=([^/]*)/", 1)
    one = found.where(name == "f1")  # a single file
    return found.select(name.alias("name"), F.regexp_extract("path", "^([^/]*)/", 1).alias("folder"), F.rtrim(F.replace("content", F.lit("\n"), F.lit(" "))).alias("content")).unionByName(
        one.select(F.lit("single").alias("name"), F.lit("one").alias("folder"), F.length("content").cast("string").alias("content"))
    )


def template_resolution(spark, sf_dir):
    keys = sql(spark, sf_dir, DECLARATIONS)
    files = sql(spark, sf_dir, "SELECT concat('t/', cast(p_partkey AS string), '.html') AS path FROM part WHERE p_size > 40")
    # Declarations only name files of even numbers, so that some templates have no owner.
    candidates = [F.concat(F.lit("t/"), (2 * c).cast("string"), F.lit(".html")) for c in (F.col("l_suppkey"), F.col("l_partkey"), F.col("l_suppkey") + F.col("l_partkey"))]
    return report.resolve_templates(keys, files, candidates)


def orphan_templates(spark, sf_dir):
    files = sql(spark, sf_dir, "SELECT concat('t/', cast(p_partkey AS string), '.html') AS path FROM part WHERE p_size > 40")
    return report.orphan_templates(files, template_resolution(spark, sf_dir))


def unique_paths(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", report.F.concat(F.lit("out/"), F.regexp_replace("p_name", " ", "-"), F.lit(".pipe.ts")).alias("path"))
    return report.unique_paths(rows, "path", "p_partkey").select("p_partkey", "unique_path")


def first_claims(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_name").alias("name"))
    return report.first_claims(rows, ["p_brand", "name"], "p_partkey")


def fallback_routes(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_partkey").alias("target"))
    return report.last_to_end(rows, "l_suppkey", F.col("l_returnflag") == "R", "at", "target")


def first_place_last_value(spark, sf_dir):
    return report.first_place_last_value(read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "value").withColumnRenamed("last_value", "last_value_of")


def names(spark, sf_dir):
    rows = sql(spark, sf_dir, "SELECT p_partkey, concat(upper(substr(p_name, 1, 1)), replace(substr(p_name, 2), ' ', 'X'), ':', p_brand) AS name FROM part")
    path = F.concat(F.lit("/"), F.replace(F.col("name"), F.lit(":"), F.lit("/")))
    return rows.select(
        "p_partkey",
        fx.kebab_case(F.col("name")).alias("kebab"),
        fx.pascal_case(F.col("name")).alias("pascal"),
        fx.camel_words(F.col("name")).alias("camel"),
        fx.route_component(path).alias("component"),
        fx.router_path(path).alias("route"),
        fx.masked_preview(F.col("name")).alias("masked"),
        fx.directive_selector(F.col("name"), F.get(F.lit(["A", "E", "AE", None]), (F.col("p_partkey") % 4).cast("int"))).alias("selector"),
    )


def page_attributes(spark, sf_dir):
    found = templates.attributes(read(spark, sf_dir, "pages"), "page_id")
    return found.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"), F.max("line").alias("last_line"))


def page_tags(spark, sf_dir):
    return templates.tag_counts(read(spark, sf_dir, "pages"))


TEMPLATE_CORPUS = """
SELECT concat('t', cast(s_suppkey AS string), '.html') AS path,
       CASE s_suppkey % 4 WHEN 0 THEN concat('<p class="a" ng-if="x', cast(s_suppkey AS string), '">', s_name, '</p>')
         WHEN 1 THEN concat('<li ng-repeat="i in items', cast(s_suppkey AS string), '">{{i}}</li>')
         WHEN 2 THEN concat('<b ng-show="on">', s_name, '</b>')
         ELSE '<p ng-if="a | b">no</p>' END AS content
FROM supplier"""


def rewritten_templates(spark, sf_dir):
    return templates.rewrite_templates(sql(spark, sf_dir, TEMPLATE_CORPUS))


LOGS = """
SELECT o_orderkey AS log_id,
       concat('start', chr(10), CASE o_orderkey % 4 WHEN 0 THEN concat('src/a', cast(o_custkey AS string), '.ts:3:14 - error TS2304: Cannot find name ''x''.')
         WHEN 1 THEN concat(chr(27), '[96msrc/b.ts', chr(27), '[0m:10:2 - error TS-992003: No suitable token.')
         WHEN 2 THEN concat('src/c', cast(o_custkey % 7 AS string), '.ts(1,2): error NG8001: unknown element', chr(10), 'src/d.ts(1,2): warning NG1: no')
         ELSE 'all good' END, chr(10), 'end') AS log
FROM orders"""


def diagnostics(spark, sf_dir):
    return verify.diagnostics(sql(spark, sf_dir, LOGS))


def compile_rounds(spark, sf_dir):
    from loomspark.sources.shared import ready

    ready(spark)
    pending = sql(spark, sf_dir, "SELECT c_custkey AS item, c_custkey AS ordinal, concat('e', cast(c_custkey AS string)) AS emitted_path, CASE WHEN c_custkey % 3 = 0 THEN concat('h', cast(c_custkey % 50 AS string)) END AS template_path FROM customer")
    logs = sql(spark, sf_dir, "SELECT 1 + cast(c_custkey % 4 AS int) AS round, CASE WHEN c_custkey % 2 = 0 THEN concat('e', cast(c_custkey AS string)) ELSE concat('h', cast(c_custkey % 50 AS string)) END AS file FROM customer WHERE c_custkey % 10 IN (2, 5, 7) AND c_custkey % 4 <> 3")
    return verify.compile_rounds(pending, logs)


def boundary_rows(spark, sf_dir):
    types = F.array(*[F.get(F.lit(["string", "number", "boolean", "array", "object", None]), ((F.col("p_partkey") + F.lit(k) * F.col("p_size")) % 6).cast("int")) for k in range(3)])
    rows = verify.boundary_rows(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("target_id"), types.alias("types")))
    return rows.withColumn("arguments", F.array_join("arguments", "|"))


CASES = """
SELECT l_orderkey AS target_id, l_linenumber * 100000 + l_partkey AS ordinal,
       CASE WHEN l_tax > 0.06 THEN 'throw' ELSE 'return' END AS original_kind, cast(l_partkey % 5 AS string) AS original_key,
       CASE WHEN l_quantity > 48 THEN 'unrunnable' WHEN l_tax > 0.06 THEN 'throw' ELSE 'return' END AS rerun_kind, cast(l_partkey % 5 AS string) AS rerun_key,
       CASE WHEN l_tax > 0.06 THEN 'throw' ELSE 'return' END AS migrated_kind, cast(CASE WHEN l_discount > 0.09 THEN 9 ELSE l_partkey % 5 END AS string) AS migrated_key
FROM lineitem"""


def characterized(spark, sf_dir):
    return verify.characterized(sql(spark, sf_dir, CASES))


def parameter_types(spark, sf_dir):
    usages = sql(spark, sf_dir, "SELECT l_orderkey AS target_id, l_linenumber AS parameter, CASE l_returnflag WHEN 'A' THEN 'string' WHEN 'R' THEN 'boolean' ELSE 'number' END AS evidence FROM lineitem")
    return verify.parameter_types(usages)


def event_windows(spark, sf_dir):
    found = live.event_counts(read(spark, sf_dir, "events"), "1 hour")
    return found.withColumn("total", F.round("total", 4))


REWRITE_CORPUS = """
SELECT concat('r', cast(s_suppkey AS string), '.js') AS path,
       concat('m.component(''box', cast(s_suppkey AS string), ''', { bindings: { a: ''<'', b: ''', CASE s_suppkey % 3 WHEN 0 THEN '<?other' WHEN 1 THEN '=' ELSE '<' END, ''' } });', chr(10),
              'm.component(''box', cast(s_suppkey AS string), ''', { bindings: { c: ''<'' } });', chr(10),
              '$http.', CASE s_suppkey % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'post' WHEN 2 THEN 'jsonp' ELSE 'put' END, '(', CASE s_suppkey % 2 WHEN 0 THEN concat('"/u/', cast(s_suppkey AS string), '"') ELSE 'base + id' END, ');', chr(10),
              'fmt(''', s_name, ''', 3); fmt(x, 4);') AS content
FROM supplier"""


def input_classes(spark, sf_dir):
    return rewrite.input_classes(sql(spark, sf_dir, REWRITE_CORPUS))


def http_calls(spark, sf_dir):
    return rewrite.http_calls(sql(spark, sf_dir, REWRITE_CORPUS))


def literal_calls(spark, sf_dir):
    return rewrite.literal_calls(sql(spark, sf_dir, REWRITE_CORPUS)).where("callee = 'fmt'").select("path", "callee", "arguments")


def event_buses(spark, sf_dir):
    named = event_pairs(spark, sf_dir).withColumn("event", F.concat(F.lit("user:ev-"), F.col("event")))
    return rewrite.event_buses(named)


def router_tables(spark, sf_dir):
    found = sql(spark, sf_dir, "SELECT concat('app', cast(c_custkey % 40 AS string)) AS path, c_custkey AS ordinal, CASE c_custkey % 7 WHEN 0 THEN '//' ELSE concat('/list/item-', cast(c_custkey AS string)) END AS path_or_state, c_custkey % 11 = 3 AS otherwise FROM customer")
    modules = sql(spark, sf_dir, "SELECT concat('app', cast(n_nationkey AS string)) AS path, 1 AS ordinal, concat('shop.mod', cast(n_nationkey AS string)) AS name FROM nation")
    return rewrite.router_tables(found, modules)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        secret_findings, secret_findings_by_rule, secret_redacted, document_tokens, document_scope, scope_counts, modules, module_edges, registrations,
        routes, watches, inventory_counts, event_pairs, repository_facts, remediated_configs, tiers_by_type, failed_checks, file_outcomes, honest_rates,
        gate_results, written_report, written_texts, scanned_corpus, template_resolution, orphan_templates, unique_paths, first_claims, fallback_routes, first_place_last_value, names, page_attributes, page_tags,
        rewritten_templates, diagnostics, compile_rounds, boundary_rows, characterized, parameter_types, event_windows, input_classes, http_calls, literal_calls, event_buses, router_tables,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | assembly.QUERIES | scripts.QUERIES | markup.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracle.statements() | assembly.SQL | scripts.SQL | markup.SQL
