"""The tables that queries read, and corpora built from them by formula.

The driver's tables hold no source code, so corpora are texts put together from keys. The
formulas are SQL that Spark and DuckDB both understand, so that an oracle starts from the
same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.sources.shared import shared_dir

#: A third of the texts hold a secret of some rule; shapes 8 and 9 are cases of overlap.
SECRET_CONTENT = """
concat('// file ', cast(p_partkey AS string), chr(10), 'var name = "', p_name, '";', chr(10),
CASE p_partkey % 12
  WHEN 0 THEN concat('const id = "AKIA', upper(substr(md5(p_name), 1, 16)), '";')
  WHEN 1 THEN concat('-----BEGIN RSA PRIVATE KEY-----', chr(10), md5(p_name), chr(10), md5(p_brand), chr(10), '-----END RSA PRIVATE KEY-----')
  WHEN 2 THEN concat('auth("ghp_', md5(p_name), 'abcdef', '")')
  WHEN 3 THEN concat('slack = "xoxb-', substr(md5(p_brand), 1, 14), '"')
  WHEN 4 THEN concat('jwt = eyJ', substr(md5(p_name), 1, 9), '.', substr(md5(p_type), 1, 12), '.', substr(md5(p_brand), 1, 12), ' end')
  WHEN 5 THEN concat('db = "postgres://user', cast(p_size AS string), ':pw', substr(md5(p_name), 1, 6), '@host', cast(p_size AS string), '/db"')
  WHEN 6 THEN concat('api_key = "', md5(p_name), '"; client-secret: ''', md5(p_type), '''')
  WHEN 7 THEN concat('APP_SECRET_KEY = ', substr(md5(p_name), 1, 5 + p_size % 9))
  WHEN 8 THEN concat('GITHUB_TOKEN=ghs_', md5(p_name), md5(p_brand))
  WHEN 9 THEN concat('API_KEY="', md5(p_type), '"', chr(10), 'DB_PASSWORD = mysql://u:', substr(md5(p_name), 1, 4), '@h/x')
  WHEN 10 THEN concat('var total = ', cast(p_size AS string), ';')
  ELSE concat('{{ ', p_type, ' }}')
END, chr(10), '// end')"""

SECRET_CORPUS = f"SELECT concat('src/part-', cast(p_partkey AS string), '.js') AS path, {SECRET_CONTENT} AS content FROM part"

#: Paths and contents of every kind of scope, ignored ones too.
SCOPE_CORPUS = """
SELECT concat(CASE s_suppkey % 9 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'app/dist/' ELSE 'app/' END, 'f', cast(s_suppkey AS string),
              CASE s_suppkey % 5 WHEN 0 THEN '.html' WHEN 1 THEN '.spec.js' WHEN 2 THEN '.min.js' ELSE '.js' END) AS path,
       CASE s_suppkey % 4
         WHEN 0 THEN concat('<p ng-if="a">', s_name, '</p>')
         WHEN 1 THEN concat('/** @license AngularJS v1.', cast(s_nationkey AS string), ' */ angular.module("x", [])')
         WHEN 2 THEN concat('angular', chr(10), '  .module("', s_name, '", [])')
         ELSE concat('var x = "', s_name, '";') END AS content
FROM supplier"""

#: A script for each customer: a module, registrations, routes and watchers that follow from the keys.
FACT_CORPUS = """
SELECT concat('app/c', cast(c_custkey AS string), '.js') AS path,
       concat('angular.module(''m', cast(c_custkey AS string), ''', [''n', cast(c_nationkey AS string), ''', "seg"])', chr(10),
              '  .controller(''C', cast(c_custkey AS string), ''', [''$scope'', ''svc'', function ($scope, svc) {', chr(10),
              CASE c_custkey % 3 WHEN 0 THEN concat('    $scope.$watch(''v', cast(c_custkey AS string), ''', f)') ELSE '    f()' END, chr(10),
              '  }])', chr(10),
              '  .', CASE c_custkey % 2 WHEN 0 THEN 'service' ELSE 'factory' END, '("S', cast(c_custkey AS string), '", function (http, q) {});', chr(10),
              'angular.module(''m', cast(c_custkey AS string), ''');', chr(10),
              CASE c_custkey % 4
                WHEN 0 THEN concat('$routeProvider', chr(10), '  .when(''/r', cast(c_custkey AS string), ''', {})', chr(10), '  .when(HOME, {});')
                WHEN 1 THEN concat('$stateProvider.state("s', cast(c_custkey AS string), '", {});')
                ELSE 'cases.when(1, 2);' END) AS content
FROM customer"""

#: Listings of a repository for each nation.
LISTING = """
SELECT concat('r', cast(n_nationkey AS string)) AS repo, path, content
FROM (
  SELECT n_nationkey, 'package.json' AS path, concat('{"dependencies": {"angular": "1.', cast(n_nationkey AS string), '.0"}}') AS content FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_nationkey, 'bower.json', CASE n_nationkey % 3 WHEN 0 THEN '{"devDependencies": {"angular": "~1.3"}}' WHEN 1 THEN '{"dependencies": {"jquery": "2"}}' ELSE '{ bad' END FROM nation WHERE n_nationkey % 3 < 2 OR n_nationkey % 4 = 0
  UNION ALL SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'gulpfile.js' WHEN 1 THEN 'Gruntfile.js' ELSE 'webpack.config.js' END, '' FROM nation WHERE n_nationkey % 5 <> 4
  UNION ALL SELECT n_nationkey, 'gulpfile.js', '' FROM nation WHERE n_nationkey % 3 = 2
  UNION ALL SELECT n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN 'karma.conf.js' ELSE 'test/karma.conf.js' END, CASE n_nationkey % 4 WHEN 0 THEN 'config.set({ browsers: [''PhantomJS''] })' ELSE 'config.set({ browsers: ["Chrome"] })' END FROM nation WHERE n_nationkey % 6 <> 5)"""

#: Artifacts from order lines: type, source, template and the evidence that a tier follows from.
ARTIFACTS = """
SELECT concat(cast(l_orderkey AS string), '-', cast(l_partkey AS string), '-', cast(l_suppkey AS string), '-', cast(l_linenumber AS string), '-', cast(cast(l_quantity AS int) AS string)) AS artifact_id,
       CASE l_linenumber % 4 WHEN 0 THEN 'controller' WHEN 1 THEN 'service' WHEN 2 THEN 'filter' ELSE 'directive' END AS artifact_type,
       concat('f', cast(l_orderkey AS string), '.js') AS source_file,
       CASE WHEN l_quantity > 25 THEN concat('f', cast(l_partkey AS string), '.js') END AS template_source,
       l_returnflag <> 'R' AS compiled,
       l_discount < 0.09 AS tests,
       CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_tax < 0.02 THEN 'mismatch' WHEN l_tax < 0.05 THEN 'ineligible' ELSE 'matched' END END AS characterization
FROM lineitem"""

FILES = "SELECT concat('f', cast(o_orderkey AS string), '.js') AS path, o_orderstatus <> 'P' AS matched FROM orders"

#: What a template is declared by: every line of an order.
DECLARATIONS = """
SELECT concat(cast(l_orderkey AS string), '-', cast(l_partkey AS string), '-', cast(l_suppkey AS string), '-', cast(l_linenumber AS string)) AS declaration_id, l_partkey, l_suppkey
FROM lineitem"""

#: Small files of three folders, two of which are never read.
SCAN = """
SELECT CASE s_suppkey % 4 WHEN 0 THEN 'node_modules' WHEN 1 THEN 'sub/dist' ELSE 'app' END AS folder, concat('f', cast(s_suppkey AS string)) AS name,
       concat('line of ', s_name, chr(10), 'end') AS content
FROM supplier"""

NAMES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()


#: Rows that a task makes texts of: a row of a few bytes becomes a text of a thousand and more.
TEXT_ROWS = 1 << 14


def spread(df: DataFrame, rows: int = TEXT_ROWS) -> DataFrame:
    """``df`` dealt by its first column so that a task has about ``rows`` rows; what is one part stays as read."""
    parts = 1 + df.count() // rows
    return df.repartition(parts, f"`{df.columns[0]}`") if parts > 1 else df


def texts(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """``sql`` for texts put together from keys. The rows are spread while they are small: a file of keys that one task reads may be gigabytes of texts."""
    return sql(spark, sf_dir, text, spread)


def sql(spark: SparkSession, sf_dir: str, text: str, dealt: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``text`` over the tables of ``sf_dir``, each as ``dealt`` gives it, passed as named frames."""
    used = {n: dealt(spark.read.parquet(f"{sf_dir}/{n}.parquet")) for n in NAMES if f" {n}" in text.replace("\n", " ")}
    text = text.replace("{", "{{").replace("}", "}}") if used else text
    for name in used:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}} AS {name}").replace(f"JOIN {name}", f"JOIN {{{name}}} AS {name}")
    return spark.sql(text, **used) if used else spark.sql(text)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
