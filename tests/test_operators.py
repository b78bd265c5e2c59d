import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as fx
from loomspark.operators import calls, listing, report, secrets, templates, verify
from loomspark.sources import corpus, shared
from loomspark.streaming import live


def corpus_of(spark, *texts):
    return spark.createDataFrame([(f"f{k}.js", t) for k, t in enumerate(texts)], "path string, content string")


KEY = "AKIA" + "ABCDEFGH12345678"
TOKEN = "ghp_" + "a1B2" * 9


def test_each_rule_finds_its_secret_on_its_line(spark):
    cases = {
        "aws-access-key-id": f"a\nb = '{KEY}'",
        "private-key-block": "x\n-----BEGIN EC PRIVATE KEY-----\nabc\n-----END EC PRIVATE KEY-----",
        "github-token": f"\nlogin({TOKEN})",
        "slack-token": "\nxoxp-1234567890ab",
        "jwt": "\neyJabcdef.ghijkl.mnopqr",
        "connection-string": "\nurl: mongodb+srv://me:pw@host/db",
        "generic-api-key-assignment": "\nclient_secret: 'abcdefghij0123456789'",
        "env-style-secret-line": "\nMY_PASSWORD_2 = hunter2",
    }
    found = secrets.findings(corpus_of(spark, *cases.values(), "plain = 1", None)).collect()
    assert sorted((r.pattern_id, r.line) for r in found) == sorted((k, 2) for k in cases)


def test_one_secret_counts_once_and_the_earlier_rule_wins(spark):
    found = secrets.findings(corpus_of(spark, f'GITHUB_TOKEN={TOKEN}\nAPI_KEY="{"z" * 20}" {KEY}')).collect()
    assert [r.pattern_id for r in found] == ["github-token", "generic-api-key-assignment", "aws-access-key-id"]
    assert found[0].redacted_preview == "ghp_" + "*" * 32 + TOKEN[-4:]


def test_redaction_keeps_the_rest(spark):
    texts = [f"a {KEY} b {KEY}", "nothing", None, "SECRET=SECRET"]
    got = {r.path: (r.redacted, r.n_findings) for r in secrets.redact(corpus_of(spark, *texts)).collect()}
    mark = "[REDACTED:aws-access-key-id]"
    assert got == {"f0.js": (f"a {mark} b {mark}", 2), "f1.js": ("nothing", 0), "f2.js": (None, 0), "f3.js": ("SECRET=[REDACTED:env-style-secret-line]", 1)}


def test_scope_order_and_ignored_paths(spark):
    rows = [
        ("a.html", "<p ng-if='x'>", "template"), ("b.html", "<p>", "out"), ("c.js", "/* @license AngularJS v1.8 */ angular.module('a', [])", "vendored"),
        ("d.js", " " * 300 + "@license AngularJS v1 angular . module ('a')", "script"), ("e.js", "var x", "out"), ("node_modules/f.js", "angular.module('a')", None), ("g.min.js", "angular.module('a')", None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "path string, content string")
    assert {r.path: r.kind for r in corpus.with_scope(df).collect() if "/" not in r.path and "min" not in r.path} == {p: k for p, _, k in rows if k}
    assert {r.kind: r.files for r in corpus.scope_counts(df).collect()} == {"template": 1, "out": 2, "vendored": 1, "script": 1}


@pytest.mark.parametrize("root", ["app/dist/app", "my+repo", "data/myrepo/repo", "build/x y%20z", "a+b/a+b/", "é"])
def test_the_root_is_cut_off_whatever_its_name(spark, tmp_path, root):
    names = {"dist/no.js": None, "x.js": "x", "app/repo/a+b/y z%41.js": "y", "é/w.html": "w", "my+repo/v.js": "v", "node_modules/n.js": None}
    for name in names:
        file = tmp_path / root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(name[-4:])
    want = sorted(n for n, kept in names.items() if kept)
    for given in (f"{tmp_path}/{root}", f"file:{tmp_path}/{root}"):
        if "%" in root and given.startswith("file:"):
            continue
        assert sorted(r.path for r in corpus.read_corpus(spark, given).collect()) == want


def test_files_are_read_whole_and_filtered(spark, tmp_path):
    for name, text in {"app/a.js": "x\r\ny", "app/b.html": "<p>", "dist/c.js": "no", "a.spec.js": "no", "d.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    got = {r.path: r.content for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {"app/a.js": "x\ny", "app/b.html": "<p>"}
    with pytest.raises(ValueError):
        corpus.write_texts(corpus.read_corpus(spark, str(tmp_path)), str(tmp_path), str(tmp_path) + "/")


def test_facts_of_a_script(spark):
    script = """angular.module('shop', ['ngRoute', "ui"])
  .controller('Main', ['$scope', 'api', function ($scope, api) { $rootScope.$watchCollection('items', f); }])
  .filter("trim", function () { return 1; })
  .value('limit', 3);
angular.module('shop').service('api', ($http, $q) => 1);
$routeProvider.when('/home', {}).when(OTHER, {}); cases.when('no');
$stateProvider
  .state('s', {});"""
    df = corpus_of(spark, script, None)
    assert [(r.name, r.depends_on, r.line) for r in calls.modules(df).collect()] == [("shop", ["ngRoute", "ui"], 1)]
    assert [(r.kind, r.name, r.line, r.dependencies) for r in calls.registrations(df).orderBy("at").collect()] == [
        ("controller", "Main", 2, ["$scope", "api"]), ("filter", "trim", 3, []), ("value", "limit", 4, []), ("service", "api", 5, ["$http", "$q"]),
    ]
    assert [(r.provider, r.path_or_state, r.line) for r in calls.routes(df).orderBy("line", "at").collect()] == [("ngRoute", "/home", 6), ("ngRoute", "OTHER", 6), ("ui-router", "s", 8)]
    assert [(r.method, r.expression, r.line) for r in calls.watches(df).collect()] == [("$watchCollection", "'items'", 2)]


def test_repository_facts(spark):
    rows = [
        ("r", "bower.json", '{"dependencies": {"angular": ""}}'), ("r", "package.json", '{"dependencies": {"angular": "1.5"}}'), ("r", "gulpfile.js", ""), ("r", "webpack.config.js", ""),
        ("r", "karma.conf.js", 'browsers: ["PhantomJS", "Chrome"]'), ("s", "package.json", "{ bad"), ("s", "readme", "x"), ("t", "package.json", '{"dependencies": {"@angular/core": "9"}}'), ("t", "Gruntfile.js", ""),
    ]
    df = spark.createDataFrame(rows, "repo string, path string, content string")
    got = {r.repo: tuple(r)[1:] for r in listing.repository_facts(df).collect()}
    assert got == {"r": ("", "bower.json", "webpack", "karma.conf.js", True), "s": (None, None, "none", None, False), "t": (None, None, "grunt", None, False)}
    fixed = df.where("path = 'karma.conf.js'").select(listing.without_phantom(F.col("content"))).first()[0]
    assert fixed == 'browsers: ["ChromeHeadless", "Chrome"]'


def test_or_join_has_no_nested_loop(spark):
    artifacts = spark.createDataFrame([(1, "a", "b", "LOW"), (2, "c", "c", "MEDIUM"), (3, "a", None, "REJECTED")], "artifact_id int, source_file string, template_source string, tier string")
    files = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True), ("e", False)], "path string, matched boolean")
    got = report.file_outcomes(files, artifacts)
    assert {r.path: r.outcome for r in got.collect()} == {"a": "LOW", "b": "LOW", "c": "MEDIUM", "d": "NOT_EMITTED", "e": "NO_MATCH"}
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rates = report.honest_rates(got).first()
    assert (rates.in_scope, rates.matched, rates.compiled, rates.match_rate, rates.compile_rate) == (5, 4, 3, 0.8, 0.6)


def test_edits_and_names(spark):
    df = spark.createDataFrame([("abcdef", [(1, 2, "X"), (4, 6, "")])], "t string, e array<struct<start:int,stop:int,replacement:string>>")
    assert df.select(report.apply_edits(F.col("t"), F.col("e"))).first()[0] == "aXcd"
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(fx.camel_words(F.lit("user:logged-In"))) == "userLoggedIn"
    assert one(fx.routes_constant(F.lit("app.shop-cart"))) == "ShopCartRoutes" and one(fx.routes_constant(F.lit("a."))) == "AppRoutes"
    assert one(fx.single_quoted(F.lit("a'b\\c\n"))) == "a\\'b\\\\c\\n"
    assert one(fx.rate(F.lit(1), F.lit(16))) == 0.063 and one(fx.rate(F.lit(0), F.lit(0))) == 0.0
    assert one(fx.emitted_path(F.lit("src"), F.lit("userFilter"), F.lit("filter"))) == "src/user.filter.ts"
    assert one(fx.emitted_path(F.lit("src"), F.lit("filter"), F.lit("filter"))) == "src/filter.filter.ts"


def test_compile_rounds(spark):
    shared.ready(spark)
    pending = spark.createDataFrame([("a", 1, "a.ts", "t.html"), ("b", 2, "b.ts", "t.html"), ("c", 3, "c.ts", None)], "item string, ordinal int, emitted_path string, template_path string")
    log = lambda *rows: spark.createDataFrame(list(rows), "round int, file string")
    run = lambda df: {r.item: r.failed_round for r in verify.compile_rounds(pending, df).collect()}
    assert run(log((1, "t.html"), (2, "c.ts"))) == {"a": 1, "b": None, "c": 2}
    assert run(log((1, "a.ts"), (2, "t.html"))) == {"a": 1, "b": 2, "c": None}
    assert run(log((1, "other.ts"))) == {"a": 1, "b": 1, "c": 1}
    assert run(spark.createDataFrame([], "round int, file string")) == {"a": None, "b": None, "c": None}


def test_earliest_case_decides(spark):
    ok, threw, lost = ("return", "1"), ("throw", "E"), ("unrunnable", None)
    rows = [("x", 1, ok, ok, ok), ("x", 2, ok, lost, ok), ("x", 3, ok, ok, threw), ("y", 1, ok, ok, threw), ("y", 2, ok, lost, ok), ("z", 1, threw, threw, threw), ("w", 1, ok, ok, ok), ("w", 2, threw, threw, threw)]
    df = spark.createDataFrame([(t, o, *a, *b, *c) for t, o, a, b, c in rows], "target_id string, ordinal int, original_kind string, original_key string, rerun_kind string, rerun_key string, migrated_kind string, migrated_key string")
    assert {r.target_id: r.verdict for r in verify.characterized(df).collect()} == {"x": "ineligible", "y": "mismatch", "z": "ineligible", "w": "matched"}


def test_templates(spark):
    html = '<p class="a" ng-if="ok">x</p><li ng-repeat="i in xs track by i.id">y</li><b ng-show="a | b">n</b><i ng-show="s">z</i>'
    row = templates.rewrite_templates(corpus_of(spark, html)).first()
    assert row.output == '@if (ok) {<p class="a">x</p>}@for (i of xs; track i.id) {<li>y</li>}<b ng-show="a | b">n</b><i [hidden]="!(s)">z</i>'


def test_streams_equal_batches(spark, tmp_path):
    corpus_of(spark, f"x {KEY}", "none", "MY_TOKEN=1").write.parquet(str(tmp_path / "c"))
    streamed = live.replay(spark, str(tmp_path / "c"), "path string, content string", live.stream_findings)
    batch = secrets.findings(spark.read.parquet(str(tmp_path / "c")))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect())) != []
    events = spark.sql("SELECT timestamp'2024-01-01' + make_interval(0,0,0,0,0,id) AS ts, 'k' || id % 2 AS event_type, 1.0D AS value FROM range(40)")
    events.write.parquet(str(tmp_path / "e"))
    counted = live.replay(spark, str(tmp_path / "e"), events.schema, live.event_counts, "complete")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, live.event_counts(events).collect())) and counted.count() == 8
