"""The token table, nesting, chains and the facts on them, against plain walks and by case."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import calls, nesting, tokens


def corpus_of(spark, *texts):
    return spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "path string, content string").repartition(3)


def shown(spark, text):
    rows = tokens.all_tokens(corpus_of(spark, text)).orderBy("place").collect()
    assert "".join(r.text for r in rows) == text
    assert all(text[r.start : r.start + len(r.text)] == r.text and r.line == 1 + text[: r.start].count("\n") for r in rows)
    return [(r.kind, r.text) for r in rows if r.kind != "space"]


def plain_stack(signs):
    """depth, partner and parent of each of '(', ')' and other signs."""
    stack, out = [], []
    for k, c in enumerate(signs):
        if c == ")" and stack:
            o = stack.pop()
            out[o][1] = k
            out.append([len(stack), o, stack[-1] if stack else None])
        else:
            out.append([len(stack), None, stack[-1] if stack else None])
        if c == "(":
            stack.append(k)
    return [tuple(x) for x in out]


def test_nesting_is_that_of_a_stack(spark):
    rng = random.Random(4)
    cases = ["", ")", "(", "())(()", "((((", "))))(x)"] + ["".join(rng.choice("()x" if k % 3 else "(()x") for _ in range(rng.randint(0, 60))) for k in range(60)]
    rows = spark.createDataFrame([(k, p, c) for k, signs in enumerate(cases) for p, c in enumerate(signs)], "file int, place int, text string").repartition(5)
    got = {k: [] for k in range(len(cases))}
    for r in nesting.nested(rows, ["file"], "place", F.col("text") == "(", F.col("text") == ")").orderBy("file", "place").collect():
        got[r.file].append((r.depth, r.partner, r.parent))
    assert got == {k: plain_stack(signs) for k, signs in enumerate(cases)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("// it's\na/* ' \n*/b", [("comment", "// it's"), ("name", "a"), ("comment", "/* ' \n*/"), ("name", "b")]),
        (r"'a\'b' + " + '"c//d"', [("string", r"'a\'b'"), ("sign", "+"), ("string", '"c//d"')]),
        ("x = /[/'\"]\\//g.test(y) / 2 / z", [("name", "x"), ("sign", "="), ("pattern", "/[/'\"]\\//g"), ("sign", "."), ("name", "test"), ("sign", "("), ("name", "y"), ("sign", ")"), ("sign", "/"), ("number", "2"), ("sign", "/"), ("name", "z")]),
        ("return /'/;returned /2", [("name", "return"), ("pattern", "/'/"), ("sign", ";"), ("name", "returned"), ("sign", "/"), ("number", "2")]),
        ("/a b/ in x", [("pattern", "/a b/"), ("name", "in"), ("name", "x")]),
        ("`a${ {b: `c${'}'}`} }'` 'd'", [("template", "`a${ {b: `c${'}'}`} }'`"), ("string", "'d'")]),
        ("`$` + `$$a` + `\\`$`", [("template", "`$`"), ("sign", "+"), ("template", "`$$a`"), ("sign", "+"), ("template", "`\\`$`")]),
        ("'open\n/* open", [("sign", "'"), ("name", "open"), ("comment", "/* open")]),
        ("1.5e-3 .5 0x1F 𝔘é$_1 => =", [("number", "1.5e-3"), ("number", ".5"), ("number", "0x1F"), ("name", "𝔘é$_1"), ("sign", "=>"), ("sign", "=")]),
    ],
)
def test_tokens(spark, text, want):
    assert shown(spark, text) == want


def test_long_texts_and_empty_ones(spark):
    long = "'" + "\\n" * 60_000 + "'" + "/*" + "x\n" * 60_000 + "*/" + "`" + "$a" * 30_000 + "`"
    assert [k for k, _ in shown(spark, long)] == ["string", "comment", "template"]
    assert tokens.tokens(corpus_of(spark, None, "", " \n", "// only")).count() == 0
    assert tokens.bracketed(tokens.tokens(corpus_of(spark, "a").limit(0))).count() == 0


def test_a_file_given_twice_is_one(spark):
    twice = spark.createDataFrame([("p", "f(a)")] * 2 + [(None, "f(a)"), ("p", "f(b)")], "path string, content string")
    rows = tokens.bracketed(tokens.tokens(twice)).collect()
    assert len(rows) == 12 and {(r.text, r.partner) for r in rows} == {("f", None), ("(", 3), ("a", None), ("b", None), (")", 1)}


def test_calls_are_told_from_comments_and_strings(spark):
    text = "// x.filter('commented', f)\nvar s = \".service('quoted', f)\";\nm.controller(\"it's\", f);\nm.value('real', 1); /* .value('no', 1) */ var r = /.value('no', 1)/;"
    got = calls.registrations(corpus_of(spark, text)).orderBy("at").collect()
    assert [(r.kind, r.name, r.line) for r in got] == [("controller", "it's", 3), ("value", "real", 4)]


def test_dependencies_of_every_form(spark):
    cases = {
        "m.service('a', ['x', \"y\", function (x, y) { }])": "x,y", "m.service('a', function (x, /* , z */ y) {})": "x,y", "m.service('a', function named(x) {})": "x", "m.service('a', (x, y) => 1)": "x,y", "m.service('a', x => 1)": "x",
        "m.service('a', async function (q) {})": "q", "m.service('a', Named)": "", "m.service('a')": "", "m.service('a', ['x', y, 'z' + 1, function () {}])": "x", "m.service('a', function () {})": "", "m.service('a', (x))": "",
        "m.component('a', { controller: ['x', function (x) {}] })": "x", "m.component('a', { b: { controller: 'no' }, controllerAs: 'c', controller: function (p, q) { f({ controller: 1 }); } })": "p,q",
        "m.component('a', { controller($s) { return { a: [1, { b: 2 }] }; } })": "$s", "m.component('a', { 'controller': (z) => 1 })": "z", "m.component('a', { controller: 'Named' })": "", "m.component('a', function (no) {})": "", "m.component('a', {})": "",
        "angular.module('a', []).\n  directive('a', function (a, ...rest) {})": "a,rest",
    }
    got = {r.path: ",".join(r.dependencies) for r in calls.registrations(corpus_of(spark, *cases)).collect()}
    assert got == {f"f{k}": want for k, want in enumerate(cases.values())}


def test_modules_routes_and_watches(spark):
    text = """angular
  .module('a', ['b', "c"]).config(f);
angular.module('a'); x.angular.module('no', []); other.module('no', []); angular.module(name, []); angular.module('d', deps);
$routeProvider
  .when('/a', {})
  .otherwise({}).when(HOME + '/b', { a: [1, 2] });
cases.when('/no'); '$routeProvider'; x.when(1);
this.$stateProvider.state("s").state();
$scope.$watch('a.b', f); vm.$scope.$watchGroup([ 'a', 'b' ], f); other.$watch('no'); $rootScope.sub.$watchCollection(function () { return x, y; }, true);"""
    df = corpus_of(spark, text)
    assert [(r.line, r.name, r.depends_on) for r in calls.modules(df).orderBy("at").collect()] == [(1, "a", ["b", "c"]), (3, "d", [])]
    assert [(r.line, r.provider, r.path_or_state) for r in calls.routes(df).orderBy("at").collect()] == [(5, "ngRoute", "/a"), (6, "ngRoute", "HOME + '/b'"), (8, "ui-router", "s"), (8, "ui-router", "")]
    assert [(r.line, r.method, r.expression) for r in calls.watches(df).orderBy("at").collect()] == [
        (9, "$watch", "'a.b'"), (9, "$watchGroup", "[ 'a', 'b' ]"), (9, "$watchCollection", "function () { return x, y; }")]


def test_chains_have_roots_and_links(spark):
    df = corpus_of(spark, "a.b(x.y()).c(1)\n.d(); e[0].f(); g().h(); if (i) j.k(); (l).m(); new N().o()")
    got = [(r.method, r.root, r.link, r.links, r.plain) for r in calls.method_calls(tokens.bracketed(tokens.tokens(df))).orderBy("at").collect()]
    assert got == [("b", "a", 1, 3, True), ("y", "x", 1, 1, True), ("c", "a", 2, 3, True), ("d", "a", 3, 3, True), ("f", "e", 1, 1, False), ("h", "g", 2, 2, False), ("k", "j", 1, 1, True), ("m", "(", 1, 1, False), ("o", "N", 2, 2, False)]


def test_promise_chains_up_to_two_deep(spark):
    text = "$http.get(u).then(f); $http.post(u, d).then(f).catch(g); $http.get(u).then(a).then(b).catch(c); $http.get(u); $http.get(u).success(f).then(g); q.get(u).then(f); $http.get(u).then(f).finally(g); vm.$http.get(u).then(f); $http.put(u).then(function (r) { $http.get(v).then(h); })"
    got = [(r.verb, r.depth, r.reason) for r in calls.promise_chains(corpus_of(spark, text)).orderBy("at").collect()]
    assert got == [("get", 1, None), ("post", 2, None), ("get", 3, "chain of 3 calls, more than 2"), ("get", 1, None), ("put", 1, None), ("get", 1, None)]


def test_files_are_dealt_by_the_size_of_their_contents(spark):
    few = spark.range(12).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("a;\n"), 200_000).alias("content"))
    assert tokens.parts_of(few) == 7 and tokens.files_of(few).rdd.getNumPartitions() == 7
    assert tokens.parts_of(few.limit(0)) == 1


def test_facts_move_and_send_no_tokens(spark):
    df = corpus_of(spark, "$scope.$watch('a', f); m.service('b', ['c', function (c) {}]); $routeProvider.when(x, {}); $scope.$watch(", "$scope.$watch('a'")
    for query in (calls.watches, calls.registrations, calls.routes):
        found = query(df)
        plan = found._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.split("\n") if "Exchange" in line]
        assert "Broadcast" not in plan and all("REPARTITION_BY_NUM" in line for line in moved), moved
    assert [(r.path, r.expression) for r in calls.watches(df).orderBy("path", "at").collect()] == [("f0", "'a'"), ("f0", ""), ("f1", "")]


def test_parts_of_tokens_are_smaller_than_those_of_contents_and_no_more_than_buckets(spark, monkeypatch):
    few = spark.range(12).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("a;\n"), 200_000).alias("content"))
    assert tokens.token_parts(few) == 55 > tokens.parts_of(few)
    monkeypatch.setattr(tokens, "TOKEN_CHARS", 100)
    corpus = corpus_of(spark, *("a(b);\n" * 10 for _ in range(9)))
    assert tokens.token_parts(corpus) == tokens.all_tokens(corpus).rdd.getNumPartitions() == calls.Script.of(corpus).parts == 6
    monkeypatch.setattr(tokens, "MOST_PARTS", 4)
    assert tokens.token_parts(corpus) == 4 and tokens.token_parts(corpus.limit(0)) == 1


def test_a_stack_in_the_worker_nests_as_windows_do():
    rng = random.Random(8)
    cases = ["", ")", "(", "x", "())(()", "x((((", "))))(x)", ""] + ["".join(rng.choice("()x" if k % 3 else "(()x") for _ in range(rng.randint(0, 60))) for k in range(60)]
    steps = np.array([{"(": 1, ")": -1, "x": 0}[c] for signs in cases for c in signs], np.int8)
    groups, places = (np.array(x) for x in zip(*((k, p) for k, signs in enumerate(cases) for p in range(len(signs))), strict=True))
    got = [(d, *(None if x < 0 else x for x in rest)) for d, *rest in zip(*(x.tolist() for x in nesting.stacked(steps, groups, places)), strict=True)]
    assert got == [row for signs in cases for row in plain_stack(signs)]
    assert [len(x) for x in nesting.stacked(steps[:0], groups[:0], places[:0])] == [0, 0, 0]


def test_no_token_is_sorted_to_be_laid_out_and_paired(spark):
    texts = ("f(a, [b], { c: (d) })) // (\n}} g(", ") ] x", "", None, " \n", "((", "é = `(`; h('𝔘(') /[(]/ (")
    df = corpus_of(spark, *texts, *(f"f({k})" for k in range(300)))
    for rows in (tokens.all_tokens(df), tokens.tokens(df), tokens.bracketed_tokens(df)):
        assert "Window" not in rows._jdf.queryExecution().sparkPlan().toString()
    script = calls.Script(df)
    plan = calls.promise_chains(script)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, "windows of a file find its tokens where they lie"
    assert len({f.rsplit("_", 1)[-1] for f in script.rows.inputFiles()}) == len(script.rows.inputFiles()) <= script.parts, "one file a bucket"
    by_windows = tokens.bracketed(tokens.tokens(df))
    found = tokens.bracketed_tokens(df)
    assert found.columns == by_windows.columns and [f.dataType for f in found.schema] == [f.dataType for f in by_windows.schema]
    assert sorted(map(str, found.collect())) == sorted(map(str, by_windows.collect())) and found.count() > 1000
