"""What rewrites add to a file, and registrations and events that only tokens tell, by case."""

import pytest

from loomspark.operators import calls, declared
from loomspark.operators.facts import ARITY


def files(spark, *texts):
    return spark.createDataFrame([(f"p{k}", t) for k, t in enumerate(texts)], "path string, content string")


def test_only_what_the_file_did_not_have_is_added_and_once(spark):
    original = files(spark, "class A {} function f() { let B = 1; } // class C\nvar s = 'class D {}';", None)
    outputs = [
        ("p0", 0, "class A {} class B {} class C {}"), ("p0", 1, "class C {} class D {} const R: Routes = [];"), ("p0", 2, "const R : Routes = [], S: Routes = []; x.class; y = { class: Z };"),
        ("p1", 0, "class A {}"), ("gone", 7, "class A {}"), (None, 0, "class A {}"), ("p0", 3, None), ("p0", 4, ""),
    ]
    got = declared.added_declarations(spark.createDataFrame(outputs, "path string, ordinal int, content string"), original).collect()
    want = {("p0", 0, "C", True), ("p0", 1, "C", False), ("p0", 1, "D", True), ("p0", 1, "R", True), ("p0", 2, "R", False), ("p1", 0, "A", True), ("gone", 7, "A", True)}
    assert {(r.path, r.ordinal, r.name, r.emitted) for r in got} == want and len(got) == len(want)
    assert {r.reason for r in got} == {None, f"C {declared.TAKEN}", f"R {declared.TAKEN}"}


def test_no_files_and_no_outputs(spark):
    none = files(spark).withColumn("ordinal", declared.F.lit(0))
    assert declared.added_declarations(none, files(spark, "class A {}")).collect() == []
    assert [r.name for r in declared.added_declarations(files(spark, "class A {}").withColumn("ordinal", declared.F.lit(0)), files(spark)).collect()] == ["A"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("m.controller('A', ['$s', \"t\", function (a, /* , no */ b) {}])", [("A", ["$s", "t"], ["a", "b"], None)]),
        ("m\n.service('A', ['x', (a, b = f(1, 2)) => a])", [("A", ["x"], ["a", "b"], ARITY.format(1, 2))]),
        ("m.factory('A', ['x', async y => y,])", [("A", ["x"], ["y"], None)]),
        ("m.filter('A', ['x', function () { n.value('B', ['y', function named(y) {}]); }])", [("A", ["x"], [], ARITY.format(1, 0)), ("B", ["y"], ["y"], None)]),
        ("// m.controller('A', ['x', function (x) {}])\nvar s = \"m.controller('A', ['x', function (x) {}])\"; m.controller('A', [x, function (x) {}])", []),
        ("m.controller('A', [function (x) {}]); m.controller('A', ['x', 'y']); m.controller('A', [['x', function (x) {}]]); m.controller('A', ['x' + z, function (x) {}])", []),
    ],
)
def test_registrations_by_a_list(spark, text, want):
    got = sorted(calls.array_injections(files(spark, text)).collect(), key=lambda r: r.ordinal)
    assert [(r.name, r.dependencies, r.parameters, r.reason) for r in got] == want
    assert [r.ordinal for r in got] == list(range(len(want)))


def test_events_that_only_look_like_some(spark):
    text = "/* $scope.$emit('a') */ s = \"$scope.$emit('b')\"; $scope /* x */\n.$emit('it\\'s', 1); $scope.$on('c' + d, f); this.$scope.$on('e', f); $scope.f().$on('g', h); scope.$on(\"i\")"
    got = sorted(calls.event_usages(files(spark, text)).collect(), key=lambda r: r.ordinal)
    assert [(r.receiver, r.event, r.kind, r.line, text[r.start : r.start + 5]) for r in got] == [("$scope", "it's", "emit", 1, "$scop"), ("scope", "i", "on", 2, "scope")]
