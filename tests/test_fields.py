"""Fields of a function's own ``this``, by case."""

import pytest

from loomspark.operators import fields, scopes, tokens


def fields_of(spark, *texts):
    rows = tokens.bracketed(tokens.tokens(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, content string")))
    return fields.assigned_fields(scopes.Scopes(rows))


CASES = [
    ("function A() { this.x = 1; this.y = this.x; this.x = 2; }", {"A": ["x", "y"]}),
    ("function A() { var vm = this; vm.x = 1; f(function () { vm.y = 2; this.no = 3; }); f(() => { this.z = 4; }); }", {"A": ["x", "y", "z"], None: ["no"]}),
    ("function A() { var vm = this; f(function (vm) { vm.no = 1; }); f(function () { var vm = {}; vm.no = 2; }); vm.x = 1; }", {"A": ["x"]}),
    ("function A() { var q = 1, self = this\nself.x = 1; o.self.no = 2; self.a.no = 3; this.b.no = 4; self['no'] = 5; }", {"A": ["x"]}),
    ("function A() { if (this.no == 1 || this.no === 2) {} this.no += 1; this.no++; f(this.no => 1); this.x =1; }", {"A": ["x"]}),
    ("function A() { var vm = this.o; vm.no = 1; var w = this || {}; w.no = 2; }", {}),
    ("var top = this; top.no = 1; this.no = 2;", {}),
    ("var o = { m() { this.x = 1; const me = this; return () => { me.y = 2; }; } };", {"m": ["x", "y"]}),
    ("function A() { var vm; vm = this; vm.no = 1; } function B() { vm.no = 1; }", {}),
]


def test_fields_by_case(spark):
    got = {}
    for r in fields_of(spark, *[t for t, _ in CASES]).collect():
        got.setdefault(int(r.path), {}).setdefault(r.name, []).append((r.place, r.field))
    for k, (text, want) in enumerate(CASES):
        assert {name: [f for _, f in sorted(found)] for name, found in got.get(k, {}).items()} == want, text


def test_declarations_in_the_order_of_first_use(spark):
    found = fields_of(spark, "function A() {\n var vm = this;\n vm.b = 1;\n vm.a = 2;\n vm.b = 3; }")
    assert [(r.field, r.line, r.n) for r in found.orderBy("place").collect()] == [("b", 3, 2), ("a", 4, 1)]
    assert [r.output for r in fields.field_declarations(found).collect()] == ["  b: any;\n  a: any;"]


@pytest.mark.parametrize("text", ["", "this;"])
def test_no_fields(spark, text):
    assert fields_of(spark, text).count() == 0
