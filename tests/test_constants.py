"""What names stand for, by case: sums, chains of names, and all that takes a value away."""

import pytest

from loomspark.operators import constants, scopes, tokens


def known(spark, *texts):
    rows = tokens.bracketed(tokens.tokens(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, content string")))
    return constants.Constants(scopes.Scopes(rows))


CASES = [
    ("var a = '/x'; const b = a + \"/y\" + `z`; let c = b + a;", {"a": "/x", "b": "/x/yz", "c": "/x/yz/x"}),
    ("var a = 'it\\'s', b = a\nvar c = 'q'\nfoo(b)", {"a": "it's", "b": "it's", "c": "q"}),
    ("var a = 'x'; a = 'y'; var b = 'x'; b += 'y'; var c = 'x'; c++; var d = 'x'; --d; var e = 'x'; [e] = [1]; var f = 'x'; ({ f } = g);", dict.fromkeys("abcdef", constants.WRITTEN)),
    ("var a = 'x'; if (a == 'y' || a === b || a >= c || a <= d || f(a => a) || a + +c) {} o[a] = 1; o.a = 2; var h = a;", {"a": "x", "h": "x"}),
    ("var a = b + 'x'; var b = 'y' + a; var c = c + 'z'; var d = a + 'w';", dict.fromkeys("abcd", constants.NO_VALUE)),
    ("var a = 'x'; function f(a) { var b = a; } function g() { var a = 'y'; var c = a + 'z'; } var d = a;", {"b": constants.NO_VALUE, "c": "yz", "d": "x"}),
    ("var a = f(); var b = 'x' * 2; var c = 'x'.length; var d = 'x' + 1; var e = 'x'\n(1); var f = ['x']; var g = 'a\\n'; var h = `a${1}`;", dict.fromkeys("abcdefgh", constants.NO_SUM)),
    ("var a = 'x'; var a = 'y'; var b = 'x'; function b() {}", dict.fromkeys("ab", constants.MANY)),
    ("for (var a = 'x'; a < 'z'; a += 'q') {} for (let b = 'x', c = b; ; ) { g(c); } var d = 'x'; for (d in o) {}", {"a": constants.WRITTEN, "b": "x", "c": "x", "d": constants.WRITTEN}),
    ("var a = 'x'; function f({ a }) { return a; } var b = 'y'; try {} catch (b) {} var c = 'z'; const { c: q } = o; var d = 'w'; const { e: d } = o;", {"a": constants.WRITTEN, "b": constants.WRITTEN, "d": constants.WRITTEN}),
    ("var a = out + 'x'; var b = a; var c = 'x' +; var d = ; var e", {"a": constants.NO_VALUE, "b": constants.NO_VALUE, "c": constants.NO_SUM}),
]


def test_values_and_reasons_by_case(spark):
    got = {}
    for r in constants.constants(known(spark, *[t for t, _ in CASES])).collect():
        got.setdefault(int(r.path), {}).setdefault(r.name, []).append(r.reason if r.value is None else r.value)
    for k, (text, want) in enumerate(CASES):
        for name, value in want.items():
            assert value in got[k][name], (text, name, got[k])


def test_a_long_chain_and_sums_that_double(spark):
    chain = ";".join(["var a0 = 'x'", *[f"var a{k} = a{k - 1} + '{k % 10}'" for k in range(1, 7)]])
    double = ";".join(["var b0 = '0123456789'", *[f"var b{k} = b{k - 1} + b{k - 1}" for k in range(1, 13)]])
    found = {r.name: r for r in constants.constants(known(spark, chain, double)).collect()}
    assert found["a6"].value == "x123456"
    assert len(found["b9"].value) == 5120 and found["b10"].value is None and found["b12"].reason == constants.NO_VALUE


URLS = """
var base = '/api', users = base + '/users', moved = '/old';
moved += '/new';
$http.get('/plain').then(f);
$http.post(users + '/1', { a: 1 });
$http.get(moved);
$http.get(base + id);
function f(base) { $http.put(base + '/x'); $http.delete(users, base); }
$http.get();
$http.get(url('/x'));
// $http.get('/no');
other.get('/no'); $http.get('/a').get('/no'); $http.config('/no');
"""


def test_request_urls(spark):
    got = {(r.line, r.verb): (r.url, r.reason) for r in constants.request_urls(known(spark, URLS)).collect()}
    assert got == {
        (4, "get"): ("/plain", None), (5, "post"): ("/api/users/1", None), (6, "get"): (None, constants.NO_VALUE), (7, "get"): (None, constants.NO_VALUE), (8, "put"): (None, constants.NO_VALUE),
        (8, "delete"): ("/api/users", None), (9, "get"): (None, constants.NO_URL), (10, "get"): (None, constants.NO_SUM), (12, "get"): ("/a", None),
    }


@pytest.mark.parametrize("text", ["", "f(1);"])
def test_no_variables(spark, text):
    found = known(spark, text)
    assert constants.constants(found).count() == constants.request_urls(found).count() == 0
