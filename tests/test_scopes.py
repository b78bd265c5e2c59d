"""What names are bound to, whose ``this`` they have, and what a declaration needs, by case."""

import re

import pytest
from pyspark.sql import functions as F

from loomspark.operators import scopes, tokens


def scopes_of(spark, text):
    """Marks ``name@n``: the name is bound to the scope whose number ``n`` stands in a mark ``#n`` behind the token that opens it."""
    clean, marks, opened, at = [], {}, {}, 0
    for part in re.split(r"(@-?\w+|#\d+)", text):
        if part.startswith("@"):
            marks[at] = part[1:]
        elif part.startswith("#"):
            opened[at] = part[1:]
        else:
            clean.append(part)
            at += len(part)
    rows = tokens.bracketed(tokens.tokens(spark.createDataFrame([("p", "".join(clean))], "path string, content string")))
    ends = {r.start + len(r.text): r for r in rows.collect()}
    number = {ends[a].place: n for a, n in opened.items()} | {scopes.FILE: "file"}
    bound = {r.place: r.scope for r in scopes.Scopes(rows).bindings().collect()}
    got = {a: "free" if bound[ends[a].place] is None else number.get(bound[ends[a].place], "?") for a in marks}
    return got, marks


@pytest.mark.parametrize(
    "text",
    [
        "var a = 1; function f(#1b) { return a@file + b@1 + c@free + f@file; }",
        "function f(#1a) { var a; g(#9a@1); return function (#2a) { return a@2; } }",
        "function f(#1x) { x@1; (function (#2) { var x = 1; x@2; }()); x@1.y; y@free; }",
        "var f = function g(#1) { return g@1; }; g@free; f@file;",
        "function f(#1) { if (q) { var v; let#8 w = 1; w@3; v@1; } w@free; }".replace("{ var v", "{#3 var v").replace("let#8", "let"),
        "var x = x#1 => x@1 + y@free, z = (#2x, y) => { return x@2 + y@2 + z@file; }; x@file;",
        "var a = 1, b = f(1, 2), c; function h(#1) { return a@file + b@file + c@file; }",
        "o = { a: a@free, m(#1a) { return a@1; }, n: function (#2b) { return b@2 + m@free; } };",
        "function outer(#1) { function inner(#2) { return outer@file(inner@1); } return inner@1; } inner@free;",
        "x#1 => x#2 => x@2; f(y#3 => y@3, y@free);",
    ],
)
def test_names_are_bound_to_the_nearest_scope_that_declares_them(spark, text):
    got, want = scopes_of(spark, text)
    assert got == want and want


def test_this_is_that_of_the_nearest_function_that_is_no_arrow(spark):
    text = "function a() { this; [1].map(() => this); [1].map(function () { this; }); var o = { m() { return () => this; } }; } this;"
    rows = tokens.bracketed(tokens.tokens(spark.createDataFrame([("p", text)], "path string, content string")))
    found = scopes.Scopes(rows)
    starts = {r.start: (r.kind, r.name) for r in found.functions.collect()}
    owned = found.owned(("function", "declaration", "method")).where("text = 'this'").orderBy("place").collect()
    assert [starts.get(r.owner) for r in owned] == [("declaration", "a"), ("declaration", "a"), ("function", None), ("method", "m"), None]


def test_no_functions_and_no_rows(spark):
    for text in ("a = b;", ""):
        rows = tokens.bracketed(tokens.tokens(spark.createDataFrame([("p", text)], "path string, content string")))
        found = scopes.Scopes(rows)
        assert found.functions.count() == found.declarations().count() == 0
        assert {(r.name, r.scope, r.owner) for r in found.bindings().collect()} == ({("a", None, None), ("b", None, None)} if text else set())


def test_innermost_spans(spark):
    rows = spark.createDataFrame([("k", p, "x") for p in range(12)] + [("other", 3, "y")], "key string, place int, _at string")
    spans = spark.createDataFrame([("k", 1, 9), ("k", 2, 5), ("k", 5 + 1, 9), ("k", 7, 7), ("k", 11, 11)], "key string, start int, stop int")
    got = {(r.key, r.place): r["in"] for r in scopes.innermost(rows.drop("_at"), spans, ["key"], "in").collect()}
    want = {0: None, 1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 6, 7: 7, 8: 6, 9: 6, 10: None, 11: 11}
    assert got == {("k", p): w for p, w in want.items()} | {("other", 3): None}


def test_owners_are_found_by_moving_places_alone(spark):
    corpus = spark.createDataFrame([("p", "function f(a) { return a; } f(1);"), ("q", "x")], "path string, content string")
    found = scopes.Scopes.of(corpus)
    moved = [line for line in found.owned()._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]
    assert len(moved) == 1 and "REPARTITION_BY_NUM" in moved[0], moved
    assert [r.owner for r in found.owned().where("path = 'p' AND text = 'a'").orderBy("place").collect()] == [2, 2]
