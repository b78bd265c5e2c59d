"""Assembly, edits and characterisation: cases that the tables do not hold."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import assemble, calls, evidence, facts, templates, verify
from loomspark.plans import catalogue


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("kind", "value", "key"),
    [
        ("json", '{"b": 1.0, "a": [2, {"d": 1, "c": null}]}', '{"$":"Object","v":[["a",[2,{"$":"Object","v":[["c",null],["d",1]]}]],["b",1]]}'),
        ("json", '{"\\ue000": 1, "\\ud83d\\ude00": 2}', '{"$":"Object","v":[["😀",2],["\ue000",1]]}'),
        ("json", "true", "true"),
        ("json", "1e21", "1e+21"),
        ("number", "-0", '{"$":"number","v":"-0"}'),
        ("number", "-Infinity", '{"$":"number","v":"-Infinity"}'),
        ("number", "3.0", "3"),
        ("undefined", None, '{"$":"undefined"}'),
        ("Date", "2020-02-30", '{"$":"Date","v":"Invalid"}'),
        ("Set", "[1, 1.0]", '{"$":"Set","v":[1,1]}'),
        ("String", "a", '{"$":"String","v":"a"}'),
    ],
)
def test_canonical_forms(kind, value, key):
    assert evidence.canonical_text(kind, value) == (key, None)


@pytest.mark.parametrize("kind", ["function", "symbol", "Promise", None])
def test_values_without_a_form_give_a_reason(kind):
    assert evidence.canonical_text(kind, "x") == (None, f"a {kind}")


def test_boundary_values_are_the_fixed_ones(spark):
    rows = verify.boundary_rows(spark.createDataFrame([(1, ["string", None, "object"])], "target_id int, types array<string>"))
    got = [r.arguments for r in rows.orderBy("parameter", "ordinal").collect()]
    assert got == [[s, "null", '{"k":"v"}'] for s in ('""', '"x"', '" <b>Hello</b>, World 42! "')] + [['"x"', "null", o] for o in ("{}", '{"k":"v"}', "null")]


def test_masking_keeps_the_length(spark):
    text = "<p>{{ a < b }}</p>{{ {{ > }} > {{ <"
    got = one(spark, templates.masked_interpolations(F.col("t")), t=text)
    assert got == "<p>{{ a   b }}</p>{{ {{   }} > {{  " and len(got) == len(text)


@pytest.mark.parametrize(
    ("text", "twice"),
    [('<p a b a="1">', True), ('<p a="1" A>', True), ("<p a=1 b=a>", False), ('<p a="x a=1">', False), ("<p a='>' b><i a>", False), ("{{ <p a a> }}", False), ("<p\na\na/>", True), ("plain a a", False)],
)
def test_duplicate_attributes(spark, text, twice):
    assert one(spark, templates.has_duplicate_attribute(F.col("t")), t=text) is twice


def test_identifiers_are_whole_words(spark):
    text = "class A { InputX; $Pipe; Subject$; Subject }"
    assert one(spark, assemble.import_lines(F.col("t")), t=text) == "import { Subject } from 'rxjs';\n"


def test_events_of_scopes_alone(spark):
    text = "a.scope.$on('x', f); $scope.$emit(n); scope\n .$on(\"y\", f); myscope.$on('z'); $rootScope.$broadcast('w')"
    got = calls.event_usages(spark.createDataFrame([("p", text)], "path string, content string")).collect()
    assert [(r.receiver, r.event, r.kind, r.line) for r in got] == [("scope", "y", "on", 1), ("$rootScope", "w", "emit", 2)]


def test_names_are_claimed_by_what_survives(spark):
    rng = random.Random(1)
    rows = [(f"f{p}", k, f"v{rng.randint(0, 2)}", rng.random() < 0.3, sorted({f"n{rng.randint(0, 5)}" for _ in range(rng.randint(0, 3))})) for p in range(40) for k in range(rng.randint(1, 6))]
    want = {}
    for p in {r[0] for r in rows}:
        used = set()
        for _, k, variable, fails, names in sorted(r for r in rows if r[0] == p):
            kept = [n for n in names if n not in used]
            survives = bool(kept) and not fails and variable not in used
            used |= {*kept, variable} if survives else set()
            want[p, k] = (survives, kept if survives else [])
    frame = spark.createDataFrame(rows, "path string, ordinal int, variable string, fails boolean, names array<string>")
    assert {(r.path, r.ordinal): (r.survives, r.kept) for r in assemble.two_phase_claims(frame).collect()} == want


def test_registered_name_claims_against_a_plain_fold(spark):
    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").collect()
    by_order = {}
    for r in lines:
        names = list(dict.fromkeys([str(r.l_partkey % 7), str(r.l_suppkey % 5)]))
        by_order.setdefault(r.l_orderkey, []).append((r.l_linenumber, f"v{r.l_partkey % 3}", r.l_returnflag == "R", names))
    want = []
    for order, claims in by_order.items():
        used = set()
        for k, variable, fails, names in sorted(claims):
            kept = [n for n in names if n not in used]
            survives = bool(kept) and not fails and variable not in used
            used |= {*kept, variable} if survives else set()
            want.append((order, k, survives, ",".join(kept if survives else [])))
    got = catalogue.queries()["name_claims"](spark, sf).collect()
    assert sorted((r.path, r.ordinal, r.survives, r.kept) for r in got) == sorted(want)


def test_people_sort_by_letters(spark):
    frame = spark.createDataFrame([(x,) for x in ("b", "A", "á", "B", "a", "z", "Z")], "n string")
    assert [r.n for r in assemble.in_locale_order(frame, "n").collect()] == ["a", "A", "á", "b", "B", "z", "Z"]


def test_places_in_the_locales_order_over_many_partitions(spark):
    words = ["b", "A", "á", "B", "a", "z", "Z", "a", None, ""]
    frame = spark.createDataFrame([(w, k) for k, w in enumerate(words * 20)], "n string, k int").repartition(7)
    got = assemble.with_place(frame, "n", ("k",)).orderBy("place").collect()
    assert [r.place for r in got] == list(range(200))
    order = [None, "", "a", "A", "á", "b", "B", "z", "Z"]
    assert [(r.n, r.k) for r in got] == sorted(((w, k) for k, w in enumerate(words * 20)), key=lambda r: (order.index(r[0]), r[1]))
    assert assemble.with_place(frame.limit(0), "n").count() == 0


def test_conflicts_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for p in range(60):
        for item in range(rng.randint(1, 5)):
            ranges = [(a, a + rng.randint(-1, 4)) for a in (rng.randint(0, 12) for _ in range(rng.randint(0, 3)))]
            rows.append((f"f{p}", item, ranges + ranges[:1], [rng.randint(0, 14) for _ in range(rng.randint(0, 3))] + [None]))
    want = {(p, i) for p, i, ranges, _ in rows for q, j, _, places in rows for a, b in ranges for x in places if p == q and i != j and x is not None and a < x < b}
    frame = spark.createDataFrame([*rows, (None, 1, [(0, 9)], [5]), ("f0", None, None, None)], "path string, item int, ranges array<struct<start:int,stop:int>>, places array<int>")
    assert {(r.path, r.item) for r in assemble.nesting_conflicts(frame).collect()} == want and 10 < len(want) < len(rows)


def test_inserts_at_one_place_meet_in_order(spark):
    rows = [("f", 5, 5, 2, "b"), ("f", 5, 5, 1, "a"), ("f", 5, 5, 3, ""), ("f", 5, 7, 4, "c"), ("g", 5, 5, 1, "x"), ("f", 6, 6, 1, "d")]
    got = assemble.combined_inserts(spark.createDataFrame(rows, "path string, start int, stop int, ordinal int, replacement string")).collect()
    assert sorted(map(tuple, got)) == sorted([("f", 5, 5, "ab"), ("f", 5, 5, ""), ("f", 5, 7, "c"), ("g", 5, 5, "x"), ("f", 6, 6, "d")])


def test_migrated_functions_that_cannot_run_make_no_mismatch(spark):
    schema = "target_id int, ordinal int, original_kind string, original_key string, rerun_kind string, rerun_key string, migrated_kind string, migrated_key string"
    rows = [(1, 0, "return", "a", "return", "a", "unrunnable", None), (1, 1, "return", "a", "return", "a", "return", "b"), (2, 0, "return", "a", "return", "a", "return", "b")]
    assert {r.target_id: r.verdict for r in verify.characterized(spark.createDataFrame(rows, schema)).collect()} == {1: "ineligible", 2: "mismatch"}


def test_what_only_looks_like_a_call_is_none(spark):
    """Nothing in a comment or a string counts; a name with the other quote is whole."""
    text = "// x.filter('commented', f)\nvar s = \".service('quoted', f)\";\nm.controller(\"it's\", f);\nm.value('real', 1)"
    got = [(r.kind, r.name) for r in calls.registrations(spark.createDataFrame([("p", text)], "path string, content string")).orderBy("at").collect()]
    assert got == [("controller", "it's"), ("value", "real")]


def test_values_that_are_not_what_they_say_have_a_reason(spark):
    cases = [("Map", "[["), ("Set", "x"), ("RegExp", "/a/"), ("Error", "{"), ("number", None), ("number", "two"), ("number", "1_0"), ("json", None), ("json", "[" * 100_000), ("number", "")]
    rows = spark.createDataFrame(cases, "kind string, value string").select("kind", evidence.canonical(F.col("kind"), F.col("value")).alias("c")).collect()
    assert [(r.c.key, r.c.reason) for r in rows] == [(None, evidence.UNREADABLE)] * len(cases)


def test_one_number_has_one_key(spark):
    same = [["12345678901234567890", "12345678901234567890.0", "1.2345678901234567890e19"], ["9007199254740993", "9007199254740992"], ["1", "1.0", "1e0"], ["-0", "-0.0"], ["1e21", "1000000000000000000000"]]
    for kind in ("json", "number", "Map"):
        for values in same:
            given = [(kind, f"[{v}]" if kind != "number" else v) for v in values]
            keys = {r.c.key for r in spark.createDataFrame(given, "kind string, value string").select(evidence.canonical(F.col("kind"), F.col("value")).alias("c")).collect()}
            assert len(keys) == 1 and None not in keys
    assert evidence.canonical_text("json", "12345678901234567890")[0] == "12345678901234567000"
