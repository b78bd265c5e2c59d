"""Rules as rows, and masks of block headers, by case."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import rules, templates

RULE = "ordinal int, rule string, expression string, scope string, message string"


def test_a_rule_is_a_row_and_a_bad_one_a_note(spark):
    files = spark.createDataFrame([("a.js", "one\ntwo TWO two"), ("b.html", "two"), ("c.js", None), (None, "x\n\ny two")], "path string, content string")
    table = [(1, "two", "two", None, "says two"), (2, "bad", "(", None, "m"), (3, "js", r"(?i)two|one", r"\.js$", None), (4, "worse", "a", "[", None), (5, "two", "x", None, None), (6, None, "x", None, None), (7, "none", "zzz", None, None), (8, "blank", "", None, None)]
    got = rules.applied(files, spark.createDataFrame(table, RULE)).collect()
    bad = {r.rule: r.note for r in got if not r.hits}
    assert {(r.path, r.rule): (r.hits, r.first_line, r.note) for r in got if r.hits} == {("a.js", "two"): (2, 2, "says two (2)"), ("b.html", "two"): (1, 1, "says two (1)"), (None, "two"): (1, 3, "says two (1)"), ("a.js", "js"): (4, 1, "js (4)")}
    assert set(bad) == {"bad", "worse", "two", None, "blank"} and bad["bad"].startswith("not an expression: ") and bad["two"] == "a rule of this name comes before"


def test_no_rules_no_files_and_too_many(spark, monkeypatch):
    files, none = spark.createDataFrame([("a", "b")], "path string, content string"), spark.createDataFrame([], RULE)
    assert rules.applied(files, none).count() == 0
    some = spark.createDataFrame([(1, "r", "b", None, None), (2, "q", "b", None, None)], RULE)
    assert rules.applied(files.limit(0), some).count() == 0
    monkeypatch.setattr(rules, "MOST", 1)
    with pytest.raises(ValueError, match="more than 1"):
        rules.applied(files, some)


def plain_mask(text):
    """Headers to their own closing parenthesis, those in quotes left out; one that does not end stays."""
    out, i = "", 0
    while i < len(text):
        head = next((h for h in ("@for (", "@if (") if text.startswith(h, i)), None)
        if head:
            depth, j = 0, i + len(head) - 1
            while j < len(text):
                c = text[j]
                if c in "'\"":
                    j += 1
                    while j < len(text) and text[j] != c:
                        j += 2 if text[j] == "\\" else 1
                elif c == "(":
                    depth += 1
                elif c == ")":
                    depth -= 1
                    if not depth:
                        break
                j += 1
            if j < len(text):
                out += text[i : j + 1].replace("<", " ").replace(">", " ")
                i = j + 1
                continue
        out += text[i]
        i += 1
    return out


def test_masked_headers_against_a_stack(spark):
    rng = random.Random(9)
    signs = ["@if (", "@for (", "(", ")", ")", "<", ">", "'", '"', "\\", "a", " ", "\n"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(400)] + ["@if (" + "(" * 8 + "<" + ")" * 9 + ">", "", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", templates.masked_headers(F.col("t")).alias("m")).orderBy("k").collect()
    assert [r.m for r in got] == [None if t is None else plain_mask(t) for t in texts]
