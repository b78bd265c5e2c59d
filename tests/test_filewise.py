"""What a worker tells of whole files: their tokens, spans around places, and plans that move files alone."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.operators import constants, fields, filewise, nesting, reach, scopes, tokens

BITS = ["/", "/a/g", "//", "/*", "*/", " ", "\x0b", "\x1c", "\x85", " ", "\r", "\n", "return", "in", "é", "𝔘", "'", '"', "`", "${", "}", "{", "\\", "[", "]", "(", ")", "a", "1e+3", "=", "=>", ",", "x of"]


def test_a_worker_cuts_texts_as_spark_does(spark):
    rng = random.Random(9)
    texts = ["", "a = /x/g + b / c / d;", "return  /[/]/.test('/')", *("".join(rng.choices(BITS, k=rng.randint(1, 30))) for _ in range(400))]
    want = [r.found for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(tokens.cut(F.col("t")).alias("found")).collect()]
    counts, start, _, _, codes, words, of, _ = tokens.numbered(tokens.found_in(texts), True)
    got = [[] for _ in texts]
    for k, code in zip(of.tolist(), codes.tolist(), strict=True):
        got[k].append(words[code])
    assert got == want and counts.tolist() == [len(x) for x in want]
    assert all(texts[k][s : s + len(words[c])] == words[c] for k, s, c in zip(of.tolist(), start.tolist(), codes.tolist(), strict=True) if texts[k].isascii())


def test_innermost_spans_of_groups():
    groups, places = np.array([1] * 12 + [4]), np.array([*range(12), 3])
    starts, stops = np.array([1, 2, 6, 7, 11]), np.array([9, 5, 9, 7, 11])
    got = nesting.held(groups, places, np.ones(5, np.int64), starts, stops)
    assert got.tolist() == [-1, 0, 1, 1, 1, 1, 2, 3, 2, 2, -1, 4, -1]
    assert nesting.held(groups[:3], places[:3], np.array([1]), np.array([-1]), np.array([-1])).tolist() == [0, 0, 0]  # a span without an end


def test_files_told_together_are_told_as_alone(monkeypatch):
    texts = ["var a = 'x', b = a + 'y'; $http.get(b + q);", "", "function A() { var vm = this; vm.x = 1; }", ") } x =>", "var c = ((a", "f(function (a) { this.y = a; });"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(texts))]), pa.array(texts)], names=["path", "content"])

    def rows(most):
        monkeypatch.setattr(filewise, "AT_ONCE", most)
        out = []
        for part in filewise.parts_at_once(batch):
            for tell in (scopes.told_functions, scopes.told_declarations, scopes.told_bindings, constants.told_constants, fields.told_fields):
                of, columns = tell(filewise.read(part))
                out += [(tell.__name__, part.column("path")[k].as_py(), *row) for k, *row in zip(of.tolist(), *(filewise.arrow(c).to_pylist() for c in columns.values()), strict=True)]
        return sorted(out, key=str)

    assert rows(1) == rows(20) == rows(1 << 20) and len(rows(1)) > 60


@pytest.mark.parametrize(
    "told",
    [
        lambda found: fields.assigned_fields(found), lambda found: constants.constants(constants.Constants(found)), lambda found: constants.request_urls(constants.Constants(found)),
        lambda found: reach.lifted(found, "controller"), lambda found: found.bindings(),
    ],
)
def test_only_files_move(spark, told):
    corpus = spark.createDataFrame([("p", "function g(a) { this.x = a; } var u = '/u'; m.controller('C', function () { $http.get(u); g(); });")], "path string, content string")
    found = told(scopes.Scopes.of(corpus))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Window" not in plan and "Join" not in plan
    assert found.count() > 0
