import pytest

from loomspark.llm import mixing


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key string")


def test_shares_reach_their_weights_and_runs_agree(spark):
    rows = [(k, "x" * 50, "big" if k % 3 else "small", "old") for k in range(6000)]
    mixed = mixing.mix_sources(table(spark, rows), {"big": 1.0, "small": 3.0})
    got = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert got["small"] / sum(got.values()) == pytest.approx(0.75, abs=0.02)
    assert sum(got.values()) == pytest.approx(6000, rel=0.05)
    again = mixing.mix_sources(table(spark, rows).repartition(3), {"big": 1.0, "small": 3.0})
    key = lambda r: (r.doc_id, r.mix_copy)
    assert sorted(map(tuple, mixed.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert len({key(r) for r in mixed.collect()}) == mixed.count()


def test_copies_follow_a_poisson_law(spark):
    rows = [(k, "xy", "a" if k < 5000 else "b", None) for k in range(5100)]
    mixed = mixing.mix_sources(table(spark, rows), {"a": 0.0, "b": 1.0})  # 100 documents at a rate of 51
    counts = [r["count"] for r in mixed.groupBy("doc_id").count().collect()]
    mean = sum(counts) / 100
    assert mean == pytest.approx(51, abs=3)
    assert sum((c - mean) ** 2 for c in counts) / 100 == pytest.approx(51, rel=0.5)


def test_nulls_ties_and_empty_tables(spark):
    rows = [(None, None, None, None), (1, "", "e", "k"), (1, "", "e", "k"), (None, "text", None, None), (3, "long " * 9999, "l", None), (3, "long " * 9999, "l", None)]
    got = mixing.mix_sources(table(spark, rows), {}).collect()
    copies = {}
    for r in got:
        copies.setdefault((r.doc_id, r.text), []).append(r.mix_copies)
    assert all(c[0] * (2 if k[0] == 3 else 1) == len(c) for k, c in copies.items())
    assert not [r for r in got if r.source == "e"]  # no characters, no rate
    assert mixing.mix_sources(table(spark, []), {"a": 2.0}).count() == 0


def test_clashing_columns_pass_through(spark):
    df = spark.createDataFrame([(k, "text", "s", k, k, k, k) for k in range(50)], "doc_id long, text string, source string, _parts int, _sums int, mix_source int, `a.b` int")
    got = mixing.mix_sources(df, {})
    assert got.columns == [*df.columns, "mix_copies", "mix_copy", "mix_key"]
    assert all(r._parts == r._sums == r.mix_source == r["a.b"] == r.doc_id for r in got.collect())
