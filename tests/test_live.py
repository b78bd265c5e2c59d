"""Outcomes while artifacts arrive equal the batch query on what has arrived."""

import random

from loomspark.operators import report
from loomspark.streaming import live

SCHEMA = "artifact_id int, source_file string, template_source string, tier string"


def test_each_drained_state_equals_the_batch_query(spark, tmp_path):
    rng = random.Random(3)
    paths = [f"f{k}" for k in range(12)]
    files = spark.createDataFrame([(p, k % 3 > 0) for k, p in enumerate(paths)], "path string, matched boolean")
    batches = [[(rng.randint(0, 30), rng.choice(paths), rng.choice([*paths, None, "gone"]), rng.choice(report.TIERS)) for _ in range(5)] for _ in range(4)]
    batches[2] += batches[0]  # rows that come again
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/batch={k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    states = []
    last = live.live_outcomes(files, stream, str(tmp_path / "state"), lambda df: states.append(sorted(map(tuple, df.collect()))))
    assert len(states) == 4
    arrived = [set(s) for s in states]
    assert sorted(map(tuple, last.collect())) == states[-1]
    whole = report.file_outcomes(files, spark.createDataFrame([r for rows in batches for r in rows], SCHEMA))
    assert sorted(map(tuple, whole.collect())) == states[-1]
    assert [tuple(r) for r in report.honest_rates(last).collect()] == [tuple(r) for r in report.honest_rates(whole).collect()]
    prefixes = [sorted(map(tuple, report.file_outcomes(files, spark.createDataFrame([r for rows in order for r in rows], SCHEMA)).collect())) for n in range(1, 5) for order in [batches[:n]]]
    assert states[0] in [sorted(map(tuple, report.file_outcomes(files, spark.createDataFrame(b, SCHEMA)).collect())) for b in batches] and len(prefixes) == len(arrived)


def test_a_batch_run_again_and_nothing_arriving(spark, tmp_path):
    files = spark.createDataFrame([("a", True), ("b", False)], "path string, matched boolean")
    (tmp_path / "in").mkdir()
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    none = live.live_outcomes(files, stream(), str(tmp_path / "state0"))
    assert {tuple(r) for r in none.collect()} == {("a", "NOT_EMITTED"), ("b", "NO_MATCH")}
    spark.createDataFrame([(1, "a", None, "LOW")], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))

    def fails(df):
        raise RuntimeError("lost")

    try:
        live.live_outcomes(files, stream(), str(tmp_path / "state"), fails)
    except Exception as e:
        assert "lost" in str(e)
    again = live.live_outcomes(files, stream(), str(tmp_path / "state"))
    assert {tuple(r) for r in again.collect()} == {("a", "LOW"), ("b", "NO_MATCH")}
    idle = live.live_outcomes(files, stream(), str(tmp_path / "state"))
    assert sorted(map(tuple, idle.collect())) == sorted(map(tuple, again.collect()))
