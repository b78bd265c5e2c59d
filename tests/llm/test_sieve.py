from pyspark.sql import functions as F

from loomspark.llm import sieve as sv


def test_keys_are_always_found_and_others_seldom(spark):
    keys = spark.range(0, 200_000, 7).select(F.col("id").alias("key"))
    table = sv.sieve(keys)
    rows = spark.range(-1000, 200_000).select("id", sv.may_have(table, F.col("id")).alias("may"))
    assert rows.where("id >= 0 AND id % 7 = 0 AND NOT may").count() == 0
    assert rows.where("(id < 0 OR id % 7 <> 0) AND may").count() < 200


def test_no_keys_find_nothing(spark):
    table = sv.sieve(spark.range(0).select(F.col("id").alias("key")))
    assert spark.range(1000).where(sv.may_have(table, F.col("id"))).count() == 0


def test_a_full_table_loses_nothing(spark, monkeypatch):
    """However many keys: what is not needed only passes."""
    monkeypatch.setattr(sv, "BITS", 1 << 6)
    table = sv.sieve(spark.range(1000).select(F.col("id").alias("key")))
    assert spark.range(2000).where(sv.may_have(table, F.col("id"))).count() == 2000
