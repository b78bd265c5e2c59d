"""Texts that are put together from keys."""

from pyspark.sql import functions as F

from loomspark.operators import tokens
from loomspark.plans import tables
from loomspark.plans.scripts import SCRIPTS


def test_no_task_makes_more_than_its_share_of_texts(spark, tmp_path):
    """However many rows of keys one file has, the rows are dealt before they become texts; the texts are the same."""
    rows, share = 3000, 200
    spark.range(1, rows + 1, 1, 1).selectExpr("id AS c_custkey", "cast(id % 25 AS int) AS c_nationkey", "'x' AS c_name").write.parquet(str(tmp_path / "customer.parquet"))
    keys = spark.read.parquet(str(tmp_path / "customer.parquet"))
    sizes = [r["count"] for r in tables.spread(keys, share).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == rows and max(sizes) < 2 * share
    assert tables.spread(keys, rows + 1) is keys
    plain = tables.sql(spark, str(tmp_path), SCRIPTS)
    got = tables.sql(spark, str(tmp_path), SCRIPTS, lambda df: tables.spread(df, share))
    assert got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 2 * share
    assert tokens.files_of(got, 3).count() == rows


def test_queries_on_tokens_spread_their_keys(spark, tmp_path, monkeypatch):
    spark.range(1, 101, 1, 1).selectExpr("id AS c_custkey", "cast(id % 25 AS int) AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    seen = []
    monkeypatch.setattr(tables, "spread", lambda df: seen.append(df.columns[0]) or df)
    tables.texts(spark, str(tmp_path), SCRIPTS)
    assert seen == ["c_custkey"]
