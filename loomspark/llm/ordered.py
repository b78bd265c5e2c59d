"""Rows beside their neighbours in a global order, without sorting all rows in one task.

Keys are cut into blocks of consecutive keys. Each block gets, besides its own rows, the
row before it and the row after it, so that a task can walk a block in order and knows
every row's neighbours. Only keys are read to find the blocks: the driver sees a hashed
sample of at most some ``SAMPLES`` keys a block, then two keys a block, never rows. The
whole rows move once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled keys by which a block's bounds are set.
SAMPLES = 16


def block_bounds(keys: DataFrame, blocks: int) -> np.ndarray:
    """Upper bounds (each the next block's first key) of at most ``blocks`` blocks of ``keys.key``."""
    step = max(1, keys.count() // (blocks * SAMPLES))
    sample = sorted(r.key for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).collect())
    return np.array(sorted(set(sample[SAMPLES::SAMPLES])), object if sample and isinstance(sample[0], str) else np.int64)


def beside(df: DataFrame, key: Column, blocks: int | None = None, cyclic: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """``df`` with ``_block``, ``_halo`` and ``_key``, each block in one partition and in order.

    ``_halo`` is 0 for a block's own rows, -1 for the last row before and 1 for the first row
    after the block; if ``cyclic``, the first row of all comes after the last. ``key`` must
    not be null; by default there are eight blocks a shuffle partition. Rows with equal keys stay together, and all of them are sent as neighbours.
    ``keys``: the keys alone as column ``key``, stored, if ``df`` is dear to read three times for them.
    """
    blocks = blocks or max(64, 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.withColumn("_key", key)
    keys = keyed.select(F.col("_key").alias("key")) if keys is None else keys
    bounds = block_bounds(keys, blocks)

    @F.pandas_udf("int")
    def block_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), "right").astype(np.int32))

    ends = keys.groupBy(block_of("key").alias("block")).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    found = sorted(ends.collect(), key=lambda r: r.block)
    sent: dict = {}
    for k, r in enumerate(found):
        if k or cyclic:
            sent.setdefault(r.low, []).append(found[k - 1].block * 3 + 2)
        if k + 1 < len(found):
            sent.setdefault(r.high, []).append(found[k + 1].block * 3)

    @F.pandas_udf("array<int>")
    def targets(keys: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, keys.to_numpy(), "right") * 3 + 1
        return pd.Series([[int(b), *sent.get(k, ())] for b, k in zip(own, keys, strict=True)])

    dealt = keyed.withColumn("_to", F.explode(targets("_key")))
    dealt = dealt.withColumns({"_block": F.floor(F.col("_to") / 3).cast("int"), "_halo": (F.col("_to") % 3 - 1).cast("int")}).drop("_to")
    return dealt.repartition("_block")
