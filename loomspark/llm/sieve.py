"""A bit table of a fixed size that tells rows which surely have no partner before they are shuffled.

It holds ``BITS`` bits (8 MB) whatever the number of keys, so it can be sent to every task. A
key that was put in is always found. The more keys there are, the more others are found too;
those only cost their way through the join that follows, and never change its result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


def places(key: Column) -> list[Column]:
    """The two places of a key in the table."""
    return [F.pmod(F.xxhash64(F.lit(k), key), F.lit(BITS)) for k in range(2)]


def held(table: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether the table has both places."""
    return (table[first >> 6] >> (first & 63) & table[second >> 6] >> (second & 63) & 1).astype(bool)


def sieve(keys: DataFrame):
    """The table of ``keys`` (one long column), broadcast."""
    (name,) = keys.columns
    bits = keys.select(F.explode(F.array(*places(F.col(name)))).alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
    one = F.expr("shiftleft(1L, cast(place % 64 AS int))")
    got = bits.agg(F.bit_or(one).alias("bits")).toArrow()  # at most BITS / 64 rows, 16 MB
    table = np.zeros(BITS // 64, np.int64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(table)


def may_have(table, key: Column) -> Column:
    """Whether ``key`` may be among those of a broadcast table."""

    @F.pandas_udf("boolean")
    def found(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series(held(table.value, first.to_numpy(), second.to_numpy()))

    return found(*places(key))
