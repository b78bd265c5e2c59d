"""Which provider serves a request: buckets that refill, daily budgets, and the next in line when one is used up.

An ``Allowance`` names a provider; their order is their priority. A bucket holds ``burst``
requests and gains one every ``every`` microseconds; a provider serves ``daily`` requests a day
at most. At the start of a day (of the session's time zone) buckets are full and budgets new, so
a pool's day is decided by itself: days of a hot pool are decided side by side, and a day is
walked in order of time, in batches, without being held as a whole.

A request goes to the first provider with something left. If none has, ``provider`` is null and
``retry_at`` is when the first of them has again; a refused request takes nothing.
Ties of time go by ``request_id``. A null pool is a pool; rows without a time have neither
provider nor ``retry_at`` (on a stream they are dropped); rows given twice are two requests.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Allowance:
    provider: str
    burst: int
    every: int
    daily: int


DECIDED = "pool string, request_id long, at long, provider string, retry_at long"
WAITING = "last long, levels array<long>, used array<long>, waiting array<long>, ids array<long>"


class Day:
    """A pool's day so far: what each bucket holds (in microseconds of refill), what each budget has used, and when that was."""

    def __init__(self, allowances: tuple[Allowance, ...], last: int | None = None, levels=None, used=None):
        self.allowances, self.last = allowances, last
        self.levels = [a.burst * a.every for a in allowances] if levels is None else [int(x) for x in levels]
        self.used = [0] * len(allowances) if used is None else [int(x) for x in used]

    def take(self, at: int, day_end: int) -> tuple[str | None, int | None]:
        passed = 0 if self.last is None else at - self.last
        self.last = at
        self.levels = [min(a.burst * a.every, level + passed) for a, level in zip(self.allowances, self.levels)]
        retry = day_end
        for k, a in enumerate(self.allowances):
            if self.used[k] >= a.daily:
                continue
            if self.levels[k] >= a.every:
                self.levels[k] -= a.every
                self.used[k] += 1
                return a.provider, None
            retry = min(retry, at + a.every - self.levels[k])
        return None, retry


def timed(requests: DataFrame) -> DataFrame:
    """``pool, request_id, at, day_end``: times in microseconds."""
    ts = F.col("ts").cast("timestamp")
    end = F.date_trunc("day", ts) + F.expr("INTERVAL 1 DAY")
    return requests.select("pool", F.col("request_id").cast("long").alias("request_id"), F.unix_micros(ts).alias("at"), F.unix_micros(end).alias("day_end"))


def as_times(decided: DataFrame) -> DataFrame:
    return decided.select("pool", "request_id", F.timestamp_micros("at").alias("ts"), "provider", F.timestamp_micros("retry_at").alias("retry_at"))


def decisions(requests: DataFrame, allowances: tuple[Allowance, ...]) -> DataFrame:
    """``pool, request_id, ts, provider, retry_at`` of ``requests`` (``pool, request_id, ts``)."""
    rows = timed(requests)
    ordered = rows.where("at IS NOT NULL").repartition("pool", "day_end").sortWithinPartitions("pool", "day_end", "at", "request_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, day = None, Day(allowances)
        for batch in batches:
            taken = []
            for pool, at, end in zip(batch["pool"], batch["at"], batch["day_end"]):
                if (pool, end) != key:
                    key, day = (pool, end), Day(allowances)
                taken.append(day.take(int(at), int(end)))
            told = batch[["pool", "request_id", "at"]].copy()
            told["provider"] = [p for p, _ in taken]
            told["retry_at"] = pd.array([r for _, r in taken], dtype="Int64")
            yield told

    none = rows.where("at IS NULL").select("pool", "request_id", "at", F.lit(None).cast("string").alias("provider"), F.lit(None).cast("long").alias("retry_at"))
    return as_times(ordered.mapInPandas(walk, DECIDED).unionByName(none))


def stream_decisions(requests: DataFrame, allowances: tuple[Allowance, ...], late: str = "30 minutes") -> DataFrame:
    """The same for a stream: a request is decided when the watermark has reached it, so requests that come out of order by less than ``late`` are decided in order.

    Those behind the watermark are dropped. A pool's day keeps the requests that wait, and goes
    when the watermark has passed its end. Requests after the last watermark stay undecided.
    """
    marked = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    day_end = F.unix_micros(F.date_trunc("day", F.col("ts")) + F.expr("INTERVAL 1 DAY"))
    rows = marked.select("pool", F.col("request_id").cast("long").alias("request_id"), "ts", F.unix_micros("ts").alias("at"), day_end.alias("day_end"))

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pool, end = key[0], int(key[1])
        last, levels, used, waiting, ids = state.get if state.exists else (None, None, None, [], [])
        rows = list(zip(map(int, waiting), map(int, ids)))
        if not state.hasTimedOut:
            for batch in batches:
                rows += zip(map(int, batch["at"]), map(int, batch["request_id"]))
        reached = state.getCurrentWatermarkMs()
        day = Day(allowances, None if last is None else int(last), levels, used)
        rows.sort()
        ready = [r for r in rows if r[0] <= reached * 1000]
        rest = rows[len(ready) :]
        taken = [day.take(at, end) for at, _ in ready]
        if not rest and reached * 1000 >= end:
            state.remove()
        else:
            state.update((day.last, day.levels, day.used, [at for at, _ in rest], [i for _, i in rest]))
            state.setTimeoutTimestamp(max(reached + 1, (rest[0][0] if rest else end) // 1000))
        if ready:
            out = pd.DataFrame({"pool": [pool] * len(ready), "request_id": [i for _, i in ready], "at": [at for at, _ in ready], "provider": [p for p, _ in taken]})
            yield out.assign(retry_at=pd.array([r for _, r in taken], dtype="Int64"))

    return as_times(rows.groupBy("pool", "day_end").applyInPandasWithState(advance, DECIDED, WAITING, "append", GroupStateTimeout.EventTimeTimeout))
