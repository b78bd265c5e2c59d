"""Requests are served by buckets that refill, as a plain replay decides them; a stream decides the same."""

import datetime as dt
import os
import random

import pytest

from loomspark.streaming import live
from loomspark.streaming.allowances import Allowance, decisions, stream_decisions

MINUTE = 60_000_000
ALLOWED = (Allowance("fast", 2, 10 * MINUTE, 6), Allowance("slow", 1, 25 * MINUTE, 3))
SCHEMA = "pool string, request_id long, ts timestamp_ntz"
DAY = dt.datetime(2024, 1, 1)


def replay(rows):
    """Request by request: what each bucket would hold is worked out anew from all that it served that day."""
    out, served = [], {}
    for pool, number, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        day = served.setdefault((pool, ts.date()), {a.provider: [] for a in ALLOWED})
        end = dt.datetime.combine(ts.date(), dt.time()) + dt.timedelta(days=1)
        chosen, retry = None, end
        for a in ALLOWED:
            # a bucket that holds ``burst`` and fills steadily: each served request pushes on the time at which it is full
            full, every = None, dt.timedelta(microseconds=a.every)
            for t in day[a.provider]:
                full = max(full or t, t) + every
            ready = full - every * (a.burst - 1) if full else ts
            if len(day[a.provider]) >= a.daily:
                continue
            if ready <= ts:
                chosen = a.provider
                day[chosen].append(ts)
                break
            retry = min(retry, ready)
        out.append((pool, number, ts, chosen, None if chosen else retry))
    return out


def some(seed, n=300, pools=("a", "b")):
    rng = random.Random(seed)
    return [(rng.choice(pools), k, DAY + dt.timedelta(minutes=rng.randint(0, 2 * 1440), microseconds=rng.choice([0, 1, 999]))) for k in range(n)]


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_decisions_equal_a_plain_replay(spark, seed):
    rows = some(seed, pools=("a", "b", None))
    got = told(decisions(spark.createDataFrame(rows, SCHEMA).repartition(5), ALLOWED))
    assert got == sorted(replay(rows), key=repr)
    assert {r[3] for r in got} == {"fast", "slow", None}


def test_ties_repeats_nulls_and_an_empty_table(spark):
    rows = [("a", 1, DAY)] * 3 + [("a", 0, DAY), ("a", 5, None)]
    got = told(decisions(spark.createDataFrame(rows, SCHEMA), ALLOWED))
    by = sorted((r[1], r[3] or "", str(r[4])) for r in got)
    assert by == [(0, "fast", "None"), (1, "", "2024-01-01 00:10:00"), (1, "fast", "None"), (1, "slow", "None"), (5, "", "None")]
    assert decisions(spark.createDataFrame([], SCHEMA), ALLOWED).count() == 0


def test_a_days_budget_ends_with_the_day(spark):
    rows = [("a", k, DAY + dt.timedelta(minutes=60 * k)) for k in range(24)] + [("a", 24, DAY + dt.timedelta(days=1))]
    got = {r.request_id: r for r in decisions(spark.createDataFrame(rows, SCHEMA), ALLOWED).collect()}
    assert [got[k].provider for k in range(10)] == ["fast"] * 6 + ["slow"] * 3 + [None]
    assert got[9].retry_at == got[23].retry_at == DAY + dt.timedelta(days=1) and got[24].provider == "fast"


def test_a_stream_decides_as_the_batch_does(spark, tmp_path):
    rows = sorted(some(3, 200), key=lambda r: r[2])
    rng = random.Random(4)
    rows.sort(key=lambda r: r[2] + dt.timedelta(minutes=rng.randint(0, 29)))  # out of order by less than what may be late
    late = ("a", 999, DAY)
    for k in range(4):
        part = rows[k * 50 : k * 50 + 50] + ([late] if k == 3 else [])
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    schema = spark.createDataFrame([], SCHEMA).schema

    def run(stream):
        return stream_decisions(stream, ALLOWED, "30 minutes")

    source = tmp_path / "flat"
    source.mkdir()
    for k in range(4):
        (file,) = (tmp_path / f"in/part{k}").glob("*.parquet")
        file.rename(source / f"{k}.parquet")
        os.utime(source / f"{k}.parquet", (1_700_000_000 + 60 * k,) * 2)  # files are taken in order of time
    got = told(live.replay(spark, str(source), schema, run, per_batch=1))
    reached = max(r[2] for r in rows) - dt.timedelta(minutes=30)
    want = sorted((r for r in replay(rows) if r[2] <= reached.replace(microsecond=0)), key=repr)
    assert got == want and len(want) > 150
