import zlib
from collections import Counter
from bisect import bisect_left

import pytest

from loomspark.llm import ring_shards as rs


def plain(places, shards, vnodes, slack):
    """Key by key: who waits, in ring order, is admitted where there is room and else steps on."""
    points = rs.ring_points(shards, vnodes)
    room = rs.capacities(len(places), shards, slack)
    at = [bisect_left([p for p, _ in points], place) % len(points) for place in places]
    out, waiting = [None] * len(places), sorted(range(len(places)), key=lambda k: places[k])
    while waiting:
        later = []
        for k in waiting:
            shard = points[at[k]][1]
            if room[shard]:
                room[shard] -= 1
                out[k] = shard
            else:
                at[k] = (at[k] + 1) % len(points)
                later.append(k)
        waiting = later
    return out


@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_runs_equal_a_walk_key_by_key(slack):
    places = sorted((k * k * 7919) % rs.BINS for k in range(900)) + [5] * 60
    places.sort()
    runs = rs.place_runs(Counter(places), 7, 16, slack)
    got = []
    for place, n in sorted(Counter(places).items()):
        for rank in range(n):
            got.append(max(r for r in runs[place] if r[0] <= rank)[1])
    assert got == plain(places, 7, 16, slack)


def test_counts_slots_and_columns(spark):
    rows = [(k, "same" if k % 3 else f"text {k} é", "x") for k in range(1003)] + [(None, "n", "x"), (None, None, "y"), (7, "same", "x"), (7, "same", "x"), (2000, "long " * 100000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = rs.assign_shards(df, 40, 16).collect()
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows)
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"}
    again = rs.assign_shards(df.repartition(5), 40, 16).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert len({r.shard for r in rs.assign_shards(df, 40, 16).collect()}) == 2
    assert rs.assign_shards(df.limit(0)).count() == 0


def test_kept_columns_of_any_name(spark):
    names = ["_spot", "_place", "_rank", "_run", "_runs", "_keep", "a.b", "text"]
    df = spark.createDataFrame([(k, *[f"{c}{k}" for c in names]) for k in range(90)], ", ".join(["doc_id long", *[f"`{c}` string" for c in names]]))
    got = rs.assign_shards(df, 7, 8, keep=tuple(names))
    assert got.columns[7:] == names
    assert sorted(map(tuple, got.select("doc_id", *[f"`{c}`" for c in names]).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError, match="shard"):
        rs.assign_shards(df.withColumn("shard", df["text"]), keep=("shard",))


@pytest.mark.parametrize(("slack", "most"), [(0.25, 0.2), (0.0, 0.06)])
def test_one_more_shard_moves_few_rows(slack, most):
    counts = Counter((k * 48271 * 7919) % rs.BINS for k in range(20000))
    shard = lambda runs: {(p, k): max(r for r in runs[p] if r[0] <= k)[1] for p, n in counts.items() for k in range(n)}
    before, after = (shard(rs.place_runs(counts, n, 64, slack)) for n in (40, 41))
    assert sum(before[k] != after[k] for k in before) / len(before) < most
