"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A row's place on the ring is a hash of its ``doc_id``; each shard owns ``vnodes`` points.
A row goes to the owner of the next point clockwise. Loads are bounded: in each round the
shards admit waiting rows in ring order while they have room, and the rest step on to the
next point. With ``slack`` 0 the bounds are the balanced counts themselves, so counts
differ by one at most; with more, fewer rows move when a shard is added.

At scale: the ring has ``BINS`` places. Spark counts rows by place (a map-side combined
count), the driver walks these counts, never rows, and gives each place its runs of
(first rank, shard, first slot). Rows then get their rank within their place by a window
over narrow rows, and their shard and slot from the runs, a table of ``BINS`` rows and a
few, which bounds the broadcast.

Defined results: a null text has no bytes; a null ``doc_id`` hashes its text instead;
rows alike in every column are interchangeable; no rows give no rows. ``doc_id`` is taken
to be a key: rows that repeat one id share a place on the ring, and a place is ranked in one
task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 1 << 16


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """The ring's (place, shard), in order; of two points at one place the first hashed stays."""
    points: dict[int, tuple[bytes, int]] = {}
    for shard in range(shards):
        for node in range(vnodes):
            digest = hashlib.md5(f"{shard}:{node}".encode()).digest()
            at = int.from_bytes(digest[:4]) % BINS
            points[at] = min(points.get(at, (digest, shard)), (digest, shard))
    return sorted((at, shard) for at, (_, shard) in points.items())


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place_runs(counts: dict[int, int], shards: int, vnodes: int, slack: float) -> dict[int, list[tuple[int, int, int]]]:
    """For each place its runs (first rank, shard, first slot) from the rows counted there."""
    points = ring_points(shards, vnodes)
    places, room = [at for at, _ in points], capacities(sum(counts.values()), shards, slack)
    filled, runs = [0] * shards, {}
    waiting = [(at, 0, counts[at], bisect_left(places, at) % len(points)) for at in sorted(counts)]
    while waiting:
        later = []
        for at, rank, n, point in waiting:
            shard = points[point][1]
            if taken := min(n, room[shard]):
                runs.setdefault(at, []).append((rank, shard, filled[shard]))
                room[shard] -= taken
                filled[shard] += taken
            if taken < n:
                later.append((at, rank + taken, n - taken, (point + 1) % len(points)))
        waiting = later
    return runs


def assign_shards(docs: DataFrame, shards: int = 40, vnodes: int = 64, slack: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and the columns ``keep``, for every row.

    ``size``: UTF-8 bytes of the text plus 16. ``slot`` counts a shard's rows from 0.
    ``law`` is ``rows``: balance comes first, so one more shard may move rows between others
    and ``grown_shard`` is null. ``keep`` may have any names but the seven; other columns are
    dropped.
    """
    if clash := set(keep) & {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}:
        raise ValueError(f"columns of the result cannot be kept beside it: {sorted(clash)}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), text))), F.lit(1 << 32))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        spot.alias("_spot"),
        F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")]).alias("_keep"),
    ).withColumn("_place", F.floor(F.col("_spot") / F.lit(1 << 16)).cast("int"))
    places = docs.select(F.floor(spot / F.lit(1 << 16)).cast("int").alias("_place"))
    counts = {r["_place"]: r["count"] for r in places.groupBy("_place").count().collect()}  # BINS rows at most
    runs = [(at, found) for at, found in place_runs(counts, shards, vnodes, slack).items()]
    table = docs.sparkSession.createDataFrame(runs, "_place int, _runs array<struct<rank:long,shard:int,slot:long>>")
    order = Window.partitionBy("_place").orderBy("_spot", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    run = F.array_max(F.filter("_runs", lambda r: r["rank"] <= F.col("_rank")))
    return ranked.join(F.broadcast(table), "_place").withColumn("_run", run).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_run.shard").alias("shard"),
        (F.col("_run.slot") + F.col("_rank") - F.col("_run.rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"_keep.`{c}`") for c in keep],
    )
