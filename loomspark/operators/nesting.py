"""Nested intervals: partner, depth and innermost container, without joining intervals to places; by windows, or by a stack where a worker has a group whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nested(rows: DataFrame, keys: list[str], place: str, opens: Column, closes: Column, prefix: str = "") -> DataFrame:
    """``rows`` with ``depth``, ``partner`` and ``parent`` (each after ``prefix``), as a stack would give them.

    Within ``keys``, in the order of ``place`` (distinct numbers), a row of ``opens`` goes in and
    a row of ``closes`` comes out of the innermost open one; with none open it does nothing.
    ``parent``: the place of the innermost open row around a row, null outside all; for the two
    ends the one around both. ``depth``: how many are around it. ``partner``: the other end's
    place, null for rows that are no end, that stay open, or that close nothing.

    Depth is a running sum less its lowest value so far. Ends of one inner depth follow each
    other in turn, and the last open one of a depth is what holds the rows of that depth.
    """
    opens, closes = F.coalesce(opens, F.lit(False)), F.coalesce(closes, F.lit(False))
    at = W.partitionBy(*keys).orderBy(place)
    so_far = at.rowsBetween(W.unboundedPreceding, 0)
    before = at.rowsBetween(W.unboundedPreceding, -1)
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    summed = rows.withColumns({"_nest_open": opens, "_nest_close": closes, "_nest_sum": F.sum(step).over(so_far)})
    lowest = summed.withColumns({"_nest_low": F.least(F.lit(0), F.min("_nest_sum").over(so_far)), "_nest_was": F.coalesce(F.least(F.lit(0), F.min("_nest_sum").over(before)), F.lit(0))})
    closing = F.col("_nest_close") & (F.col("_nest_low") == F.col("_nest_was"))
    inside = F.col("_nest_sum") - F.col("_nest_low") + F.when(closing, 1).otherwise(0)  # an end's depth is the one within
    level = lowest.withColumns({"_nest_level": inside.cast("int"), "_nest_closing": closing})
    ends = W.partitionBy(*keys, "_nest_level").orderBy(place)
    after, until = ends.rowsBetween(1, W.unboundedFollowing), ends.rowsBetween(W.unboundedPreceding, -1)
    partner = F.when(F.col("_nest_open"), F.min(F.when(F.col("_nest_closing"), F.col(place))).over(after)).when(F.col("_nest_closing"), F.max(F.when(F.col("_nest_open"), F.col(place))).over(until))
    # two opens of one level have a close of that level between them, so a close before the next open is its own
    paired = level.withColumn("_nest_partner", partner)
    outer = F.col("_nest_level") - F.when(F.col("_nest_open") | F.col("_nest_closing"), 1).otherwise(0)
    member = F.struct(outer.alias("level"), F.lit(False).alias("marks"))
    marks = paired.withColumn("_nest_row", F.explode(F.when(F.col("_nest_open"), F.array(F.struct(F.col("_nest_level").alias("level"), F.lit(True).alias("marks")), member)).otherwise(F.array(member))))
    held = W.partitionBy(*keys, F.col("_nest_row.level")).orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    parent = F.max(F.when(F.col("_nest_row.marks"), F.col(place))).over(held)
    found = marks.withColumn("_nest_parent", F.when(F.col("_nest_row.level") > 0, parent)).where("NOT _nest_row.marks")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_nest_row.level").alias(f"{prefix}depth"), F.col("_nest_partner").alias(f"{prefix}partner"), F.col("_nest_parent").alias(f"{prefix}parent"))


def stacked(steps: np.ndarray, groups: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``depth``, ``partner`` and ``parent`` of ``nested``, -1 for null, of rows that lie in the order of groups and places.

    ``steps``: 1 for a row that opens, -1 for one that closes, 0 for others. Only the ends are nested; what
    holds another row is what was open after the last end before it.
    """
    ends = np.flatnonzero(steps)
    step, group, n = steps[ends].astype(np.int64), groups[ends], len(ends)
    head = np.append(True, group[1:] != group[:-1])[:n]
    number = np.cumsum(head) - 1  # of the group
    summed = np.cumsum(step)
    summed -= (summed - step)[np.flatnonzero(head)][number] if n else 0
    low = np.minimum.accumulate(np.minimum(summed, 0) - number * (n + 1)) + number * (n + 1)  # each group begins below all before it
    low_before = np.append(0, low)[:n]
    low_before[head] = 0
    opens, closes = step > 0, (step < 0) & (low == low_before)  # with none open, a close does nothing
    depth_after = summed - low
    level = depth_after + closes  # an end's depth is the one within
    # by level, opens and closes follow each other in turn
    real = np.flatnonzero(opens | closes)
    turn = real[np.argsort((number * (n + 1) + level)[real], kind="stable")]
    same = (number[turn[1:]] == number[turn[:-1]]) & (level[turn[1:]] == level[turn[:-1]])
    pair = np.flatnonzero(same & opens[turn[:-1]] & closes[turn[1:]])
    other = np.full(n, -1)
    other[turn[pair]], other[turn[pair + 1]] = turn[pair + 1], turn[pair]
    # what opens behind an open end lies in it; what opens behind a close lies where that one did
    behind_open, behind_close = (np.append(False, x)[:n] & ~head for x in (opens, closes))
    first = np.maximum.accumulate(np.where((opens & ~behind_close)[turn], np.arange(len(turn)), 0))
    within = np.full(n, -1)
    within[turn] = np.where(behind_open, np.arange(n) - 1, -1)[turn[first]]
    within[closes] = within[other[closes]]
    partner = np.full(len(steps), -1, np.int64)
    partner[ends] = np.where(other < 0, -1, places[ends[other]] if n else other)
    inside = np.append(np.where(opens, np.arange(n), within), -1)  # what is open after an end
    last = np.cumsum(steps != 0) - 1  # the last end up to a row
    known = (last >= 0) & (np.append(group, -1)[last] == groups)
    depth = np.where(known, np.append(depth_after, 0)[last], 0)
    parent = np.where(known, inside[last], -1)
    depth[ends], parent[ends] = level - (opens | closes), within
    return depth, partner, np.where(parent < 0, -1, places[ends[parent]] if n else parent)


def held(groups: np.ndarray, places: np.ndarray, span_groups: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """For each place, which of its group's spans is the innermost that holds it, -1 for none.

    Spans of one group nest or lie apart; a span holds its two ends, and one whose stop is -1 does not end. Places are below 2**30.
    """
    wide, ended = 1 << 31, np.flatnonzero(stops >= 0)
    group = np.concatenate([groups, span_groups, span_groups[ended]])
    at = np.concatenate([places * wide + (1 << 29), starts * wide, stops[ended] * wide + wide - 1 - starts[ended]])
    rows, spans = len(places), len(starts)
    steps = np.repeat(np.array([0, 1, -1], np.int8), (rows, spans, len(ended)))
    order = np.lexsort((at, group))
    numbers = np.concatenate([np.full(rows, -1), np.arange(spans), np.full(len(ended), -1)])[order]
    parent = stacked(steps[order], group[order], numbers)[2]
    out, own = np.full(rows, -1, np.int64), order < rows
    out[order[own]] = parent[own]
    return out
