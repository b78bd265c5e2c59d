"""What is reached over directed edges, within groups, and what a declaration needs of its file."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import filewise
from loomspark.operators.filewise import FILE, FUNCTIONS, Files, ints, places
from loomspark.operators.scopes import Scopes
from loomspark.sources.shared import removed, written


def reachable(edges: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, source, node, steps``: every node that a source reaches in one or more steps, once, with the fewest steps.

    ``edges``: ``keys, a, b``; ``sources``: ``keys, source``. Breadth first: each round goes on from the
    pairs found new in the last, so a cycle ends it; a pair is sent over its node's edges once.
    Rounds are written, so that none is computed twice; they are as many as the longest of the shortest paths.
    """
    ahead = written(edges.select(*keys, F.col("a").alias("node"), "b").where("node IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    pair = [*keys, "source", "node"]
    front = written(sources.select(*keys, "source", F.col("source").alias("node"), F.lit(0).alias("steps")).where("source IS NOT NULL").distinct(), "front")
    seen = written(front.limit(0), "seen")
    while True:
        step = front.join(ahead, [*keys, "node"]).select(*keys, "source", F.col("b").alias("node"), (F.col("steps") + 1).alias("steps"))
        new = written(step.dropDuplicates(pair).join(seen.select(*pair), pair, "left_anti"), "front")
        removed(front)
        if new.isEmpty():
            removed(new)
            removed(ahead)
            return seen
        both = written(seen.unionByName(new), "seen")
        removed(seen)
        seen, front = both, new


def needs(files: Files, used: np.ndarray) -> dict[int, list[int]]:
    """The file's own functions that each of its own functions names in its text, by the tokens of their names. ``used``: names bound to the file."""
    f, d = files.functions, files.declarations
    tops: dict[int, list[int]] = {}
    for token in d["token"][d["scope"] == FILE].tolist():
        tops.setdefault(int(files.named(np.array([token]))[0]), []).append(token)
    own = np.flatnonzero((f["kind"] == FUNCTIONS.index("declaration")) & (f["outer"] == files.none))
    found = files.within(used, f["start"][own], f["stop"][own])
    inside, out = found >= 0, {}
    names = f["name"][own]
    for token, a, name in zip(used[inside].tolist(), names[found[inside]].tolist(), files.named(used[inside]).tolist(), strict=True):
        for b in tops[name]:
            if b not in (token, a) and b not in out.setdefault(a, []):
                out[a].append(b)
    return out


def steps_from(source: int, edges: dict[int, list[int]]) -> dict[int, int]:
    """Every node that is reached in one or more steps, with the fewest."""
    seen: dict[int, int] = {}
    front, step = [source], 0
    while front:
        step += 1
        front = list(dict.fromkeys(b for a in front for b in edges.get(a, ()) if b not in seen))
        seen |= dict.fromkeys(front, step)
    return seen


def told_lifted(files: Files, method: str) -> tuple[np.ndarray, dict]:
    starts = files.calls((method,))["open"]
    stops = files.partner[starts]
    token, scope = files.bindings
    used = token[scope == FILE]
    d = files.declarations
    top: dict[int, int] = {}
    declared = np.sort(d["token"][d["scope"] == FILE])
    for name, at in zip(files.named(declared).tolist(), declared.tolist(), strict=True):
        top.setdefault(name, at)
    firsts = set(top.values())
    found = files.within(used, starts, stops)
    asked = sorted({(span, top[name]) for span, name in zip(found[found >= 0].tolist(), files.named(used[found >= 0]).tolist(), strict=True)})
    edges, reached, fewest = needs(files, used), {}, {}
    outside = lambda span, at: at < starts[span] or (stops[span] < files.none and at > stops[span])
    for span, source in asked:
        if outside(span, source):
            fewest[span, source] = 1
    for span, source in list(fewest):
        if source not in reached:
            reached[source] = steps_from(source, edges)
        for node, steps in reached[source].items():
            fewest[span, node] = min(fewest.get((span, node), steps + 1), steps + 1)
    rows = [(span, node, steps) for (span, node), steps in fewest.items() if node in firsts and outside(span, node)]
    span, node, steps = np.array(rows, np.int64).reshape(-1, 3).T
    columns = {"start": places(files, starts[span]), "name": filewise.words(files, node), "place": places(files, node), "line": ints(files.line[node]), "steps": ints(steps)}
    return files.of[node], columns


def lifted(found: Scopes, method: str) -> DataFrame:
    """``file, path, start, name, place, line, steps``: what of its file's own functions and variables the arguments of each call of ``method`` need, directly or through others, each once.

    ``start``: the bracket that opens the arguments. What is declared within them is not needed from outside.
    """
    return filewise.told(found.lists, partial(told_lifted, method=method), "start int, name string, place int, line int, steps int")
