"""Names that stand for one string, and requests whose url follows from such names, from the token table.

A variable has a value if it is declared once, by ``var``, ``let`` or ``const``, with a sum of
strings and of names that have one, and never written to again. Values spread along the edges
``name = a + b``: a variable gets its value when the last of its names has got one, so what goes
round in a circle, or hangs on a parameter or a name from outside, never gets one.

Told as written to: assignments of all kinds, ``++`` and ``--``, loops ``for (a in b)``, and names in
patterns on the left of an assignment, in parameters, or after ``catch``, which the scopes do not
know as names of their own. Strings are those whose only escapes are quotes and
backslashes; template strings those without expressions or escapes. Numbers have no value here.
That a ``var`` is read before its line is reached is not told.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from loomspark.operators import filewise
from loomspark.operators.filewise import MANY, NO_SUM, NO_URL, NO_VALUE, WRITTEN, Files, added_up, ints, strings
from loomspark.operators.scopes import Scopes

VERBS = ("get", "delete", "head", "post", "put", "patch", "jsonp")
__all__ = ["MANY", "NO_SUM", "NO_URL", "NO_VALUE", "VERBS", "WRITTEN", "Constants", "constants", "request_urls"]


class Constants:
    """What the variables of ``found`` stand for."""

    def __init__(self, found: Scopes):
        self.found = found


def told_constants(files: Files) -> tuple[np.ndarray, dict]:
    v = files.variables
    reason = [f or (NO_VALUE if x is None else None) for f, x in zip(v["fault"], v["value"], strict=True)]
    return files.of[v["token"]], {"name": filewise.words(files, v["token"]), "line": ints(files.line[v["token"]]), "value": strings(v["value"]), "reason": strings(reason)}


def constants(known: Constants) -> DataFrame:
    """``path, name, line, value, reason`` of every variable that is declared with a value: the string it stands for, or why it has none."""
    return filewise.told(known.found.lists, told_constants, "name string, line int, value string, reason string").drop("file")


def told_urls(files: Files, root: str) -> tuple[np.ndarray, dict]:
    calls, known = files.calls(VERBS), files.variables
    asked = np.flatnonzero((files.codes[calls["root"]] == files.code(root)) & calls["plain"] & (calls["link"] == 1))
    opened, method = calls["open"][asked], calls["method"][asked]
    first = np.full(files.none + 1, files.none)
    begins = np.flatnonzero((files.before == files.none) & (files.parent < files.none))
    first[files.parent[begins]] = begins
    heads = first[opened]
    there = heads < files.none
    terms = iter(files.sums(heads[there]))
    value, reason = [], []
    for head in there.tolist():
        found = next(terms) if head else None
        value.append(added_up(known, found) if found is not None else None)
        reason.append(NO_URL if not head else NO_SUM if found is None else NO_VALUE if value[-1] is None else None)
    return files.of[opened], {"line": ints(files.line[method]), "verb": filewise.words(files, method), "url": strings(value), "reason": strings(reason)}


def request_urls(known: Constants, root: str = "$http") -> DataFrame:
    """``path, line, verb, url, reason`` of ``$http.verb(url, ...)``: the url as its strings and names give it, or why it is not known."""
    return filewise.told(known.found.lists, partial(told_urls, root=root), "line int, verb string, url string, reason string").drop("file")
