"""Fields that a function assigns to its own ``this``, directly, in arrows, or by a variable that stands for it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import filewise
from loomspark.operators.filewise import ASSIGNS, FREE, FUNCTIONS, GOING_ON, NAMES, NUMBERS, STRINGS, VARIABLES, Files, ints, places
from loomspark.operators.rewrite import in_order
from loomspark.operators.scopes import Scopes

#: The functions that have a ``this`` of their own.
OWN_THIS = ("function", "declaration", "method")


def aliases(files: Files, this_of: np.ndarray) -> dict[int, set[int]]:
    """By file, name and scope (``Files.scoped``): the functions whose ``this`` variables stand for that are declared with it and nothing else."""
    at, then = files.lead(2), files.lead(3)
    on_a_new_line = (files.line[then] > files.line[at]) & np.isin(files.kind[then], (NAMES, STRINGS, NUMBERS)) & ~files.among(then, *GOING_ON)
    ends = (then == files.none) | files.among(then, ",", ";", "{", "}") | on_a_new_line
    own = (files.kind == NAMES) & files.among(files.lead(1), "=") & files.among(at, "this") & ends
    d, out = files.declarations, {}
    told = np.flatnonzero(own[d["token"]] & np.isin(d["how"], VARIABLES))
    token = d["token"][told]
    for key, function in zip(files.scoped(token, d["scope"][told]).tolist(), this_of[token].tolist(), strict=True):
        out.setdefault(key, set()).add(function)
    return out


def told_fields(files: Files) -> tuple[np.ndarray, dict]:
    this_of, f = files.owner(OWN_THIS), files.functions
    before, through, far = files.lag(1), files.lag(2), files.lag(3)
    put = np.flatnonzero((files.kind == NAMES) & files.among(before, ".") & ~files.among(far, ".") & files.among(files.lead(1), "="))
    put = put[files.signs(put, ASSIGNS)]
    direct = put[files.among(through[put], "this")]
    named, scope = files.bindings
    bound = np.full(files.none + 1, FREE)
    bound[named] = scope
    by_name = put[bound[through[put]] != FREE]
    known = aliases(files, this_of)
    keys = files.scoped(through[by_name], bound[through[by_name]])
    further = [(function, token) for token, key in zip(by_name.tolist(), keys.tolist(), strict=True) for function in known.get(key, ())]
    pairs = np.array([*zip(this_of[direct].tolist(), direct.tolist(), strict=True), *further], np.int64).reshape(-1, 2)
    pairs = pairs[pairs[:, 0] >= 0]
    pairs = pairs[np.argsort(pairs[:, 1], kind="stable")]
    _, first, n = np.unique(pairs[:, 0] * len(files.words) + files.codes[pairs[:, 1]], return_index=True, return_counts=True)
    function, token = pairs[first, 0], pairs[first, 1]
    columns = {"start": places(files, f["start"][function]), "name": filewise.words(files, f["name"][function]), "kind": pa.array(FUNCTIONS).take(pa.array(f["kind"][function], pa.int64()))}
    return files.of[token], columns | {"field": filewise.words(files, token), "place": places(files, token), "line": ints(files.line[token]), "n": pa.array(n, pa.int64())}


def assigned_fields(found: Scopes) -> DataFrame:
    """``file, path, start, name, kind, field, place, line, n``: each field of each function, where it is first assigned, and how often.

    ``start, name, kind`` are the function's. A variable stands for ``this`` wherever its name is bound to it,
    inner functions included, also if it is written to again; one that shadows it does not. Compound
    assignments (``+=``) and comparisons make no field.
    """
    return filewise.told(found.lists, told_fields, "start int, name string, kind string, field string, place int, line int, n long")


def field_declarations(fields: DataFrame) -> DataFrame:
    """``file, path, start, name, output``: a declaration for each field of a function, in the order of first assignments."""
    line = F.concat(F.lit("  "), F.col("field"), F.lit(": any;"))
    return fields.groupBy("file", "path", "start", "name").agg(in_order(F.col("place"), line, "\n").alias("output"))
