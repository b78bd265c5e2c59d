"""Functions, declarations and what names are bound to, from the token table.

A function holds the places from its parameters to the end of its body. A name is bound to the
innermost function or block around it that declares it: within one name of one file, scopes
that declare it nest like brackets, so this is the same nesting, with the scopes' two ends set
among the name's uses. No interval is joined to the places within it. A worker has a file's
tokens whole (``filewise``), so that nothing but files moves.

What is told: parameters, ``var`` (held by its function), ``let``, ``const`` and ``class`` (by their
block), function declarations (by their function), names of function expressions (by
themselves). What is not: patterns in parameters or declarations, ``catch`` parameters, labels.
Names that nothing in the file declares have no scope; those of the file itself scope ``FILE``.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import filewise
from loomspark.operators.filewise import END, FILE, FREE, FUNCTIONS, Files, ints, places
from loomspark.operators.nesting import nested
from loomspark.operators.tokens import KINDS


def told_functions(files: Files) -> tuple[np.ndarray, dict]:
    f = files.functions
    columns = {c: places(files, f[c]) for c in ("start", "stop", "parameters", "outer")} | {"name_at": places(files, f["name"])}
    return files.of[f["start"]], columns | {"kind": pa.array(FUNCTIONS).take(pa.array(f["kind"], pa.int64())), "name": filewise.words(files, f["name"])}


def told_owners(files: Files, kinds: tuple[str, ...], name: str) -> tuple[np.ndarray, dict]:
    tokens, n = files.all[:-1], files.none
    columns = {"place": places(files, tokens), "start": ints(files.start[:n]), "line": ints(files.line[:n]), "kind": pa.array(KINDS).take(pa.array(files.kind[:n], pa.int64())), "text": filewise.words(files, tokens)}
    return files.of[:n], columns | {name: places(files, np.append(files.functions["start"], n)[files.owner(kinds)[:n]])}


def told_declarations(files: Files) -> tuple[np.ndarray, dict]:
    d = files.declarations
    token, scope, stop = d["token"], d["scope"], d["stop"]
    own = lambda at, end: np.where(at == end, at, files.place(np.where(at == end, 0, at)))
    columns = {"name": filewise.words(files, token), "place": places(files, token), "scope": ints(own(scope, FILE)), "stop": ints(own(stop, END), stop == files.none)}
    return files.of[token], columns | {"how": pa.array(d["how"].tolist(), pa.string())}


def told_bindings(files: Files) -> tuple[np.ndarray, dict]:
    token, scope = files.bindings
    columns = {"place": places(files, token), "line": ints(files.line[token]), "name": filewise.words(files, token), "owner": places(files, np.append(files.functions["start"], files.none)[files.owners[token]])}
    return files.of[token], columns | {"scope": ints(np.where(scope < 0, scope, files.place(np.maximum(scope, 0))), scope == FREE)}


def told_counts(files: Files) -> tuple[np.ndarray, dict]:
    token, scope = files.bindings
    _, first, which = np.unique(files.named(token), return_index=True, return_inverse=True)
    count = lambda marks: pa.array(np.bincount(which, marks, len(first)).astype(np.int64), pa.int64())
    columns = {"of_file": count(scope == FILE), "of_function": count(scope >= 0), "free": count(scope == FREE)}
    return files.of[token[first]], columns | {"name": filewise.words(files, token[first])}


class Scopes:
    """Functions, declarations and bindings of tokens of ``bracketed``, each told anew from the files' tokens (``lists``)."""

    def __init__(self, rows: DataFrame | None, lists: DataFrame | None = None):
        self.lists = filewise.lists_of_rows(rows) if lists is None else lists

    @classmethod
    def of(cls, corpus: DataFrame) -> Scopes:
        """Those of the tokens of a corpus."""
        return cls(None, filewise.lists_of(corpus))

    @property
    def functions(self) -> DataFrame:
        """``file, path, start, stop, kind, name, name_at, parameters, outer`` of functions.

        ``kind``: ``function`` (an expression), ``declaration``, ``method`` or ``arrow``; ``start``: the place of the parameter
        list (or of a bare parameter), ``stop``: of the body's last token; ``parameters``: the list's place, null for a
        bare one; ``outer``: the place of the bracket around it.
        """
        return filewise.told(self.lists, told_functions, "start int, stop int, kind string, name string, name_at int, parameters int, outer int")

    def owned(self, kinds: tuple[str, ...] = FUNCTIONS, name: str = "owner") -> DataFrame:
        """Tokens with ``owner``, the start of the innermost function of these kinds around them; null outside all.

        Without arrows it is the function whose ``this`` a token has.
        """
        return filewise.told(self.lists, partial(told_owners, kinds=kinds, name=name), f"place int, start int, line int, kind string, text string, {name} int")

    def declarations(self) -> DataFrame:
        """``file, path, name, place, scope, stop, how``: each declared name, and the first and last place of what holds it."""
        return filewise.told(self.lists, told_declarations, "name string, place int, scope int, stop int, how string")

    def bindings(self) -> DataFrame:
        """``file, path, place, line, name, scope, owner``: every name that stands for a variable, and the scope that declares it."""
        return filewise.told(self.lists, told_bindings, "place int, line int, name string, scope int, owner int")

    def counts(self) -> DataFrame:
        """``file, path, name, of_file, of_function, free``: how often a name of a file is bound to the file, to a function in it, and to nothing."""
        return filewise.told(self.lists, told_counts, "name string, of_file long, of_function long, free long")


def innermost(rows: DataFrame, spans: DataFrame, keys: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``rows`` (with ``place``) with ``name``, the start of the innermost of the ``spans`` (``keys, start, stop``) that holds it.

    Spans of one key nest or lie apart; a span holds its two ends. With ``parts``, the result is dealt by the first key into so many.
    """
    wide = 1 << 31  # places are below 2**30
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    inside = rows.select(*keys, (F.col("place").cast("long") * wide + (1 << 29)).alias("_at"), F.lit(0).alias("_end"), row.alias("_row"))
    empty = F.lit(None).cast(inside.schema["_row"].dataType)
    first = spans.select(*keys, (F.col("start").cast("long") * wide).alias("_at"), F.lit(1).alias("_end"), empty.alias("_row"))
    last = spans.select(*keys, (F.col("stop").cast("long") * wide + (1 << 30) + (1 << 30) - 1 - F.col("start")).alias("_at"), F.lit(-1).alias("_end"), empty.alias("_row"))
    every = inside.unionByName(first).unionByName(last)
    found = nested(every.repartition(parts, keys[0]) if parts else every, keys, "_at", F.col("_end") == 1, F.col("_end") == -1, "_in_")
    held = F.floor(F.col("_in_parent") / wide).cast("int")
    return found.where("_end = 0").select("_row.*", held.alias(name))
