"""What follows from facts of scripts: parameters bound by place, events paired in a file. The facts come from tokens (``calls``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds of registrations and of watchers, and how much of an expression is kept.
KINDS = ("controller", "directive", "component", "service", "factory", "provider", "value", "constant", "filter", "decorator", "animation")
WATCHES = ("$watch", "$watchCollection", "$watchGroup")
WATCH_TEXT = 200

#: Fixed value: why names and parameters cannot be bound by place.
ARITY = "dependency array has {} names but the function declares {} parameter(s) — ambiguous binding, not safely transformable"


def bound_parameters(injections: DataFrame) -> DataFrame:
    """``path, name, place, dependency, parameter`` of registrations without a ``reason`` against it."""
    pairs = F.arrays_zip(F.col("dependencies").alias("dependency"), F.col("parameters").alias("parameter"))
    return injections.where("reason IS NULL").select("path", "name", F.posexplode(pairs).alias("place", "p")).select("path", "name", "place", "p.dependency", "p.parameter")


def paired_events(usages: DataFrame) -> DataFrame:
    """``path, event, first_at`` of events that a file both emits and receives (``kind`` emit or on)."""
    both = usages.groupBy("path", "event").agg(F.bool_or(F.col("kind") == "emit").alias("sent"), F.bool_or(F.col("kind") == "on").alias("got"), F.min("ordinal").alias("first_at"))
    return both.where("sent AND got").select("path", "event", "first_at")
