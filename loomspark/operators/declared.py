"""Which declarations a rewrite has added to a file, from tokens.

A rewrite's output is compared with the file it was made of by declared names alone: what the
file had already stays behind, and of a name that several rewrites add the first one's counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators.scopes import Scopes
from loomspark.operators.tokens import token_parts, tokens
from loomspark.sources.shared import dealt

#: Words that declare a variable, the type whose constants are taken, and why a name is not emitted.
VARIABLES, TABLE_TYPE = ("var", "let", "const"), "Routes"
TAKEN = "was already produced by an earlier pattern for this file — not emitted twice"


def existing_names(files: DataFrame) -> DataFrame:
    """``path, name``: every class and variable that a file declares, at any depth, once."""
    return Scopes.of(files).declarations().where(F.col("how").isin("class", *VARIABLES)).select("path", "name").distinct()


def produced_names(outputs: DataFrame) -> DataFrame:
    """``path, ordinal, place, name`` of the classes and the constants of type ``Routes`` in the outputs (``path, ordinal, content``)."""
    named = outputs.where("path IS NOT NULL AND ordinal IS NOT NULL").select(F.concat(F.col("ordinal").cast("string"), F.lit(":"), F.col("path")).alias("path"), "content")
    near = W.partitionBy("file").orderBy("place")
    parts = token_parts(named)
    rows = dealt(tokens(named, parts), "produced", "file", parts, lies=True).withColumns({f"b{k}": F.lag("text", k).over(near) for k in (1, 2)} | {f"n{k}": F.lead("text", k).over(near) for k in (1, 2)})
    is_class = (F.col("b1") == "class") & (F.coalesce("b2", F.lit("")) != ".") & ~F.col("text").isin("extends", "implements")
    is_table = F.col("b1").isin(*VARIABLES) & (F.col("n1") == ":") & (F.col("n2") == TABLE_TYPE)
    found = rows.where((F.col("kind") == "name") & (is_class | is_table))
    at = F.instr("path", F.lit(":"))
    return found.select(F.substr("path", at + 1).alias("path"), F.left("path", at - 1).cast("long").alias("ordinal"), "place", F.col("text").alias("name"))


def added_declarations(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """``path, ordinal, name, emitted, reason``: what each output declares that its file did not have.

    ``outputs``: ``path, ordinal, content``, in the order of the rewrites. A name produced again has a
    reason; outputs and files of null path or content declare nothing; an output without a file is all new.
    """
    new = produced_names(outputs).join(existing_names(files), ["path", "name"], "left_anti")
    first = F.row_number().over(W.partitionBy("path", "name").orderBy("ordinal", "place")) == 1
    return new.withColumn("emitted", first).select("path", "ordinal", "name", "emitted", F.when(~F.col("emitted"), F.concat("name", F.lit(" " + TAKEN))).alias("reason"))
