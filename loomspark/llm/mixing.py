"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source of ``size`` characters and weight ``w`` out of ``W`` is to be read
``rate = w / W * total / size`` times. Each document's copies are a Poisson variable of that
mean, by inversion of a hash of seed and document, so that the same document gets the same
copies in every run and on every machine. A rate over ``PART`` is the sum of equal parts,
each inverted with a hash of its own. Copies are exploded and the whole is dealt and sorted
by a hash of seed, document and copy: a global shuffle.

At scale: one combined sum by source, then one narrow pass and the shuffle itself. Rates are
broadcast only if there are at most ``SMALL`` sources; beyond, they are joined. A hot source
adds no skew, as rows are dealt by the hash.

Defined results: a null source is a source of its own; a source without characters has rate
0; null texts have no characters; a null ``doc_id`` hashes its text; rows that repeat a
``doc_id`` get the same number of copies each; columns named ``mix_copies``, ``mix_copy`` and
``mix_key`` are replaced, others pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.tables import cut

#: Largest mean that is inverted at once, and how many terms its distribution then needs.
PART, TERMS = 16, 96
SMALL = 20_000


def fraction(*parts: Column) -> Column:
    """A hash of the parts in [0, 1), with 52 bits."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulative(mean: Column) -> Column:
    """P(X <= k) for k from 0 to TERMS of a Poisson variable."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["sums"]


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0) -> DataFrame:
    """``mix_source, mix_size, mix_rate`` of every source."""
    name = F.coalesce(F.col("source").cast("string"), F.lit("(null)"))
    sizes = cut(docs.groupBy(name.alias("mix_source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("mix_size")))
    weight = F.lit(float(default_weight))
    for source, w in sorted(weights.items()):
        weight = F.when(F.col("mix_source") == source, float(w)).otherwise(weight)
    sizes = sizes.withColumn("mix_weight", F.when(F.col("mix_size") > 0, weight).otherwise(0.0))
    total = sizes.agg(F.sum("mix_size").alias("size"), F.sum("mix_weight").alias("weight")).first()
    rate = F.col("mix_weight") / float(total.weight or 1) * float(total.size or 0) / F.col("mix_size")
    return sizes.select("mix_source", "mix_size", F.when(F.col("mix_size") > 0, rate).otherwise(0.0).alias("mix_rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, seed: str = "mix") -> DataFrame:
    """``docs`` replicated and shuffled, with ``mix_copies``, ``mix_copy`` (from 1) and ``mix_key``."""
    docs = docs.drop("mix_copies", "mix_copy", "mix_key")
    rates = source_rates(docs, weights, default_weight)
    parts = F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / PART)).cast("int")
    rates = rates.withColumn("_parts", parts).withColumn("_sums", cumulative(F.col("mix_rate") / F.col("_parts")))
    rates = rates.select("mix_source", "_parts", "_sums")
    rates = F.broadcast(rates) if rates.count() <= SMALL else rates
    # A row's own columns travel as one, so that none can clash.
    name = F.coalesce(F.col("source").cast("string"), F.lit("(null)"))
    document = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), name.alias("mix_source"), document.alias("_document"))
    # Hashed once a part; the terms are then compared with the number.
    draws = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda part: fraction(F.lit(seed), part.cast("string"), F.col("_document")))
    drawn = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("_sums", lambda c: c <= u)))
    copies = packed.join(rates, "mix_source").select("_row", "_document", drawn.alias("mix_copies")).where("mix_copies > 0")
    copies = copies.select("_row", "_document", "mix_copies", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy"))
    digits = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), "_document", F.col("mix_copy").cast("string")))
    key = F.conv(F.substring(digits, 1, 15), 16, 10).cast("long")
    return copies.select("_row.*", "mix_copies", "mix_copy", key.alias("mix_key")).repartition("mix_key").sortWithinPartitions("mix_key")
