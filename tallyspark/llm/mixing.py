"""Mixing sources to target weights by capped water-filling, as DataFrame expressions only.

Every source asks for a share of the words to mix in proportion to its weight. A source stops at ``epochs`` times its own
words; what it cannot give is asked of the others by weight, again and again until no source is above its stop. Each round
is one aggregate over the table of sources, and the driver sees three sums. The level is kept as a fraction of integers.

A source gives every document ``floor(target / size)`` times, and once more the first documents of a seeded order until the
rest of its target is reached. The order is by md5 of (seed, doc_id, size), so a rerun and another cluster take the same.
To come near a target in spite of very long documents, those above ``TIERS`` times the mean size of their source are drawn
first, and each smaller tier makes up for what the larger one took too much or too little: what remains is about half a
document of the mean size. Running sums go in two levels, by slot of the md5 and inside a slot, so a source that holds
most rows is spread over all slots. The text is read once; afterwards only narrow rows move.

Null text or no words: size 0, nothing taken. Null source: a source of its own, last in order. Null doc_id: drawn as the
empty id. Repeated rows: each is a document; among equal ones it is not defined which is taken, and their rows are the same.
Ties in the draw go by doc_id and size. Very long texts: counted without a list of their words. Empty table: no rows. All
sources at their stop: each gives ``epochs`` times its words. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.plans.keyed import cut

#: The table of sources is broadcast up to so many rows (some 100 bytes each); beyond it joins are left to the shuffle.
BROADCAST_SOURCES = 100_000
#: Documents of more than so many times the mean size of their source are drawn before the smaller ones.
TIERS = (8, 1)
#: Rows of the order that one slot should hold.
SLOT_ROWS = 20_000
MOST_SLOTS = 1 << 16

_BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of runs of other than blanks, 0 of null; each run is shrunk to a letter, so no list of words is made."""
    runs = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.char_length(F.translate(runs, _BLANKS, "")).cast("long")


def ranked_sources(rows: DataFrame, weights: Sequence[int]) -> DataFrame:
    """(source, n, source_size, rank, weight): sources by code point, null last, weights dealt in turn.

    Sources are put in order by ranges; a range counts on from the ranges before it.
    """
    found = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    ranges = found.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("range", F.spark_partition_id())
    dealt = cut(ranges, "sources")
    before = dealt.groupBy("range").agg(F.count("*").alias("m"))  # as many rows as ranges
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("range", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").isNull(), "source"))
    out = dealt.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + inside - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    return out.select("source", "n", "source_size", "rank", weight.alias("weight"))


def _whole(value: int) -> Column:
    return F.lit(Decimal(value)).cast("decimal(38,0)")


def water_level(sources: DataFrame, share: Fraction, epochs: int) -> tuple[int, int]:
    """The level as (numerator, denominator): an open source's target is its weight times it; denominator 0: all stop."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    stop, at_stop = F.col("source_size") * epochs, -1
    level = (0, 1)
    while True:
        closed = stop.cast("decimal(19,0)") * _whole(level[1]).cast("decimal(19,0)") <= F.col("weight").cast("decimal(19,0)") * _whole(level[0]).cast("decimal(19,0)")
        n, full, weight = sources.agg(
            F.count(F.when(closed, 1)), F.coalesce(F.sum(F.when(closed, stop)), F.lit(0)), F.coalesce(F.sum(F.when(~closed, F.col("weight"))), F.lit(0))
        ).first()
        if n == at_stop or not weight:
            return level if weight else (0, 0)
        at_stop = n
        rest = share * total - full
        level = (rest.numerator, rest.denominator * weight)


def targets(sources: DataFrame, share: Fraction = Fraction(3, 2), epochs: int = 2) -> DataFrame:
    """Adds ``target`` (words), ``whole`` (times every document is given) and ``rest`` (words still to give)."""
    num, den = water_level(sources, share, epochs)
    stop = (F.col("source_size") * epochs).cast("double")
    if den:
        asked = (F.col("weight") * F.lit(num)).cast("double") / F.lit(den).cast("double")
        closed = (F.col("source_size") * epochs).cast("decimal(19,0)") * _whole(den).cast("decimal(19,0)") <= F.col("weight").cast("decimal(19,0)") * _whole(num).cast("decimal(19,0)")
        target = F.when(closed, stop).otherwise(asked)
    else:
        target = stop
    out = sources.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    out = out.withColumn("whole", whole)
    return out.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))


def _attach(rows: DataFrame, sources: DataFrame, on: str, small: bool) -> DataFrame:
    s = sources.withColumnRenamed(on, "__on")
    return rows.join(F.broadcast(s) if small else s, F.col(on).eqNullSafe(F.col("__on")), "left").drop("__on")


def placed(rows: DataFrame, sources: DataFrame, small: bool, n: int) -> DataFrame:
    """(rank, tier, doc_id, size, before): words of the same source and tier that come earlier in the drawn order."""
    out = _attach(rows, sources.select("source", "rank", "n", "source_size"), "source", small)
    tier = F.lit(len(TIERS))
    for i, times in reversed(list(enumerate(TIERS))):
        tier = F.when(F.col("size").cast("decimal(19,0)") * F.col("n") > F.col("source_size").cast("decimal(19,0)") * times, i).otherwise(tier)
    slots = max(1, min(MOST_SLOTS, n // SLOT_ROWS))
    slot = F.floor(F.conv(F.substring("draw", 1, 4), 16, 10).cast("long") * slots / (1 << 16)).cast("int")
    out = out.select("rank", tier.cast("int").alias("tier"), slot.alias("slot"), "draw", "doc_id", "size")
    keys = ["rank", "tier"]
    earlier = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = out.groupBy(*keys, "slot").agg(F.sum("size").alias("s")).select(*keys, "slot", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("carried"))
    inside = Window.partitionBy(*keys, "slot").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = out.join(sums, [*keys, "slot"])
    return out.select(*keys, "doc_id", "size", (F.col("carried") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("before"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), epochs: int = 2, seed: int = 7
) -> DataFrame:
    """(doc_id, source, size, weight, source_size, target, taken) of every document."""
    size = word_count(F.col("text"))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = cut(rows.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), name, F.col("size").cast("string")))), "sized")
    sources = cut(ranked_sources(rows, weights), "ranked")
    count, n = sources.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    small = count <= BROADCAST_SOURCES
    sources = cut(targets(sources, share, epochs), "targets")
    order = cut(placed(rows, sources, small, n), "placed")

    wide = sources.join(order.groupBy("rank").pivot("tier", list(range(len(TIERS) + 1))).agg(F.sum("size")), "rank", "left")
    held, given = F.lit(0), F.lit(0)
    for t in range(len(TIERS) + 1):
        held = held + F.coalesce(F.col(str(t)), F.lit(0))
        budget = F.when(F.col("source_size") > 0, F.col("rest") * held / F.col("source_size")).otherwise(0.0) - given
        wide = cut(wide.withColumn(f"budget{t}", budget), "budget")
        if t < len(TIERS):
            drawn = _attach(order.filter(F.col("tier") == t), wide.select("rank", f"budget{t}"), "rank", small).filter(2 * F.col("before") + F.col("size") <= 2 * F.col(f"budget{t}"))
            wide = wide.join(drawn.groupBy("rank").agg(F.sum("size").alias(f"given{t}")), "rank", "left").fillna({f"given{t}": 0})
            given = given + F.col(f"given{t}")
    wide = wide.select("rank", "source", "weight", "source_size", "target", "whole", F.array(*[f"budget{t}" for t in range(len(TIERS) + 1)]).alias("budgets"))
    out = _attach(order, wide, "rank", small)
    more = (2 * F.col("before") + F.col("size") <= 2 * F.get("budgets", F.col("tier"))) & (F.col("whole") < epochs)
    taken = F.col("size") * (F.col("whole") + more.cast("long"))
    return out.select("doc_id", "source", "size", "weight", "source_size", "target", taken.alias("taken"))
