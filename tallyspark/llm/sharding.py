"""Byte-balanced shards by sampled splitters, as DataFrame expressions only.

Rows have the order (md5 of the text, doc_id), so equal texts stand together. Keys are sampled with a chance in
proportion to their size; weighted quantiles of the sample bound the ranges, and ranges that turn out overfull get
more splitters from a denser sample of their own rows. Ranges give every row its place in the global order: sums per
range, then a running sum inside a range, so no task sees more than a range even if a third of all rows are copies.

Placement: copies stay in one shard. Groups larger than 1/32 of a shard (there are few, whatever the input) are placed
first, largest first, where most room is left, and only a group with more bytes than any room is divided. The other
groups fill the room that is left in order. Shards then differ by about the size of the largest small group.

Null text: size 1, in a group with the empty text. Null doc_id: first among its copies. Repeated rows are numbered in
any order among themselves. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.plans.keyed import cut

#: Expected sample keys for each range; the driver holds this many times the number of ranges, at most MOST_RANGES.
PER_RANGE = 24
MOST_RANGES = 4096
#: A group larger than this part of a shard is placed by itself.
LARGE = 32


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, k): ``k`` sorts by md5 of the text, then by doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return docs.select(
        "doc_id",
        F.when(F.col("text").isNull(), 1).otherwise(F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(F.md5(text.cast("binary")), F.coalesce(number, F.lit(""))).alias("k"),
    )


def _sampled(rows: DataFrame, expected: int, total: int) -> list[tuple[str, float]]:
    """Keys drawn with chance ``expected * size / total``, each with the weight it stands for."""
    chance = F.col("size") * (expected / max(1, total))
    drawn = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1 << 30)) / float(1 << 30) < chance
    return [(r["k"], max(1.0, r["w"])) for r in rows.filter(drawn).select("k", chance.alias("w")).orderBy("k").collect()]


def _quantiles(sample: list[tuple[str, float]], parts: int) -> list[str]:
    step, seen, out = sum(w for _, w in sample) / max(1, parts), 0.0, []
    for key, w in sample:
        seen += w
        if seen >= step * (len(out) + 1) and len(out) < parts - 1 and (not out or key > out[-1]):
            out.append(key)
    return out


def range_of(k: Column, bounds: list) -> Column:
    """Number of bounds not above ``k``, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    coarse, fine = F.array(*[F.lit(b) for b in bounds[::width]]), F.array(*[F.lit(b) for b in bounds])
    below = F.greatest(F.size(F.filter(coarse, lambda b: b <= k)) - 1, F.lit(0)) * width
    return below + F.size(F.filter(F.slice(fine, below + 1, F.lit(width)), lambda b: b <= k))


def splitters(rows: DataFrame, ranges: int) -> list[str]:
    """Range bounds by weighted sample quantiles; overfull ranges are subdivided."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    bounds = _quantiles(_sampled(rows, PER_RANGE * ranges, total), ranges)
    for denser in (8, 64):
        measured = rows.groupBy(range_of(F.col("k"), bounds).alias("range")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        over = {r["range"]: r["size"] for r in measured.collect() if r["n"] > 1 and r["size"] > 2 * total / ranges}
        if not over:
            break
        inside = rows.filter(range_of(F.col("k"), bounds).isin(list(over)))
        sample, edges = _sampled(inside, PER_RANGE * ranges * denser, total), ["", *bounds, "~"]
        for r, size in over.items():
            bounds = bounds + _quantiles([x for x in sample if edges[r] <= x[0] < edges[r + 1]], 1 + int(size * ranges // max(1, total)))
        bounds = sorted(set(bounds))
    return bounds


def placed(large: list[tuple[str, int]], shards: int, total: int) -> tuple[list[tuple[str, int, int, int]], list[int]]:
    """Pieces (group, from byte, to byte, shard) of the large groups, and the bytes each shard has then."""
    room = [total // shards + (i < total % shards) for i in range(shards)]
    share, pieces = list(room), []
    for name, size in sorted(large, key=lambda x: (-x[1], x[0])):
        start = 0
        while start < size:
            s = max(range(shards), key=lambda i: (room[i], -i))
            stop = size if room[s] <= 0 else min(size, start + room[s])
            pieces.append((name, start, stop, s))
            room[s] -= stop - start
            start = stop
    return pieces, [a - b for a, b in zip(share, room, strict=True)]


def shard(spark: SparkSession, docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, range): every row once; slots count from 0 in each shard."""
    rows = cut(keyed_rows(docs), "keyed")
    ranges = min(MOST_RANGES, max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranged = rows.withColumn("range", range_of(F.col("k"), splitters(rows, ranges))).withColumn("md5", F.substring("k", 1, 32))

    def before(counted: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
        """Running total of a table with a row per range (and shard) over the ranges before it."""
        w = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        return counted.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))

    sums = before(ranged.groupBy("range").agg(F.sum("size").alias("bytes")).withColumn("all", F.lit(0)), ["all"], "bytes", "base").select("range", "base")
    inside = Window.partitionBy("range").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    started = ranged.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, "range").withColumn("start", F.col("start") + F.col("base")).drop("base")
    started = cut(started, "started")
    groups = started.groupBy("md5").agg(F.min("start").alias("at"), F.sum("size").alias("bytes"))
    total = started.agg(F.sum("size")).first()[0] or 0
    big = [(r["md5"], r["bytes"]) for r in groups.filter(F.col("bytes") * shards * LARGE > total).collect()]  # fewer than shards * LARGE
    pieces, loads = placed(big, shards, total)

    # Small groups: their middle, less the bytes of the large groups before them, falls into the room of one shard.
    table = spark.createDataFrame(pieces, "md5 string, lo long, hi long, to int")
    starts = {r["md5"]: r["at"] for r in groups.filter(F.col("md5").isin([m for m, _ in big])).collect()} if big else {}
    skipped = F.aggregate(F.array(*[F.struct(F.lit(starts[m]).alias("at"), F.lit(n).alias("n")) for m, n in big]), F.lit(0).cast("long"), lambda s, x: s + F.when(x["at"] < F.col("at"), x["n"]).otherwise(0)) if big else F.lit(0)
    ends, room = [], 0
    for load in loads:
        room += max(0, total / shards - load)
        ends.append(room)
    scale = (total - sum(n for _, n in big)) / room if room else 1.0
    middle = F.col("at") - skipped + F.col("bytes") / 2
    fill = F.size(F.filter(F.array(*[F.lit(e * scale) for e in ends[:-1]]), lambda e: e <= middle)) if shards > 1 else F.lit(0)
    homes = groups.withColumn("small", F.when(F.col("bytes") * shards * LARGE <= total, fill)).select("md5", "at", "small")
    joined = started.join(homes, "md5")
    few = joined.filter("small is not null").withColumn("shard", F.col("small"))
    offset = F.col("start") - F.col("at") + F.col("size") / 2
    many = joined.filter("small is null").join(F.broadcast(table), "md5").filter((offset >= F.col("lo")) & (offset < F.col("hi"))).withColumn("shard", F.col("to")).select(*few.columns)
    out = cut(few.unionByName(many).select("doc_id", "size", "text_crc32", "k", "range", "shard"), "placed")
    counts = before(out.groupBy("shard", "range").agg(F.count("*").alias("rows")), ["shard"], "rows", "base").select("shard", "range", "base")
    place = F.row_number().over(Window.partitionBy("range", "shard").orderBy("k")) - 1
    return out.withColumn("place", place).join(counts, ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("base")).cast("long").alias("slot"), "range")
