"""Document fingerprints by closed syncmers, as DataFrame expressions only.

A text becomes tokens: up to four characters of a word. Of every k consecutive tokens the inner substrings of s tokens
are hashed; where the least one stands first or last, the k-mer is an anchor. Whether it is one depends on the k-mer
alone, so texts that share a passage share its anchors wherever it stands. k - 1 empty tokens stand before every text and
k - s - 1 after it, so that texts of any length have anchors: of k - s k-mers in a row one is an anchor.

Anchors are matched by position: a step is an anchor, the one before it (at first the beginning) and the distance between
them. The fingerprint is the 32-bit hashes of the steps in text order; two
fingerprints are alike by twice the number of common steps over the number of both. So an anchor counts only where its
neighbour follows in step, and an insertion costs the steps across it.

Null texts are empty. Texts without words have the empty fingerprint, two such are alike by 1. Equal texts have equal
fingerprints. The next document follows in descending doc_id, then by text hash; rows without doc_id are last, after the
last row comes the first. Texts of any length are read whole. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.sharding import range_of

K, S = 8, 2
TOKEN = "[^ \\t\\n\\x0B\\f\\r]{1,4}"
#: Documents in a task when the next document is looked up, and the most parts that are made.
PER_PART, MOST_PARTS = 250, 4096


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column, k: int = K, s: int = S, edges: bool = False) -> Column:
    """array<struct<pos, hash>>: closed syncmers of a text with their token positions; ``edges`` adds the empty tokens around it."""
    w = k - s + 1  # inner substrings of a k-mer

    def chosen(tokens: Column, inner: Column) -> Column:
        n = F.size(tokens)
        at = lambda i, d: F.get(inner, i + d)
        least = lambda i: F.least(*[at(i, d) for d in range(w)])
        places = F.filter(F.sequence(F.lit(0), n - k), lambda i: F.least(at(i, 0), at(i, w - 1)) == least(i))
        kmers = F.transform(places, lambda i: F.struct(i.alias("pos"), F.hash(F.slice(tokens, i + 1, F.lit(k))).alias("hash")))
        return F.when(n >= k, kmers).otherwise(F.array().cast("array<struct<pos:int,hash:int>>"))

    def of_hashes(tokens: Column) -> Column:
        inner = F.when(F.size(tokens) >= k, F.transform(F.sequence(F.lit(0), F.size(tokens) - s), lambda i: F.xxhash64(*[F.get(tokens, i + d) for d in range(s)])))
        return _bound(inner, lambda x: chosen(tokens, x))

    tokens = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    if edges:
        before, after = (F.array_repeat(F.lit(0).cast("long"), n) for n in (k - 1, k - s - 1))
        tokens = _bound(tokens, lambda t: F.when(F.size(t) > 0, F.concat(before, t, after)).otherwise(t))
    return _bound(tokens, of_hashes)


def marks(text: Column) -> Column:
    """Hashes of the steps from anchor to anchor in text order; none in a text without words."""

    def steps(a: Column) -> Column:
        none = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("hash"))
        step = lambda x, y: F.hash(x["hash"], y["hash"], y["pos"] - x["pos"])
        inside = F.transform(F.slice(a, F.lit(2), F.size(a)), lambda y, i: step(F.get(a, i), y))
        return F.when(F.size(a) > 0, F.concat(F.array(step(none, F.get(a, 0))), inside)).otherwise(F.array().cast("array<int>"))

    return _bound(anchors(text, edges=True), steps)


def fingerprint(hashes: Column) -> Column:
    """Eight hexadecimal digits for each step."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Twice the common distinct steps over the distinct steps of both; 1 where neither has any."""
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, marks, next_text, next_marks): each document beside the one that follows in descending doc_id.

    Documents are dealt into parts by doc_id; each part ends with a copy of the first document of the part after it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    parts = max(1, min(MOST_PARTS, n // PER_PART))
    steps = [i / parts for i in range(1, parts)]
    bounds = rows.agg(F.percentile_approx("doc_id", steps, 100 * MOST_PARTS)).first()[0] if steps else []
    bounds = sorted(set(bounds or []))
    part = F.when(F.col("doc_id").isNull(), -1).otherwise(range_of(F.col("doc_id"), bounds))
    heads = rows.groupBy(part.alias("part")).agg(F.max(F.struct("doc_id", (-F.hash("text").cast("long")).alias("low"))).alias("head")).orderBy(F.desc("part")).collect()
    if not heads:
        return rows.select("*", marks(F.col("text")).alias("marks"), F.col("text").alias("next_text"), marks(F.col("text")).alias("next_marks"))
    follows = [(heads[i - 1]["part"], h["head"]["doc_id"], h["head"]["low"]) for i, h in enumerate(heads)]
    ends = docs.sparkSession.createDataFrame(follows, "part int, head long, head_low long")  # at most MOST_PARTS rows
    low = -F.hash("text").cast("long")
    first = rows.withColumn("low", low).join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("low") == F.col("head_low")))
    first = first.select("doc_id", "text", "part", F.lit(1).alias("last")).dropDuplicates(["part"])
    dealt = rows.select("doc_id", "text", part.alias("part"), F.lit(0).alias("last")).unionByName(first)
    dealt = dealt.withColumn("marks", marks(F.col("text")))
    order = Window.partitionBy("part").orderBy("last", F.desc_nulls_last("doc_id"), F.hash("text"), F.xxhash64("text"))
    out = dealt.withColumn("next", F.lead(F.struct("text", "marks")).over(order)).filter("last = 0")
    return out.select("doc_id", "text", "marks", F.col("next.text").alias("next_text"), F.col("next.marks").alias("next_marks"))


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, with their likeness."""
    rows = with_next(docs)
    n = F.char_length("text")
    moved = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - moved), F.substring("next_text", F.lit(1), moved))
    rows = rows.withColumn("edited", edited).withColumn("edited_marks", marks(F.col("edited")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("marks")).alias("fingerprint"),
        fingerprint(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )
