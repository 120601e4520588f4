"""N-gram Jaccard join by grouped prefix join.

Two documents link when ``percent`` of the union of their distinct word shingles is shared. Tokens (shingle hashes)
have one total order: those in the lowest part of the hash range come first, rarest first, with counts over all
documents; the others follow by hash. Linked sets must share a token among the first ``n - ceil(t n) + 1``.

1. Equal sets collapse into one node. Only the lowest part of the hash range is counted and joined, since the order
   puts a prefix almost always inside it; a prefix of tokens that occur once needs no entry at all.
2. Nodes with the same size and prefix collapse into a group. Groups that share a token few nodes have are filtered by
   size and position, expanded to members and verified on whole sets.
3. Nodes that share a token with many others, as in large families of copies, meet once more with all their tokens,
   counted among themselves, and are grouped anew. In a bucket that is still large, or a group, all are first held
   against one pivot; what that connects needs no further pair. Only pairs that lie in different components and pass
   the filters are expanded then, so no link between components is lost and no family emits all its pairs.
4. Components come from alternating large-star and small-star steps over tables written to the shared folder.

Nulls, texts without words: empty set, linked with nothing. Equal texts and repeated rows: one component. ``doc_id``
names a document: where different texts share one, each is a node of its own and the id unites what they are linked with.
Rows without doc_id get no component. Texts of any length are taken whole, in blocks. Ties have no part in the result. An
empty table gives no rows. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.words import blocks, shingles
from tallyspark.plans.keyed import cut

#: The tokens of this much more of the hash range than a prefix has of its set are counted.
MARGIN = 0.05
#: Buckets with more nodes than this are large: their nodes meet with all their tokens and a pivot.
SMALL_BUCKET = 24
#: Document ids that may be broadcast (8 bytes each); beyond it, documents are picked by a join.
BROADCAST_IDS = 4_000_000


def set_table(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, p, r, h1, h2, counted, later): set size, prefix length, counted tokens, a 128-bit key of the set."""
    schema = "doc_id long, n int, p int, r int, h1 long, h2 long, counted array<long>, later array<long>"
    bound = np.uint64(int((1 - percent / 100 + MARGIN) * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            n, p, r, h1, h2, low, high = [], [], [], [], [], [], []
            for s in shingles(batch.column(1), words):
                size = len(s)
                prefix = size - -(-percent * size // 100) + 1 if size else 0
                split = int(np.searchsorted(s, bound))
                key = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                n.append(size)
                p.append(prefix)
                r.append(split)
                h1.append(key[0])
                h2.append(key[1])
                low.append(s[:split].view(np.int64))
                high.append(s[split : split + max(0, prefix - split)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int32()) for x in (n, p, r)), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), _lists(low), _lists(high)],
                ["doc_id", "n", "p", "r", "h1", "h2", "counted", "later"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def prefix_table(sets: DataFrame) -> DataFrame:
    """(node, n, group key, tokens with positions) of the distinct sets that can have a partner."""
    frequent = sets.select(F.explode("counted").alias("token")).groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = sets.select("node", F.explode("counted").alias("token")).join(frequent, "token")
    lists = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    none = F.array().cast("array<struct<df:bigint,token:bigint>>")
    known = sets.drop("counted").join(lists, "node", "left").withColumn("shared", F.coalesce("shared", none))
    known = known.withColumn("alone", F.col("r") - F.size("shared"))
    order = F.concat(F.transform("shared", lambda x: x["token"]), F.col("later"))
    kept = known.withColumn("tokens", F.slice(order, F.lit(1), F.greatest(F.col("p") - F.col("alone"), F.lit(0))))
    kept = kept.filter(F.size("tokens") > 0)
    same = F.when(F.col("alone") > 0, F.col("node"))  # a token of one's own makes a prefix unique
    return kept.select("node", "n", "alone", "tokens", F.xxhash64("n", "alone", "tokens", same).alias("k1"), F.hash("tokens", "n", same).alias("k2"))


def _can_link(a: str, b: str, percent: int) -> Column:
    """Size and position filter; right for the first shared token of the order, which every linked pair has."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * rest >= percent * (na + nb))


def _sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(node, tokens): whole sets of the documents named."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = None
    if ids.count() <= BROADCAST_IDS:
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toPandas()["node"].to_numpy(np.int64)))
    else:
        docs = docs.join(ids.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                got = np.isin(batch.column(0).fill_null(-(2**63)).to_numpy(), wanted.value) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(got))
            for part in blocks([batch]):
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([s.view(np.int64) for s in shingles(part.column(1), words)])], ["node", "tokens"])

    return docs.mapInArrow(run, "node long, tokens array<long>").groupBy("node").agg(F.first("tokens").alias("tokens"))


def verify(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ids")
    sets = _sets_of(docs, ids, words)
    left, right = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    shared = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("common"), (F.size("ta") + F.size("tb")).alias("both"))
    return shared.filter(100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node. ``edges``: (a, b), written."""
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.union(low.filter("low < a").select("a", F.col("low").alias("b"))).distinct()
        large = cut(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = cut(small.union(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _grouped(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their group (same size and prefix), and one entry per group and prefix token with the token's bucket."""
    groups = prefixes.groupBy("k1", "k2").agg(F.min("node").alias("g"), F.count("*").alias("members"))
    nodes = cut(prefixes.join(groups, ["k1", "k2"]), "nodes")
    posed = nodes.filter("node = g").select("g", "n", "alone", "members", F.posexplode("tokens").alias("i", "token"))
    entries = posed.select("g", "n", "members", "token", (F.col("alone") + F.col("i")).alias("pos"))
    buckets = entries.groupBy("token").agg(F.sum("members").alias("size"), F.min(F.struct("pos", "n", "g")).alias("pivot")).filter("size > 1")
    return nodes.select("node", "n", "g", "members"), cut(entries.join(buckets, "token"), "entries")


def _group_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): groups that share a token and pass the filters."""
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.g") < F.col("y.g")) & _can_link("x", "y", percent)
    return entries.alias("x").join(entries.alias("y"), meet).select(F.col("x.g").alias("a"), F.col("y.g").alias("b")).distinct()


def _expanded(group_pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, and the columns of both members): pairs of nodes behind pairs of groups; a group may meet itself."""
    rest = [c for c in members.columns if c not in ("node", "g")]
    left = members.select(F.col("g").alias("a"), F.col("node").alias("na"), *(F.col(c).alias(f"{c}_a") for c in rest))
    right = members.select(F.col("g").alias("b"), F.col("node").alias("nb"), *(F.col(c).alias(f"{c}_b") for c in rest))
    pairs = group_pairs.join(left, "a").join(right, "b").filter("na <> nb")
    return pairs.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), *(f"{c}_{s}" for c in rest for s in "ab"))


def link_components(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of the nodes that have a link."""
    nodes, entries = _grouped(prefix_table(sets))
    small = entries.filter(F.col("size") <= SMALL_BUCKET)
    alone = nodes.filter(f"members between 2 and {SMALL_BUCKET}").select(F.col("g").alias("a"), F.col("g").alias("b")).distinct()
    tried = _expanded(_group_pairs(small, percent).union(alone), nodes.select("g", "node")).distinct()
    crowded = entries.filter(F.col("size") > SMALL_BUCKET).select("g").union(nodes.filter(f"members > {SMALL_BUCKET}").select("g")).distinct()
    crowd = cut(nodes.join(crowded, "g", "left_semi").select("node"), "crowd")
    if crowd.isEmpty():
        tried = cut(tried, "tried")
        return _labels(docs, None, tried, words, percent)

    # Nodes of large buckets meet again with all their tokens, counted among themselves: what sets a copy apart is then rare.
    whole = _sets_of(docs, crowd, words).withColumn("n", F.size("tokens"))
    whole = whole.select("node", "n", F.expr(f"n - cast(ceil({percent} * n / 100.0) as int) + 1").alias("p"), F.col("n").alias("r"), F.col("tokens").alias("counted"), F.array().cast("array<bigint>").alias("later"))
    nodes, entries = _grouped(prefix_table(cut(whole, "crowd-sets")))
    few, many = entries.filter(F.col("size") <= SMALL_BUCKET), entries.filter(F.col("size") > SMALL_BUCKET)
    to_pivot = many.select(F.struct("g", "n", "pos").alias("x"), F.col("pivot").alias("y")).filter(_can_link("x", "y", percent) & (F.col("x.g") != F.col("y.g")))
    to_pivot = to_pivot.select(F.least("x.g", "y.g").alias("a"), F.greatest("x.g", "y.g").alias("b"))
    in_group = nodes.filter("node <> g").select(F.col("g").alias("a"), F.col("node").alias("b"))
    few = cut(_group_pairs(few, percent), "pairs")
    tried = cut(tried.union(few).union(to_pivot).union(in_group).distinct(), "tried")
    return _labels(docs, (nodes, few, many), tried, words, percent)


def _labels(docs: DataFrame, crowd: tuple[DataFrame, DataFrame, DataFrame] | None, tried: DataFrame, words: int, percent: int) -> DataFrame:
    """Components of the links among the pairs tried, and of those that the pivots leave open."""
    if crowd is None and tried.isEmpty():
        return docs.sparkSession.createDataFrame([], "node long, component long")
    links = cut(verify(docs, tried, words, percent), "links")
    labels = cut(components(links), "labels")
    if crowd is None:
        return labels
    nodes, few, many = crowd
    marked = cut(_labelled(nodes.select("node", "g"), labels), "marked")
    spread = marked.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
    cells = many.drop("members").join(spread, "g").groupBy("token", "n", "pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    differ = ~((F.col("x.lo") == F.col("x.hi")) & (F.col("x.hi") == F.col("y.lo")) & (F.col("y.lo") == F.col("y.hi")))
    ordered = F.struct("x.n", "x.pos") <= F.struct("y.n", "y.pos")
    open_cells = cells.alias("x").join(cells.alias("y"), (F.col("x.token") == F.col("y.token")) & ordered & differ & _can_link("x", "y", percent))
    open_cells = open_cells.select(F.col("x.token").alias("token"), F.col("x.n").alias("n"), F.col("x.pos").alias("pos"), F.col("y.n").alias("n2"), F.col("y.pos").alias("pos2"))
    other = many.select("token", F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("g").alias("b"))
    behind = many.select("token", "n", "pos", F.col("g").alias("a")).join(open_cells, ["token", "n", "pos"]).join(other, ["token", "n2", "pos2"]).select("a", "b")
    wide = spread.filter("members > 1").select("g")
    multiple = few.join(wide.withColumnRenamed("g", "a"), "a", "left_semi").union(few.join(wide.withColumnRenamed("g", "b"), "b", "left_semi").select("a", "b"))
    within = spread.filter("lo <> hi").select(F.col("g").alias("a"), F.col("g").alias("b"))
    rest = _expanded(behind.union(multiple).union(within).distinct(), marked).filter("component_a <> component_b")
    rest = cut(rest.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    if rest.isEmpty():
        return labels
    return components(links.union(verify(docs, rest, words, percent)))


def _united(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """As ``near_duplicates`` where an id stands for different texts: rows are linked by numbers of their own, ids unite them."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = cut(rows.withColumn("doc_id", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows.select("doc_id", "text"), words, percent)
    linked = cut(rows.select("doc_id", "id").join(found, "doc_id"), "by-number")
    worded = linked.filter("n_shingles > 0")
    first = worded.groupBy("id").agg(F.min("component_id").alias("b"))
    joint = components(worded.join(first, "id").select(F.col("component_id").alias("a"), "b")).withColumnRenamed("component", "whole")
    homes = worded.join(joint, worded["component_id"] == joint["node"], "left").select(worded["doc_id"], "id", F.coalesce("whole", "component_id").alias("whole"))
    least = homes.join(homes.groupBy("whole").agg(F.min("id").alias("least")), "whole").select("doc_id", "least")
    known = linked.join(least, "doc_id", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("least", "id").alias("component_id"))
    nameless = sets.filter(F.col("doc_id").isNull()).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return known.unionByName(nameless)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; see the module text for the method and the special cases."""
    sets = cut(set_table(docs, words, percent), "sets")
    first = lambda c: F.first(c).alias(c)
    named = sets.filter("n > 0 and doc_id is not null")
    key = F.struct("h1", "h2")
    if not named.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).filter("a <> b").isEmpty():
        return _united(docs, sets, words, percent)
    distinct = cut(named.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node"), *(first(c) for c in ("p", "r", "counted", "later"))), "distinct")
    labels = link_components(docs, distinct.drop("h1", "h2"), words, percent)
    per_set = _labelled(distinct.select("h1", "h2", "node"), labels).select("h1", "h2", "component")
    plain = sets.select("doc_id", "n", "h1", "h2")
    out = plain.join(per_set, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
