"""Conversation prefix trie from vertical bitmaps.

A node is a distinct sequence of turns with which some conversation starts; the root is the empty one. Conversations are
dealt into shards by ranges of their ids. A shard keeps, for every position, the set of its conversations that have a
certain turn there as a bitset (a posting). From the bitset of a parent, the lowest conversation not yet covered names a
turn; parent AND posting is the child, its population count the members, and what no child covers ends at the parent. Nodes
come out depth first, so a subtree is a range of numbers.

Shards are joined by the chained 128-bit hash of (role, text): sums of members, the smallest id and whether any shard has a
child are windows over the copies of a node, one copy a shard. A node belongs to the shard of its smallest member, which
also holds all its ancestors; so children, leaves and saved characters of a subtree are counted in one shard each and add
up. Lists of ends stay packed by shard (two bytes an id) and are digested as a stream in order of ids.

Only hashes and lengths of turns move, never texts. A shard holds at most ``WIDTH`` conversations (twice that around zero),
whatever their content, so a first turn or a whole conversation that a third of all share is a bit in each shard. The digest
of one node's ends is one stream by its definition: a task reads it in packed pieces and keeps only the hash.

Null role or text: empty. Null turn: before all others; equal turns go by their hash. Null conv_id: left out, it names no
conversation. Repeated rows: turns of their own. Very long texts: hashed where they are read. Long conversations: 24 bytes a
turn in their shard's task. A conversation left without turns ends at the root. Empty table: no nodes. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.plans.keyed import cut

#: Conversation ids of one shard; a multiple of the family size, so that a conversation and its base share a shard.
WIDTH = 400

NODES = pa.schema([
    ("shard", pa.int64()), ("pre", pa.int32()), ("parent", pa.int32()), ("size", pa.int32()), ("path", pa.binary()), ("depth", pa.int64()), ("first", pa.int64()),
    ("n", pa.int64()), ("local_children", pa.int32()), ("length", pa.int64()), ("ends", pa.binary()),
])
PARTS = pa.schema([
    ("path", pa.binary()), ("depth", pa.int64()), ("first", pa.int64()), ("parent_first", pa.int64()), ("n_convs", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()),
])


def turn_keys(rows: DataFrame) -> DataFrame:
    """(shard, conv_id, turn, key, length): one row a turn, its 16-byte hash and code points in place of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    conv = F.col("conv_id").cast("long")
    return rows.filter(conv.isNotNull()).select(
        F.expr(f"cast(conv_id as bigint) div {WIDTH}").alias("shard"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.char_length(text).cast("long").alias("length")
    )


class Shard:
    """Conversations of one range of ids: ``ids`` ascending, and the (turn number, length) lists of each."""

    def __init__(self, ids: list[int], turns: list[list[int]], keys: list[bytes], lengths: list[int]):
        self.ids, self.turns, self.keys, self.lengths = ids, turns, keys, lengths
        self.postings: dict[tuple[int, int], int] = {}
        for i, own in enumerate(turns):
            for at, k in enumerate(own):
                self.postings[at, k] = self.postings.get((at, k), 0) | (1 << i)

    def walk(self) -> Iterator[list]:
        """[parent, subtree size, path, depth, smallest id, members, children, length, ends] of every node, depth first."""
        nodes: list[list] = []
        open_ = [((1 << len(self.ids)) - 1, -1, b"", 0, 0)] if self.ids else []
        while open_:
            members, parent, path, depth, length = open_.pop()
            me, rest, children, ends = len(nodes), members, [], []
            while rest:
                low = rest & -rest
                i = low.bit_length() - 1
                if depth == len(self.turns[i]):
                    ends.append(i)
                    rest ^= low
                    continue
                k = self.turns[i][depth]
                child = members & self.postings[depth, k]
                children.append((child, me, hashlib.md5(path + self.keys[k]).digest(), depth + 1, self.lengths[k]))
                rest &= ~child
            first = self.ids[(members & -members).bit_length() - 1]
            nodes.append([parent, 1, path, depth, first, members.bit_count(), len(children), length, ends])
            open_.extend(reversed(children))
        for at in range(len(nodes) - 1, 0, -1):
            nodes[nodes[at][0]][1] += nodes[at][1]
        return nodes


def rebuilt(own: dict[int, list[int]], family: int = 100) -> dict[int, list[int]]:
    """Each conversation with the first turns of its family's base in place of its own: crc32(id) mod 6 turns."""
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def _shard_nodes(rebuild: Callable[[dict[int, list[int]]], dict[int, list[int]]]):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.sort_by([("conv_id", "ascending"), ("key", "ascending")])
        turn, conv = table.column("turn"), table.column("conv_id").to_numpy()
        order = np.lexsort((np.arange(len(conv)), turn.fill_null(0).to_numpy(), turn.is_valid().to_numpy(), conv))
        coded = table.column("key").combine_chunks().dictionary_encode()
        keys, at = [k for k in coded.dictionary.to_pylist()], coded.indices.to_numpy()[order].tolist()
        lengths = [0] * len(keys)
        for k, n in zip(at, table.column("length").to_numpy()[order].tolist(), strict=True):
            lengths[k] = n
        own: dict[int, list[int]] = {}
        for c, k in zip(conv[order].tolist(), at, strict=True):
            own.setdefault(c, []).append(k)
        whole = rebuild(own)
        ids = sorted(whole)
        floor = ids[0]
        rows = Shard(ids, [whole[c] for c in ids], keys, lengths).walk()
        packed = [np.array([ids[i] - floor for i in r[8]], "<u2").tobytes() if r[8] else None for r in rows]
        packed = [None if p is None else int(floor).to_bytes(8, "little", signed=True) + p for p in packed]
        parent, size, path, depth, first, n, children, length, _ = map(list, zip(*rows, strict=True))
        return pa.Table.from_arrays(
            [pa.array(x, t) for x, t in zip([[shard] * len(rows), range(len(rows)), parent, size, path, depth, first, n, children, length, packed], NODES.types, strict=True)], schema=NODES
        )

    return run


def _subtree_sums(table: pa.Table) -> pa.Table:
    """What one shard adds to each node it holds: children and leaves it owns, members times length, less the lengths it owns."""
    table = table.sort_by([("pre", "ascending")])
    col = {name: table.column(name).to_numpy() for name in table.column_names if name != "path"}
    pre, parent, end = col["pre"], col["parent"], col["pre"] + col["size"]
    owned = col["first"] == col["all_first"]
    above = lambda x: np.concatenate(([0], np.cumsum(x)))
    within = lambda x: above(x)[end] - above(x)[pre]
    saved = col["n"] * col["length"] - owned * col["length"]
    children = np.bincount(parent[1:], weights=owned[1:], minlength=len(pre)).astype(np.int64)
    parent_first = pa.array(col["all_first"][np.maximum(parent, 0)], mask=parent < 0)
    leaves = within((owned & (col["most_children"] == 0)).astype(np.int64))
    return pa.Table.from_arrays(
        [table.column("path").cast(pa.binary()), *[pa.array(x) for x in (col["depth"], col["all_first"])], parent_first, *[pa.array(x) for x in (col["all_n"], children, leaves, within(saved))]], schema=PARTS
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each path, joined by commas; rows come by path and ascending shard."""
    path, state, out = None, None, []

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], ["path", "digest"])

    for batch in batches:
        for p, ends in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if p != path:
                if state:
                    out.append((path, state.hexdigest()))
                path, state, joint = p, hashlib.sha256(), ""
            floor = int.from_bytes(ends[:8], "little", signed=True)
            ids = np.frombuffer(ends, "<u2", offset=8).astype(np.int64) + floor
            state.update((joint + ",".join(map(str, ids.tolist()))).encode())
            joint = ","
        if len(out) >= 10_000:
            yield closed()
            out.clear()
    if state:
        out.append((path, state.hexdigest()))
    if out:
        yield closed()


def _fields(schema: pa.Schema) -> str:
    kind = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kind[f.type]}" for f in schema)


def trie(conversations: DataFrame, rebuild: Callable[[dict[int, list[int]]], dict[int, list[int]]] = dict) -> DataFrame:
    """One row per node of (path, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``rebuild`` maps the turn lists of a shard's conversations to those that are indexed.
    """
    shards = turn_keys(conversations).groupBy("shard").applyInArrow(_shard_nodes(rebuild), _fields(NODES))
    nodes = cut(shards, "trie")
    same = Window.partitionBy("path")
    joined = nodes.drop("ends").select(
        "*", F.min("first").over(same).alias("all_first"), F.sum("n").over(same).alias("all_n"), F.max("local_children").over(same).alias("most_children")
    )
    parts = joined.groupBy("shard").applyInArrow(_subtree_sums, _fields(PARTS))
    ended = nodes.filter(F.col("ends").isNotNull()).select("path", "shard", "ends").repartition("path").sortWithinPartitions("path", "shard")
    digests = ended.mapInArrow(_digests, "path binary, digest string")
    nothing: dict[str, Column] = {f.name: F.lit(None).cast("long") for f in PARTS if f.name != "path"}
    rows = parts.withColumn("digest", F.lit(None).cast("string")).unionByName(digests.select("path", *[c.alias(k) for k, c in nothing.items()], "digest"))
    return rows.groupBy("path").agg(
        F.max("depth").alias("depth"), F.min("first").alias("conv_id"), F.min("parent_first").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.sum("children").alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.coalesce(F.max("digest"), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
