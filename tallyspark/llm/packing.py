"""Bound-certified best-fit packing of tokenised documents into sequences of a fixed length.

Documents become token ids and an end id; longer ones are cut so that only the first piece is short, and full pieces
are sequences of their own. The others are packed in partitions of bounded size by best-fit decreasing. Dual-feasible
functions give a lower bound on each partition's sequences: where the bound is met the packing is certified and stays,
but for a sequence that is half empty. In the other partitions full sequences stay. The documents of the rest are dealt anew among fewer
partitions of twice the size, which pack again, until nothing is gained or after four rounds.

Null text: empty, one end id. Very long texts are streamed through as pieces. Repeated rows are pieces of their own.
Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.words import blocks
from tallyspark.plans.keyed import cut

#: Pieces that one task packs.
PARTITION = 40_000
#: Words whose ids a worker keeps.
KEPT_WORDS = 800_000
MARKS = ".,!?;:*$%#&|"
ROUNDS = 4


class ByteBpe:
    """Token ids of a byte-level BPE given as ranks, with the ids of space-separated words kept.

    Byte-level pre-tokenisation never joins a blank-led word to what stands before it, so the ids of ``" word"`` do not
    depend on the text around it. Texts with other white space next to a blank are encoded whole.
    """

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.words: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def learn(self, word: str) -> bytes | None:
        """Ids of a new word; letters and the marks after them are kept apart, so that few forms are new."""
        if not word or word != word.strip():
            found = None
        else:
            stem = word.rstrip(MARKS)
            if stem and len(stem) < len(word) and stem.isalpha():
                marks = "\0" + word[len(stem) :]
                found = (self.words.get(stem) or self.learn(stem)) + (self.words.get(marks) or self.words.setdefault(marks, self.whole(marks[1:])))
            else:
                found = self.whole(" " + word)
        self.words[word] = found
        return found

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        head, *rest = text.split(" ")
        words = self.words
        try:
            known = [words[w] for w in rest]
        except KeyError:
            if len(words) > KEPT_WORDS:
                words.clear()
            known = [words[w] if w in words else self.learn(w) for w in rest]
        if None in known or head[:1].isspace() or head[-1:].isspace():
            return self.whole(text)
        return self.whole(head) + b"".join(known)


@lru_cache(1)
def encoder(ranks: str, pattern: str) -> ByteBpe:
    return ByteBpe(ranks, pattern)


def tokenize(docs: DataFrame, ranks: str, pattern: str, capacity: int, end: int, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, if wanted, ids): pieces of at most ``capacity`` ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks, pattern)
        for batch in blocks(batches):
            at, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = bpe.ids(text or "") + last
                n = len(ids) // 4
                a, b, k = 0, (n - 1) % capacity + 1, 0
                while a < n:
                    part = ids[4 * a : 4 * b]
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(np.frombuffer(part, "<u4").astype(np.int64))
                    a, b, k = b, b + capacity, k + 1
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the best dual-feasible function of the threshold and the rounding family."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    for cut_off in np.unique(np.concatenate((sizes[2 * sizes <= capacity], capacity - sizes[2 * sizes > capacity] + 1))):
        if 2 * cut_off > capacity:
            continue
        value = np.where(sizes > capacity - cut_off, capacity, np.where(sizes >= cut_off, sizes, 0))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    for k in range(2, 21):  # k pieces of more than capacity / (k + 1): u(x) = floor((k + 1) x) / k
        whole = (k + 1) * sizes % capacity == 0
        value = np.where(whole, k * sizes, capacity * ((k + 1) * sizes // capacity))
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each length by best-fit decreasing."""
    bins = np.zeros(len(lengths), np.int64)
    room: dict[int, list[int]] = {}
    free: list[int] = []
    made = 0
    values = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = values[i]
        at = bisect_left(free, size)
        if at < len(free):
            left = free[at]
            b = room[left].pop()
            if not room[left]:
                del free[at]
        else:
            b, left, made = made, capacity, made + 1
        bins[i] = b
        left -= size
        if left:
            if not room.setdefault(left, []):
                insort(free, left)
            room[left].append(b)
    return bins


def _pack_partition(table: pa.Table, capacity: int) -> pa.Table:
    """Adds sequence_id, offset and ``settled``: the partition meets its bound (unless half empty), or the sequence is full."""
    lengths = table["length"].to_numpy()
    uid = table["uid"].to_numpy()
    bins = best_fit(lengths, capacity)
    made = int(bins.max()) + 1 if len(bins) else 0
    certified = made == lower_bound(lengths, capacity)
    order = np.lexsort((uid, bins))
    first = np.searchsorted(bins[order], np.arange(made))
    ends = np.cumsum(lengths[order])
    offset = ends - lengths[order]
    offset -= np.repeat(offset[first], np.diff(np.append(first, len(order)))) if made else 0
    filled = np.bincount(bins, lengths, made)
    out = table.select([c for c in table.column_names if c not in ("part", "sequence_id", "offset", "settled")]).take(pa.array(order))
    fill = filled[bins[order]]
    settled = 2 * fill > capacity if certified else fill == capacity  # at most one sequence is half empty
    for name, values in (("sequence_id", uid[order][first][bins[order]] if made else uid), ("offset", offset), ("settled", settled)):
        out = out.append_column(name, pa.array(values))
    return out


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """The pieces with sequence_id (the ``uid`` of its first piece) and offset; ``pieces`` needs ``length``."""
    pieces = cut(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    names = pieces.columns
    done = [pieces.filter(F.col("length") == capacity).select(*names, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = pieces.filter(F.col("length") < capacity)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long, settled boolean"
    before = None
    for turn in range(ROUNDS):
        n = rest.count()
        if n == 0:
            break
        parts = -(-n // (PARTITION << turn))
        dealt = rest.select(*names, F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)).alias("part"))
        packed = cut(dealt.groupBy("part").applyInArrow(lambda t: _pack_partition(t, capacity), schema), "packed")
        made = packed.filter("not settled").select("sequence_id").distinct().count()
        last = parts == 1 or turn == ROUNDS - 1 or (before is not None and made >= before)
        done.append((packed if last else packed.filter("settled")).drop("settled"))
        if last:
            break
        rest, before = packed.filter("not settled").select(*names), made
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed token ids of each sequence; at most its capacity of ids is gathered."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
