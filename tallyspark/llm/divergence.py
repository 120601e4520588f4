"""Source divergence audit: how differently the sources of a language use its terms, by a minimal-perfect-hash recount.

First pass: documents per (lang, term), counted exactly; a language keeps the terms of at least ``least_docs`` documents. Its
kept terms are dealt into shards of about ``SHARD_TERMS``. A task gives each shard a minimal perfect hash: a term that is
alone at its place of a bit array takes the rank of its bit, the others go to a next array. The terms themselves are stored
by slot. Second pass: blocks of shards of at most ``BLOCK_BYTES`` are broadcast, every text is read against every block, and
each word is looked up, compared with the stored term byte by byte, and counted in the dense slots of its (lang, source).
Dense slots are held for as many groups as fit ``HELD_SLOTS`` and then handed on. So what a task or the driver holds is
bounded whatever the vocabulary; a larger one costs more passes.

Probabilities are exact integers (decimals where a product may not fit). The distance of two sources is summed over chunks
of slots: a task holds a matrix of sources and slots of at most ``CELLS`` cells and adds the distances of all its pairs, as
the result itself has a row for each pair.

Null text, lang or source: empty text, lang or source of that name. A language without kept terms: distances 0, no terms.
Texts of any length are cut into ranges of a megabyte between words; a text counts once a term however many ranges it has.
Ties: items ascending by UTF-8. Repeated rows: documents of their own. Empty table: no rows. Equal word hashes of different
terms: found by the comparison and told apart by the term. Other columns, doc_id too, are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import words
from tallyspark.plans.keyed import cut

LETTERS = words.Alphabet(bytes([*range(65), *range(91, 97), *range(123, 128)]))
SHARD_TERMS = 50_000
#: Bytes of perfect hashes and their stored terms that are broadcast at once.
BLOCK_BYTES = 32 << 20
#: Counters that a task holds (8 bytes each).
HELD_SLOTS = 8 << 20
#: Cells (8 bytes each) of a matrix of sources and slots, and slots of a chunk at most.
CELLS, CHUNK = 4 << 20, 4096
SCALE, PRIOR = 1_000_000_000, 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all bytes of the given ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def same_bytes(a: np.ndarray, a_at: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Whether each range of ``a`` has the bytes of the same range of ``b``; ranges are not empty."""
    same = a_len == b_len
    k = np.flatnonzero(same)
    if len(k):
        equal = a[spread(a_at[k], a_len[k])] == b[spread(b_at[k], b_len[k])]
        same[k] = np.logical_and.reduceat(equal, np.cumsum(a_len[k]) - a_len[k])
    return same


def strings(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[spread(at, lengths)].tobytes())]).cast(pa.string())


def terms(column: pa.Array, bits: int = 64) -> Iterator[tuple]:
    """(whether the last text goes on, lower-case bytes, text, start, length, hash) of all terms, range by range; ``bits`` of the hash are kept."""
    data, offsets = words.buffers(column)
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[offsets[:-1]] = True
    for at, stop in words._cuts(data, starts_text[:-1], LETTERS):
        part, new = _LOWER[data[at:stop]], starts_text[at:stop]
        inside = ~LETTERS.separates[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | new[1:]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | new[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(starts):
            continue
        up, down = (words._UP, words._DOWN) if len(part) <= words.BLOCK_BYTES else (words._powers(words._BASE, len(part)), words._powers(pow(words._BASE, -1, 2**64), len(part)))
        hashes = words.mix(np.add.reduceat(LETTERS.codes[part] * up[: len(part)], starts) * down[starts]) >> np.uint64(64 - bits)
        text = np.searchsorted(offsets, at + starts, "right") - 1
        yield offsets[text[-1] + 1] > stop, part, text, starts, ends - starts, hashes


def numbered(part: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each term, equal for equal terms only, and the place of one term of each number."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    same = same_bytes(part, starts, lengths, part, starts[first[number]], lengths[first[number]])
    if same.all():
        return number, first
    text = [part[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    seen: dict[bytes, int] = {}
    number = np.array([seen.setdefault(t, len(seen)) for t in text])
    return number, np.unique(number, return_index=True)[1]


def _coded(batch: pa.RecordBatch, name: str) -> tuple[list[str], np.ndarray]:
    coded = batch.column(name).fill_null("").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _document_terms(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.blocks(batches):
            langs, lang_of = _coded(batch, "lang")
            before, open_text = set(), -1  # terms of a text that goes on in the next range
            for goes_on, part, text, starts, lengths, hashes in terms(batch.column("text"), bits):
                number, first = numbered(part, starts, lengths, hashes)
                m = len(first)
                pairs = np.unique(text * m + number)
                known = lambda k: part[starts[first[k]] : starts[first[k]] + lengths[first[k]]].tobytes()  # noqa: E731, B023
                if before and text[0] == open_text:
                    old = [p for p in pairs[: np.searchsorted(pairs, (open_text + 1) * m)].tolist() if known(p % m) in before]
                    pairs = np.setdiff1d(pairs, old, assume_unique=True)
                if not goes_on or text[-1] != open_text:
                    before, open_text = set(), int(text[-1])
                if goes_on:
                    before.update(known(p % m) for p in pairs[np.searchsorted(pairs, open_text * m) :].tolist())
                found, n = np.unique(lang_of[pairs // m] * m + pairs % m, return_counts=True)
                at = first[found % m]
                lang = pa.DictionaryArray.from_arrays(pa.array(found // m, pa.int32()), pa.array(langs, pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lang, strings(part, starts[at], lengths[at]), pa.array(n, pa.int64())], ["lang", "term", "n"])

    return run


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: bit arrays in turn, each for the keys that shared a place before."""

    def __init__(self, keys: np.ndarray):
        self.n, self.levels, base = len(keys), [], 0
        while len(keys):
            m = (2 * len(keys) + 63) // 64 * 64
            place = self._place(keys, len(self.levels), m)
            alone = np.bincount(place, minlength=m) == 1
            packed = np.packbits(alone, bitorder="little").view(np.uint64)
            rank = base + np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1]
            self.levels.append((m, packed, rank))
            base += int(alone.sum())
            keys = keys[~alone[place]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (words.mix(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(m)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key not hashed any slot or -1."""
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for level, (m, packed, rank) in enumerate(self.levels):
            place = self._place(keys[open_], level, m)
            word, bit = packed[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = rank[place[hit] >> 6] + below
            open_ = open_[~hit]
        return out


class TermShard:
    """Perfect hash of the terms of one shard with the terms stored by slot; of terms with one hash all but the first are listed."""

    def __init__(self, own: list[bytes], hashes: np.ndarray):
        _, first = np.unique(hashes, return_index=True)
        self.hash = PerfectHash(hashes[first])
        order = np.empty(len(first), np.int64)
        order[self.hash.slots(hashes[first])] = first
        later = sorted(set(range(len(own))) - set(first.tolist()))
        self.order = np.concatenate((order, np.array(later, np.int64)))  # the term of each slot
        self.twins = {own[k]: len(first) + i for i, k in enumerate(later)}
        self.twin_hashes = np.unique(hashes[later]) if later else hashes[:0]
        self.n = len(own)
        self.stored = np.frombuffer(b"".join(own[k] for k in order), np.uint8)
        self.lengths = np.array([len(own[k]) for k in order], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def find(self, part: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slot of each term of ``part``, -1 where it is not kept."""
        slot = self.hash.slots(hashes)
        k = np.flatnonzero(slot >= 0)
        slot[k[~same_bytes(part, starts[k], lengths[k], self.stored, self.starts[slot[k]], self.lengths[slot[k]])]] = -1
        if self.twins:
            for k in np.flatnonzero((slot < 0) & np.isin(hashes, self.twin_hashes)).tolist():
                slot[k] = self.twins.get(part[starts[k] : starts[k] + lengths[k]].tobytes(), -1)
        return slot


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (words.mix(hashes ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(shards)).astype(np.int64)


def _dealt(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes = np.concatenate([h for *_, h in terms(batch.column("term"), bits)])
                shards = batch.column("shards").to_numpy().astype(np.uint64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard_of(hashes, shards))], [*batch.schema.names, "shard"])

    return run


def _built(bits: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("term").combine_chunks()
        own = table.column("term").combine_chunks().cast(pa.string())
        shard = TermShard([t.encode() for t in own.to_pylist()], np.concatenate([h for *_, h in terms(own, bits)]))
        n = len(own)
        lang, k, shards = (table.column(c)[0].as_py() for c in ("lang", "shard", "shards"))
        columns = [[lang] * (n + 1), [k] * (n + 1), [shards] * (n + 1), [*range(n), None], [*own.take(pa.array(shard.order)).to_pylist(), None], [None] * n + [pickle.dumps(shard)]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary()), strict=True)], names=["lang", "shard", "shards", "slot", "term", "hash"])

    return run


def _recounted(block, bits: int):
    """Counts of one block: {lang: (shards, {shard: (first slot, pickled TermShard)}, slots)}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {lang: (shards, {k: (base, pickle.loads(blob)) for k, (base, blob) in own.items()}, n) for lang, (shards, own, n) in block.value.items()}
        held: dict[tuple[str, str], np.ndarray] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in held.items():
                at = np.flatnonzero(counts)
                bases = sorted((base, k) for k, (base, _) in known[lang][1].items())
                which = np.searchsorted([b for b, _ in bases], at, "right") - 1
                shard = np.array([k for _, k in bases], np.int64)[which]
                slot = at - np.array([b for b, _ in bases], np.int64)[which]
                same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(at), np.int32))) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(shard), pa.array(slot.astype(np.int32)), pa.array(counts[at])], ["lang", "source", "shard", "slot", "n"])
            held.clear()

        for batch in words.blocks(batches):
            langs, lang_of = _coded(batch, "lang")
            sources, source_of = _coded(batch, "source")
            for _, part, text, starts, lengths, hashes in terms(batch.column("text"), bits):
                for code in np.unique(lang_of[text]).tolist():
                    lang = langs[code]
                    if lang not in known:
                        continue
                    shards, own, n = known[lang]
                    mine = np.flatnonzero(lang_of[text] == code)
                    slot = np.full(len(mine), -1)
                    dealt = shard_of(hashes[mine], shards)
                    for k, (base, shard) in own.items():
                        some = np.flatnonzero(dealt == k)
                        at = mine[some]
                        found = shard.find(part, starts[at], lengths[at], hashes[at])
                        slot[some] = np.where(found >= 0, found + base, -1)
                    kept = slot >= 0
                    cells, times = np.unique(source_of[text[mine[kept]]] * n + slot[kept], return_counts=True)
                    for s in np.unique(cells // n).tolist():
                        if (lang, sources[s]) not in held:
                            if held and sum(map(len, held.values())) + n > HELD_SLOTS:
                                yield from handed_on()
                            held[lang, sources[s]] = np.zeros(n, np.int64)
                        a, b = np.searchsorted(cells, (s * n, (s + 1) * n))
                        held[lang, sources[s]][cells[a:b] - s * n] += times[a:b]
        yield from handed_on()

    return run


def _distances(table: pa.Table) -> pa.Table:
    """(lang, a, b, value) of all pairs a < b of a chunk; rows of slot -1 name the sources, their empty p and the chunk's width."""
    slot, source, p = (table.column(c).to_numpy() for c in ("slot", "sid", "p"))
    head = slot < 0
    order = np.argsort(source[head])
    ids, empty, width = source[head][order], p[head][order], int(table.column("width").to_numpy()[head][0])
    cells = np.repeat(empty[:, None], width, axis=1)
    cells[np.searchsorted(ids, source[~head]), slot[~head]] = p[~head]
    a, b, value = [], [], []
    for i in range(len(ids) - 1):
        a.append(np.full(len(ids) - i - 1, ids[i]))
        b.append(ids[i + 1 :])
        value.append(np.abs(cells[i + 1 :] - cells[i]).sum(axis=1))
    none = np.zeros(0, np.int64)
    a, b, value = (np.concatenate([none, *x]).astype(np.int64) for x in (a, b, value))
    lang = pa.array([table.column("lang")[0].as_py()], pa.string()).take(pa.array(np.zeros(len(a), np.int32)))
    return pa.table([lang, pa.array(a), pa.array(b), pa.array(value)], names=["lang", "a", "b", "value"])


def _p(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR kept)), exact."""
    top = (count.cast("decimal(20,0)") + PRIOR) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, total + PRIOR * kept) + 1


def kept_terms(docs: DataFrame, least_docs: int = 30, bits: int = 64) -> DataFrame:
    """(lang, term) of every language's terms that are in ``least_docs`` of its documents or more."""
    counted = docs.select("lang", "text").mapInArrow(_document_terms(bits), "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_docs).select("lang", "term")


def recount(docs: DataFrame, least_docs: int = 30, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """((lang, shard, shards, slot, term) of the kept terms, (lang, source, shard, slot, n) of what occurs)."""
    spark = docs.sparkSession
    kept = cut(kept_terms(docs, least_docs, bits), "terms")
    deal = kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD_TERMS).cast("long").alias("shards"))
    dealt = kept.join(deal, "lang").mapInArrow(_dealt(bits), "lang string, term string, shards long, shard long")
    built = cut(dealt.groupBy("lang", "shard").applyInArrow(_built(bits), "lang string, shard long, shards long, slot int, term string, hash binary"), "perfect")
    done = spark.createDataFrame([], "lang string, source string, shard long, slot int, n long")
    block: dict = {}
    held = 0

    def passed(block: dict) -> DataFrame:
        own = docs.select("lang", "source", "text").mapInArrow(_recounted(spark.sparkContext.broadcast(block), bits), "lang string, source string, shard long, slot int, n long")
        return cut(own.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n")), "recount")

    hashes = built.filter(F.col("hash").isNotNull()).join(built.groupBy("lang", "shard").agg(F.count("slot").alias("m")), ["lang", "shard"]).select("lang", "shard", "shards", "m", "hash")
    for row in hashes.orderBy("lang", "shard").toLocalIterator():  # one partition at a time
        if held and held + len(row["hash"]) > BLOCK_BYTES:
            done, block, held = done.unionByName(passed(block)), {}, 0
        shards, own, n = block.get(row["lang"], (row["shards"], {}, 0))
        block[row["lang"]] = (shards, {**own, row["shard"]: (n, row["hash"])}, n + row["m"])
        held += len(row["hash"])
    if block:
        done = done.unionByName(passed(block))
    return built.filter(F.col("hash").isNull()).drop("hash"), done


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` of every two sources, part ``term`` of a source's own terms."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    names, counts = recount(docs, least_docs, bits)
    v = names.groupBy("lang").agg(F.count("*").alias("v"))
    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    seen = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one").join(total, ["lang", "source"], "left").join(v, "lang", "left")
    order = Window.partitionBy("lang")
    groups = seen.select(
        "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"), (F.row_number().over(order.orderBy("source")) - 1).cast("long").alias("sid")
    )
    groups = cut(groups.withColumn("sources", F.count("*").over(order)).withColumn("chunk_slots", F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.floor(CELLS / F.col("sources")))).cast("long")), "groups")

    found = counts.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("total"), F.col("v")))
    found = cut(found.select("lang", "source", "sid", "shard", "slot", "n", "p", "chunk_slots"), "p")

    own = names.groupBy("lang", "shard").agg(F.count("*").alias("m"))
    slots = groups.filter("v > 0").join(own, "lang").withColumn("chunk", F.explode(F.sequence(zero, F.expr("(m - 1) div chunk_slots"))))
    slots = slots.withColumn("width", F.least("chunk_slots", F.col("m") - F.col("chunk") * F.col("chunk_slots")))
    nothing = groups.filter("v = 0").select("*", zero.alias("shard"), zero.alias("chunk"), zero.alias("width"))
    empty = F.when(F.col("v") > 0, _p(zero, F.col("total"), F.greatest("v", F.lit(1)))).otherwise(0)
    cells = ["lang", "shard", "chunk", "sid", "slot", "p", "width"]
    heads = slots.select(nothing.columns).unionByName(nothing).select("lang", "shard", "chunk", "sid", F.lit(-1).cast("long").alias("slot"), empty.alias("p"), "width")
    at = found.select("lang", "shard", F.expr("slot div chunk_slots").alias("chunk"), "sid", (F.col("slot") % F.col("chunk_slots")).alias("slot"), "p", zero.alias("width"))
    pairs = heads.select(cells).unionByName(at.select(cells)).groupBy("lang", "shard", "chunk").applyInArrow(_distances, "lang string, a long, b long, value long")
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    pairs = pairs.select("lang", "value", both.alias("ab")).select("lang", F.col("ab.x").alias("sid"), F.col("ab.y").alias("other"), "value")
    label = groups.select("lang", "sid", "source")
    pairs = pairs.join(label, ["lang", "sid"]).join(label.select("lang", F.col("sid").alias("other"), F.col("source").alias("item")), ["lang", "other"])

    whole = counts.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("all_n"))
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("v").alias("lang_v"))
    q = whole.join(of_lang, "lang").select("lang", "shard", "slot", _p(F.col("all_n"), F.col("lang_total"), F.col("lang_v")).alias("q"))
    more = found.select("lang", "source", "shard", "slot", "p").join(q, ["lang", "shard", "slot"]).filter(F.col("p") > F.col("q"))
    own_terms = more.join(names.select("lang", "shard", "slot", "term"), ["lang", "shard", "slot"]).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(by_value).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(own_terms, "term").filter(F.col("rank") <= top))
