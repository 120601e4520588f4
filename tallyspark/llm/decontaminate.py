"""Benchmark decontamination with one FM-index per shard of training text.

A phrase is a window of ``span`` consecutive words of a benchmark item (an item of fewer words is one phrase). Each
shard, a few megabytes of documents inside a task, becomes a word sequence over the benchmark's vocabulary; places
that no phrase can cover (words or word pairs that no phrase has, stretches shorter than every phrase with the word)
shrink to one separator. The index of that sequence is its Burrows-Wheeler transform with wavelet-matrix ranks: all
phrases are searched backwards at once, occurrences are located by stepping to sampled suffix positions, and the found
spans are merged per document.

Benchmarks of any size: items are taken in blocks of ``ITEM_BYTES`` text, one pass over the documents for each block,
and the spans of all blocks are merged.

Null or wordless documents: no words, no hits. Null or wordless items: no phrase. Items that share an id count once.
Empty tables: no rows, or no hits. Repeated rows stay rows of their own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.words import ALNUM, blocks, buffers, text_of, word_hashes

#: Benchmark text that one pass over the documents searches for.
ITEM_BYTES = 8 << 20
#: Every so many text positions keep their suffix-array entry.
SAMPLE = 8


class Phrases:
    """The distinct phrases of some items over a sorted vocabulary of word hashes."""

    def __init__(self, items: list[tuple[str, str]], span: int):
        names = sorted({name for name, _ in items})
        index = {name: i for i, name in enumerate(names)}
        data, offsets = buffers(pa.array([text for _, text in items], pa.string()))
        words, first = word_hashes(data, offsets, ALNUM)
        self.vocabulary, codes = np.unique(words, return_inverse=True)
        found: dict[tuple[int, ...], set[int]] = {}
        for (name, _), a, b in zip(items, first[:-1].tolist(), first[1:].tolist(), strict=True):
            seq = codes[a:b].tolist()
            for i in range(max(1, len(seq) - span + 1) if seq else 0):
                found.setdefault(tuple(seq[i : i + span]), set()).add(index[name])
        self.names = np.array(names, object)
        self.phrases = [np.array(p) for p in found]
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.owners = [np.array(sorted(v)) for v in found.values()]
        size = len(self.vocabulary)
        self.shortest = np.full(size, 1 << 30)
        pairs: list[np.ndarray] = []
        for p in self.phrases:
            self.shortest[p] = np.minimum(self.shortest[p], len(p))
            pairs.append(p[:-1] * size + p[1:])
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)


def member(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each value in a sorted array, and whether it is there."""
    if not len(sorted_values):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return at, sorted_values[at] == x


def reduce_shard(phrases: Phrases, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (0 end, 1 separator, 2 + code) and the word position behind each symbol (-1 for the others)."""
    code, known = member(phrases.vocabulary, words)
    opens = np.zeros(len(words) + 1, bool)
    opens[first] = True
    joined = known[:-1] & known[1:] & ~opens[1:-1] if len(words) else np.zeros(0, bool)
    at = np.flatnonzero(joined)
    joined[at] = member(phrases.pairs, code[at] * len(phrases.vocabulary) + code[at + 1])[1]
    run = np.concatenate(([0], np.cumsum(~joined))) if len(words) else np.zeros(0, np.int64)
    length = np.bincount(run)[run] if len(words) else run
    keep = np.flatnonzero(known)
    keep = keep[phrases.shortest[code[keep]] <= length[keep]]
    breaks = np.flatnonzero((np.diff(keep) > 1) | (np.diff(run[keep]) > 0)) + 1
    symbols = np.insert(code[keep] + 2, breaks, 1)
    places = np.insert(keep, breaks, -1)
    return np.concatenate((symbols, [1, 0])), np.concatenate((places, [-1, -1]))


class FMIndex:
    """Backward search over an integer text that ends in a unique smallest 0."""

    def __init__(self, text: np.ndarray):
        n = self.n = len(text)
        order = self._suffixes(text)
        bwt = text[order - 1]
        self.alphabet = int(text.max()) + 1
        counts = np.bincount(text, minlength=self.alphabet)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        self.counts, self.bwt = counts, bwt
        self.bits = max(1, int(self.alphabet - 1).bit_length())
        self.levels = []  # wavelet matrix: per level the ones before each place, and the number of zeros
        rest = bwt
        for level in reversed(range(self.bits)):
            bit = (rest >> level) & 1
            ones = np.concatenate(([0], np.cumsum(bit)))
            self.levels.append((level, ones, n - int(ones[-1])))
            rest = np.concatenate((rest[bit == 0], rest[bit == 1]))
        self.marked = order % SAMPLE == 0
        self.sample_rank = np.cumsum(self.marked) - 1
        self.samples = order[self.marked]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling."""
        n, step = len(text), 1
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        while True:
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = rank[step:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank[order] = new
            if new[-1] == n - 1:
                return order
            step *= 2

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        low = np.zeros_like(places)
        for level, ones, zeros in self.levels:
            bit = (symbols >> level) & 1 == 1
            a, b = ones[low], ones[places]
            low = np.where(bit, zeros + a, low - a)
            places = np.where(bit, zeros + b, places - b)
        return places - low

    def search(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, lowest row, end of rows) of the patterns that occur."""
        lengths = np.array([len(p) for p in patterns], np.int64)
        table = np.zeros((len(patterns), int(lengths.max())), np.int64)
        for i, p in enumerate(patterns):
            table[i, : len(p)] = p[::-1]
        alive, low, high = np.arange(len(patterns)), np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        done = []
        for step in range(table.shape[1]):
            c = table[alive, step]
            low, high = self.before[c] + self.rank(c, low), self.before[c] + self.rank(c, high)
            ok = high > low
            alive, low, high = alive[ok], low[ok], high[ok]
            ended = lengths[alive] == step + 1
            done.append((alive[ended], low[ended], high[ended]))
            alive, low, high = alive[~ended], low[~ended], high[~ended]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by walking back to a sampled suffix."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.marked[rows[open_]]
            got = open_[hit]
            out[got] = self.samples[self.sample_rank[rows[got]]] + steps[got]
            open_ = open_[~hit]
            c = self.bwt[rows[open_]]
            rows[open_] = self.before[c] + self.rank(c, rows[open_])
            steps[open_] += 1
        return out


def occurrences(phrases: Phrases, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every place of the shard where a phrase stands."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.phrases) or not len(words):
        return none
    symbols, places = reduce_shard(phrases, words, first)
    if len(symbols) <= 2:
        return none
    index = FMIndex(symbols)
    there = np.zeros(max(index.alphabet, len(phrases.vocabulary) + 2), bool)
    there[: index.alphabet] = index.counts > 0
    possible = [i for i, p in enumerate(phrases.phrases) if there[p + 2].all()]
    if not possible:
        return none
    which, low, high = index.search([phrases.phrases[i] + 2 for i in possible])
    n = high - low
    rows = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else low
    return np.repeat(np.array(possible)[which], n), places[index.locate(rows)]


def _found(phrases: Phrases, batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = buffers(text_of(batch))
    words, first = word_hashes(data, offsets, ALNUM)
    which, place = occurrences(phrases, words, first)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + phrases.lengths[which] if len(which) else place, -1)
    hit = np.cumsum(edge[:-1]) > 0
    change = hit.copy()
    inner = first[:-1][first[:-1] < len(words)]
    change[1:] = hit[1:] & ~hit[:-1]
    change[inner] = hit[inner]
    starts = np.flatnonzero(change)
    stops_at = hit.copy()
    stops_at[:-1] = hit[:-1] & ~hit[1:]
    last = first[1:][first[1:] > first[:-1]] - 1
    stops_at[last] = hit[last]
    stops = np.flatnonzero(stops_at) + 1
    doc = np.searchsorted(first, starts, "right") - 1
    ends = np.searchsorted(doc, np.arange(len(first)), "left").astype(np.int32)
    begin = first[doc] if len(doc) else starts
    spans = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(starts - begin, pa.int64()), pa.array(stops - begin, pa.int64())], ["start", "stop"]))
    owners = [phrases.owners[i] for i in which]
    at = np.repeat(np.searchsorted(first, place, "right") - 1, [len(o) for o in owners])
    pairs = np.unique(at * max(1, len(phrases.names)) + (np.concatenate(owners) if owners else np.zeros(0, np.int64)))
    who, item = np.divmod(pairs, max(1, len(phrases.names)))
    ends = np.searchsorted(who, np.arange(len(first)), "left").astype(np.int32)
    items = pa.ListArray.from_arrays(pa.array(ends), pa.array(phrases.names[item].tolist(), pa.string()))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first), pa.int64()), spans, items, batch.column(1)], ["doc_id", "n_words", "spans", "items", "row"])


def find_passages(docs: DataFrame, benchmark: DataFrame, span: int = 13, whole_rows: bool = False) -> DataFrame:
    """(doc_id, n_words, spans, items): merged word ranges under a phrase and the items they come from.

    ``spans`` holds ``struct<start, stop>`` of word positions, half open, disjoint and in order; ``items`` the distinct
    item ids as text, in text order. ``whole_rows`` adds ``row``, the struct of all columns of ``docs``.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // ITEM_BYTES))
    numbered = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    columns = docs.columns if whole_rows else ["text"]
    frame = docs.select("doc_id", F.struct(*[docs[c] for c in columns]).alias("row"))
    kinds = [frame.schema[c].dataType.simpleString() for c in ("doc_id", "row")]
    schema = f"doc_id {kinds[0]}, n_words long, spans array<struct<start:long,stop:long>>, items array<string>, row {kinds[1]}"
    sc = docs.sparkSession.sparkContext

    def one(part: int) -> DataFrame:
        rows = numbered.filter(F.col("part") == part).select("item", "text").collect()
        shared = sc.broadcast(Phrases([(r["item"], r["text"]) for r in rows], span))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches):
                yield _found(shared.value, batch)

        return frame.mapInArrow(run, schema)

    if parts == 1:
        out = one(0)
    else:  # equal rows find the same in each block of items, so they are told apart by their number alone
        found = reduce(DataFrame.unionByName, [one(part).withColumn("part", F.lit(part)) for part in range(parts)])
        found = found.groupBy("doc_id", "row", "part").agg(F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.first("items").alias("items"), F.count("*").alias("copies"))
        merged = found.groupBy("doc_id", "row").agg(
            F.first("n_words").alias("n_words"),
            merge_spans(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.first("copies").alias("copies"),
        )
        out = merged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "n_words", "spans", "items", *(["row"] if whole_rows else []))


def merge_spans(spans: Column) -> Column:
    """Disjoint ranges that cover the same positions, in order."""
    kind = "array<struct<start:bigint,stop:bigint>>"
    grow = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
        F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))),
        ),
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), grow)


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and ``contaminated``: a twentieth or more of the words lie in passages."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    found = found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    found = found.withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
