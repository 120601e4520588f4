"""Quality scores: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Statistics of the whole text (letter, capital, digit, mark and space shares, word and line lengths, repetition) are
scaled by their mean and deviation over the learning rows and mapped to random cosine features, whose inner products
approximate a Gaussian kernel. Each partition sums its part of the normal equations; Spark adds the parts row by row,
and the driver solves one system of fixed size. Scores of learning rows that the fit has not seen are calibrated by
isotonic regression over fixed bins.

Null and empty texts have the statistics of the empty text. Rows without a label or id are scored, not learned from.
Repeated rows score alike. With one label value or none the score is that share (0.5 without labels). Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.words import SPACED, blocks, buffers, text_of, word_hashes

FEATURES, WIDTH, RIDGE, BINS = 256, 3.0, 1.0, 2000
STATISTICS = ("length", "words", "lower", "upper", "digit", "point", "symbol", "newline", "other", "word_length", "line_length", "distinct", "capitals")

_CLASS = np.full(256, 7)  # 0 lower, 1 upper, 2 digit, 3 point, 4 symbol, 5 blank, 6 newline, 7 non-ASCII
_CLASS[:128] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[list(b".,;:!?'\"()-")] = 3
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 5, 6


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    data, offsets = buffers(column)
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    counts = np.bincount(text * 8 + _CLASS[data], minlength=8 * len(n)).reshape(-1, 8).astype(float)
    words, first = word_hashes(data, offsets, SPACED)
    many = np.diff(first)
    order = np.lexsort((words, np.repeat(np.arange(len(many)), many)))
    new = np.ones(len(words), bool)
    if len(words):
        owner = np.repeat(np.arange(len(many)), many)
        new[1:] = (words[order][1:] != words[order][:-1]) | (owner[1:] != owner[:-1])
    distinct = np.bincount(np.repeat(np.arange(len(many)), many)[new], minlength=len(many)) if len(words) else np.zeros(len(many))
    size, count, lines = np.maximum(n, 1), np.maximum(many, 1), counts[:, 6] + 1
    letters = counts[:, 0] + counts[:, 1] + counts[:, 7]
    shares = [counts[:, i] / size for i in (0, 1, 2, 3, 4, 6, 7)]
    return np.column_stack([
        np.log1p(n), np.log1p(many), *shares, np.log1p((n - counts[:, 5] - counts[:, 6]) / count), np.log1p(many / lines), distinct / count, counts[:, 1] / np.maximum(letters, 1),
    ])


@dataclass
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    coefficients: np.ndarray
    edges: np.ndarray  # raw scores where the calibrated score changes
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.coefficients

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.edges):
            return np.full(len(x), self.values[0])
        return np.interp(self.raw(x), self.edges, self.values)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every text."""
    frame = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(statistics(text_of(batch))), pa.list_(pa.float64()))], ["doc_id", "x"])

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy().reshape(len(column), -1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators over sorted ``x``: block middles and their non-decreasing means."""
    blocks_: list[list[float]] = []
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist(), strict=True):
        blocks_.append([a * c, b * c, c])
        while len(blocks_) > 1 and blocks_[-2][1] * blocks_[-1][2] >= blocks_[-1][1] * blocks_[-2][2]:
            top = blocks_.pop()
            blocks_[-1] = [p + q for p, q in zip(blocks_[-1], top, strict=True)]
    return np.array([b[0] / b[2] for b in blocks_]), np.array([b[1] / b[2] for b in blocks_])


def learn(rows: DataFrame, seed: int = 17) -> Model:
    """From (x, label, fitted) rows: ``fitted`` rows make the ridge fit, the others the calibration."""
    d = len(STATISTICS)
    sums = rows.select(*[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d)], *[F.sum(F.get("x", F.lit(i)) ** 2).alias(f"q{i}") for i in range(d)], F.count("*").alias("n"), F.avg("label").alias("share")).first()
    n, share = sums["n"], sums["share"]
    rng = np.random.default_rng(seed)
    mean = np.array([(sums[f"s{i}"] or 0.0) / max(1, n) for i in range(d)])
    deviation = np.sqrt(np.maximum([(sums[f"q{i}"] or 0.0) / max(1, n) for i in range(d)] - mean**2, 1e-6))
    base = Model(mean, deviation, rng.normal(0, 1 / WIDTH, (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(0), np.array([0.5 if share is None else share]))
    if n == 0 or share in (0.0, 1.0):
        return base
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(base)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                phi = shared.value.features(_matrix(batch, "x"))
                total += phi.T @ np.column_stack([phi, batch.column(1).to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.filter("fitted").select("x", F.col("label").cast("double").alias("label")).mapInArrow(equations, "i int, row array<double>")
    system = {r["i"]: r["row"] for r in parts.groupBy("i").applyInArrow(_added, "i int, row array<double>").collect()}
    table = np.array([system[i] for i in range(FEATURES + 1)])
    base.coefficients = np.linalg.solve(table[:, :-1] + RIDGE * np.diag([1.0] * FEATURES + [1e-6]), table[:, -1])
    fitted = sc.broadcast(base)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.clip(fitted.value.raw(_matrix(batch, "x")), -1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.round(raw * BINS).astype(int), pa.int64()), batch.column(1)], ["bin", "label"])

    held = rows.filter("not fitted").select("x", F.col("label").cast("double").alias("label"))
    bins = held.mapInArrow(binned, "bin long, label double").groupBy("bin").agg(F.avg("label").alias("y"), F.count("*").alias("w")).orderBy("bin").collect()
    if bins:
        x, y, w = (np.array([r[c] for r in bins], float) for c in ("bin", "y", "w"))
        base.edges, base.values = isotonic(x / BINS, y, w)
        base.values = np.clip(base.values, 0.01, 0.99)
    else:
        base.edges, base.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return base


def _added(key: tuple, table: pa.Table) -> pa.Table:
    rows = table["row"].combine_chunks()
    total = rows.flatten().to_numpy().reshape(len(rows), -1).sum(axis=0)
    return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([total], pa.list_(pa.float64()))})


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of (doc_id, x) rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(_matrix(batch, "x")) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
