"""Language identification by error-correcting output codes.

Every language of the learning rows has a codeword of +1/-1 bits. For each bit a binary classifier weighs hashed byte
n-grams of the text: the log ratio of their share in the languages with +1 and with -1, from counts over all learning
rows. A second pass over a bounded sample of learning rows centres each bit's score and measures its errors. Decoding
takes the codeword with the least logistic loss, each bit weighted by its reliability. A text is ambiguous when its
sign pattern is farther from the chosen codeword than the code can correct, or the second choice is about as good.

Texts that are null or have no letter get ``und`` with score 0; so does every text when nothing could be learned. Rows
without a language or id are predicted but not learned from. Repeated rows are predicted alike. Other columns are
neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.words import blocks, buffers, text_of

GRAM, BITS = 4, 15
#: Learning rows used to centre and weigh the bits; the n-gram counts use all learning rows.
CALIBRATION_ROWS = 20_000
STEP = 1 << 19
#: The best and the second language are told apart when their probabilities differ by this much.
CLEAR = 0.1

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[x for x in range(128) if not chr(x).isalpha()]] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[x for x in range(128) if chr(x).isalpha()]] = True


def grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram at each byte of lower-cased text, where other ASCII than letters is a blank."""
    b = _FOLD[data]
    upper = (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97) & (b[:-1] == 0xC3)  # two-byte capitals of Latin-1
    b[1:][upper] += 32
    n = max(0, len(b) - GRAM + 1)
    code = np.zeros(n, np.uint32)
    for i in range(GRAM):
        code = code * np.uint32(257) + b[i : i + n]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, start, stop) of parts of at most STEP bytes; parts of one text overlap by GRAM - 1."""
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a >= GRAM:
            yield i, a, min(b, a + STEP)
            a += STEP - GRAM + 1


@dataclass
class Codes:
    languages: list[str]
    words: np.ndarray  # languages x bits, +1 and -1
    weights: np.ndarray  # buckets x bits
    centre: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    @property
    def radius(self) -> int:
        """Bit errors that the code corrects."""
        apart = [int((a != b).sum()) for i, a in enumerate(self.words) for b in self.words[:i]]
        return (min(apart) - 1) // 2 if apart else 0


def codewords(n: int) -> np.ndarray:
    """Exhaustive codes for up to seven classes; beyond, the best spread of 200 random codes of 10 log2(n) bits."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, float).T
    rng, bits = np.random.default_rng(5), int(np.ceil(10 * np.log2(n)))
    spread = lambda m: ((m @ m.T) - 2 * bits * np.eye(n)).max()
    return min((rng.choice([-1.0, 1.0], (n, bits)) for _ in range(200)), key=spread)


def scores(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean n-gram weight of each text for each bit."""
    out, n = np.zeros((len(offsets) - 1, weights.shape[1])), np.zeros(len(offsets) - 1)
    for i, a, b in _pieces(offsets):
        g = grams(data[a:b])
        out[i] += np.bincount(g, minlength=len(weights)) @ weights if len(g) > 4 * len(weights) else weights[g].sum(axis=0)
        n[i] += len(g)
    return out / np.maximum(n, 1)[:, None]


def lettered(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    seen = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))
    has = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~has & (offsets[1:] > offsets[:-1])):
        has[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    return has


def learn(rows: DataFrame) -> Codes | None:
    """Codes from (text, lang, draw) rows; None without any language. The lowest ``draw`` numbers centre and weigh the bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in blocks(batches):
            data, offsets = buffers(batch.column(0))
            langs = batch.column(1).to_pylist()
            for i, a, b in _pieces(offsets):
                t = totals.setdefault(langs[i], np.zeros(1 << BITS, np.int64))
                np.add.at(t, grams(data[a:b]), 1)
        for lang, t in totals.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(t[at], pa.int64())], ["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    if not languages:
        return None
    table = np.zeros((len(languages), 1 << BITS))
    table[counts["lang"].map({x: i for i, x in enumerate(languages)}), counts["gram"]] = counts["n"]
    share = (table + 0.5) / (table + 0.5).sum(axis=1, keepdims=True)
    words = codewords(len(languages))
    plus, minus = np.maximum(words, 0), np.maximum(-words, 0)
    mean = lambda side: share.T @ (side / np.maximum(side.sum(axis=0), 1)) + 1e-9
    weights = (np.log(mean(plus)) - np.log(mean(minus))).astype(np.float32) if len(languages) > 1 else np.zeros((1 << BITS, 1), np.float32)
    bits = words.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((weights, {x: i for i, x in enumerate(languages)}))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, index = shared.value
        for batch in blocks(batches):
            data, offsets = buffers(batch.column(0))
            f = scores(w, data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array([index[x] for x in batch.column(1).to_pylist()], pa.int32()), pa.array(list(f), pa.list_(pa.float64()))], ["lang", "f"])

    total = rows.count()
    part = rows.filter(F.pmod("draw", F.lit(1 << 40)) < int((1 << 40) * min(1.0, CALIBRATION_ROWS / max(1, total))))  # about as many rows
    got = part.mapInArrow(measure, "lang int, f array<double>").toPandas()
    f, sign = (np.vstack(got["f"]), words[got["lang"]]) if len(got) else (np.zeros((0, bits)), np.zeros((0, bits)))
    centre, scale, trust = np.zeros(bits), np.ones(bits), np.ones(bits)
    for b in range(bits):
        up, down = f[sign[:, b] > 0, b], f[sign[:, b] < 0, b]
        if len(up) and len(down):
            centre[b] = (np.median(up) + np.median(down)) / 2
            scale[b] = max(1e-6, (np.median(up) - np.median(down)) / 2)
            wrong = ((up < centre[b]).mean() + (down > centre[b]).mean()) / 2
            trust[b] = np.log((1 - wrong + 1e-3) / (wrong + 1e-3))
    return Codes(languages, words, weights, centre, scale, np.maximum(trust, 0.05))


def decode(codes: Codes, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, probability, ambiguous) of each row of bit scores."""
    if len(codes.languages) == 1:
        return np.zeros(len(f), int), np.ones(len(f)), np.zeros(len(f), bool)
    margin = np.clip((f - codes.centre) / codes.scale, -4, 4)
    trust = codes.trust / codes.trust.sum()
    loss = np.stack([np.logaddexp(0, -2 * margin * word) @ trust for word in codes.words], axis=1)
    p = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    two = np.partition(p, -2, axis=1)[:, -2:]
    wrong = (np.sign(margin) != codes.words[best]).sum(axis=1)
    return best, p[np.arange(len(p)), best], (wrong > codes.radius) & (two[:, 1] - two[:, 0] < CLEAR)


def identify(docs: DataFrame, learnable: Column) -> DataFrame:
    """(row, lang_pred, lang_score, lang_ambiguous) with ``row`` the struct of all columns; ``learnable`` marks rows to learn from."""
    known = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    codes = learn(known.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("draw")))
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in blocks(batches):
            text = text_of(batch)
            data, offsets = buffers(text)
            ok = lettered(text, data, offsets) & (model is not None)
            if model is None:
                names, p, doubt = ["und"] * batch.num_rows, np.zeros(batch.num_rows), ~ok
            else:
                best, p, doubt = decode(model, scores(model.weights, data, offsets))
                names = [model.languages[i] if y else "und" for i, y in zip(best.tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.where(ok, p, 0.0)), pa.array(doubt & ok)], ["row", "lang_pred", "lang_score", "lang_ambiguous"]
            )

    frame = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return frame.mapInArrow(run, f"row {frame.schema['row'].dataType.simpleString()}, lang_pred string, lang_score double, lang_ambiguous boolean")
