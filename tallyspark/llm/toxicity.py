"""Toxicity with noisy-channel deobfuscation.

Words that may be disguised (leetspeak such as ``1d10t``, marks or blanks between letters, stretched letters) become a
lattice: for each character the letters it may stand for, or nothing, with a channel cost. Viterbi decoding under a
character trigram model finds the likeliest plain word. The model counts the letter words of all documents. Scores
come from the restored words: word forms and word beginnings that learning rows show significantly more often in toxic
texts add their log odds, and a logistic curve turns the sum into a probability.

Null, empty or wordless texts have no evidence and get the base score. Rows without a label or id are scored, not
learned from. Repeated rows score alike. Without any labels every score is 0.5. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.words import blocks, text_of

#: Letters a character may stand for besides itself; a blank text stands for "left out". Fixed values of the channel.
STANDS_FOR = {
    "0": ("o",), "1": ("i", "l"), "3": ("e",), "4": ("a",), "5": ("s",), "6": ("g",), "7": ("t",), "8": ("b",), "9": ("g",),
    "@": ("a",), "$": ("s",), "!": ("i",), "|": ("i", "l"), "+": ("t",), "(": ("c",), "<": ("c",), "€": ("e",), "£": ("l",),
    ".": ("",), "-": ("",), "_": ("",), "*": ("",), " ": ("",), "/": ("",), "~": ("",), "^": ("",), "'": ("",), ",": ("",),
}
SUBSTITUTED, DROPPED, LEFT_OUT, STRETCHED = -1.5, -7.0, -0.7, -0.5
#: Learning rows whose evidence sums fit the logistic curve.
CURVE_ROWS = 50_000
#: Toxic texts a form must be in to be evidence, however many there are, and their share of all texts it is in.
LEAST_TEXTS, PURITY = 5, 0.85
KEPT_WORDS = 400_000
_SYMBOLS = "abcdefghijklmnopqrstuvwxyz"
_SPACED = re.compile(r"(?<![^\s\"'(\[{«“‘])(?:[\w@$!€£][ .\-_*]{1,3}){2,}[\w@$!€£](?!\w)")
_GAPS = [re.compile(r"[ .\-_*]" + n) for n in ("{2,}", "{3}")]
_STRETCHED = re.compile(r"(.)\1\1")
_EDGE = ".,!?;:\"'()[]{}*$%#&|<>~^_-+=/\\@€£`´«»“”‘’…"
#: Signs and digits that may be letters, and the marks around a word that never are.
_LETTERED = frozenset(c for c, readings in STANDS_FOR.items() if readings != ("",))
_SIGNS = "".join(sorted(_LETTERED))
_MARKS = "".join(c for c in _EDGE if c not in _LETTERED)


def _index(c: str) -> int:
    """0 edge, 1-26 a-z, 27 any other letter."""
    return ord(c) - 96 if "a" <= c <= "z" else 27


class Trigrams:
    """Interpolated character trigram log probabilities over edge, a-z and one class of other letters."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(28, 28, 28).astype(float)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + 28)
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3).tolist()


def word_trigrams(word: str) -> list[int]:
    x = [0, 0, *map(_index, word), 0]
    return [(x[i] * 28 + x[i + 1]) * 28 + x[i + 2] for i in range(len(x) - 2)]


def lattice(core: str, edges: str = "") -> list[list[tuple[str, float]]]:
    """For each character (or run of one letter) its possible readings with their channel cost.

    ``edges``: signs that are easily left out at the edges of the word.
    """
    out: list[list[tuple[str, float]]] = []
    first, last = len(core) - len(core.lstrip(edges)), len(core.rstrip(edges)) - 1
    i = 0
    while i < len(core):
        c, j = core[i], i + 1
        while j < len(core) and core[j] == c:
            j += 1
        if c.isalpha():
            n = j - i
            out.append([(c, 0.0 if n == 1 else STRETCHED * (1 if n == 2 else 0.2)), *([(c + c, 0.0)] if n > 1 else [])])
        else:
            readings = [(r, SUBSTITUTED if r else LEFT_OUT) for r in STANDS_FOR.get(c, ("",))]
            if c in edges and (i < first or i > last):
                out.extend([[*readings, ("", LEFT_OUT)]] * (j - i))
                i = j
                continue
            out.append(readings if "" in STANDS_FOR.get(c, ("",)) else [*readings, ("", DROPPED)])
            out.extend([[("", LEFT_OUT), *readings]] * (j - i - 1))
        i = j
    return out


def viterbi(readings_of: list[list[tuple[str, float]]], model: Trigrams) -> str:
    """The likeliest plain word behind a disguised one, given as its lattice."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for readings in readings_of:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, word) in best.items():
            for letters, cost in readings:
                s, x, y = score + cost, a, b
                for c in letters:
                    z = _index(c)
                    s += model.log[x][y][z]
                    x, y = y, z
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, word + letters)
        best = after
    return max((score + model.log[a][b][0], word) for (a, b), (score, word) in best.items())[1]


def disguised(core: str) -> bool:
    """Whether a word has letters or leet signs and anything that plain words don't have."""
    if core.isalpha():
        return _STRETCHED.search(core) is not None
    return any(c.isalpha() for c in core)


def restored(token: str, model: Trigrams) -> list[str]:
    """The words a lower-case token may be: without the marks around it, and with those that may be letters.

    The marks are taken twice, left out where the model likes that better, as in ``idiot!``, and each as a letter, as in
    ``a$$``. What looks disguised is decoded. Empty if it is no word.
    """
    plain, out = token.strip(_EDGE), []
    if plain and not plain.isdigit():
        if disguised(plain):
            out.append(viterbi(lattice(plain), model))
        elif plain.isalpha():
            out.append(plain)
    marked = token.strip(_MARKS)
    if (marked != plain or marked.isdigit()) and sum(c in _LETTERED or c.isalpha() for c in marked) > 2:
        out.append(viterbi(lattice(marked, _SIGNS), model))
        out.append(viterbi([[r for r in x if r[0]] or x for x in lattice(marked)], model))
    return out


def spelt(run: str) -> Iterator[str]:
    """The words that letters with blanks or marks between them may be, joined by hyphens.

    A letter at the end may be a word of its own (``a m o r o n``), and wider gaps may part words.
    """
    parts = {run, *(p for gap in _GAPS for p in gap.split(run))}
    for letters in (re.split(r"[ .\-_*]+", p) for p in parts):
        for x in (letters, letters[1:], letters[:-1], letters[1:-1]):
            if len(x) > 2:
                yield "-".join(x)


def beginnings(word: str) -> list[str]:
    """The forms a word counts under: itself and its beginnings of four to six letters, marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in (4, 5, 6) if len(word) > n)] if len(word) > 2 else []


@dataclass
class Words:
    """Per token what it contributes; kept between texts, since most tokens are frequent."""

    model: Trigrams
    weights: dict[str, float] | None = None
    seen: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def forms(self, token: str) -> tuple[str, ...]:
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) > KEPT_WORDS:
                self.seen.clear()
            forms = dict.fromkeys(f for word in restored(token, self.model) for f in beginnings(word))
            got = self.seen[token] = tuple(forms if self.weights is None else [f for f in forms if f in self.weights])
        return got

    def of(self, text: str) -> set[str]:
        """All forms of a text, words spelt with blanks between the letters included."""
        text = text.lower()
        tokens = set(text.split())
        for m in _SPACED.finditer(text):
            tokens.update(spelt(m[0]))
        seen, out = self.seen, set()
        for t in tokens:
            got = seen.get(t)
            if got is None:
                got = self.forms(t)
            if got:
                out.update(got)
        return out


@dataclass
class Model:
    trigrams: Trigrams
    weights: dict[str, float]
    slope: float
    base: float


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of the letter words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = np.zeros(256, np.int64)
        fold[97:123] = np.arange(1, 27)
        fold[65:91] = np.arange(1, 27)
        fold[128:] = 27
        total = np.zeros(28**3, np.int64)
        for batch in blocks(batches):
            for text in text_of(batch).to_pylist():
                data = np.frombuffer((text or "").encode(), np.uint8)
                x = np.concatenate(([0, 0], fold[data[data & 0xC0 != 0x80]], [0]))  # one byte for each character
                codes = (x[:-2] * 28 + x[1:-1]) * 28 + x[2:]
                total += np.bincount(codes[(x[1:-1] > 0) | (x[2:] > 0)], minlength=28**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["gram", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(28**3, np.int64)
    for r in rows:
        out[r["gram"]] = r["n"]
    out = out.reshape(28, 28, 28)
    out[0, 0] += out[1:, 0].sum(axis=0)  # after one edge a word begins, whatever stood before it
    return out


def learn(docs: DataFrame, labelled: DataFrame) -> Model:
    """``docs`` gives the character model; ``labelled`` has (text, toxic) rows to learn from."""
    trigrams = Trigrams(character_counts(docs))
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(trigrams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, totals = Words(shared.value), {}
        for batch in blocks(batches):
            for text, toxic in zip(text_of(batch).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for form in words.of(text or ""):
                    totals.setdefault(form, [0, 0])[toxic] += 1
            if len(totals) > KEPT_WORDS:
                yield _counted(totals)
                totals = {}
        yield _counted(totals)

    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Model(trigrams, {}, 1.0, 0.0)
    forms = labelled.select("text", "toxic").mapInArrow(count, "form string, clean long, toxic long").groupBy("form").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # A form is evidence if it is nearly only in toxic texts, and chance alone would hardly give it there so often.
    rate, many = toxic / (toxic + clean), F.col("toxic") + F.col("clean")
    spread = F.sqrt(many * rate * (1 - rate))
    strong = (F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") >= PURITY * many) & (F.col("toxic") - many * rate > 4.5 * spread + 1.0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    chosen = forms.filter(strong & (odds > 2)).select("form", odds.alias("odds")).collect()
    weights = {r["form"]: r["odds"] for r in chosen}
    evidence = sc.broadcast((trigrams, weights))
    share = min(1.0, CURVE_ROWS / (clean + toxic))
    part = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) <= int(1_000_000 * share)).select("text", "toxic")
    got = part.mapInArrow(lambda b: _sums(b, evidence.value), "sum double, toxic int").groupBy("sum", "toxic").agg(F.count("*").alias("n")).collect()
    x, y, n = (np.array([r[c] for r in got], float) for c in ("sum", "toxic", "n"))
    return Model(trigrams, weights, *_curve(x, y, n))


def _counted(totals: dict[str, list[int]]) -> pa.RecordBatch:
    values = list(totals.values())
    return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), *(pa.array([v[i] for v in values], pa.int64()) for i in (0, 1))], ["form", "clean", "toxic"])


def _evidence(words: Words, text: str) -> float:
    """Log odds of the forms found, the strongest in full and each further one less; rounded to make few values."""
    found = sorted((words.weights[f] for f in words.of(text)), reverse=True)
    return round(sum(w / (1 + i) for i, w in enumerate(found)), 2)


def _sums(batches: Iterator[pa.RecordBatch], model: tuple[Trigrams, dict[str, float]]) -> Iterator[pa.RecordBatch]:
    words = Words(*model)
    for batch in blocks(batches):
        sums = [_evidence(words, t or "") for t in text_of(batch).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.float64()), batch.column(1).cast(pa.int32())], ["sum", "toxic"])


def _curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and base of the logistic curve, lightly held towards slope 1 (Newton steps)."""
    a, b = 1.0, -3.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(n * (p - y) * x).sum() + (a - 1), (n * (p - y)).sum() + 0.01 * (b + 3)])
        hess = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence): probability of toxicity, and the restored forms that count."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = Words(m.trigrams, m.weights)
        for batch in blocks(batches):
            scores, found = [], []
            for text in text_of(batch).to_pylist():
                x = m.slope * _evidence(words, text or "") + m.base
                scores.append(1 / (1 + exp(-max(-30.0, min(30.0, x)))))
                found.append(sorted(words.of(text or "")) if scores[-1] >= 0.5 else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.string()))], ["doc_id", "score", "evidence"])

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, score double, evidence array<string>")


