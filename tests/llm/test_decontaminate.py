import hashlib
import random

import numpy as np
from cases import ROWS, alnum_words, documents

from tallyspark.llm import decontaminate
from tallyspark.llm.decontaminate import FMIndex, find_passages, judged

ITEMS = [
    (1, "the quick brown fox went over the hill to see whether the lazy dog was still asleep"),
    (2, "past the mill and the old stone bridge and told everybody what it had seen nobody"),
    (2, "Short item"),
    (10, "word"),
    (3, None),
    (4, "!!!"),
    (None, "une phrase sans numéro"),
]


def twin(rows, items, span=13):
    out = []
    phrases = []
    for name, text in items:
        w = alnum_words(text)
        phrases += [("" if name is None else str(name), w[i : i + span]) for i in range(max(1, len(w) - span + 1) if w else 0)]
    for doc, text in rows:
        w, hit, found = alnum_words(text), set(), set()
        for name, p in phrases:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(name)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def result(df, bench):
    rows = judged(find_passages(df, bench)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return sorted([tuple(r) for r in rows], key=str)


def test_awkward_rows(spark, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [r for r in ROWS if r[0] != 8]
    expected = twin([(r[0], r[1]) for r in rows], ITEMS)
    assert result(documents(spark, rows, extra=True), bench) == expected
    whole = find_passages(documents(spark, rows, extra=True), bench, whole_rows=True)
    assert whole.count() == len(rows) and whole.select("row.*").columns == documents(spark, extra=True).columns
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 60)  # items in several blocks
    assert result(documents(spark, rows), bench) == expected


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert result(documents(spark, []), bench) == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r[2] == 0 and not r[5] for r in result(documents(spark), none))


def test_random_texts(spark):
    rng = random.Random(5)
    words = "a b c d e".split()
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 20)))) for i in range(8) if i]
    rows = [(i, " ".join(rng.choice([*words, "x", "Y,"]) for _ in range(rng.randrange(0, 200))), "en", "s", 0) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert result(documents(spark, rows), bench) == twin([(r[0], r[1]) for r in rows], items)


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    text = np.concatenate((rng.integers(1, 5, 400), [0]))
    index = FMIndex(text)
    patterns = [text[i : i + n] for i in range(0, 390, 13) for n in (1, 3, 7)] + [np.array([4, 4, 4, 4, 4, 4, 4, 4, 4])]
    which, low, high = index.search(patterns)
    found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high, strict=True)}
    for i, p in enumerate(patterns):
        assert found.get(i, []) == [j for j in range(len(text) - len(p) + 1) if (text[j : j + len(p)] == p).all()]
