import random
import re
from collections import defaultdict
from fractions import Fraction

from cases import EXTRA, ROWS, documents
from pyspark.sql import functions as F

from tallyspark.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(rows, weights=(3, 1, 2), share=Fraction(3, 2), epochs=2):
    """{source: (words, target)} by giving out what is left over, round after round."""
    words = defaultdict(int)
    for r in rows:
        words[r[3]] += size(r[1])
    names = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = {s: Fraction(0) for s in names}
    left, open_ = share * sum(words.values()), set(names)
    while left > 0 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = Fraction(0)
        for s in list(open_):
            if target[s] >= epochs * words[s]:
                left += target[s] - epochs * words[s]
                target[s] = Fraction(epochs * words[s])
                open_.remove(s)
    return {s: (words[s], target[s]) for s in names}


def check(rows, got, share=Fraction(3, 2), epochs=2):
    want = filled(rows, share=share, epochs=epochs)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    taken, n = defaultdict(int), defaultdict(int)
    for r in got:
        words, target = want[r["source"]]
        assert r["source_size"] == words and abs(r["target"] - float(target)) <= 1e-9 * max(1, words)
        assert 0 <= r["taken"] <= epochs * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
        n[r["source"]] += 1
    return {s: (taken[s] - float(target), words / n[s]) for s, (words, target) in want.items()}


def test_awkward_rows(spark):
    df = documents(spark, extra=True)
    got = mixing.mix(df).collect()
    check(ROWS, got)
    assert set(EXTRA) <= set(df.columns)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))


def test_empty_table_and_tables_without_words(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    rows = [(1, None, "en", "a", 0), (2, " ", "en", None, 1)]
    assert [(r["taken"], r["target"]) for r in mixing.mix(documents(spark, rows)).collect()] == [(0, 0.0)] * 2


def _varied():
    rng = random.Random(5)
    rows = []
    for source, n in (("hot", 2000), ("b", 300), ("ä", 200), (None, 300), ("one", 1), ("tiny", 12), ("zero", 4)):
        for _ in range(n):
            words = 0 if source == "zero" else rng.choice([1, 5, 20, 20, 30, 50, 80, 1500 if source == "b" else 60])
            rows.append((len(rows), " ".join(["wort"] * words), "en", source, 0))
    return rows


def test_many_sources_against_reshared_excess(spark, monkeypatch):
    """Targets, their limits and the words taken, with a hot source; every path gives the same rows."""
    rows = _varied()
    df = documents(spark, rows).repartition(4)
    got = mixing.mix(df).collect()
    for source, (off, mean) in check(rows, got).items():
        assert abs(off) <= mean or source == "one", (source, off)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(mixing, "SLOT_ROWS", 50)
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, got))


def test_each_seed_draws_others(spark):
    df = documents(spark, _varied())
    a, b = ({r["doc_id"]: r["taken"] for r in mixing.mix(df, seed=s).collect()} for s in (1, 2))
    assert a != b


def test_more_than_all_sources_can_give(spark):
    rows = [(i, "a b c", "en", f"s{i % 3}", 0) for i in range(9)]
    assert {(r["taken"], r["target"]) for r in mixing.mix(documents(spark, rows), share=Fraction(5)).collect()} == {(6, 18.0)}
    check(rows, mixing.mix(documents(spark, rows), share=Fraction(1, 2), epochs=1).collect(), Fraction(1, 2), 1)


def test_words_of_blanks_of_all_kinds(spark):
    texts = ["a\tb\x0bc\x0cd\re\nf g", "  ", "", None, " x y z", "w" * 70000, "日本 語"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.word_count(F.col("text")).alias("n"))
    assert all(r["n"] == size(r["text"]) for r in df.collect())
