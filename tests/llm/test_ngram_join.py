import random

import pytest
from cases import EXTRA, ROWS, components, documents, shingle_set

from tallyspark.llm import ngram_join
from tallyspark.llm.ngram_join import near_duplicates


def result(df, words, percent):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, words, percent).collect()}


def test_awkward_rows(spark):
    df = documents(spark, extra=True)
    rows = near_duplicates(df, 4, 85).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert got == components([(r[0], r[1]) for r in ROWS if r[0] is not None], 4, 85)
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert set(EXTRA) <= set(df.columns)


def test_empty_table(spark):
    assert near_duplicates(documents(spark, []), 5, 80).collect() == []


def test_families_of_copies_against_all_pairs(spark):
    """A large family with random edits, chains of copies, a passage that many share, and texts of few words."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    base, passage = [rng.choice(vocabulary) for _ in range(120)], [rng.choice(vocabulary) for _ in range(60)]
    rows = []

    def add(words):
        rows.append((len(rows) + 1, " ".join(words), "en", "s", 0))

    for _ in range(160):
        words = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        add(words)
    for _ in range(120):
        at = rng.randrange(40)
        own = [rng.choice(vocabulary) for _ in range(80)]
        add(own[:at] + passage + own[at:])
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for _ in range(40):
        chain = chain[1:] + [rng.choice(vocabulary)]
        add(chain)
    for n in (1, 1, 2, 2, 3, 4, 4, 5, 6):
        add(base[:n])
    for words, percent in ((4, 85), (5, 80)):
        assert result(documents(spark, rows), words, percent) == components([(r[0], r[1]) for r in rows], words, percent)


def test_crowd_without_any_pair_tried(spark):
    """Open cells of crowded buckets are tried although nothing else was."""
    text = " ".join(f"w{i}" for i in range(40))
    docs = documents(spark, [(1, text, "en", "s", 0), (2, text + " more", "en", "s", 0), (3, "one two three four five six", "en", "s", 0)])
    nodes = spark.createDataFrame([(i, n, i, 1) for i, n in ((1, 36), (2, 37), (3, 2))], "node long, n int, g long, members long")
    many = spark.createDataFrame([(i, n, 1, 7, pos) for i, n, pos in ((1, 36, 1), (2, 37, 1), (3, 2, 0))], "g long, n int, members long, token long, pos int")
    none = spark.createDataFrame([], "a long, b long")
    labels = ngram_join._labels(docs, (nodes, none, many), none, 5, 80)
    assert {(r["node"], r["component"]) for r in labels.collect()} == {(1, 1), (2, 1)}


def linked_rows(rows, words, percent):
    """[component of each row] by comparing all pairs of rows; rows of one doc_id are one."""
    sets = [shingle_set(t, words) for _, t in rows]
    home = list(range(len(rows)))

    def find(a):
        while home[a] != a:
            a = home[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and (rows[i][0] == rows[j][0] or 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)):
                home[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("turned", [False, True])
def test_one_id_for_different_texts(spark, turned):
    """Each text of an id keeps its links, whichever row comes first."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "quite another text of a few words"), (4, ""), (4, None), (5, b.upper()), (1, a)]
    rows = rows[::-1] if turned else rows
    df = documents(spark, [(d, t, "en", "s", 0) for d, t in [*rows, (None, a)]]).repartition(2)
    got = near_duplicates(df, 5, 80).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == linked_rows(rows, 5, 80)
    assert [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None] == [(56, None)]


def test_other_paths_give_the_same(spark, monkeypatch):
    """Documents picked by a join instead of a broadcast; every shared token makes a crowd."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(50):
        words = list(base) if i % 2 else [f"v{j}" for j in range(70)]
        for _ in range(rng.choice([0, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words), "en", "s", 0))
    want = components([(r[0], r[1]) for r in rows], 5, 80)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    assert result(documents(spark, rows), 5, 80) == want
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", 1)
    assert result(documents(spark, rows), 5, 80) == want
