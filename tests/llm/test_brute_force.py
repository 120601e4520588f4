"""Decoders, classifiers, fingerprints, shards and packing against plain versions that try everything."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import PARAGRAPH, documents
from pyspark.sql import functions as F

from tallyspark.llm import language_id, packing, quality, syncmers, toxicity

TEXT = "the idiot and the clown were stupid but the moron was pathetic scum and trash is disgusting loser worthless " * 5


def spelled(model, word):
    """Log-likelihood of a word under the trigrams, letter by letter."""
    a = b = 0
    total = 0.0
    for c in word:
        z = toxicity._index(c)
        total += model.log[a][b][z]
        a, b = b, z
    return total + model.log[a][b][0]


@pytest.mark.parametrize("seen", ["1d10t", "m0r0n", "$cum", "tr@$h", "cl0vvn", "l0$er", "5tupid", "id-iot", "aa55", "b!tch", "x"])
def test_viterbi_against_every_reading(spark, seen):
    """The best of all readings of a lattice, and its score."""
    got = test_viterbi_against_every_reading
    if not hasattr(got, "model"):
        got.model = toxicity.Trigrams(toxicity.character_counts(spark.createDataFrame([(TEXT,)], "text string")))
    lattice = toxicity.lattice(seen)
    scored = {}
    for path in itertools.product(*lattice):
        word = "".join(letters for letters, _ in path)
        scored[word] = max(scored.get(word, -math.inf), sum(cost for _, cost in path) + spelled(got.model, word))
    assert math.isclose(scored[toxicity.viterbi(lattice, got.model)], max(scored.values()), abs_tol=1e-9)


def test_character_counts_against_a_loop(spark):
    texts = ["Ab cé! the THE", "", None, "x-y 日本", "zz\nzz"]
    want = Counter()
    for text in texts:
        folded = [0, 0] + [ord(c) - 96 if "a" <= c <= "z" else 27 if ord(c) > 127 else 0 for c in (text or "").translate({i: i + 32 for i in range(65, 91)})] + [0]
        for a, b, c in zip(folded, folded[1:], folded[2:]):
            if b or c:
                want[(0, 0, c) if b == 0 else (a, b, c)] += 1
                if b == 0 and a:
                    want[a, 0, c] += 1
    table = toxicity.character_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    assert {k: n for k, n in want.items() if k[0] == 0 or k[1]} == {tuple(map(int, k)): int(table[k]) for k in zip(*np.nonzero(table)) if k[0] == 0 or k[1]}


def test_language_counts_and_decoding_against_loops(spark):
    """Gram shares, bit weights, scores and the nearest codeword, each by definition."""
    rng = random.Random(3)
    words = {"aa": ["kalo", "meri", "sutto"], "bb": ["wrzk", "pfnt", "glisch"], "cc": ["oiuea", "eau", "aoi"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(20)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    codes = language_id.learn(df.select("text", "lang", F.xxhash64("doc_id", "text").alias("draw")).repartition(3))
    counts = {x: Counter() for x in codes.languages}
    for _, text, lang in rows:
        counts[lang].update(language_id.grams(np.frombuffer(text.encode(), np.uint8)).tolist())
    size = 1 << language_id.BITS
    share = {x: {g: (c[g] + 0.5) / (sum(c.values()) + 0.5 * size) for g in set().union(*counts.values())} for x, c in counts.items()}
    for b in range(codes.words.shape[1]):
        up = [x for x, w in zip(codes.languages, codes.words) if w[b] > 0]
        down = [x for x, w in zip(codes.languages, codes.words) if w[b] < 0]
        for g in list(share["aa"])[:50]:
            want = math.log(sum(share[x][g] for x in up) / max(1, len(up)) + 1e-9) - math.log(sum(share[x][g] for x in down) / max(1, len(down)) + 1e-9)
            assert abs(codes.weights[g, b] - want) < 1e-4
    f = np.random.default_rng(1).normal(codes.centre, 2 * codes.scale, (40, len(codes.centre)))
    best, p, _ = language_id.decode(codes, f)
    for i, row in enumerate(f):
        loss = []
        for word in codes.words:
            margins = [max(-4.0, min(4.0, (x - c) / s)) for x, c, s in zip(row, codes.centre, codes.scale)]
            loss.append(sum(t * math.log1p(math.exp(-2 * m * w)) for t, m, w in zip(codes.trust, margins, word)) / sum(codes.trust))
        assert best[i] == min(range(len(loss)), key=lambda k: loss[k])
        assert abs(p[i] - 1 / sum(math.exp(-4 * (x - min(loss))) for x in loss)) < 1e-6
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, F.lit(True)).select("row.doc_id", "lang_pred").collect()}
    assert sum(found[i] == lang for i, _, lang in rows) >= 0.97 * len(rows)


def naive_isotonic(y, w):
    """Weighted isotonic means by the minimum over ends of the maximum over beginnings."""
    n = len(y)
    mean = lambda i, j: sum(y[k] * w[k] for k in range(i, j + 1)) / sum(w[i : j + 1])
    return [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


def test_isotonic_against_the_definition():
    rng = random.Random(8)
    for _ in range(20):
        n = rng.randrange(1, 12)
        x, y, w = np.arange(n, dtype=float), np.array([rng.choice([0.0, 0.5, 1.0]) for _ in range(n)]), np.array([float(rng.randrange(1, 4)) for _ in range(n)])
        middles, means = quality.isotonic(x, y, w)
        want = naive_isotonic(y.tolist(), w.tolist())
        blocks = [list(g) for _, g in itertools.groupby(range(n), key=lambda k: round(want[k], 9))]
        assert np.allclose(means, [want[g[0]] for g in blocks])
        assert np.allclose(middles, [np.average(x[g], weights=w[g]) for g in blocks])


K, S = syncmers.K, syncmers.S


def signed(h):
    return h - (1 << 32) if h >= 1 << 31 else h


def test_anchors_against_a_loop(spark):
    """Which k-mers are anchors, by looking at every inner substring; hashes come from the engine, one by one."""
    tokens = [PARAGRAPH[i : i + 3].replace(" ", "x").replace("\n", "y") for i in range(0, 150, 3)]
    pairs = [tokens[i : i + S] for i in range(len(tokens) - S + 1)]
    inner = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(F.xxhash64(F.xxhash64("a"), F.xxhash64("b"))).collect()]
    want = []
    for i in range(len(tokens) - K + 1):
        window = inner[i : i + K - S + 1]
        if min(window) in (window[0], window[-1]):
            want.append(i)
    got = spark.createDataFrame([(" ".join(tokens),)], "text string").select(syncmers.anchors(F.col("text"))).first()[0]
    assert [a["pos"] for a in got] == want and len(want) > 5
    assert max(b - a for a, b in zip(want, want[1:])) <= K - S


def test_fingerprints_follow_one_rule_at_every_length(spark):
    """Prefixes of one text are the more alike the longer they are; no length behaves unlike its neighbours."""
    tokens = [f"{c}{i}" for i in range(60) for c in "k"]
    texts = [" ".join(tokens[:n]) for n in range(1, 60)]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts, 1)], "n int, text string").select("n", syncmers.marks(F.col("text")).alias("m"))
    got = {r["n"]: set(r["m"]) for r in rows.collect()}
    assert all(got.values())
    alike = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    near = [alike(got[n], got[n + 1]) for n in range(20, 58)]
    assert min(near) > 0.45 and max(near) < 1


def test_likeness_wants_anchors_in_step(spark):
    """The same words in another order of passages share most steps, single words dealt anew share none."""
    rng = random.Random(2)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i % 10}" for i in range(240)]
    moved = words[120:] + words[:120]
    mixed = rng.sample(words, len(words))
    rows = spark.createDataFrame([(" ".join(words), " ".join(moved), " ".join(mixed))], "a string, b string, c string")
    near, far = rows.select(*[syncmers.likeness(syncmers.marks(F.col("a")), syncmers.marks(F.col(x))) for x in "bc"]).first()
    assert near > 0.7 and far < 0.1


def least_bins(sizes, capacity):
    """The fewest bins, by trying every place for every piece."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity:
                bins[b] += sizes[i]
                place(i + 1, bins)
                bins[b] -= sizes[i]
        bins.append(sizes[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best


def test_packing_against_the_optimum(spark):
    """Up to nine pieces: no more than one bin above the optimum, and the best fit of a loop in the order of sizes."""
    rng = random.Random(4)
    for _ in range(4):
        sizes = sorted((rng.randrange(100, 2049) for _ in range(9)), reverse=True)
        rows = [(i, 0, 0, n, 0) for i, n in enumerate(sizes)]
        pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
        got = packing.pack(pieces, capacity=2048).collect()
        bins = Counter()
        for r in got:
            bins[r["sequence_id"]] += r["length"]
        assert max(bins.values()) <= 2048 and sorted(r["length"] for r in got) == sorted(sizes)
        room = []
        for n in sizes:
            fits = [i for i, r in enumerate(room) if r >= n]
            if fits:
                i = min(fits, key=lambda i: room[i])
                room[i] -= n
            else:
                room.append(2048 - n)
        assert least_bins(sizes, 2048) <= len(bins) <= len(room)


def test_shards_by_a_loop(spark):
    """Every shard's rows, slots and bytes from the result alone; copies together unless larger than any room."""
    from tallyspark.llm import sharding

    rows = [(i, f"text {i % 37} " * (1 + i % 5), "en", "s", 0) for i in range(400)]
    got = sharding.shard(spark, documents(spark, rows), 8).collect()
    load, slots, homes = Counter(), {}, {}
    text_of = {r[0]: r[1] for r in rows}
    for r in got:
        assert r["size"] == len(text_of[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text_of[r["doc_id"]].encode())
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(text_of[r["doc_id"]], set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for text in text_of.values():
        groups[text] += len(text.encode()) + 1
    assert max(load.values()) - min(load.values()) <= 2 * max(groups.values()) and all(len(h) == 1 for h in homes.values())
