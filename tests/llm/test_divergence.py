import random
import re
from collections import Counter, defaultdict

import numpy as np
from cases import EXTRA, LOWER, ROWS, documents

from tallyspark.llm import divergence
from tallyspark.llm.divergence import PerfectHash, TermShard, audit, kept_terms


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, least, top=50):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        docs[lang].update(set(terms(text)))
        counts[lang, source].update(terms(text))
    out = []
    p_of = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        count = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        all_n = {t: sum(count[s][t] for s in sources) for t in kept}
        p = {s: {t: p_of(n, sum(count[s].values()), len(kept)) for t, n in count[s].items()} for s in sources}
        q = {t: p_of(n, sum(all_n.values()), len(kept)) for t, n in all_n.items()}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(p[s][t] - q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", own)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def result(df, *args, **options):
    return sorted(tuple(r) for r in audit(df, *args, **options).collect())


def test_awkward_rows(spark):
    df = documents(spark, extra=True)
    for name in ("term", "shard", "slot", "hash", "rank"):
        df = df.selectExpr("*", f"'x' AS {name}")
    for least in (1, 2, 30):
        assert result(df, least) == brute(ROWS, least)
    assert set(EXTRA) <= set(df.columns)


def test_empty_table(spark):
    assert result(documents(spark, []), 30) == []


def _corpus():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in ("Ka", "ro", "ß", "日") for b in ("m", "né", "t") for c in ("", "x", "Y", "zz")]
    rows = []
    for i in range(400):
        source = "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", "S2", None, "é"])
        lang = rng.choice(["en", "en", "fr", None])
        words = [rng.choice(vocabulary[: 20 if source == "hot" else None]) for _ in range(rng.randrange(40))]
        rows.append((i, rng.choice([" ", "1", ", "]).join(words), lang, source, 0))
    return rows + [(500, "", "xx", "alone", 0), (501, None, "yy", "a", 0), (502, "7", "yy", "b", 0)]


def test_against_counting(spark):
    rows = _corpus()
    assert result(documents(spark, rows).repartition(5), 30) == brute(rows, 30)


def test_small_shards_blocks_and_slots(spark, monkeypatch):
    """Many shards, a pass for each, counters handed on again and again, chunks of a few slots."""
    rows = _corpus()
    for name, value in (("SHARD_TERMS", 7), ("BLOCK_BYTES", 3000), ("HELD_SLOTS", 40), ("CHUNK", 3), ("CELLS", 12)):
        monkeypatch.setattr(divergence, name, value)
    assert result(documents(spark, rows).repartition(3), 10) == brute(rows, 10)


def test_equal_hashes_are_told_apart(spark):
    rows = _corpus()
    assert result(documents(spark, rows).repartition(2), 10, bits=3) == brute(rows, 10)


def test_a_text_of_many_ranges_is_one_document(spark):
    long = "start " + "alpha beta " * 200_000 + "W" * 1_500_000 + " alpha gamma"
    rows = [(1, long, "en", "a", 0), (2, "beta delta", "en", "b", 0)]
    assert {r["term"] for r in kept_terms(documents(spark, rows), 2).collect()} == {"beta"}
    assert result(documents(spark, rows), 1) == brute(rows, 1)


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    found = PerfectHash(keys)
    assert sorted(found.slots(keys).tolist()) == list(range(len(keys)))
    assert sum(len(packed) * 64 for _, packed, _ in found.levels) < 4.5 * len(keys)
    assert (found.slots(keys + np.uint64(1)) < len(keys)).all()


def test_stored_terms_decide():
    own = [b"alpha", b"beta", b"gamma", b"delta"]
    shard = TermShard(own, np.array([7, 7, 9, 7], np.uint64))
    text = np.frombuffer(b"gammadeltaomegabetaalphaalphb", np.uint8)
    starts, lengths = np.array([0, 5, 10, 15, 19, 24]), np.array([5, 5, 5, 4, 5, 5])
    slots = shard.find(text, starts, lengths, np.array([9, 7, 9, 7, 7, 7], np.uint64)).tolist()
    named = [own[shard.order[s]].decode() if s >= 0 else None for s in slots]
    assert named == ["gamma", "delta", None, "beta", "alpha", None]
