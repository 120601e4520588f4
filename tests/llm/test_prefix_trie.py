import hashlib
import random
import zlib
from collections import defaultdict

from tallyspark.llm import prefix_trie
from tallyspark.llm.prefix_trie import rebuilt, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def turns_of(rows):
    """{conv_id: [(role, text)]} in order; equal turn numbers go by the hash of the turn."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, key), (role, text)))
    return {c: [t for _, t in sorted(x)] for c, x in own.items()}


def brute(convs):
    """All nodes by looking at every prefix of every conversation."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = lambda p: [q for q in members if q[: len(p)] == p]
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p] for p in members}
    out = []
    for p, own in members.items():
        ends = sorted(c for c in own if len(convs[c]) == len(p))
        out.append((
            min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children[p]), sum(not children[q] for q in below(p)),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in below(p) if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(map(str, out))


def result(df, **options):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(str(tuple(r)) for r in trie(df, **options).select(*cols).collect())


def fold(c):
    return zlib.crc32(str(c).encode()) % 6


def family(convs):
    out = {}
    for c, turns in convs.items():
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[: fold(c)] + turns[fold(c) :]
    return out


def test_awkward_rows(spark):
    rows = [
        (0, 0, "user", "hello"), (0, 1, "assistant", None), (0, None, None, "first"), (0, None, "user", None), (1, 5, "user", "hello"), (1, 5, "user", "hello"), (1, 7, "user", "x" * 300_000),
        (None, 0, "user", "nobody"), (-150, 0, "user", "hello"), (-100, 3, "user", "hello"), (-7, 0, "user", "été 日本"), (2**62, 1, "user", "hello"), (101, 0, "a", ":b"), (100, 0, "a:", "b"), (102, 0, "a", "b"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("shard", "path", "n", "pre", "key", "length", "ends"):
        df = df.selectExpr("*", f"'x' AS {name}")
    assert result(df) == brute(turns_of(rows))
    assert result(df, rebuild=rebuilt) == brute(family(turns_of(rows)))


def test_empty_table_and_only_null_ids(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert result(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)) == []


def test_shared_prefixes_over_many_shards(spark, monkeypatch):
    """A common first turn, a conversation that a third repeats, others that share some turns; shards are a few ids wide."""
    rng = random.Random(8)
    rows = []
    for c in range(600):
        if rng.random() < 0.33:
            texts = ["hi", "there", "all", "of you"]
        else:
            texts = ["hi"] + [rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(6))]
        if c % 100 and rng.random() < 0.1:
            texts = texts[:1]
        rows += [(c * 3, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(family(turns_of(rows)))
    assert result(df, rebuild=rebuilt) == want
    monkeypatch.setattr(prefix_trie, "WIDTH", 100)
    assert result(df, rebuild=rebuilt) == want


def test_long_conversation(spark):
    rows = [(c, i, "user", f"turn {i}" if i < 1500 or c else "other") for c in range(2) for i in range(2000)]
    got = trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 2501 and max(r["depth"] for r in got) == 2000
    root = next(r for r in got if r["depth"] == 0)
    assert (root["n_convs"], root["n_children"], root["n_leaves"], root["saved_tokens"]) == (2, 1, 2, sum(len(f"turn {i}") for i in range(1500)) + 5 * 0 + 0)
