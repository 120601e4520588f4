"""Sharding, fingerprints, packing and chat formatting."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import PARAGRAPH, ROWS, crc, documents

from tallyspark.llm import chat, packing, sharding, syncmers

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_shards_of_awkward_rows(spark):
    got = sharding.shard(spark, documents(spark, extra=True), 3).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len(r[1].encode()) + 1 if r[1] is not None else 1, crc(r[1])) for r in ROWS)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= {0, 1, 2}
    assert sharding.shard(spark, documents(spark, []), 8).collect() == []


def test_shards_balance_and_keep_copies(spark):
    rows = [(i, "copy" * 50 if i % 3 == 0 else f"text {i} " * (1 + i % 17), "en", "s", 0) for i in range(3000)]  # a third are copies
    rows += [(5000 + i, "other " * 60, "en", "s", 0) for i in range(100)]
    got = sharding.shard(spark, documents(spark, rows), 8).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and load.max() - load.min() < 0.02 * load.mean()
    small = got[got.text_crc32 == crc("other " * 60)]
    assert small.shard.nunique() == 1
    assert got[got.text_crc32 == crc("copy" * 50)].shard.nunique() <= 5


def test_overfull_ranges_are_split(spark):
    rows = sharding.keyed_rows(documents(spark, [(i, "same", "en", "s", 0) for i in range(4000)]))
    bounds = sharding.splitters(rows, 16)
    sizes = [r["n"] for r in rows.groupBy(sharding.range_of(rows["k"], bounds).alias("r")).agg({"k": "count"}).withColumnRenamed("count(k)", "n").collect()]
    assert max(sizes) < 4 * 4000 / 16


def edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        m = len(t) // 3
        out[d] = t[: len(t) - m] + order[(i + 1) % len(order)][1][:m]
    return out


@pytest.mark.parametrize("per_part", [2, 250])
def test_fingerprints(spark, monkeypatch, per_part):
    monkeypatch.setattr(syncmers, "PER_PART", per_part)
    rows = [(r[0], r[1] or "") for r in ROWS if r[0] is not None and r[0] not in (6, 8)] + [(20 + i, f"{i} {PARAGRAPH[i * 3:]}") for i in range(9)]
    got = {r["doc_id"]: r for r in syncmers.compared(documents(spark, [(d, t, None, None, 0) for d, t in rows], extra=True)).collect()}
    expected = edited(rows)
    for d, t in rows:
        assert got[d]["edited_sha256"] == hashlib.sha256(expected[d].encode()).hexdigest() and got[d]["n_chars"] == len(t)
    assert got[21]["near_next"] > 0.5 and got[25]["near_edited"] > 0.5 and got[2]["fingerprint"] == ""
    assert got[2]["fingerprint"] == got[1]["fingerprint"] and got[5]["fingerprint"] != got[12]["fingerprint"]


def test_fingerprints_of_awkward_rows(spark):
    got = syncmers.compared(documents(spark, extra=True)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (5, 6)}) == 1
    assert syncmers.compared(documents(spark, [])).collect() == []


def test_anchors_do_not_depend_on_their_place(spark):
    text = PARAGRAPH
    rows = spark.createDataFrame([(text,), ("Some other words stand here first. " + text,)], "text string")
    a, b = (set(x.hash for x in r[0]) for r in rows.select(syncmers.anchors(rows["text"])).collect())
    assert len(a) > 15 and a <= b


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    bpe = packing.ByteBpe(RANKS, public_tokenizers.PATTERN)
    texts = [r[1] or "" for r in ROWS if r[0] != 8] + ["  a  b", "a\n b", "it's we'll  x", " a b", "<|endoftext|> hi", "x ,,, y.", "a \n\n b\tc", "a\x1c b \x85 c", "\n a", "x\n y z", "1,000.5 don't!!"]
    for t in [*texts, *texts]:
        assert np.frombuffer(bpe.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_packing_of_awkward_rows(spark):
    df = documents(spark, extra=True)
    pieces = packing.tokenize(df, RANKS, public_tokenizers.PATTERN, 2048, 0, keep_ids=True)
    got = packing.pack(pieces, 2048).collect()
    bpe = packing.ByteBpe(RANKS, public_tokenizers.PATTERN)
    expected = Counter((r[0], len(bpe.ids(r[1] or "")) // 4 + 1) for r in ROWS)
    sums = Counter()
    for r in got:
        assert 0 < r["length"] <= 2048 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and (r["piece"] == 0 or r["length"] == 2048)
        sums[r["doc_id"]] += r["length"]
    assert all(sums[d] == sum(n * c for (e, n), c in expected.items() if e == d) for d, _ in expected)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        ends = 0
        for offset, length in sorted(spans):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert packing.pack(packing.tokenize(documents(spark, []), RANKS, public_tokenizers.PATTERN, 2048, 0), 2048).collect() == []
    assert packing.sequences(packing.pack(pieces, 2048)).count() == len(places)


def test_packing_exchanges_between_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION", 100)
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 100, 500).tolist()
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    got = packing.pack(frame, 100).toPandas()
    bound = packing.lower_bound(np.array(lengths), 100)
    assert len(got) == 500 and got.groupby("sequence_id")["length"].sum().max() <= 100
    assert bound <= got.sequence_id.nunique() <= bound + max(3, 0.04 * bound)


def test_bound_holds():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = rng.integers(1, 60, rng.integers(1, 80))
        assert packing.lower_bound(n, 60) <= packing.best_fit(n, 60).max() + 1
    assert packing.lower_bound(np.array([31] * 7), 60) == 7 and packing.lower_bound(np.array([21] * 6), 60) == 3


TALK = [
    (1, 1, "user", "Hello ### User: </turn>\n \\ \\\\ \\###"), (1, 2, "assistant", "</turn>\n### Assistant: fine\\"), (1, 0, "system", None),
    (2, 0, "assistant", "first"), (2, 1, "assistant", "é日"), (3, 0, None, "x"), (3, 0, 'odd "role": \n', "y ### z"), (None, 0, "user", ""), (None, 1, "assistant", " </turn>\n" * 3), (4, 5, "user", "same"), (4, 5, "user", "same"),
]


def test_conversations_round_trip(spark):
    turns = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS segments", "1 AS number")
    formatted = chat.format_turns(turns)
    got = {r["conv_id"]: r for r in chat.conversation_digests(formatted).collect()}
    by = defaultdict(list)
    for c, t, r, x in TALK:
        by[c].append((t, r or "", x or ""))
    text = defaultdict(str)
    for r in sorted(formatted.collect(), key=lambda r: (str(r["conv_id"]), r["number"])):
        text[r["conv_id"]] += "".join(s["text"] for s in r["segments"])
    for c, rows in by.items():
        rows.sort()
        assert list(chat.DEFAULT.read(text[c])) == [(r, x) for _, r, x in rows]
        loss = "".join(x for _, r, x in rows if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(rows), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == len(text[c])
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: False, 3: False, None: True, 4: False}
    assert chat.conversation_digests(chat.format_turns(turns.limit(0))).collect() == []
