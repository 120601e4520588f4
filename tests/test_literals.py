"""Boundary cases on small literal frames, and brute-force twins of the skew-safe shapes."""

import datetime as dt
import difflib
import itertools
import random
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dates, money, text, vectors
from tallyspark.functions.udfs import compound_charge
from tallyspark.operators import assets as A
from tallyspark.operators import categorize as C
from tallyspark.operators import changes as M
from tallyspark.operators import evaluate as E
from tallyspark.operators import ledger as L
from tallyspark.operators import obligations as O
from tallyspark.operators import ranking as R
from tallyspark.operators import receipts as P
from tallyspark.plans import keyed
from tallyspark.plans.session import work_folder
from tallyspark.streaming import jobs as J

D = dt.date


def one(df):
    return df.collect()[0]


def values(spark, expr, rows, schema="x STRING"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expr(F.col("x"))).collect()]


def test_money(spark):
    got = values(spark, money.parse_minor, ["12.30", " 5 ", "1.239", "1.230", "abc", "", "-0.05", "99999999999999999999"])
    assert got == [1230, 500, None, 123, None, None, -5, None]
    shown = values(spark, money.format_minor, [123456, -5, 100, 0], "x LONG")
    assert shown == ["1,234.56 EGP", "-0.05 EGP", "1 EGP", "0 EGP"]


def test_period_windows():
    assert dates.analytics_range(D(2026, 3, 15), "LAST_3_MONTHS") == (D(2026, 1, 1), D(2026, 4, 1), D(2025, 10, 1))
    assert dates.analytics_range(D(2026, 3, 15), "LAST_MONTH") == (D(2026, 2, 1), D(2026, 3, 1), D(2026, 1, 1))
    assert dates.spending_range(D(2026, 3, 31), "THREE_MONTHS") == (D(2025, 12, 31), D(2026, 4, 1))


def test_item_text(spark):
    got = values(spark, text.normalize_item, ["P A N adol", "p a", "Juice  1.5-L!", "٣ تـفاح", "a b c d e", "x a b"])
    assert got == ["pan adol", "p a", "juice 15l", "3 ت فاح", "abcde", "xab"]
    assert values(spark, text.normalize_merchant, ["  ＫＦＣ  Cairo "]) == ["kfc cairo"]


COMMITMENT = "commitment_id LONG, owner_id LONG, amount_minor LONG, frequency STRING, next_due_date DATE, end_date DATE, is_active BOOLEAN"


def test_month_end_is_restored(spark):
    c = spark.createDataFrame([(1, 1, 10, "MONTHLY", D(2024, 1, 31), D(2024, 4, 30), True)], COMMITMENT)
    due = [r.due_date for r in O.generate_occurrences(c, None, D(2025, 1, 1)).orderBy("due_date").collect()]
    assert due == [D(2024, 1, 31), D(2024, 2, 29), D(2024, 3, 31), D(2024, 4, 30)]


def test_start_bound_and_one_time(spark):
    c = spark.createDataFrame([
        (1, 1, 10, "WEEKLY", D(2024, 1, 1), None, True), (2, 1, 10, "ONE_TIME", D(2024, 2, 1), None, True), (3, 1, 10, "ANNUAL", D(2020, 2, 29), None, True),
        (4, 1, 10, "MONTHLY", D(2024, 1, 1), None, False)], COMMITMENT)
    got = {(r.commitment_id, r.due_date) for r in O.generate_occurrences(c, D(2024, 1, 29), D(2024, 3, 1)).collect()}
    assert got == {(1, D(2024, 1, 29)), (1, D(2024, 2, 5)), (1, D(2024, 2, 12)), (1, D(2024, 2, 19)), (1, D(2024, 2, 26)), (2, D(2024, 2, 1)), (3, D(2024, 2, 29))}


RULE = "profile_id LONG, grace_days INT, charge_type STRING, charge_interval STRING, charge_basis STRING, fixed_minor LONG, rate_points LONG, is_compounding BOOLEAN, minimum_minor LONG, maximum_minor LONG"


def charge(spark, due, as_of, rule, scheduled=1000, outstanding=5000):
    d = spark.createDataFrame([(1, due, scheduled, outstanding)], "profile_id LONG, due_date DATE, scheduled_minor LONG, outstanding_minor LONG")
    r = one(O.late_charge(d, spark.createDataFrame([(1, *rule)], RULE), as_of))
    return r.chargeable_periods, r.charge_minor


def test_late_charges(spark):
    fixed = ("FIXED_PERIODIC", "WEEKLY", "OVERDUE_INSTALLMENT", 100, None, False, None, None)
    assert charge(spark, D(2026, 1, 1), D(2026, 1, 7), (0, *fixed)) == (0, 0)
    assert charge(spark, D(2026, 1, 1), D(2026, 1, 8), (0, *fixed)) == (1, 100)
    assert charge(spark, D(2026, 1, 1), D(2026, 1, 15), (0, *fixed)) == (2, 200)
    monthly = ("FIXED_PERIODIC", "MONTHLY", "OVERDUE_INSTALLMENT", 100, None, False, None, None)
    assert charge(spark, D(2026, 1, 1), D(2026, 1, 31), (0, *monthly)) == (0, 0)
    assert charge(spark, D(2026, 1, 1), D(2026, 2, 1), (0, *monthly)) == (1, 100)
    once = ("FIXED_ONCE", "ONCE", "OVERDUE_INSTALLMENT", 500, None, False, None, None)
    assert charge(spark, D(2026, 1, 1), D(2026, 1, 4), (3, *once)) == (0, 0)
    assert charge(spark, D(2026, 1, 1), D(2026, 1, 5), (3, *once)) == (1, 500)
    compound = ("PERCENT_PERIODIC", "MONTHLY", "OVERDUE_INSTALLMENT", None, 1000, True, None, None)
    simple = (*compound[:5], False, None, None)
    assert charge(spark, D(2026, 1, 1), D(2026, 3, 1), (0, *compound)) == (2, 210)
    assert charge(spark, D(2026, 1, 1), D(2026, 3, 1), (0, *simple)) == (2, 200)
    half = ("PERCENT_ONCE", "ONCE", "OVERDUE_INSTALLMENT", None, 50, False, None, None)
    assert charge(spark, D(2026, 1, 1), D(2026, 1, 9), (0, *half), scheduled=100) == (1, 1)
    capped = (*fixed[:5], False, None, 150)
    assert charge(spark, D(2026, 1, 1), D(2026, 1, 22), (0, *capped)) == (3, 150)


def test_compound_is_exact(spark):
    rows = [(random.Random(i).randrange(1, 10**9), 1 + i * 37 % 900, i % 40) for i in range(60)]
    df = spark.createDataFrame(rows, "b LONG, p LONG, n LONG").select("*", compound_charge(F.col("b"), F.col("p"), F.col("n")).alias("c"))
    for r in df.collect():
        exact = Decimal(r.b) * ((1 + Decimal(r.p) / 10000) ** r.n - 1)
        assert abs(Decimal(r.c) - exact) <= Decimal("0.5000001")
    assert Decimal("2.5").quantize(Decimal(1), ROUND_HALF_UP) == 3


def test_maintenance_reason_and_status(spark):
    rules = spark.createDataFrame(
        [(1, 1, "t", "k", "TIME_OR_MILEAGE", 6, 5000, D(2026, 1, 1), 0, 30, 500, True)],
        "rule_id LONG, asset_id LONG, title STRING, kind STRING, trigger_type STRING, interval_months INT, interval_km LONG, baseline_date DATE, baseline_km LONG, warning_days INT, warning_km LONG, is_active BOOLEAN")
    events = spark.createDataFrame([], "rule_id LONG, event_id STRING, event_date DATE, km LONG, created_at LONG")
    assets = spark.createDataFrame([(1, 1, 5001, False)], "asset_id LONG, owner_id LONG, current_km LONG, is_archived BOOLEAN")
    r = one(A.maintenance_due(rules, events, assets, D(2026, 3, 1)))
    assert (r.due_status, r.trigger_reason, r.remaining_km) == ("OVERDUE", "MILEAGE", -1)
    r = one(A.maintenance_due(rules, events, assets.withColumn("current_km", F.lit(None).cast("long")), D(2026, 7, 1)))
    assert (r.due_status, r.trigger_reason) == ("DUE", "TIME")


def test_pruned_nearest_prototypes(spark, monkeypatch):
    """10,000 prototypes in groups: the full matrix's best three, with a small share of the products; ties, blocks and no prototypes."""
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(100, 16)))
    protos = unit(centres[rng.integers(0, 100, 10_000)] + 0.1 * rng.normal(size=(10_000, 16)))
    protos[5001] = protos[17]
    items = np.vstack([unit(centres[:60] + 0.1 * rng.normal(size=(60, 16))), protos[17:18]])
    full = items @ protos.T
    best = [sorted(range(len(protos)), key=lambda c, i=i: (-full[i, c], c))[:3] for i in range(len(items))]
    p = spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(protos)], "category_id BIGINT, vec ARRAY<DOUBLE>")
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)] + [(999, None)], "item_id BIGINT, vec ARRAY<DOUBLE>").repartition(3)
    got = {r.item_id: r for r in C.topk_with_gap(C.nearest_prototypes(x, p)).collect()}
    assert sorted(got) == list(range(len(items)))
    for i in got:
        assert got[i].topk == best[i] and abs(got[i].score_gap - (full[i, best[i][0]] - full[i, best[i][1]])) < 1e-9
    assert sum(r.tried for r in got.values()) < 0.25 * full.size
    monkeypatch.setattr(C, "PROTOTYPE_BYTES", 3000 * 128)
    blocks = {r.item_id: r.topk for r in C.topk_with_gap(C.nearest_prototypes(x, p), blocks=4).collect()}
    assert blocks == {i: best[i] for i in got}
    assert C.nearest_prototypes(x, p.limit(0)).collect() == []


def test_semantic_gap_at_threshold(spark):
    protos = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "category_id LONG, vec ARRAY<DOUBLE>")
    items = spark.createDataFrame([(1, [0.51, 0.50]), (2, [0.509, 0.50]), (3, None)], "item_id LONG, vec ARRAY<DOUBLE>")
    got = {r.item_id for r in C.suggest_semantic(items, protos, 0.01).collect()}
    assert got == {1}


def test_lexical_needs_a_unique_winner(spark):
    cats = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", True)], "category_id LONG, name STRING, is_archived BOOLEAN")
    terms = spark.createDataFrame([("milk", 1), ("rice", 1), ("soap", 2), ("book", 3)], "term STRING, category_id LONG")
    items = spark.createDataFrame([(1, "Milk rice"), (2, "milk soap"), (3, "book"), (4, "milk rice soap")], "item_id LONG, item_name STRING")
    got = {r.item_id: (r.category_id, round(r.confidence, 2)) for r in C.suggest_lexical(items, terms, cats).collect()}
    assert got == {1: (1, 0.85), 4: (1, 0.85)}


# --- brute-force twins -------------------------------------------------------


def test_prefix_and_numbering(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("aaaab"), D(2026, 1, rnd.randrange(1, 6)), i, rnd.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "k STRING, d DATE, i LONG, v LONG")
    got = {r.i: (r.m, r.n) for r in keyed.number_rows(keyed.prefix_before(df, ["k"], "d", [F.asc("i")], F.col("v"), "m"), ["k"], "d", [F.asc("i")], "n").collect()}
    for key in "ab":
        seen = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for n, r in enumerate(seen):
            assert got[r[2]] == (max((x[3] for x in seen[:n]), default=None), n)


def test_exact_median(spark):
    rnd = random.Random(7)
    for size in (1, 2, 7, 500):
        xs = [round(rnd.random() ** 3, 4) for _ in range(size)]
        df = spark.createDataFrame([("k", x) for x in xs], "k STRING, v DOUBLE")
        s = sorted(xs)
        assert abs(one(keyed.exact_median(df, ["k"], "v")).median - (s[(size - 1) // 2] + s[size // 2]) / 2) < 1e-12
        assert one(keyed.exact_median(df, ["k"], "v", upper=True)).median == s[size // 2]


def test_confirmation_fold_against_a_loop(spark):
    rnd = random.Random(11)
    cmds = [(1, rnd.choice(["milk", "rice"]), rnd.choice([None, "shop"]), rnd.randrange(1, 4), i, i) for i in range(80)]
    start = [(1, "milk", None, 2, 4, -1, -1), (1, "tea", "shop", 1, 2, -1, -1)]
    state = {(o, i, m): [c, n, a, b] for o, i, m, c, n, a, b in start}
    for o, item, merchant, cat, ts, _ in cmds:
        for m in [None] if merchant is None else [None, merchant]:
            s = state.get((o, item, m))
            if s is None:
                state[(o, item, m)] = [cat, 1, ts, ts]
            elif s[0] == cat:
                s[1], s[3] = s[1] + 1, ts
            else:
                s[0], s[1], s[3] = cat, 1, ts
    known = spark.createDataFrame(start, "owner_id LONG, normalized_item STRING, normalized_merchant STRING, category_id LONG, confirmation_count LONG, created_at LONG, updated_at LONG")
    batch = spark.createDataFrame(cmds, "owner_id LONG, normalized_item STRING, normalized_merchant STRING, category_id LONG, ts LONG, seq LONG")
    got = {(r.owner_id, r.normalized_item, r.normalized_merchant): [r.category_id, r.confirmation_count, r.created_at, r.updated_at] for r in M.fold_confirmations(known, batch).collect()}
    assert got == state


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_merchant_search_against_all_pairs(spark):
    rnd = random.Random(3)
    names = sorted({"".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 9))).strip() or "a" for _ in range(150)})
    queries = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 8))) for _ in range(60)})
    m = spark.createDataFrame([(i, n, n, i % 5, i % 3, "USER") for i, n in enumerate(names)], "merchant_id LONG, display_name STRING, normalized_name STRING, usage_count LONG, last_used_at LONG, source STRING")
    q = spark.createDataFrame([(x,) for x in queries], "query STRING")
    got = {(r.query, r.merchant_id): r.match_kind for r in R.rank_merchants(q, m, k=1000).collect()}
    want = {}
    for x in queries:
        for i, n in enumerate(names):
            kind = "EXACT" if n == x else "PREFIX" if n.startswith(x) else "CONTAINS" if x in n else (
                "FUZZY" if len(x) >= 3 and levenshtein(n, x) <= max(1, len(x) // 3) else None)
            if kind:
                want[(x, i)] = kind
    assert got == want


def test_fuzzy_baseline_against_a_loop(spark):
    refs = [("fruit", "p1", "red apple"), ("fruit", "p2", "green apple"), ("home", "p3", "dish soap"), ("home", "p4", "hand soap")]
    items = [(1, "p1", "red app1e"), (2, "p3", "dish 5oap"), (3, "p9", "apple soap")]
    desc = {"fruit": "apple fruit", "home": "soap cleaner"}
    norm = lambda s: s
    fold = lambda s: s.translate(str.maketrans("0157", "olst"))
    toks = lambda s: {t for t in s.split() if len(t) > 1}

    def score(item, cat, own):
        best = 0.0
        for c, p, ref in refs:
            if c == cat and p != own:
                fuzzy = max(difflib.SequenceMatcher(None, norm(item), norm(ref)).ratio(), difflib.SequenceMatcher(None, fold(item), fold(ref)).ratio())
                union = toks(item) | toks(ref)
                best = max(best, 0.75 * fuzzy + 0.25 * len(toks(item) & toks(ref)) / len(union))
        word = len(toks(item) & toks(desc[cat])) / max(1, min(3, len(toks(item))))
        return max(best, min(1.0, 0.85 * word))

    out = C.suggest_fuzzy(
        spark.createDataFrame(items, "item_id LONG, canonical_id STRING, item_text STRING"),
        spark.createDataFrame(refs, "category_id STRING, canonical_id STRING, reference_text STRING"),
        spark.createDataFrame(list(desc.items()), "category_id STRING, description STRING"))
    for r in out.collect():
        own = {i: p for i, p, _ in items}[r.item_id]
        scores = {c: score(r.item_text, c, own) for c in desc}
        assert r.top1 == max(scores, key=scores.get)
        assert abs(r.top1_score - max(scores.values())) < 1e-9 and abs(r.top2_score - min(scores.values())) < 1e-9


def test_kshot_against_all_sets(spark):
    rnd = random.Random(2)
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    vec = lambda: unit([rnd.gauss(0, 1) for _ in range(4)])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    items = [(i, 1, f"p{i % 5}", vec()) for i in range(12)]
    desc = [(1, vec()), (2, vec()), (3, vec())]
    refs = [(1, f"p{i}", vec()) for i in range(5)]
    got = {r.confirmed_examples: (r.trials, r.top1_accuracy) for r in E.kshot_eval(
        spark.createDataFrame(items, "item_id LONG, category_id LONG, canonical_id STRING, vec ARRAY<DOUBLE>"),
        spark.createDataFrame(desc, "category_id LONG, vec ARRAY<DOUBLE>"),
        spark.createDataFrame(refs, "category_id LONG, canonical_id STRING, ref_vec ARRAY<DOUBLE>"), 1, (0, 1, 2, 3, 5)).collect()}
    for k in (0, 1, 2, 3):
        trials = hits = 0
        for _, _, own, x in items:
            for combo in itertools.combinations([r for r in refs if r[1] != own], k):
                proto = desc[0][1]
                if combo:
                    c = unit([sum(r[2][d] for r in combo) / k for d in range(4)])
                    proto = unit([0.5 * a + 0.5 * b for a, b in zip(desc[0][1], c)])
                trials += 1
                hits += dot(proto, x) >= max(dot(desc[1][1], x), dot(desc[2][1], x))
        assert got[k][0] == trials and abs(got[k][1] - hits / trials) < 1e-9


def test_embedding_once_per_text(spark):
    from tallyspark.functions.udfs import embed

    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t STRING")
    out = embed(df, "t", "PASSAGE", lambda texts: [[float(len(t)), float(ord(t[-1]))] for t in texts]).collect()
    assert sorted((r.t or "", r.embedding) for r in out) == [("", None), ("a", [10.0, 97.0]), ("a", [10.0, 97.0]), ("b", [10.0, 98.0])]


def test_centroid_paths_agree(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0])], "k STRING, v ARRAY<DOUBLE>")
    for dim in (None, 2):
        assert {r.k: r.centroid for r in vectors.centroid(df, ["k"], "v", dim=dim).collect()} == {"a": [2.0, 3.0], "b": [5.0, 6.0]}


# --- receipts ----------------------------------------------------------------

LINE = "receipt_id LONG, line_id STRING, text STRING, confidence DOUBLE, box_left DOUBLE, box_top DOUBLE, box_right DOUBLE, box_bottom DOUBLE"


def receipt(spark):
    rows = [
        ("Corner Market", 0.9, 10, 0, 200, 14), ("12/03/2026", 0.9, 10, 20, 100, 34), ("extra virgin", 0.9, 0, 40, 120, 54), ("olive oil", 0.9, 0, 58, 120, 72), ("120.00", 0.9, 200, 58, 260, 72),
        ("rice 5kg", 0.9, 0, 80, 100, 94), ("75.50", 0.9, 200, 80, 260, 94), ("rice 5kg", 0.5, 2, 81, 102, 95), ("TOTAL", 0.95, 0, 110, 60, 124), ("195.50", 0.95, 200, 110, 260, 124), ("x", 0.1, 0, 200, 10, 214),
    ]
    return spark.createDataFrame([(1, f"l{i:02d}", t, c, *map(float, b)) for i, (t, c, *b) in enumerate(rows)], LINE)


def test_receipt_end_to_end(spark):
    lines = P.dedupe_lines(P.clean_lines(receipt(spark)))
    assert lines.count() == 9
    rows = keyed.cut(P.classify_rows(P.band_rows(lines)), "test")
    texts = [r.row_text for r in rows.orderBy("row_no").collect()]
    assert texts == ["Corner Market", "12/03/2026", "extra virgin", "olive oil 120.00", "rice 5kg 75.50", "TOTAL 195.50"]
    assert one(P.receipt_date(rows)).receipt_date == D(2026, 3, 12)
    total = one(P.detect_total(rows))
    assert (total.detected_total_minor, total.priority, total.total_reliable) == (19550, 4, True)
    assert one(P.receipt_merchant(rows)).merchant == "Corner Market"
    items = P.dedupe_items(P.attach_wrapped(P.row_items(rows), rows))
    assert sorted((r.name, r.amount_minor) for r in items.collect()) == [("extra virgin olive oil", 12000), ("rice 5kg", 7550)]
    assert one(P.reconcile(items, P.detect_total(rows))).consistency == "MATCH"


def fragments(spark, *rows):
    """Boxed fragments (text, left, right) of rows 20 units high."""
    out = [(1, f"l{i:02d}-{j}", t, 0.9, float(a), 20.0 * i, float(b), 20.0 * i + 12) for i, row in enumerate(rows) for j, (t, a, b) in enumerate(row)]
    return spark.createDataFrame(out, LINE)


def test_rows_join_the_nearest_and_grow(spark):
    """A line joins by the whole row's band, not only by the line before it; a tall line bridges; the next row begins anew."""
    lines = [("a", 0, 10), ("b", 4, 16), ("c", 9, 22), ("d", 14, 40), ("e", 30, 36), ("f", 60, 66)]
    df = spark.createDataFrame([(1, n, n, 0.9, float(i), float(top), float(i) + 1, float(bottom)) for i, (n, top, bottom) in enumerate(lines)], LINE)
    rows, want, band = {}, [], None
    for n, top, bottom in sorted(lines, key=lambda x: (x[1] + x[2]) / 2):
        if band is not None and P._same_row(band, [top, bottom]):
            band = P._same_row(band, [top, bottom])
            want[-1] += n
        else:
            band = (top, bottom)
            want.append(n)
    rows = [r.row_text.replace(" ", "") for r in P.band_rows(df).orderBy("row_no").collect()]
    assert rows == want and 1 < len(want) < 6
    got = {r.line_id: r.row_no for r in P.row_fragments(df).collect()}
    assert got == {n: i for i, row in enumerate(want) for n in row}


def test_products_end_at_the_footer(spark):
    rows = spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate([("Total items", True), ("TOTAL 3.00", True), ("Milk 2.00", False), ("Name only", False), ("NET 5.00", True), ("Bag 1.00", False), ("TOTAL", True)])]
                                 + [(2, 0, "TOTAL 9.00", True), (2, 1, "Milk 9.00", False)], "receipt_id BIGINT, row_no BIGINT, row_text STRING, is_summary BOOLEAN")
    assert sorted((r.receipt_id, r.row_no) for r in P.before_footer(rows).collect()) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]


def test_columns_follow_their_mean(spark):
    """A cell within the tolerance of the column's mean joins, though the last cell is farther off; steps alone do not chain."""
    xs = [100.0, 112.0, 125.0, 137.0, 180.0]
    cells = spark.createDataFrame([(1, i, 0, x, 100, "1.00", 0.9, True) for i, x in enumerate(xs)], "receipt_id BIGINT, row_no BIGINT, token_no INT, x DOUBLE, amount_minor BIGINT, raw STRING, confidence DOUBLE, is_strong BOOLEAN")
    widths = spark.createDataFrame([(1, 200.0)], "receipt_id BIGINT, width DOUBLE")
    assert [r.column_no for r in P.column_cells(cells, widths).orderBy("x").collect()] == [0, 0, 1, 1, 2]


def test_prices_and_arithmetic_columns(spark):
    lines = fragments(
        spark, [("Apples", 0, 80), ("12.50", 150, 180), ("2.000", 200, 230), ("25.00", 260, 300)], [("Pears", 0, 80), ("8.00", 150, 180), ("1.500", 200, 230), ("12.00", 260, 300)],
        [("Figs", 0, 80), ("30.00", 150, 180), ("0.500", 200, 230), ("99.00", 260, 300)], [("Deposit 7", 0, 80)])
    parts = keyed.cut(P.row_fragments(lines), "test")
    cells = keyed.cut(P.decimal_cells(parts), "test")
    columns = keyed.cut(P.arithmetic_columns(cells, P.receipt_widths(lines)), "test")
    found = one(columns)
    assert (found.unit, found.weight, found.total, found.support) == (0, 1, 2, 2)
    checked = P.arithmetic_check(P.read_arithmetic(cells, columns)).orderBy("row_no").collect()
    assert [(r.amount_minor, r.price_source, r.requires_review) for r in checked] == [(2500, "OCR_ORIGINAL", False), (1200, "OCR_ORIGINAL", False), (1500, "ARITHMETIC_RECOVERY", True)]
    none = spark.createDataFrame([], "receipt_id BIGINT, center_x DOUBLE, reach DOUBLE")
    money = keyed.cut(P.fragment_cells(parts), "test")
    assert [r.amount_minor for r in P.choose_prices(money, none).orderBy("row_no").collect()] == [2500, 1200, 9900]
    unit = spark.createDataFrame([(1, 165.0, 14.0)], "receipt_id BIGINT, center_x DOUBLE, reach DOUBLE")
    assert [(r.amount_minor, r.from_column) for r in P.choose_prices(money, unit).orderBy("row_no").collect()] == [(1250, True), (800, True), (3000, True)]
    right = fragments(spark, [("9.99", 0, 40), ("2.00", 150, 170), ("خبز", 250, 300)], [("4.00", 10, 30)])
    assert [r.amount_minor for r in P.choose_prices(P.fragment_cells(P.row_fragments(right)), none).orderBy("row_no").collect()] == [999, 400]
    two = P.arithmetic_columns(P.decimal_cells(P.row_fragments(fragments(spark, [("a", 0, 9), ("2.00", 20, 30), ("3.00", 60, 70)]))), spark.createDataFrame([(1, 90.0)], "receipt_id BIGINT, width DOUBLE"))
    assert two.collect() == []


def test_repaired_numbers(spark):
    got = values(spark, P.repair_number, ["1O5.5O", "12,50", "1,250", "l2.S0 EGP", "٣٫٥٠", "12.345", "abc"])
    assert got == [10550, 1250, 125000, 1250, 350, None, None]


def test_money_tokens_skip_dates(spark):
    df = spark.createDataFrame([(1, "on 12/03/2026 10:30 paid 1,250.50 and 7 LE 12.345")], "id LONG, row_text STRING")
    got = [(r.raw, r.amount_minor, r.is_strong) for r in P.money_tokens(df, ["id"]).orderBy("token_no").collect()]
    assert got == [("1,250.50", 125050, True), ("7", 700, True)]


def test_arithmetic_recovery(spark):
    df = spark.createDataFrame([(1, Decimal("10.00"), Decimal("1.500"), 1500), (2, Decimal("10.00"), Decimal("1.500"), 1507), (3, Decimal("0.33"), Decimal("0.500"), None)],
                               "id LONG, unit_price DECIMAL(12,2), weight DECIMAL(10,3), total_minor LONG")
    got = {r.id: (r.amount_minor, r.requires_review) for r in P.arithmetic_check(df).collect()}
    assert got == {1: (1500, False), 2: (1500, True), 3: (17, True)}


def test_hot_key_merge(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "k LONG, v STRING")
    cmds = spark.createDataFrame([(1, f"x{i}", i) for i in range(50)] + [(3, "n", 0)], "k LONG, v STRING, seq LONG")
    got = defaultdict(set)
    for policy in ("REPLACE", "IGNORE", "UPDATE", "DELETE"):
        got[policy] = {(r.k, r.v) for r in keyed.merge(held, cmds, ["k"], policy, [F.desc("seq")]).collect()}
    assert got["REPLACE"] == {(1, "x49"), (2, "b"), (3, "n")}
    assert got["IGNORE"] == {(1, "a"), (2, "b"), (3, "n")}
    assert got["UPDATE"] == {(1, "x49"), (2, "b")}
    assert got["DELETE"] == {(2, "b")}


def test_commands_are_folded_in_order(spark):
    """Two commands per key, an invalid try before a valid one, and a link that outlives an UNPAID."""
    status = spark.createDataFrame(
        [(1, dt.date(2024, 1, 5), "PAID", True, 100, 1), (1, dt.date(2024, 1, 5), "UNPAID", False, 200, 2), (2, dt.date(2024, 1, 5), "PAID", False, 10, 1), (2, dt.date(2024, 1, 5), "PAID", True, 20, 2)],
        "commitment_id BIGINT, due_date DATE, status STRING, create_expense BOOLEAN, ts BIGINT, seq BIGINT")
    commitments = spark.createDataFrame([(1, 7, "Rent", 500, None), (2, 7, "Gym", 50, None)], "commitment_id BIGINT, owner_id BIGINT, title STRING, amount_minor BIGINT, merchant_id BIGINT")
    none = spark.createDataFrame([], "owner_id BIGINT, commitment_id BIGINT, due_date DATE, status STRING, paid_tx_id STRING, paid_at BIGINT")
    out = M.apply_status(none, status, commitments)
    got = {r["commitment_id"]: (r["status"], r["paid_tx_id"], r["paid_at"]) for r in out["overrides"].collect()}
    assert got == {1: ("UNPAID", "commitment-1-2024-01-05", None), 2: ("PAID", "commitment-2-2024-01-05", 20)}
    assert out["transactions"].count() == 2

    assets = spark.createDataFrame([(1, 7, 100, False)], "asset_id BIGINT, owner_id BIGINT, current_km BIGINT, is_archived BOOLEAN")
    rules = spark.createDataFrame([], "rule_id BIGINT, asset_id BIGINT, is_active BOOLEAN, trigger_type STRING")
    events = spark.createDataFrame([], "asset_id BIGINT, rule_id BIGINT, event_date DATE, km BIGINT, cost_minor BIGINT, linked_tx_id STRING, idempotency_key STRING")
    cats = spark.createDataFrame([(2, False), (3, True)], "category_id BIGINT, is_archived BOOLEAN")
    tries = [(" ", 900, "a", 1), ("oil", 50, "b", 2), ("oil", 150, "a", 3), ("oil", 120, "b", 4), ("oil", 160, "b", 5), ("oil", 999, "b", 6)]
    cmds = spark.createDataFrame([(1, None, t, dt.date(2024, 1, 1), km, None, False, None, k, s) for t, km, k, s in tries],
        "asset_id BIGINT, rule_id BIGINT, title STRING, event_date DATE, km BIGINT, cost_minor BIGINT, create_expense BOOLEAN, category_id BIGINT, idempotency_key STRING, seq BIGINT")
    done = M.apply_maintenance(events, cmds, assets, rules, cats)
    assert sorted((r["idempotency_key"], r["km"]) for r in done["events"].collect()) == [("a", 150), ("b", 160)]
    assert one(done["assets"])["current_km"] == 160

    cp = spark.createDataFrame([(1, 1, "Oil", "DATE", dt.date(2024, 3, 1), None, 6, None, None, None, dt.date(2024, 4, 1), None, True)],
        "checkpoint_id BIGINT, asset_id BIGINT, title STRING, trigger_mode STRING, due_date DATE, due_km BIGINT, repeat_months INT, repeat_km BIGINT, warning_days INT, warning_km BIGINT, rescheduled_date DATE, rescheduled_km BIGINT, is_active BOOLEAN")
    no_events = spark.createDataFrame([], "checkpoint_id BIGINT, event_id BIGINT, event_date DATE, km BIGINT, created_at BIGINT")
    twice = spark.createDataFrame([(1, dt.date(2024, 4, 2), None, " ", 1, 1), (1, dt.date(2024, 10, 3), None, " ", 2, 2)], "checkpoint_id BIGINT, event_date DATE, km BIGINT, note STRING, ts BIGINT, seq BIGINT")
    made = M.complete_checkpoints(cp, twice, no_events)
    assert [r["due_date"] for r in made["events"].orderBy("event_id").collect()] == [dt.date(2024, 4, 1), dt.date(2024, 10, 2)]

    edits = cp.select(*[F.lit(0).cast("bigint").alias(c) if c == "checkpoint_id" else F.col(c) for c in cp.columns]).withColumn("seq", F.lit(1))
    after = M.edit_checkpoints(cp, edits, no_events, spark.createDataFrame([], "source_type STRING, source_id BIGINT"), assets)["checkpoints"]
    assert after.count() == 2 and after.filter("rescheduled_date is null").count() == 1


def test_lookup_by_broadcast_and_by_filter(spark, monkeypatch):
    """Both paths give the same rows, null keys included; the filter lets little else through and the table is not shuffled before it."""
    rows = [(i % 400 if i % 50 else None, f"k{i % 7}", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "a BIGINT, b STRING, n BIGINT")
    wanted = spark.createDataFrame([(3, "k3"), (3, "k3"), (None, "k1"), (77, None), (9999, "k1")] + [(i, "k0") for i in range(0, 400, 40)], "a BIGINT, b STRING")
    keys = {tuple(r) for r in wanted.collect()}
    want = sorted(n for a, b, n in rows if (a, b) in keys)
    assert sorted(r.n for r in L.lookup(df, wanted, ["a", "b"]).collect()) == want and want
    monkeypatch.setattr(L, "LOOKUP_KEYS", 0)
    found = L.lookup(df, wanted, ["a", "b"])
    assert sorted(r.n for r in found.collect()) == want
    near = L.maybe_wanted(df, L.key_filter(wanted.distinct(), ["a", "b"]), ["a", "b"])
    assert len(want) <= near.count() <= len(want) + 3
    assert L.lookup(df, wanted.limit(0), ["a", "b"]).collect() == []


def test_owners_stay_apart(spark):
    """Confirmed mappings and backfilled merchants of several owners give one answer each."""
    empty = spark.createDataFrame([], "owner_id BIGINT, normalized_item STRING, normalized_merchant STRING, category_id BIGINT, confirmation_count BIGINT, created_at BIGINT, updated_at BIGINT")
    confirms = spark.createDataFrame([(1, "milk", None, 4, 1, 1), (2, "milk", None, 5, 2, 2)], "owner_id BIGINT, normalized_item STRING, normalized_merchant STRING, category_id BIGINT, ts BIGINT, seq BIGINT")
    cats = spark.createDataFrame([(4, False), (5, False)], "category_id BIGINT, is_archived BOOLEAN")
    items = spark.createDataFrame([(10, 1, "milk", "shop"), (11, 2, "milk", "shop")], "item_id BIGINT, owner_id BIGINT, item_name STRING, merchant STRING")
    learned = C.suggest_learned(items, M.fold_confirmations(empty, confirms), cats)
    assert sorted((r["item_id"], r["category_id"]) for r in learned.collect()) == [(10, 4), (11, 5)]
    tx = spark.createDataFrame([(1, "t1", "EXPENSE", " Shop ", "g"), (2, "t2", "EXPENSE", "shop", "g")], "owner_id BIGINT, tx_id STRING, type STRING, merchant STRING, receipt_group_id STRING")
    shops = spark.createDataFrame([(1, "shop", 8), (2, "shop", 9)], "owner_id BIGINT, normalized_name STRING, merchant_id BIGINT")
    assert sorted((r["tx_id"], r["merchant_id"]) for r in M.backfill_merchant_ids(tx, shops).collect()) == [("t1", 8), ("t2", 9)]


def test_late_payment_is_recorded(spark, tmp_path):
    """Three batches, the last one a week late and with a repeated key."""
    schema = "idempotency_key STRING, ts TIMESTAMP, amount_minor BIGINT"
    for i, (key, day) in enumerate([("a", "2024-01-10"), ("b", "2024-01-12"), ("c", "2024-01-03"), ("a", "2024-01-20")]):
        spark.createDataFrame([(key, dt.datetime.fromisoformat(day), i)], schema).write.parquet(f"{tmp_path}/in/f{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    J.stream_payments(stream, f"{tmp_path}/sink", f"{tmp_path}/ck", schema).awaitTermination()
    assert sorted(r["idempotency_key"] for r in J.read_versions(spark, f"{tmp_path}/sink", schema).collect()) == ["a", "b", "c"]


def test_work_is_cleared(spark, tmp_path, monkeypatch):
    from tallyspark.plans import session

    monkeypatch.setattr(session, "_MADE", [])
    a, b = keyed.cut(spark.range(3), "a"), keyed.cut(spark.range(4), "b")
    assert (a.count(), b.count(), len(session._MADE)) == (3, 4, 2)
    assert session.clear_work(spark) == 2 and session.clear_work(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST|No such file|FileNotFound"):
        spark.catalog.clearCache()
        a.collect()


@pytest.mark.parametrize("master, fails", [("spark://host:7077", True), ("local-cluster[2,1,1024]", True), ("local[4]", False)])
def test_work_folder_needs_a_shared_place(master, fails):
    unset = SimpleNamespace(get=lambda *_: None)
    session = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset))
    if fails:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            work_folder(session, "x")
    else:
        assert work_folder(session, "x").endswith("/x")


def test_very_tall_box_meets_its_receipt(spark):
    """One box over a million bands: no row per band, and its copies are still found."""
    rows = [(1, "a", "fresh milk", 0.9, 0.0, 0.0, 100.0, 32e6), (1, "b", "fresh milk", 0.5, 0.0, 500.0, 100.0, 520.0), (1, "c", "bread", 0.5, 0.0, 500.0, 100.0, 520.0)]
    lines = spark.createDataFrame(rows, "receipt_id BIGINT, line_id STRING, text STRING, confidence DOUBLE, box_left DOUBLE, box_top DOUBLE, box_right DOUBLE, box_bottom DOUBLE")
    assert sorted(r["line_id"] for r in P.dedupe_lines(lines).collect()) == ["a", "c"]


def test_compound_charge_of_awkward_amounts(spark):
    """Nothing, a loss, odd and even periods, high rates, the largest amounts, ties, and unknown parts."""
    rng = random.Random(6)
    rows = [(0, 240, 10), (0, 1, 1), (5, 0, 7), (7, -100, 9), (-700, 300, 3), (2**39, 5000, 39), (2**38, 5000, 39), (1, 10000, 62), (1, 10000, 63), (3, 4_000_000, 2), (10**18, 150, 100), (100, 50, 0)]
    rows += [(rng.randrange(1, 10**rng.randrange(1, 16)), rng.choice([1, 37, 150, 249, 5000, 99_999, 200_001]), rng.randrange(1, 25)) for _ in range(150)]
    df = spark.createDataFrame([*rows, (None, 1, 1), (1, None, 1), (1, 1, None)], "b LONG, p LONG, n LONG").select("*", compound_charge(F.col("b"), F.col("p"), F.col("n")).alias("c"))
    for r in df.collect():
        if None in (r.b, r.p, r.n):
            assert r.c is None
            continue
        top, one_ = abs(r.b) * ((10000 + r.p) ** r.n - 10000**r.n), 10000**r.n
        exact = (2 * top + one_) // (2 * one_) if top >= 0 else -((-2 * top + one_) // (2 * one_))
        assert r.c == min(2**63 - 1, exact) * (-1 if r.b < 0 else 1), r


def test_compound_charge_saturates(spark):
    df = spark.createDataFrame([(10**7, 249, 3000)], "b BIGINT, p BIGINT, n BIGINT")
    assert one(df.select(compound_charge(F.col("b"), F.col("p"), F.col("n")).alias("x")))["x"] == 2**63 - 1
