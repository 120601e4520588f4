"""Plans of queries that failed on large tables: what is written, joined and dealt once."""

import datetime as dt
import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from tallyspark.catalog.index import QUERIES
from tallyspark.functions.money import compound_charge
from tallyspark.operators import assets as A
from tallyspark.operators import changes as M
from tallyspark.operators import evaluate as E
from tallyspark.operators import obligations as O
from tallyspark.operators import receipts as R
from tallyspark.sources.fixtures import DriverTables
from tallyspark.streaming import calendar

FOLDER = "/root/testdata/sf0.001"


def joins(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_branches_read_a_stored_table(spark):
    """The joins of lines, orders and parts are made once, not in each branch of a reshaped table."""
    t = DriverTables(spark, FOLDER)
    assert joins(t.candidates) == 0
    assert joins(t.table_lines) == 0
    assert "Window" not in t.table_lines._jdf.queryExecution().optimizedPlan().toString()
    assert t.candidates.filter("preprocessing = 'binary'").count() == t.lines.count() > 0


def test_readings_are_dealt_once(spark):
    """Agreeing readings are counted where an item's readings meet: items, unit price, weight and totals are the only joins."""
    items = spark.createDataFrame([(1, "a", 500, 0.5, "OCR_ORIGINAL", None, None)], "receipt_id BIGINT, item_id STRING, amount_minor BIGINT, confidence DOUBLE, price_source STRING, expected_x DOUBLE, row_width DOUBLE")
    read = [(1, "a", p, "LINE_TOTAL", text, 0.9, 0.0, 10.0) for p, text in (("raw", "7.00"), ("binary", "7.OO"), ("contrast", "9.00"))]
    candidates = spark.createDataFrame(read, "receipt_id BIGINT, item_id STRING, preprocessing STRING, role STRING, text STRING, confidence DOUBLE, box_left DOUBLE, box_right DOUBLE")
    totals = spark.createDataFrame([(1, 700)], "receipt_id BIGINT, detected_total_minor BIGINT")
    scored = R.score_candidates(items, candidates, totals)
    assert {(r.preprocessing, r.amount, r.agreeing) for r in scored.collect()} == {("raw", 700, 2), ("binary", 700, 2), ("contrast", 900, 1)}
    assert joins(scored) == 5


def test_prices_are_chosen_in_one_grouping(spark):
    cells = [(1, 1, "a", 0, 700, 0.9, True, 250.0, 60.0), (1, 1, "b", 0, 300, 0.9, True, 100.0, 60.0), (1, 2, "c", 0, 5, 0.9, True, 10.0, None), (1, 2, "d", 0, 6, 0.9, True, 20.0, None)]
    df = spark.createDataFrame(cells, "receipt_id BIGINT, row_no BIGINT, line_id STRING, token_no INT, amount_minor BIGINT, confidence DOUBLE, is_strong BOOLEAN, x DOUBLE, letter_x DOUBLE")
    got = R.choose_prices(df, spark.createDataFrame([], "receipt_id BIGINT, center_x DOUBLE, reach DOUBLE"))
    assert sorted((r.row_no, r.amount_minor) for r in got.collect()) == [(1, 700), (2, 6)]  # farthest from the letters; the last without letters
    assert joins(got) <= 1


def _lines(spark, rows):
    return spark.createDataFrame(rows, "receipt_id BIGINT, line_id STRING, text STRING, confidence DOUBLE, box_left DOUBLE, box_top DOUBLE, box_right DOUBLE, box_bottom DOUBLE")


def test_rows_meet_all_others_only_where_one_is_tall(spark):
    flat = [(1, "a", "Milk 2.00", 0.9, 0.0, 0.0, 90.0, 14.0), (1, "b", "Milk 2.00", 0.5, 1.0, 1.0, 91.0, 15.0), (1, "c", "Bread 1.00", 0.5, 0.0, 40.0, 90.0, 54.0)]
    once = R.dedupe_lines(_lines(spark, flat))
    assert [r.line_id for r in once.orderBy("line_id").collect()] == ["a", "c"]
    assert joins(once) == 2
    tall = [(1, "t", "Total 5.00", 0.9, 0.0, 0.0, 90.0, 9000.0), (1, "u", "Total 5.00", 0.4, 0.0, 5.0, 90.0, 8990.0)]
    both = R.dedupe_lines(_lines(spark, flat + tall))
    assert [r.line_id for r in both.orderBy("line_id").collect()] == ["a", "c", "t"]


def test_rows_are_numbered_where_they_are_grouped(spark):
    rows = R.band_rows(_lines(spark, [(1, f"l{i:03d}", f"x{i}", 0.9, 0.0, 20.0 * i, 90.0, 20.0 * i + 14) for i in range(300)]))
    assert [(r.row_no, r.row_text) for r in rows.filter("box_top is not null").orderBy("row_no").collect()] == [(i, f"x{i}") for i in range(300)]
    assert joins(rows.filter("box_top is not null")) == 0


def test_last_lines_of_parts_are_not_dealt_by_order(spark, tmp_path):
    """Attention, cards and reminders read lines without a join to orders or parts; lines of lost orders stay out."""
    for name in ("lineitem", "orders", "part"):
        df = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        df = df.filter("o_orderkey % 5 <> 0").union(df.filter("o_orderkey % 7 = 0")) if name == "orders" else df
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    t = DriverTables(spark, str(tmp_path))
    for name in ("fx_rule_events", "fx_checkpoint_events", "fx_ownership_events"):
        once = t.of_lines(name)
        assert joins(once) == 1 and "o_orderdate" not in once._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < once.count() < spark.read.parquet(f"{tmp_path}/lineitem.parquet").count()
        assert {tuple(r) for r in once.collect()} == {tuple(r) for r in t.sql(f"SELECT * FROM {name}").collect()}


def test_a_tick_without_touched_assets_reads_no_history(spark, tmp_path):
    day = dt.date(2024, 3, 1)
    assets = spark.createDataFrame([(1,)], "asset_id BIGINT")
    item = (1, "WARRANTY", 7, "W", day + dt.timedelta(days=1), None, 30, None, 1, None)
    asked = []

    def evaluate(touched, as_of):
        asked.append(as_of)
        return A.described(touched.join(spark.createDataFrame([item], calendar._TYPES), "asset_id"), as_of)

    for n, some in ((0, assets), (1, assets.limit(0)), (2, assets.limit(0))):
        calendar.tick(spark, f"{tmp_path}/c", day + dt.timedelta(days=n), some, evaluate)
    assert asked == [day]
    assert [r.status for r in calendar.attention_list(spark, f"{tmp_path}/c").collect()] == ["OVERDUE"]


def test_totals_are_judged_without_a_self_join(spark):
    """Candidates and the strongest of them meet in one grouping, so rows are classified once; Arabic words still count."""
    rows = [(1, 1, "TOTAL 12.00", 0.5, 0.0, 0.0, 9.0, 1.0), (1, 2, "Net total 12.01", 0.5, 0.0, 2.0, 9.0, 3.0), (1, 3, "Change 3.00", 0.9, 0.0, 4.0, 9.0, 5.0), (2, 1, "الإجمالي 7.50", 0.9, 0.0, 0.0, 9.0, 1.0), (3, 1, "Milk 2.00", 0.9, 0.0, 0.0, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "receipt_id BIGINT, row_no BIGINT, row_text STRING, confidence DOUBLE, box_left DOUBLE, box_top DOUBLE, box_right DOUBLE, box_bottom DOUBLE")
    got = R.detect_total(R.summary_rows(df))
    assert joins(got) == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.detect_total(R.classify_rows(df)).collect())) == [(1, 1201, 4, True), (2, 750, 4, True)]


def test_arabic_words_are_not_looked_for_in_ascii_text(spark):
    df = spark.createDataFrame([(1, "Milk 2.00"), (2, "الخصم 1.00"), (3, "الصنف السعر"), (4, None)], "line_id BIGINT, row_text STRING")
    x = R.classify_rows(df)
    assert "x7F" in df.select(R.is_noise(F.col("row_text")))._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.is_summary, r.is_adjustment, r.is_noise, r.is_header) for r in x.orderBy("line_id").collect()] == [(False,) * 4, (True, True, False, False), (False, False, False, True), (None, None, None, None)]


def test_the_only_number_of_a_text_stands_where_it_is_found(spark):
    texts = [(1, "a 12.50 b"), (2, "12.50"), (3, "x. ,,1.5 EGP"), (4, "1.5 and 1.5"), (5, "on 01/02/2020 9.00"), (6, "ج 7.00")]
    got = R.money_tokens(spark.createDataFrame(texts, "text_id BIGINT, row_text STRING"), ["text_id"])
    at = {(r.text_id, r.token_no): (r.raw, round(r.center_ratio, 4)) for r in got.collect()}
    assert at == {(1, 0): ("12.50", 0.5), (2, 0): ("12.50", 0.5), (4, 0): ("1.5", 0.1364), (4, 1): ("1.5", 0.8636), (5, 0): ("9.00", 0.8889), (6, 0): ("7.00", 0.6667)}


def test_a_sum_beyond_a_long_is_null(spark, tmp_path):
    for name in ("lineitem", "orders", "part", "conversations"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    text = " ".join(["4111111111111111"] * 30)
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(f"{tmp_path}/documents.parquet")
    row = QUERIES["r04_money_tokens"](spark, str(tmp_path)).filter("text_id = 'doc1'").first()
    assert (row.n_tokens, row.sum_minor, row.n_strong) == (30, None, 0)


def test_shuffled_shares_of_a_task_are_small(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "64m")
    QUERIES["x20_warranty_status"](spark, FOLDER)
    assert spark.conf.get(key) == "16m"


def test_only_the_beginnings_of_reference_sets_are_shuffled(spark):
    """Sets of three are dealt by their first member, not by their first two; each set is there once, in more than one task."""
    refs = spark.createDataFrame([(c, f"p{i}") for c, n in ((1, 9), (2, 2), (3, 4)) for i in range(n)] + [(1, "p0")], "category_id BIGINT, canonical_id STRING")
    assert E.k_reference_sets(refs, 3)._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    for k, spread in ((3, 1), (3, 2), (2, 1), (1, 1), (5, 2)):
        sets = E.k_reference_sets(refs, k, spread)
        assert sets._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
        assert sorted((r.category_id, tuple(r.members)) for r in sets.collect()) == sorted((c, m) for c, n in ((1, 9), (2, 2), (3, 4)) for m in combinations(range(n), k))
    assert E.k_reference_sets(refs, 3).select(F.spark_partition_id()).distinct().count() > 4


def test_compounding_is_written_once_and_settled_where_floating_point_is_not(spark):
    """Limbs stand once in a late charge's plan and behind a test; amounts on, next to and far from a half are exact."""
    due = spark.createDataFrame([(1, dt.date(2020, 1, 1), 1001, 5000)], "profile_id LONG, due_date DATE, scheduled_minor LONG, outstanding_minor LONG")
    rule = spark.createDataFrame([(1, 0, "PERCENT_PERIODIC", "MONTHLY", "OVERDUE_INSTALLMENT", None, 1000, True, None, 900)], "profile_id LONG, grace_days INT, charge_type STRING, charge_interval STRING, charge_basis STRING, fixed_minor LONG, rate_points LONG, is_compounding BOOLEAN, minimum_minor LONG, maximum_minor LONG")
    late = O.late_charge(due, rule, dt.date(2020, 3, 1))
    assert late._jdf.queryExecution().analyzed().toString().count("flatten(") == 1
    assert [r.charge_minor for r in late.collect()] == [210]
    rng = random.Random(3)
    rows = [(1, 5000, 1), (-1, 5000, 1), (3, 5000, 1), (2**53 + 1, 1, 1), (0, 7, 9), (5, 0, 400), (10**18, 9999, 60), (7, -500, 3)]
    for _ in range(150):
        g, n = 10000 + rng.randrange(1, 3000), rng.randrange(1, 80)
        top, low = g**n, 10000**n
        k = rng.randrange(1, 10 ** rng.randrange(2, 13))
        at = (2 * k + 1) * low // (2 * top)  # the amount that grows to about k and a half
        rows += [(b, g - 10000, n) for b in (at, at + 1) if b > 0]
    got = spark.createDataFrame(rows, "b LONG, p LONG, n LONG").select("*", compound_charge(F.col("b"), F.col("p"), F.col("n")).alias("c")).collect()
    for r in got:
        grown = (2 * abs(r.b) * (10000 + r.p) ** r.n + 10000**r.n) // (2 * 10000**r.n)
        assert r.c == (-1 if r.b < 0 else 1) * min(grown - abs(r.b), 2**63 - 1), r


def test_few_shot_deals_few_beginnings(spark, monkeypatch):
    """Of five products the first or first two are dealt, not three: 700 products make 57 million beginnings of three."""
    assert [E._spread(n, 3, 512) for n in (31, 156, 700)] == [3, 2, 1]
    assert [E._spread(31, m, 512) for m in (-1, 0, 1)] == [1, 1, 1]
    dealt, sets = [], E.k_reference_sets
    monkeypatch.setattr(E, "k_reference_sets", lambda refs, k, spread: dealt.append((k, spread)) or sets(refs, k, spread))
    monkeypatch.setattr(E, "_spread", lambda n, members, enough, spread=E._spread: spread(n, members, 5))
    vectors = spark.createDataFrame([(c, f"{c}-{i}", [float(i * i % 7), float(i % 3), 1.0]) for c in (1, 2) for i in range(7)], "category_id BIGINT, canonical_id STRING, vec ARRAY<DOUBLE>")
    got = E.kshot_eval(vectors, vectors.filter("canonical_id like '%-0'"), vectors.withColumnRenamed("vec", "ref_vec"), 1, (1, 5))
    assert [(r.confirmed_examples, r.trials) for r in got.collect()] == [(1, 7 * 6), (5, 7 * 6)]
    assert dealt == [(0, 1), (3, 1)]


def _executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_items_of_ownership_changes_are_dealt(spark):
    """Neither parts nor items pass through the driver, and one window gives the status before a command; orders are few here."""
    text = _executed(QUERIES["m11_apply_ownership"](spark, FOLDER))
    assert text.count("SortMergeJoin") == 2 and text.count("BroadcastHashJoin") <= 1 and text.count("Window ") == 1


def test_ownership_before_a_command_of_the_same_time(spark):
    assets = spark.createDataFrame([(1, "OWNED", False), (2, "SOLD", False), (3, "OWNED", True)], "asset_id BIGINT, ownership_status STRING, is_archived BOOLEAN")
    cmds = [(1, "OWNED", 5, "a"), (1, "SOLD", 5, "b"), (1, "SOLD", 6, "a"), (1, "LOST", 7, "a"), (2, "OWNED", 9, "c"), (2, "SOLD", 8, "z"), (3, "SOLD", 1, "a"), (4, "SOLD", 1, "a")]
    rows = spark.createDataFrame([(a, s, dt.date(2024, 1, 1), " ", ts, seq) for a, s, ts, seq in cmds], "asset_id BIGINT, status STRING, effective_date DATE, note STRING, ts BIGINT, seq STRING")
    log = M.apply_ownership(assets, rows)["events"]
    assert sorted((r.asset_id, r.created_at, r.seq, r.status) for r in log.collect()) == [(1, 5, "b", "SOLD"), (1, 7, "a", "LOST"), (2, 9, "c", "OWNED")]


def test_items_of_checkpoint_edits_are_dealt(spark):
    """Live items and known checkpoints meet edits in merge joins, and events are read without a join of lines and parts."""
    text = _executed(QUERIES["m10_edit_checkpoints"](spark, FOLDER))
    assert re.search(r"SortMergeJoin \[asset_id[^\n]*LeftSemi", text) and re.search(r"SortMergeJoin [^\n]*checkpoint_id[^\n]*LeftAnti", text)
    assert not re.search(r"BroadcastHashJoin \[(asset_id|checkpoint_id)[^\n]*Left(Semi|Anti)", text)
    assert not re.search(r"Join \[[^\n]*(l_partkey|p_partkey)", text)
