"""Receipts in one pass: the same rows as by joins and groupings, and nothing dealt or written on the way."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.catalog.index import QUERIES
from tallyspark.operators import receipts as R
from tallyspark.plans import keyed
from tallyspark.sources.fixtures import SUMMED_ITEMS, DriverTables

FOLDER = "/root/testdata/sf0.001"
LINE = "receipt_id LONG, line_id STRING, text STRING, confidence DOUBLE, box_left DOUBLE, box_top DOUBLE, box_right DOUBLE, box_bottom DOUBLE"


@pytest.fixture
def unwritten(monkeypatch):
    """Writing an intermediate table fails."""
    def cut(df, label):
        raise AssertionError(f"{label} was written")

    monkeypatch.setattr(keyed, "cut", cut)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def odd_lines(spark):
    """Receipts with copies, misread copies, tall, flat, turned and missing boxes, equal places and missing confidences."""
    rng, rows = random.Random(4), []
    names = ["Olive oil extra virgin 12.50", "Olive oil extra virgin 12,50", "olive oil extra virgjn 12.50", "Brown rice basmati long 7.00", "12/03/2024", "TOTAL 19.50", "Total 19.50", "شاي أخضر فاخر ١٢", "Milk", "mi1k", "--", "a"]
    for receipt in range(40):
        for n in range(rng.randrange(1, 14)):
            top = float(rng.randrange(0, 60 if receipt % 2 else 400, rng.choice([1, 4, 20])))
            height = rng.choice([0.0, 1.0, 12.0, 14.0, 14.0, 14.0, 30.0, 300.0, -6.0])
            left = float(rng.randrange(0, 90, 30))
            box = [left, top, left + 100.0, top + height] if rng.random() < 0.9 else [None] * 4
            rows.append((receipt, f"l{n:02d}", rng.choice(names), rng.choice([None, 0.0, 0.5, 0.5, 0.9]), *box))
    return spark.createDataFrame(rows, LINE).repartition(3, "receipt_id")


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_receipt_lines_are_the_ocr_table(spark, tmp_path):
    """Also with an order and a part there twice, lines there twice, and lines of orders and parts that are not there."""
    for name in ("lineitem", "orders", "part"):
        df = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        key = {"lineitem": "l_orderkey", "orders": "o_orderkey", "part": "p_partkey"}[name]
        df = df.union(df.filter(f"{key} % 7 = 0"))
        (df if name == "lineitem" else df.filter(f"{key} % 5 <> 0")).write.parquet(f"{tmp_path}/{name}.parquet")
    t = DriverTables(spark, str(tmp_path))
    lines = t.receipt_lines()
    want = t.ocr.drop("made_as")
    assert lines.dtypes == want.dtypes
    assert as_set(lines) == as_set(want) != []


def test_rows_come_out_of_one_pass(spark):
    """Rows and kept lines are those of the joins and groupings."""
    lines = odd_lines(spark)
    kept = R.dedupe_lines(lines)
    assert 0 < kept.count() < lines.count()
    assert as_set(R.kept_lines(lines)) == as_set(kept.select("receipt_id", "line_id", "text", "confidence"))
    assert as_set(R.settled_rows(lines)) == as_set(R.band_rows(kept).select(R.settled_rows(lines).columns))
    assert as_set(R.settled_rows(lines, copies=False)) == as_set(R.band_rows(lines).select(R.settled_rows(lines).columns))


def test_only_bands_of_the_distance_are_filled():
    rng = random.Random(1)

    def whole(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        return row[-1]

    for _ in range(3000):
        a, b = ("".join(rng.choice("ab1") for _ in range(rng.randrange(14))) for _ in range(2))
        most = rng.randrange(5)
        assert min(R._edits(a, b, most), most + 1) == min(whole(a, b), most + 1), (a, b, most)


def test_rows_are_neither_dealt_again_nor_written(spark, unwritten):
    """r03_band_rows deals lines to parts and orders; copies, rows and numbers need no join, grouping or stored table."""
    text = plan(QUERIES["r03_band_rows"](spark, FOLDER))
    assert text.count("Join ") == 2 and "Aggregate" not in text and "RepartitionByExpression" not in text


def test_copies_are_found_where_receipts_lie(spark, unwritten):
    """r02_dedupe_lines meets no lines with lines in a join."""
    text = plan(QUERIES["r02_dedupe_lines"](spark, FOLDER))
    assert text.count("Join ") == 2 and "Aggregate" not in text and "RepartitionByExpression" not in text


def odd_rows(spark):
    """Classified rows of receipts with footers, gaps, wrapped names, weak and several numbers, and rows without a box."""
    rng, rows = random.Random(9), []
    texts = ["extra virgin", "olive oil 12.50", "rice 5kg 7.00 14.00", "TOTAL 19.50", "Total items", "12/03/2024 10:30", "bag 3", "شاي أخضر ١٢", "NET 5.00", "qty 2 1.00", "tea 0.00", "Rice 5kg 14.00", "x" * 130 + " 2.00", "9.99", "Change 1.00"]
    for receipt in range(60):
        for n in range(rng.randrange(1, 16)):
            top = 20.0 * n + rng.choice([0, 0, 0, 90])
            box = [0.0, top, 100.0 + rng.randrange(50), top + rng.choice([12.0, 14.0])] if rng.random() < 0.95 else [None] * 4
            if rng.random() < 0.9:
                rows.append((receipt, n, rng.choice(texts), rng.choice([0.4, 0.9, None]), *box))
    df = spark.createDataFrame(rows, "receipt_id LONG, row_no LONG, row_text STRING, confidence DOUBLE, box_left DOUBLE, box_top DOUBLE, box_right DOUBLE, box_bottom DOUBLE")
    return keyed.cut(R.classify_rows(df), "test")


def test_tokens_of_a_row_stay_in_it(spark):
    rows = odd_rows(spark)
    kept = R.with_tokens(rows)
    assert kept.count() == rows.count() and set(kept.columns) == {*rows.columns, "tokens"}
    got = kept.select("receipt_id", "row_no", F.explode("tokens").alias("t")).select("receipt_id", "row_no", "t.*")
    assert as_set(got) == as_set(R.money_tokens(rows, ["receipt_id", "row_no"]).select(got.columns)) != []


def test_wrapped_names_are_completed_in_one_pass(spark):
    rows = odd_rows(spark)
    items = R.row_items(R.before_footer(rows))
    want = R.attach_wrapped(items, rows).select(*R._ITEM)
    assert as_set(R.items_above_footer(rows)) == as_set(items.select(*R._ITEM)) != []
    assert as_set(R.wrapped_items(rows)) == as_set(want) != as_set(items.select(*R._ITEM))


def test_items_are_dealt_once(spark, unwritten):
    """r12_attach_wrapped: lines meet parts and orders; rows are neither joined nor written."""
    assert plan(QUERIES["r12_attach_wrapped"](spark, FOLDER)).count("Join ") == 2


def test_columns_are_found_in_rows_dealt_once(spark):
    rows = odd_rows(spark)
    want = R.column_cells(R.numeric_cells(R.before_footer(rows).filter("is_product")), R.receipt_widths(rows))
    place = ["receipt_id", "row_no", "token_no", "column_no", "x", "amount_minor"]
    assert as_set(R.placed_cells(rows).select(place)) == as_set(want.select(place)) != []


def test_numeric_columns_write_no_rows(spark, unwritten):
    """r08_numeric_columns: lines meet parts and orders; rows, footers and widths are not joined."""
    assert plan(QUERIES["r08_numeric_columns"](spark, FOLDER)).count("Join ") == 2


def test_total_columns_are_chosen_where_cells_lie(spark, unwritten):
    """r09_choose_total_column joins neither totals nor letters to the columns."""
    assert plan(QUERIES["r09_choose_total_column"](spark, FOLDER)).count("Join ") == 2


def test_totals_and_letters_go_along_with_the_cells(spark):
    rows = odd_rows(spark)
    facts = R.placed_cells(rows, totals=True).select("receipt_id", "total_minor", F.round("letter_x", 6).alias("letter_x")).distinct()
    letters = rows.filter(F.col("row_text").rlike(R.LETTER)).groupBy("receipt_id").agg(F.round(F.avg((F.col("box_left") + F.col("box_right")) / 2), 6).alias("letter_x"))
    totals = R.detect_total(rows).select("receipt_id", F.col("detected_total_minor").alias("total_minor"))
    want = facts.select("receipt_id").join(totals, "receipt_id", "left").join(letters, "receipt_id", "left")
    assert as_set(facts) == as_set(want)
    assert facts.filter("total_minor > 0").count() > 5


def test_a_merchant_is_found_in_rows_dealt_once(spark, unwritten):
    """r14_receipt_merchant writes no rows and joins neither ends of headers nor second rows."""
    assert plan(QUERIES["r14_receipt_merchant"](spark, FOLDER)).count("Join ") == 2


def test_merchants_end_at_dates_and_take_a_second_row(spark):
    def rows(receipt, *texts):
        return [(receipt, n, t, 0.9, 0.0, 20.0 * n, 90.0, 20.0 * n + 14) for n, t in enumerate(texts)]

    made = [
        *rows(1, "Corner Market", "Main street branch", "12/03/2026", "Olive oil"), *rows(2, "12/03/2026", "Corner Market"), *rows(3, "9.00 Milk", "Tea House", "No 12345678", "Cairo 12"),
        *rows(4, "Bag 3.00", "1", "2", "3", "4", "5", "Late Market"), *rows(5, "TOTAL 3.00", "Market A")]
    df = R.classify_rows(spark.createDataFrame(made, "receipt_id LONG, row_no LONG, row_text STRING, confidence DOUBLE, box_left DOUBLE, box_top DOUBLE, box_right DOUBLE, box_bottom DOUBLE"))
    assert as_set(R.receipt_merchant(df)) == [(1, "Corner Market Main street branch"), (3, "Tea House"), (5, "Market A")]


def test_repeated_items_are_found_where_receipts_lie(spark, unwritten):
    """r13_dedupe_items writes no rows and meets no items with items in a join."""
    assert plan(QUERIES["r13_dedupe_items"](spark, FOLDER)).count("Join ") == 2


def test_repeated_items_are_those_of_the_join(spark):
    rng, rows = random.Random(2), []
    for receipt in range(30):
        for n in range(rng.randrange(1, 25)):
            top, height = float(rng.randrange(0, 120, 3)), rng.choice([0.0, 12.0, 14.0, 14.0, 60.0, -5.0])
            box = (top, top + height) if rng.random() < 0.9 else (None, None)
            rows.append((receipt, n, rng.choice(["Olive oil virgin", "Olive oil virgjn", "olive oil  virgin", "Tea", "شاي أخضر"]), rng.choice([100, 100, 250]), 0.9, *box))
    items = spark.createDataFrame(rows, "receipt_id LONG, row_no LONG, name STRING, amount_minor LONG, confidence DOUBLE, box_top DOUBLE, box_bottom DOUBLE").repartition(3, "receipt_id")
    want = as_set(R.dedupe_items(items).select(items.columns))
    assert as_set(R.kept_items(items)) == want and 0 < len(want) < len(rows)


def test_table_fragments_are_the_table_lines(spark, tmp_path):
    """Also with lines and orders there twice; ids are places in a row, in the order of the ids they stand for."""
    for name in ("lineitem", "orders", "part"):
        df = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        key = {"lineitem": "l_orderkey", "orders": "o_orderkey", "part": "p_partkey"}[name]
        df.union(df.filter(f"{key} % 7 = 0")).filter(f"{key} % 5 <> 0").write.parquet(f"{tmp_path}/{name}.parquet")
    t = DriverTables(spark, str(tmp_path))
    got, want = t.table_fragments(), t.table_lines
    place = F.expr("locate(substr(line_id, 1, 1), 'nuwz') - 1").alias("line_id")
    columns = ["receipt_id", "row_no", "line_id", "text", "box_left", "box_right"]
    assert as_set(got.select(columns)) == as_set(want.withColumn("line_id", place).select(columns)) != []
    assert as_set(got.select("receipt_id", "width").distinct()) == as_set(R.receipt_widths(want))


def test_arithmetic_columns_write_cells_and_columns_alone(spark, monkeypatch):
    """r10_arithmetic_columns: the reshaped table, the placed cells and the columns' places are neither written nor joined."""
    written, cut = [], keyed.cut
    monkeypatch.setattr(keyed, "cut", lambda df, label: written.append(label) or cut(df, label))
    assert plan(QUERIES["r10_arithmetic_columns"](spark, FOLDER)).count("Join ") == 1
    assert written == ["decimal-cells", "decimal-columns"]


def test_totals_are_recovered_from_cells_written_once(spark, monkeypatch):
    """r10_recover_totals writes the same two tables; cells meet the places of their receipt's columns."""
    written, cut = [], keyed.cut
    monkeypatch.setattr(keyed, "cut", lambda df, label: written.append(label) or cut(df, label))
    assert QUERIES["r10_recover_totals"](spark, FOLDER).count() > 0
    assert written == ["decimal-cells", "decimal-columns"]


def test_readings_of_a_line_come_out_together(spark):
    """r18_score_candidates: readings are those of fx_candidates, from one scan of the stored lines."""
    t = DriverTables(spark, FOLDER)
    want = as_set(t.candidates)
    t.keep_sums()
    assert as_set(t.readings()) == want and "Union" not in plan(t.readings())
    assert plan(QUERIES["r18_score_candidates"](spark, FOLDER)).count("Join ") == 3  # items, unit price and weight


def test_items_bring_their_receipts_sum(spark):
    """r18_select_repairs: items with sums and totals are those of the joins, and are not joined with either."""
    t = DriverTables(spark, FOLDER)
    items = t.receipt_items.select("receipt_id", "item_id", "amount_minor", "confidence", "price_source")
    sums = t.receipt_items.groupBy("receipt_id").agg(F.sum("amount_minor").alias("item_sum"))
    want = as_set(items.join(sums, "receipt_id").join(t.receipt_totals.select("receipt_id", "detected_total_minor"), "receipt_id"))
    t.keep_sums()
    assert as_set(t.sql(SUMMED_ITEMS)) == want != []
    assert plan(QUERIES["r18_select_repairs"](spark, FOLDER)).count("Join ") == 3
