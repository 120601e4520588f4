"""Ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalog.registry import query
from tallyspark.functions import dates as D
from tallyspark.operators import ledger as L
from tallyspark.plans import keyed
from tallyspark.sources import readers
from tallyspark.sources.fixtures import AS_OF
from tallyspark.sources.schemas import DRIVER_TABLES

START, END, PREVIOUS = D.analytics_range(AS_OF, "LAST_6_MONTHS")
IN_RANGE = f"tx_date >= DATE '{START}' AND tx_date < DATE '{END}'"
EXPENSE = "type = 'EXPENSE'"
TX = "owner_id, tx_id, type, amount_minor, category_id, merchant_id, tx_date, created_at, purchase_group_id"
TXC = [c.strip() for c in TX.split(",")]
LABELLED = f"""
SELECT t.owner_id, t.category_id, COALESCE(c.name, 'Uncategorized') AS category_name, CAST(SUM(t.amount_minor) AS BIGINT) AS amount_minor
FROM fx_tx t LEFT JOIN fx_categories c ON c.category_id = t.category_id
WHERE {EXPENSE.replace('type', 't.type')} AND {IN_RANGE} GROUP BY t.owner_id, t.category_id, c.name"""
SHARE = """
SELECT owner_id, category_id, category_name, amount_minor,
  CASE WHEN total > 0 THEN CAST((amount_minor * 1000 + total // 2) // total AS BIGINT) ELSE 0 END AS share_tenths,
  ROW_NUMBER() OVER (PARTITION BY owner_id ORDER BY amount_minor DESC, category_name, category_id) AS position
FROM (SELECT *, CAST(SUM(amount_minor) OVER (PARTITION BY owner_id) AS BIGINT) AS total FROM (""" + LABELLED + ") a) b"
TOTALS = f"""
SELECT owner_id, CAST(COALESCE(SUM(amount_minor) FILTER (type = 'EXPENSE'), 0) AS BIGINT) AS spent_minor,
  CAST(COALESCE(SUM(amount_minor) FILTER (type = 'INCOME'), 0) AS BIGINT) AS income_minor,
  COUNT(*) FILTER (type = 'EXPENSE') AS expense_count
FROM fx_tx WHERE {IN_RANGE} GROUP BY owner_id"""
COMPARE = f"""
SELECT *, CASE WHEN previous_minor > 0 AND current_minor <> previous_minor
    THEN LEAST(CAST((ABS(current_minor - previous_minor) * 100 + previous_minor // 2) // previous_minor AS BIGINT), 2147483647) END AS change_percent,
  CASE WHEN previous_minor > 0 AND current_minor <> previous_minor
    THEN CASE WHEN current_minor > previous_minor THEN 'more' ELSE 'less' END END AS direction
FROM (SELECT owner_id, CAST(COALESCE(SUM(amount_minor) FILTER (tx_date >= DATE '{START}'), 0) AS BIGINT) AS current_minor,
        CAST(COALESCE(SUM(amount_minor) FILTER (tx_date < DATE '{START}'), 0) AS BIGINT) AS previous_minor
      FROM fx_tx WHERE {EXPENSE} AND tx_date >= DATE '{PREVIOUS}' AND tx_date < DATE '{END}' GROUP BY owner_id) x"""


def egp(minor: str) -> str:
    """DuckDB text of ``format_minor``."""
    return (
        f"(CASE WHEN {minor} < 0 THEN '-' ELSE '' END || format('{{:,}}', ABS({minor}) // 100) || "
        f"CASE WHEN ABS({minor}) % 100 = 0 THEN '' ELSE '.' || LPAD(CAST(ABS({minor}) % 100 AS VARCHAR), 2, '0') END || ' EGP')"
    )


def tenths(value: str) -> str:
    """DuckDB text of ``format_tenths``."""
    return (
        f"(CASE WHEN {value} % 10 = 0 THEN CAST({value} // 10 AS VARCHAR) || '%' "
        f"ELSE CAST({value} // 10 AS VARCHAR) || '.' || CAST({value} % 10 AS VARCHAR) || '%' END)"
    )


@query("src01_ledger", f"SELECT {TX} FROM fx_tx", dates=["tx_date"])
def _(t):
    return readers.ledger(t.tx).select(*TXC)


@query("src03_load_tables", " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS n_rows FROM {n}" for n in DRIVER_TABLES))
def _(t):
    return readers.table_sizes(readers.load_tables(t.spark, t.folder, DRIVER_TABLES, suffix=".parquet"))


@query("f01_expenses_between", f"SELECT {TX} FROM fx_tx WHERE {EXPENSE} AND {IN_RANGE}", dates=["tx_date"])
def _(t):
    return L.expenses_between(t.tx, START, END).select(*TXC)


@query("f02_transactions_between", f"SELECT {TX} FROM fx_tx WHERE {IN_RANGE}", dates=["tx_date"])
def _(t):
    return L.transactions_between(t.tx, START, END).select(*TXC)


@query("f03_filter_type", f"SELECT {TX} FROM fx_tx WHERE type = 'INCOME'", dates=["tx_date"])
def _(t):
    return L.filter_type(t.tx, "INCOME").select(*TXC)


PRESETS = ["THIS_MONTH", "LAST_MONTH", "LAST_3_MONTHS", "LAST_6_MONTHS"]
# Independent statement of the preset windows: (months back to start, months back to end, months back to previous start).
PRESET_SHIFT = {"THIS_MONTH": (0, -1, 1), "LAST_MONTH": (1, 0, 2), "LAST_3_MONTHS": (2, -1, 5), "LAST_6_MONTHS": (5, -1, 11)}
_M0 = f"date_trunc('month', DATE '{AS_OF}')"


@query("f04_analytics_range", " UNION ALL ".join(
    f"SELECT '{p}' AS preset, CAST(COUNT(*) FILTER (tx_date >= {_M0} - INTERVAL {s} MONTH AND tx_date < {_M0} - INTERVAL ({e}) MONTH) AS BIGINT) AS n_current, "
    f"CAST(COUNT(*) FILTER (tx_date >= {_M0} - INTERVAL {b} MONTH AND tx_date < {_M0} - INTERVAL {s} MONTH) AS BIGINT) AS n_previous FROM fx_tx"
    for p, (s, e, b) in PRESET_SHIFT.items()))
def _(t):
    """Ledger rows in each preset window and its preceding window, one scan."""
    aggs = []
    for p in PRESETS:
        start, end, prev = D.analytics_range(AS_OF, p)
        d = F.col("tx_date")
        aggs.append(F.struct(F.lit(p).alias("preset"), F.count_if((d >= F.lit(start)) & (d < F.lit(end))).alias("n_current"),
                             F.count_if((d >= F.lit(prev)) & (d < F.lit(start))).alias("n_previous")))
    return t.tx.agg(F.array(*aggs).alias("x")).select(F.inline("x"))


SPEND_SQL = {"THIS_MONTH": f"date_trunc('month', DATE '{AS_OF}')", "THREE_MONTHS": f"DATE '{AS_OF}' - INTERVAL 3 MONTH",
             "ONE_YEAR": f"DATE '{AS_OF}' - INTERVAL 1 YEAR", "TOTAL": "DATE '0001-01-01'"}


@query("f05_spending_range", " UNION ALL ".join(
    f"SELECT '{p}' AS preset, CAST(COALESCE(SUM(amount_minor), 0) AS BIGINT) AS spent_minor FROM fx_tx WHERE {EXPENSE} AND tx_date >= {s} AND tx_date <= DATE '{AS_OF}'"
    for p, s in SPEND_SQL.items()))
def _(t):
    aggs = []
    for p in SPEND_SQL:
        start, end = D.spending_range(AS_OF, p)
        inside = (F.col("type") == "EXPENSE") & L._within(F.col("tx_date"), start, end)
        aggs.append(F.struct(F.lit(p).alias("preset"), L.zero_sum(F.col("amount_minor"), inside).alias("spent_minor")))
    return t.tx.agg(F.array(*aggs).alias("x")).select(F.inline("x"))


@query("f06_active", """
SELECT 'categories' AS kind, category_id AS id FROM fx_categories WHERE NOT is_archived
UNION ALL SELECT 'assets', asset_id FROM fx_assets WHERE NOT is_archived
UNION ALL SELECT 'debts', profile_id FROM fx_profiles WHERE NOT is_archived
UNION ALL SELECT 'rules', rule_id FROM fx_rules WHERE is_active""")
def _(t):
    parts = [
        L.active(t.categories).select(F.lit("categories").alias("kind"), F.col("category_id").alias("id")),
        L.active(t.assets).select(F.lit("assets").alias("kind"), F.col("asset_id").alias("id")),
        L.active(t.profiles).select(F.lit("debts").alias("kind"), F.col("profile_id").alias("id")),
        L.active(t.rules, flag="is_active").select(F.lit("rules").alias("kind"), F.col("rule_id").alias("id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("f11_purchase_prefill", f"SELECT owner_id, tx_id, tx_date AS purchase_date, amount_minor, merchant_id, merchant, category_id FROM fx_tx WHERE {EXPENSE} AND purchase_group_id IS NULL", dates=["purchase_date"])
def _(t):
    return L.purchase_prefill(t.tx)


@query("f12_selectable_categories", """
SELECT a.asset_id, c.category_id AS selectable_id FROM fx_assets a JOIN fx_categories c ON NOT c.is_archived OR c.category_id = a.category_id""")
def _(t):
    return L.selectable_categories(t.assets, t.categories)


@query("f14_lookup", """
SELECT owner_id, profile_id, idempotency_key, due_date, total_minor FROM fx_payments
WHERE idempotency_key IN (SELECT idempotency_key FROM fx_payments WHERE total_minor > 9000000)""", dates=["due_date"])
def _(t):
    wanted = t.payments.filter(F.col("total_minor") > 9000000)
    return L.lookup(t.payments, wanted, ["idempotency_key"]).select("owner_id", "profile_id", "idempotency_key", "due_date", "total_minor")


@query("j01_with_category", f"""
SELECT t.owner_id, t.tx_id, t.amount_minor, t.category_id, COALESCE(c.name, 'Uncategorized') AS category_name
FROM fx_tx t LEFT JOIN fx_categories c ON c.category_id = t.category_id""")
def _(t):
    return L.with_category(t.tx, t.categories).select("owner_id", "tx_id", "amount_minor", "category_id", "category_name")


@query("a01_period_totals", f"SELECT *, income_minor - spent_minor AS remaining_minor FROM ({TOTALS}) x")
def _(t):
    return L.period_totals(t.tx, START, END)


@query("a02_spend_by_category", SHARE)
def _(t):
    return L.spend_by_category(t.tx, t.categories, START, END)


@query("a03_average_expense", f"""
SELECT owner_id, CASE WHEN expense_count = 0 THEN 0 ELSE (spent_minor + expense_count // 2) // expense_count END AS average_minor FROM ({TOTALS}) x""")
def _(t):
    return L.average_expense(t.tx, START, END)


@query("a04_period_comparison", COMPARE)
def _(t):
    return L.period_comparison(t.tx, START, END, PREVIOUS)


@query("a05_trend_daily", f"""
SELECT o.owner_id, CAST(d.day AS DATE) AS day, CAST(COALESCE(s.amount_minor, 0) AS BIGINT) AS amount_minor, CAST(day(d.day) AS VARCHAR) AS label
FROM (SELECT DISTINCT owner_id FROM fx_tx) o
CROSS JOIN (SELECT unnest(generate_series(DATE '1998-06-01', DATE '1998-06-30', INTERVAL 1 DAY)) AS day) d
LEFT JOIN (SELECT owner_id, tx_date, SUM(amount_minor) AS amount_minor FROM fx_tx WHERE {EXPENSE} GROUP BY ALL) s
  ON s.owner_id = o.owner_id AND s.tx_date = CAST(d.day AS DATE)""", dates=["day"])
def _(t):
    start, end, _ = D.analytics_range(AS_OF, "THIS_MONTH")
    return L.trend_daily(t.tx, start, end)


@query("a06_trend_monthly", f"""
SELECT o.owner_id, CAST(m.month AS DATE) AS month, CAST(COALESCE(s.amount_minor, 0) AS BIGINT) AS amount_minor, strftime(m.month, '%b') AS label
FROM (SELECT DISTINCT owner_id FROM fx_tx) o
CROSS JOIN (SELECT unnest(generate_series(DATE '{START}', DATE '{END}' - INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS month) m
LEFT JOIN (SELECT owner_id, CAST(date_trunc('month', tx_date) AS DATE) AS month, SUM(amount_minor) AS amount_minor FROM fx_tx WHERE {EXPENSE} GROUP BY ALL) s
  ON s.owner_id = o.owner_id AND s.month = CAST(m.month AS DATE)""", dates=["month"])
def _(t):
    return L.trend_monthly(t.tx, START, 6)


@query("a07_income_spent_share", f"""
SELECT owner_id, CASE WHEN income_minor > 0 THEN CAST((spent_minor * 1000 + income_minor // 2) // income_minor AS BIGINT) END AS spent_share_tenths FROM ({TOTALS}) x""")
def _(t):
    return L.income_spent_share(t.tx, START, END)


@query("a08_categories_for_entry", f"""
SELECT c.category_id, c.name, COUNT(t.tx_id) AS usage_count, MAX(t.tx_date) AS last_used
FROM fx_categories c LEFT JOIN fx_tx t ON t.category_id = c.category_id AND t.type = 'EXPENSE' WHERE NOT c.is_archived GROUP BY c.category_id, c.name""", dates=["last_used"])
def _(t):
    return L.categories_for_entry(t.categories, t.tx)


@query("a09_category_explorer", f"""
WITH spent AS (SELECT t.* FROM fx_tx t JOIN fx_categories c ON c.category_id = t.category_id AND NOT c.is_archived
  WHERE t.type = 'EXPENSE' AND tx_date >= DATE '1997-06-15' AND tx_date < DATE '1998-06-16')
SELECT c.category_id, 'TOTAL' AS section, NULL AS entry_id, CAST(0 AS BIGINT) AS position, CAST(COALESCE(SUM(s.amount_minor), 0) AS BIGINT) AS amount_minor
FROM fx_categories c LEFT JOIN spent s ON s.category_id = c.category_id WHERE NOT c.is_archived GROUP BY c.category_id
UNION ALL
SELECT category_id, 'RECENT', tx_id, p, amount_minor FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY category_id ORDER BY tx_date DESC, created_at DESC, tx_id) AS p FROM spent) r WHERE p <= 10
UNION ALL
SELECT a.category_id, 'OWNED', CAST(a.asset_id AS VARCHAR), 0, NULL FROM fx_assets a JOIN fx_categories c ON c.category_id = a.category_id AND NOT c.is_archived
WHERE a.ownership_status = 'OWNED' AND NOT a.is_archived""")
def _(t):
    return L.category_explorer(t.categories, t.tx, t.assets, AS_OF, "ONE_YEAR").withColumn("position", F.col("position").cast("bigint"))


@query("a10_group_purchases", """
SELECT owner_id, display_id, CAST(SUM(amount_minor) AS BIGINT) AS amount_minor, COUNT(*) AS n_rows, MAX(tx_date) AS shown_date,
  MAX(created_at) FILTER (tx_date = newest) AS shown_at
FROM (SELECT *, MAX(tx_date) OVER (PARTITION BY owner_id, display_id) AS newest
      FROM (SELECT *, COALESCE(purchase_group_id, 'tx' || tx_id) AS display_id FROM fx_tx) a) b GROUP BY owner_id, display_id""", dates=["shown_date"])
def _(t):
    return L.group_purchases(t.tx)


@query("a11_insights", f"""
WITH top AS (SELECT * FROM ({SHARE}) s WHERE position = 1), cmp AS ({COMPARE}), everyone AS (SELECT DISTINCT owner_id FROM fx_tx),
  wide AS (SELECT e.owner_id, t.category_name, t.amount_minor, t.share_tenths, c.change_percent, c.direction
           FROM everyone e LEFT JOIN top t USING (owner_id) LEFT JOIN cmp c USING (owner_id))
SELECT owner_id, CAST(0 AS INTEGER) AS seq, COALESCE(category_name || ' is your highest spending category at ' || {egp('amount_minor')} || '.', 'No spending recorded for this period.') AS sentence FROM wide
UNION ALL SELECT owner_id, 1, category_name || ' represents ' || {tenths('share_tenths')} || ' of your spending.' FROM wide WHERE category_name IS NOT NULL
UNION ALL SELECT owner_id, 2, 'You spent ' || change_percent || '% ' || direction || ' than the previous comparable period.' FROM wide WHERE category_name IS NOT NULL AND change_percent IS NOT NULL""")
def _(t):
    return L.insights(t.tx, t.categories, START, END, PREVIOUS)


@query("a11_month_insight", f"""
SELECT t.owner_id, CASE WHEN s.category_name IS NULL THEN 'No spending recorded this month yet.'
    ELSE 'Your highest spending category this month is ' || s.category_name || ' at ' || {egp('s.amount_minor')} || '.' END ||
  CASE WHEN t.income_minor > 0 AND t.spent_minor > t.income_minor
    THEN ' You have spent ' || {egp('(t.spent_minor - t.income_minor)')} || ' more than your recorded income this month.' ELSE '' END AS sentence
FROM ({TOTALS}) t LEFT JOIN (SELECT * FROM ({SHARE}) q WHERE position = 1) s ON s.owner_id = t.owner_id""")
def _(t):
    return L.month_insight(t.tx, t.categories, START, END)


@query("a12_backfill_merchants", f"""
SELECT owner_id, LOWER(TRIM(merchant)) AS normalized_name, MIN(TRIM(merchant)) AS display_name, COUNT(*) AS usage_count, MAX(tx_date) AS last_used,
  MIN(created_at) AS created_at, CAST(NULL AS BIGINT) AS default_category_id, 'USER' AS source
FROM fx_tx WHERE {EXPENSE} AND merchant IS NOT NULL AND TRIM(merchant) <> '' GROUP BY owner_id, LOWER(TRIM(merchant))""", dates=["last_used"])
def _(t):
    return L.backfill_merchants(t.tx)


@query("w02_recent_per_category", f"""
SELECT category_id, tx_id, tx_date, amount_minor, p AS position FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY category_id ORDER BY tx_date DESC, created_at DESC, tx_id) AS p FROM fx_tx WHERE {EXPENSE} AND category_id IS NOT NULL) r WHERE p <= 10""", dates=["tx_date"])
def _(t):
    return L.recent_per_category(t.tx).select("category_id", "tx_id", "tx_date", "amount_minor", "position")


@query("s01_merchants_recent", "SELECT merchant_id, display_name, usage_count, last_used_at FROM fx_merchants")
def _(t):
    return L.ordered(t.merchants, "merchants").select("merchant_id", "display_name", "usage_count", "last_used_at")


@query("s02_custom_types", "SELECT c.custom_type_id, c.name, COUNT(a.asset_id) AS n_assets FROM fx_custom_types c LEFT JOIN fx_assets a ON a.custom_type_id = c.custom_type_id WHERE NOT c.is_archived GROUP BY c.custom_type_id, c.name")
def _(t):
    """Custom types in name order with the number of items that use each."""
    n = t.assets.filter(F.col("custom_type_id").isNotNull()).groupBy("custom_type_id").agg(F.count("*").alias("n_assets"))
    types = t.custom_types.join(n, "custom_type_id", "left").withColumn("n_assets", F.coalesce("n_assets", F.lit(0).cast("long")))
    return L.custom_types_by_name(types).select("custom_type_id", "name", "n_assets")


@query("s04_ordered_listings", """
SELECT 'assets' AS listing, CAST(asset_id AS VARCHAR) AS id FROM fx_assets WHERE NOT is_archived
UNION ALL SELECT 'warranties', CAST(warranty_id AS VARCHAR) FROM fx_warranties
UNION ALL SELECT 'maintenance_events', event_id FROM fx_rule_events
UNION ALL SELECT 'checkpoints', CAST(checkpoint_id AS VARCHAR) FROM fx_checkpoints
UNION ALL SELECT 'documents', CAST(document_id AS VARCHAR) FROM fx_documents""")
def _(t):
    frames = {"assets": (L.active(t.assets), "asset_id"), "warranties": (t.warranties, "warranty_id"),
              "maintenance_events": (t.rule_events, "event_id"), "checkpoints": (t.checkpoints, "checkpoint_id"),
              "documents": (t.documents, "document_id")}
    out = None
    for name, (df, key) in frames.items():
        part = L.ordered(df, name).select(F.lit(name).alias("listing"), F.col(key).cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("w08_number_parts", f"""
SELECT owner_id, purchase_group_id, tx_id, created_at + ROW_NUMBER() OVER (PARTITION BY owner_id, purchase_group_id ORDER BY created_at, tx_id) - 1 AS stable_created_at
FROM fx_tx WHERE purchase_group_id IS NOT NULL""")
def _(t):
    """Creation stamp plus the part's position in its purchase."""
    rows = t.tx.filter(F.col("purchase_group_id").isNotNull())
    numbered = keyed.number_rows(rows, ["owner_id", "purchase_group_id"], "created_at", [F.asc("tx_id")], "part")
    return numbered.select("owner_id", "purchase_group_id", "tx_id", (F.col("created_at") + F.col("part")).alias("stable_created_at"))
