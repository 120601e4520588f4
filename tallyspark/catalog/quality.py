"""Validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalog.registry import query
from tallyspark.operators import quality as Q
from tallyspark.sources.schemas import ENUMS

PARTS = """
SELECT CONCAT('p', CAST(order_id AS STRING)) AS purchase_key, line_id, owner_id, line_no AS part_no,
  CASE WHEN quantity < 2 THEN 0 ELSE price_minor END AS amount_minor,
  CASE WHEN tax > 0.075 THEN NULL ELSE CAST(p_size % 8 + 1 AS BIGINT) END AS category_id, p_name AS note, ship_date AS tx_date FROM fx_lines"""
PURCHASE_TOTALS = """
SELECT CONCAT('p', CAST(order_id AS STRING)) AS purchase_key,
  CAST(SUM(price_minor) + CASE WHEN MAX(discount) > 0.09 THEN 500 WHEN MIN(discount) < 0.01 THEN -500 ELSE 0 END AS BIGINT) AS total_minor FROM fx_lines GROUP BY order_id
UNION ALL SELECT CONCAT('e', CAST(s_suppkey AS STRING)), CAST(100 AS BIGINT) FROM supplier"""
BAD_PAYMENTS = """
SELECT payment_id, CASE WHEN created_at % 10 = 1 THEN 0 ELSE total_minor END AS total_minor, CASE WHEN created_at % 10 = 3 THEN principal_minor - 1 ELSE principal_minor END AS principal_minor,
  CASE WHEN created_at % 10 = 5 THEN -financing_minor ELSE financing_minor END AS financing_minor, late_minor FROM fx_payments"""
BAD_CHECKPOINTS = """
SELECT checkpoint_id, CASE WHEN due_km > 90000 THEN ' ' ELSE title END AS title, CASE WHEN warning_days IS NULL THEN 'DATE' ELSE trigger_mode END AS trigger_mode,
  due_date, CASE WHEN due_km < 10000 THEN due_km - 10000 ELSE due_km END AS due_km, CASE WHEN due_km BETWEEN 20000 AND 30000 THEN -1 ELSE repeat_months END AS repeat_months, repeat_km, warning_days,
  CASE WHEN due_km BETWEEN 30000 AND 40000 THEN CAST(-1 AS BIGINT) ELSE warning_km END AS warning_km FROM fx_checkpoints"""
BAD_RULES = """
SELECT rule_id, CASE WHEN interval_km = 5000 THEN '' ELSE title END AS title, trigger_type, CASE WHEN interval_months = 3 THEN NULL ELSE interval_months END AS interval_months,
  CASE WHEN interval_km = 15000 THEN CAST(0 AS BIGINT) ELSE interval_km END AS interval_km, baseline_date, CASE WHEN interval_months = 7 THEN NULL ELSE baseline_km END AS baseline_km,
  CASE WHEN interval_months = 9 THEN -1 ELSE warning_days END AS warning_days, warning_km FROM fx_rules"""
DRAFTS = "SELECT order_id AS receipt_id, CASE WHEN MIN(discount) > 0.06 THEN NULL ELSE MIN(ship_date) END AS receipt_date FROM fx_lines GROUP BY order_id UNION ALL SELECT -1 - s_suppkey, DATE '1998-01-01' FROM supplier"
DRAFT_ITEMS = "SELECT order_id AS receipt_id, CASE WHEN quantity > 49 THEN ' ' ELSE p_name END AS name, CASE WHEN quantity < 2 THEN 0 ELSE price_minor END AS amount_minor, CAST(p_size % 9 + 1 AS BIGINT) AS category_id FROM fx_lines"
DEBTS = """
SELECT p.profile_id, CASE WHEN c.order_status = 'F' AND c.priority = '5-LOW' THEN ' ' ELSE c.title END AS title, CASE WHEN c.frequency = 'ANNUAL' THEN 0 ELSE p.original_principal_minor END AS original_principal_minor,
  t.financing_type, CASE WHEN c.frequency = 'WEEKLY' THEN @DIV[t.total_repayable_minor, 2] ELSE t.total_repayable_minor END AS total_repayable_minor,
  CASE WHEN c.frequency = 'QUARTERLY' THEN 0 ELSE c.amount_minor END AS amount_minor
FROM fx_profiles p JOIN fx_commitments c ON c.commitment_id = p.commitment_id LEFT JOIN fx_terms t ON t.profile_id = p.profile_id"""


def rows_of(source: str, key: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{name}' AS violation FROM ({source}) s WHERE {bad}" for name, bad in rules.items())


@query("dq01_check_splits", f"""
SELECT purchase_key, assigned_minor, remaining_minor, message IS NULL AS is_exact, message FROM (
  SELECT t.purchase_key, COALESCE(p.a, 0) AS assigned_minor, t.total_minor - COALESCE(p.a, 0) AS remaining_minor,
    CASE WHEN p.bad IS NULL OR p.bad > 0 THEN 'Every split needs a positive amount and category.' WHEN t.total_minor > COALESCE(p.a, 0) THEN 'Assign the remaining amount before saving.'
      WHEN t.total_minor < COALESCE(p.a, 0) THEN 'Split amounts exceed the purchase total.' END AS message
  FROM ({PURCHASE_TOTALS}) t LEFT JOIN (SELECT purchase_key, CAST(SUM(amount_minor) AS BIGINT) AS a, COUNT(*) FILTER (amount_minor <= 0 OR category_id IS NULL) AS bad FROM ({PARTS}) q GROUP BY purchase_key) p ON p.purchase_key = t.purchase_key) x""")
def _(t):
    return Q.check_splits(t.sql(PARTS), t.sql(PURCHASE_TOTALS))


@query("dq02_check_payments", f"""
SELECT payment_id, total_minor, principal_minor FROM ({BAD_PAYMENTS}) p WHERE total_minor <= 0 OR principal_minor < 0 OR financing_minor < 0 OR late_minor < 0 OR total_minor <> principal_minor + financing_minor + late_minor""")
def _(t):
    return Q.check_payments(t.sql(BAD_PAYMENTS)).select("payment_id", "total_minor", "principal_minor")


@query("dq03_check_checkpoints", rows_of(BAD_CHECKPOINTS, "checkpoint_id", {
    "blank title": "trim(title) = ''", "repeat months not positive": "repeat_months <= 0", "repeat km not positive": "repeat_km <= 0", "negative warning days": "warning_days < 0",
    "negative warning km": "warning_km < 0", "negative due km": "due_km < 0",
    "date trigger": "trigger_mode = 'DATE' AND NOT (due_date IS NOT NULL AND due_km IS NULL AND repeat_km IS NULL)",
    "mileage trigger": "trigger_mode = 'MILEAGE' AND NOT (due_km IS NOT NULL AND due_date IS NULL AND repeat_months IS NULL)",
    "date or mileage trigger": "trigger_mode = 'DATE_OR_MILEAGE' AND (due_date IS NULL OR due_km IS NULL)",
    "repeat months without date": "repeat_months IS NOT NULL AND due_date IS NULL", "repeat km without km": "repeat_km IS NOT NULL AND due_km IS NULL"}))
def _(t):
    return Q.check_checkpoints(t.sql(BAD_CHECKPOINTS))


@query("dq04_check_rules", rows_of(BAD_RULES, "rule_id", {
    "blank title": "trim(title) = ''", "time trigger needs interval and baseline": "trigger_type <> 'MILEAGE' AND NOT (COALESCE(interval_months, 0) > 0 AND baseline_date IS NOT NULL)",
    "mileage trigger needs interval and baseline": "trigger_type <> 'TIME' AND NOT (COALESCE(interval_km, 0) > 0 AND baseline_km IS NOT NULL)", "negative warning": "warning_days < 0 OR warning_km < 0"}))
def _(t):
    return Q.check_rules(t.sql(BAD_RULES))


@query("dq05_check_receipts", f"""
SELECT receipt_id, message FROM (SELECT d.receipt_id, CASE WHEN d.receipt_date IS NULL THEN 'Select a receipt date.' WHEN COUNT(i.receipt_id) = 0 THEN 'Add at least one receipt item.'
  WHEN COUNT(*) FILTER (trim(i.name) = '') > 0 THEN 'Every item needs a name.' WHEN COUNT(*) FILTER (i.amount_minor <= 0) > 0 THEN 'Every item needs a valid positive price.'
  WHEN COUNT(*) FILTER (i.category_id NOT IN (SELECT category_id FROM fx_categories WHERE NOT is_archived)) > 0 THEN 'Every item needs an active category.' END AS message
FROM ({DRAFTS}) d LEFT JOIN ({DRAFT_ITEMS}) i ON i.receipt_id = d.receipt_id GROUP BY d.receipt_id, d.receipt_date) x WHERE message IS NOT NULL""")
def _(t):
    return Q.check_receipts(t.sql(DRAFTS), t.sql(DRAFT_ITEMS), t.categories)


@query("dq06_check_integrity", """
SELECT 'payment profile' AS violation, CAST(profile_id AS VARCHAR) AS value, COUNT(*) AS n_rows FROM fx_payments WHERE profile_id NOT IN (SELECT profile_id FROM fx_profiles WHERE NOT is_archived) GROUP BY profile_id
UNION ALL SELECT 'commitment merchant', CAST(merchant_id AS VARCHAR), COUNT(*) FROM fx_commitments WHERE merchant_id NOT IN (SELECT merchant_id FROM fx_merchants) GROUP BY merchant_id
UNION ALL SELECT 'payment key', idempotency_key, COUNT(*) FROM fx_payments GROUP BY idempotency_key HAVING COUNT(*) > 1
UNION ALL SELECT 'override key', commitment_id || '|' || CAST(due_date AS VARCHAR), COUNT(*) FROM fx_overrides GROUP BY commitment_id, due_date HAVING COUNT(*) > 1
UNION ALL SELECT 'ownership status', status, COUNT(*) FROM fx_ownership_events WHERE status NOT IN ('OWNED', 'GIVEN_AWAY', 'LOST', 'DISPOSED') GROUP BY status
UNION ALL SELECT 'frequency', frequency, COUNT(*) FROM fx_commitments WHERE frequency NOT IN ('ONE_TIME', 'WEEKLY', 'MONTHLY', 'QUARTERLY', 'SEMI_ANNUAL', 'ANNUAL', 'CUSTOM') GROUP BY frequency""")
def _(t):
    return Q.check_integrity([
        Q.foreign_key(t.payments, "profile_id", t.profiles.filter("NOT is_archived"), "profile_id", "payment profile"),
        Q.foreign_key(t.commitments, "merchant_id", t.merchants, "merchant_id", "commitment merchant"),
        Q.unique_key(t.payments, ["idempotency_key"], "payment key"), Q.unique_key(t.overrides, ["commitment_id", "due_date"], "override key"),
        Q.enum_domain(t.ownership_events, "status", [s for s in ENUMS["ownership_status"] if s != "SOLD"], "ownership status"),
        Q.enum_domain(t.commitments, "frequency", ENUMS["frequency"], "frequency"),
    ])


@query("dq07_check_identifiers", """
SELECT asset_id, identifier_type, '' AS value, 'Enter an identifier value.' AS violation, COUNT(*) AS n_rows FROM fx_identifiers WHERE trim(value) = '' GROUP BY ALL
UNION ALL SELECT asset_id, identifier_type, v, 'This identifier is already added.', COUNT(*) FROM (SELECT *, trim(value) AS v FROM fx_identifiers) x WHERE v <> '' GROUP BY asset_id, identifier_type, v HAVING COUNT(*) > 1""")
def _(t):
    return Q.check_identifiers(t.identifiers)


@query("dq08_check_active", f"SELECT line_id, category_id FROM ({PARTS}) p WHERE category_id IS NULL OR category_id NOT IN (SELECT category_id FROM fx_categories WHERE NOT is_archived)")
def _(t):
    return Q.check_active(t.sql(PARTS), t.categories).select("line_id", "category_id")


@query("dq09_check_paths", "SELECT document_id, stored_path FROM fx_documents WHERE NOT starts_with(replace(stored_path, chr(92), '/'), 'assets/documents/') OR contains(stored_path, '..')")
def _(t):
    return Q.check_paths(t.documents).select("document_id", "stored_path")


@query("dq10_check_debts", rows_of(DEBTS, "profile_id", {
    "blank title": "trim(title) = ''", "principal not positive": "original_principal_minor <= 0",
    "repayable below principal": "financing_type = 'FIXED_TOTAL' AND total_repayable_minor < original_principal_minor", "amount not positive": "amount_minor <= 0"}))
def _(t):
    return Q.check_debts(t.sql(DEBTS))
