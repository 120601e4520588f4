"""Obligation and debt queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.catalog.registry import query
from tallyspark.catalog.scalars import compound_sql
from tallyspark.operators import obligations as O
from tallyspark.sources.fixtures import AS_OF

NOW = f"DATE '{AS_OF}'"
TO = "DATE '1999-07-01'"
ITEM = "owner_id, commitment_id, title, amount_minor, type, frequency"
STEP = "CASE frequency WHEN 'QUARTERLY' THEN 3 WHEN 'SEMI_ANNUAL' THEN 6 WHEN 'ANNUAL' THEN 12 ELSE 1 END"


def occurrences(source: str, end: str = TO) -> str:
    """DuckDB text: dated occurrences of the active rows of ``source``."""
    return f"""
SELECT * FROM (SELECT g.*, CASE frequency WHEN 'WEEKLY' THEN next_due_date + CAST(i * 7 AS INTEGER) ELSE CAST(next_due_date + to_months(CAST(i * {STEP} AS INTEGER)) AS DATE) END AS due_date
FROM (SELECT c.*, unnest(generate_series(0, CASE WHEN next_due_date >= {end} THEN -1 WHEN frequency = 'ONE_TIME' THEN 0 WHEN frequency = 'WEEKLY' THEN date_diff('day', next_due_date, {end}) // 7 + 1
    ELSE date_diff('month', next_due_date, {end}) // {STEP} + 1 END)) AS i FROM ({source}) c WHERE is_active) g) h
WHERE due_date < {end} AND (end_date IS NULL OR due_date <= end_date)"""


SCHEDULABLE = "SELECT * FROM fx_commitments WHERE commitment_id NOT IN (SELECT commitment_id FROM fx_profiles WHERE repayment_mode = 'OPEN_ENDED')"
OCC = f"""
SELECT o.owner_id, o.commitment_id, o.title, o.amount_minor, o.type, o.frequency, o.due_date, COALESCE(v.status, 'UNPAID') AS status, v.paid_tx_id, v.paid_at
FROM ({occurrences(SCHEDULABLE)}) o LEFT JOIN fx_overrides v ON v.commitment_id = o.commitment_id AND v.due_date = o.due_date"""
PROGRESS = f"""
SELECT *, CASE WHEN status = 'SKIPPED' THEN 0 ELSE GREATEST(0, amount_minor - paid_minor) END AS remaining_minor,
  CASE WHEN status = 'SKIPPED' THEN 'SKIPPED' WHEN paid_minor <= 0 THEN 'UNPAID' WHEN paid_minor < amount_minor THEN 'PARTIALLY_PAID' ELSE 'PAID' END AS state
FROM (SELECT o.*, p.profile_id, LEAST(o.amount_minor, GREATEST(0, CASE WHEN o.status = 'SKIPPED' THEN 0 WHEN p.profile_id IS NOT NULL THEN COALESCE(a.allocated, 0)
    WHEN o.status = 'PAID' THEN o.amount_minor ELSE 0 END)) AS paid_minor
  FROM ({OCC}) o LEFT JOIN fx_profiles p ON p.commitment_id = o.commitment_id
  LEFT JOIN (SELECT profile_id, due_date, CAST(SUM(principal_minor + financing_minor) AS BIGINT) AS allocated FROM fx_payments GROUP BY ALL) a ON a.profile_id = p.profile_id AND a.due_date = o.due_date) q"""
BALANCE = """
SELECT p.*, COALESCE(y.a, 0) AS principal_paid_minor, COALESCE(y.b, 0) AS total_paid_minor, GREATEST(0, p.original_principal_minor - COALESCE(y.a, 0)) AS outstanding_minor
FROM fx_profiles p LEFT JOIN (SELECT profile_id, CAST(SUM(principal_minor) AS BIGINT) AS a, CAST(SUM(total_minor) AS BIGINT) AS b FROM fx_payments GROUP BY profile_id) y
  ON y.profile_id = p.profile_id"""


def months_between(a: str, b: str) -> str:
    """DuckDB text: completed calendar months from a to b (a <= b)."""
    return f"((year({b}) - year({a})) * 12 + month({b}) - month({a}) - CASE WHEN day({b}) < day({a}) THEN 1 ELSE 0 END)"


def charges(due: str, rules: str = "fx_late_rules") -> str:
    """DuckDB text of ``late_charge`` for rules that do not compound."""
    return f"""
SELECT profile_id, due_date, days_overdue, in_grace, periods, charge_type, basis, rate_points, minimum_minor, maximum_minor,
  CASE WHEN periods = 0 THEN 0 ELSE CAST(GREATEST(0, LEAST(COALESCE(maximum_minor, 9223372036854775807), GREATEST(COALESCE(minimum_minor, 0), raw))) AS BIGINT) END AS charge_minor
FROM (SELECT *, CASE charge_type WHEN 'FIXED_ONCE' THEN fixed_minor WHEN 'FIXED_PERIODIC' THEN fixed_minor * periods
    WHEN 'PERCENT_ONCE' THEN (CAST(basis AS HUGEINT) * rate_points + 5000) // 10000 ELSE (CAST(basis AS HUGEINT) * rate_points * periods + 5000) // 10000 END AS raw
  FROM (SELECT *, CASE WHEN charge_basis = 'OVERDUE_INSTALLMENT' THEN scheduled_minor ELSE outstanding_minor END AS basis,
      charge_type IS NOT NULL AND days_overdue > 0 AND days_overdue <= grace_days AS in_grace,
      CASE WHEN charge_type IS NULL OR days_overdue <= grace_days THEN 0 WHEN charge_type LIKE '%ONCE' THEN 1 WHEN charge_interval = 'ONCE' THEN 1
        WHEN charge_interval = 'DAILY' THEN days_overdue - grace_days WHEN charge_interval = 'WEEKLY' THEN (days_overdue - grace_days) // 7
        ELSE GREATEST(0, {months_between('(due_date + CAST(grace_days AS INTEGER))', NOW)}) END AS periods
    FROM (SELECT d.*, GREATEST(0, date_diff('day', d.due_date, {NOW})) AS days_overdue, r.* EXCLUDE (profile_id, owner_id)
      FROM ({due}) d LEFT JOIN (SELECT * FROM {rules}) r ON r.profile_id = d.profile_id) a) b) c"""


def occ_of(t):
    return O.schedule(t.commitments, t.profiles, t.overrides, AS_OF)


def progress_of(t):
    return O.occurrence_progress(occ_of(t), t.profiles, t.payments)


OCC_COLS = ["owner_id", "commitment_id", "amount_minor", "due_date", "status"]


@query("f07_filter_group", " UNION ALL ".join(
    f"SELECT '{g}' AS grp, commitment_id, amount_minor FROM fx_commitments WHERE {w}"
    for g, w in {"INSTALLMENTS": "type = 'INSTALLMENT'", "DEBTS": "type = 'DEBT_PAYMENT'", "OTHER": "type NOT IN ('INSTALLMENT', 'DEBT_PAYMENT')"}.items()))
def _(t):
    parts = [O.filter_group(t.commitments, g).select(F.lit(g).alias("grp"), "commitment_id", "amount_minor") for g in ("INSTALLMENTS", "DEBTS", "OTHER")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f09_occurrence_view", f"""
WITH occ AS ({OCC})
SELECT 'MONTH' AS mode, commitment_id, due_date, status, amount_minor FROM occ WHERE due_date >= DATE '1998-08-01' AND due_date < DATE '1998-09-01'
UNION ALL SELECT 'NEXT_30_DAYS', commitment_id, due_date, status, amount_minor FROM occ WHERE due_date BETWEEN {NOW} AND {NOW} + 30
UNION ALL SELECT 'ALL_UPCOMING', commitment_id, due_date, status, amount_minor FROM occ WHERE due_date >= {NOW}""", dates=["due_date"])
def _(t):
    occ, out = occ_of(t), None
    for mode in ("MONTH", "NEXT_30_DAYS", "ALL_UPCOMING"):
        part = O.occurrence_view(occ, mode, AS_OF, dt.date(1998, 8, 1)).select(F.lit(mode).alias("mode"), "commitment_id", "due_date", "status", "amount_minor")
        out = part if out is None else out.unionByName(part)
    return out


@query("f10_overdue", f"SELECT owner_id, commitment_id, amount_minor, due_date, status FROM ({OCC}) o WHERE due_date < {NOW} AND status = 'UNPAID'", dates=["due_date"])
def _(t):
    return O.overdue(occ_of(t), AS_OF).select(*OCC_COLS)


@query("f13_schedulable", f"SELECT {ITEM} FROM ({SCHEDULABLE}) s")
def _(t):
    return O.schedulable(t.commitments, t.profiles).select(*[c.strip() for c in ITEM.split(",")])


@query("p05_canonical_debt", """
SELECT profile_id, CASE WHEN o THEN 0 ELSE amount_minor END AS amount_minor, CASE WHEN o THEN 'ONE_TIME' ELSE frequency END AS frequency,
  CASE WHEN o THEN start_date ELSE next_due_date END AS next_due_date, CASE WHEN NOT o THEN end_date END AS end_date,
  CASE WHEN o THEN NULL WHEN amount_minor <= 0 THEN 'Installment amount is required' WHEN frequency = 'CUSTOM' THEN 'Select a supported frequency' END AS violation
FROM (SELECT p.profile_id, p.start_date, p.repayment_mode = 'OPEN_ENDED' AS o, c.amount_minor, c.frequency, c.next_due_date, c.end_date
  FROM fx_profiles p JOIN fx_commitments c ON c.commitment_id = p.commitment_id) x""", dates=["next_due_date", "end_date"])
def _(t):
    defs = t.profiles.select("profile_id", "commitment_id", "start_date", "repayment_mode").join(
        t.commitments.select("commitment_id", "amount_minor", "frequency", "next_due_date", "end_date"), "commitment_id")
    return O.canonical_debt(defs).select("profile_id", "amount_minor", "frequency", "next_due_date", "end_date", "violation")


@query("j02_with_merchant", "SELECT c.commitment_id, c.title, c.next_due_date, m.display_name AS merchant_name FROM fx_commitments c LEFT JOIN fx_merchants m ON m.merchant_id = c.merchant_id", dates=["next_due_date"])
def _(t):
    return O.with_merchant(t.commitments, t.merchants).select("commitment_id", "title", "next_due_date", "merchant_name")


@query("o01_generate_occurrences", f"SELECT owner_id, commitment_id, amount_minor, frequency, due_date FROM ({occurrences('SELECT * FROM fx_commitments', 'DATE ' + chr(39) + '1999-03-01' + chr(39))}) o WHERE due_date >= DATE '1998-02-10'", dates=["due_date"])
def _(t):
    return O.generate_occurrences(t.commitments, dt.date(1998, 2, 10), dt.date(1999, 3, 1)).select("owner_id", "commitment_id", "amount_minor", "frequency", "due_date")


@query("o02_preview", f"""
SELECT commitment_id, due_date FROM (SELECT *, CASE frequency WHEN 'WEEKLY' THEN next_due_date + CAST(i * 7 AS INTEGER) ELSE CAST(next_due_date + to_months(CAST(i * {STEP} AS INTEGER)) AS DATE) END AS due_date
  FROM (SELECT *, unnest(generate_series(0, CASE WHEN frequency = 'ONE_TIME' THEN 0 ELSE 4 END)) AS i FROM fx_commitments) a) b
WHERE frequency = 'ONE_TIME' OR end_date IS NULL OR due_date <= end_date""", dates=["due_date"])
def _(t):
    return O.preview(t.commitments, 5).select("commitment_id", "due_date")


@query("j08_overlay_overrides", f"SELECT owner_id, commitment_id, amount_minor, due_date, status, paid_tx_id, paid_at FROM ({OCC}) o", dates=["due_date"])
def _(t):
    return occ_of(t).select(*OCC_COLS, "paid_tx_id", "paid_at")


@query("o03_forecast", f"""
WITH occ AS ({OCC})
SELECT w.owner_id, CAST(m.month AS DATE) AS month, CAST(COALESCE(SUM(o.amount_minor), 0) AS BIGINT) AS amount_minor
FROM (SELECT DISTINCT owner_id FROM occ) w CROSS JOIN (SELECT unnest(generate_series(DATE '1998-06-01', DATE '1999-05-01', INTERVAL 1 MONTH)) AS month) m
LEFT JOIN occ o ON o.owner_id = w.owner_id AND date_trunc('month', o.due_date) = m.month AND o.status <> 'SKIPPED' GROUP BY ALL""", dates=["month"])
def _(t):
    return O.forecast(occ_of(t), AS_OF, 12)


@query("o04_commitment_summary", f"""
WITH occ AS ({OCC}), live AS (SELECT *, date_trunc('month', due_date) AS m FROM occ),
 months AS (SELECT owner_id, m, SUM(amount_minor) AS a FROM live WHERE status <> 'SKIPPED' AND due_date >= DATE '1998-06-01' AND due_date < DATE '1999-06-01' GROUP BY ALL),
 best AS (SELECT owner_id, m, a FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY owner_id ORDER BY a DESC, m) AS r FROM months) x WHERE r = 1 AND a > 0),
 nxt AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY owner_id ORDER BY due_date, commitment_id) AS r FROM occ WHERE due_date >= {NOW} AND status = 'UNPAID') x WHERE r = 1),
 sums AS (SELECT owner_id, CAST(COALESCE(SUM(amount_minor) FILTER (m = DATE '1998-06-01' AND status <> 'SKIPPED'), 0) AS BIGINT) AS committed_this_month_minor,
   CAST(COALESCE(SUM(amount_minor) FILTER (m = DATE '1998-06-01' AND status = 'PAID'), 0) AS BIGINT) AS paid_this_month_minor,
   CAST(COALESCE(SUM(amount_minor) FILTER (m = DATE '1998-06-01' AND status = 'UNPAID'), 0) AS BIGINT) AS remaining_this_month_minor,
   CAST(COALESCE(SUM(amount_minor) FILTER (due_date BETWEEN {NOW} AND {NOW} + 29 AND status = 'UNPAID'), 0) AS BIGINT) AS next_30_days_minor FROM live GROUP BY owner_id)
SELECT s.*, CAST(COALESCE((SELECT SUM(a) FROM months WHERE months.owner_id = s.owner_id), 0) AS BIGINT) AS next_12_months_minor,
  COALESCE(CAST(b.m AS DATE), DATE '1998-06-01') AS highest_month, CAST(COALESCE(b.a, 0) AS BIGINT) AS highest_month_minor,
  n.due_date AS next_due_date, n.commitment_id AS next_commitment_id, n.amount_minor AS next_amount_minor
FROM sums s LEFT JOIN best b USING (owner_id) LEFT JOIN nxt n USING (owner_id)""", dates=["highest_month", "next_due_date"])
def _(t):
    return O.commitment_summary(occ_of(t), AS_OF)


JUNE = "due_date >= DATE '1998-06-01' AND due_date < DATE '1998-07-01'"


@query("o05_period_summary", f"""
SELECT owner_id, CAST(COALESCE(SUM(amount_minor) FILTER (status <> 'SKIPPED'), 0) AS BIGINT) AS committed_minor, CAST(COALESCE(SUM(amount_minor) FILTER (status = 'PAID'), 0) AS BIGINT) AS paid_minor,
  CAST(COALESCE(SUM(amount_minor) FILTER (status = 'UNPAID'), 0) AS BIGINT) AS remaining_minor FROM ({OCC}) o WHERE {JUNE} GROUP BY owner_id""")
def _(t):
    return O.period_summary(O.occurrence_view(occ_of(t), "MONTH", AS_OF))


@query("o06_upcoming_by_month", f"""
SELECT owner_id, CAST(date_trunc('month', due_date) AS DATE) AS month, COUNT(*) AS n_occurrences, CAST(SUM(amount_minor) AS BIGINT) AS amount_minor, MIN(due_date) AS first_due_date
FROM ({OCC}) o WHERE due_date >= {NOW} GROUP BY ALL""", dates=["month", "first_due_date"])
def _(t):
    return O.upcoming_by_month(occ_of(t), AS_OF)


BAL = "profile_id, original_principal_minor, principal_paid_minor, total_paid_minor, outstanding_minor"


@query("o07_debt_balance", f"SELECT {BAL} FROM ({BALANCE}) b")
def _(t):
    return O.debt_balance(t.profiles, t.payments).select(*[c.strip() for c in BAL.split(",")])


@query("o08_occurrence_progress", f"SELECT commitment_id, due_date, status, amount_minor, profile_id, paid_minor, remaining_minor, state FROM ({PROGRESS}) p", dates=["due_date"])
def _(t):
    return progress_of(t).select("commitment_id", "due_date", "status", "amount_minor", "profile_id", "paid_minor", "remaining_minor", "state")


@query("o09_period_summary_paid", f"""
SELECT owner_id, CAST(COALESCE(SUM(amount_minor) FILTER (state <> 'SKIPPED'), 0) AS BIGINT) AS committed_minor, CAST(COALESCE(SUM(paid_minor) FILTER (state <> 'SKIPPED'), 0) AS BIGINT) AS paid_minor,
  CAST(COALESCE(SUM(remaining_minor) FILTER (state <> 'SKIPPED'), 0) AS BIGINT) AS remaining_minor FROM ({PROGRESS}) p WHERE {JUNE} GROUP BY owner_id""")
def _(t):
    june = O.occurrence_view(occ_of(t), "MONTH", AS_OF)
    return O.period_summary_paid(O.occurrence_progress(june, t.profiles, t.payments))


@query("o10_allocated", "SELECT profile_id, due_date, CAST(SUM(principal_minor + financing_minor) AS BIGINT) AS allocated_minor FROM fx_payments GROUP BY ALL", dates=["due_date"])
def _(t):
    return O.allocated(t.payments)


@query("o11_one_time_amount", """
SELECT profile_id, CASE WHEN v > 0 THEN v END AS one_time_minor, CASE WHEN v > 0 THEN s END AS amount_source FROM (
  SELECT p.profile_id, CASE WHEN f.financing_type IS NULL THEN p.original_principal_minor WHEN f.financing_type = 'FIXED_TOTAL' THEN f.total_repayable_minor ELSE c.amount_minor - 500000 END AS v,
    CASE WHEN f.financing_type IS NULL THEN 'PRINCIPAL' WHEN f.financing_type = 'FIXED_TOTAL' THEN 'FIXED_TOTAL_REPAYABLE' ELSE 'EXPLICIT_AMOUNT_DUE' END AS s
  FROM fx_profiles p JOIN fx_commitments c ON c.commitment_id = p.commitment_id LEFT JOIN fx_terms f ON f.profile_id = p.profile_id) x""")
def _(t):
    explicit = t.commitments.select("commitment_id", (F.col("amount_minor") - 500000).alias("explicit_amount_minor"))
    return O.one_time_amount(t.profiles.join(explicit, "commitment_id"), t.terms).select("profile_id", "one_time_minor", "amount_source")


@query("o12_financing_cost", """
SELECT p.profile_id, CASE WHEN f.financing_type = 'FIXED_TOTAL' THEN GREATEST(0, f.total_repayable_minor - p.original_principal_minor) END AS financing_cost_minor
FROM fx_profiles p LEFT JOIN fx_terms f ON f.profile_id = p.profile_id""")
def _(t):
    return O.financing_cost(t.profiles, t.terms).select("profile_id", "financing_cost_minor")


@query("o13_payment_history", "SELECT profile_id, payment_id, payment_date, total_minor FROM fx_payments", dates=["payment_date"])
def _(t):
    return O.payment_history(t.payments).select("profile_id", "payment_id", "payment_date", "total_minor")


DUE = f"""SELECT q.profile_id, q.due_date, q.remaining_minor AS scheduled_minor, b.outstanding_minor FROM ({PROGRESS}) q JOIN ({BALANCE}) b ON b.profile_id = q.profile_id"""


def due_of(t):
    bal = O.debt_balance(t.profiles, t.payments).select("profile_id", "outstanding_minor")
    return progress_of(t).filter(F.col("profile_id").isNotNull()).select(
        "profile_id", "due_date", F.col("remaining_minor").alias("scheduled_minor")).join(bal, "profile_id")


@query("o14_late_charge", f"SELECT profile_id, due_date, days_overdue, in_grace AS in_grace_period, periods AS chargeable_periods, charge_minor FROM ({charges(DUE)}) c", dates=["due_date"])
def _(t):
    return O.late_charge(due_of(t), t.late_rules, AS_OF, compounding=False).select("profile_id", "due_date", "days_overdue", "in_grace_period", "chargeable_periods", "charge_minor")


MONTHLY = "(SELECT * REPLACE ('MONTHLY' AS charge_interval) FROM fx_late_rules)"
# The table has no compounding rule; here all of them do, by month.
COMPOUND = f"""
WITH c AS MATERIALIZED ({charges(DUE, MONTHLY)}),
 g AS ({compound_sql("SELECT profile_id, due_date, CAST(GREATEST(0, basis) AS HUGEINT) AS basis, rate_points AS points, periods FROM c WHERE charge_type = 'PERCENT_PERIODIC' AND periods > 0", "profile_id, due_date")})
SELECT profile_id, due_date, periods AS chargeable_periods, CASE WHEN gain IS NULL THEN charge_minor
  ELSE CAST(GREATEST(0, LEAST(COALESCE(maximum_minor, 9223372036854775807), GREATEST(COALESCE(minimum_minor, 0), gain))) AS BIGINT) END AS charge_minor FROM c LEFT JOIN g USING (profile_id, due_date)"""


@query("o14_late_charge_compound", COMPOUND, dates=["due_date"])
def _(t):
    rules = t.late_rules.withColumn("is_compounding", F.lit(True)).withColumn("charge_interval", F.lit("MONTHLY"))
    return O.late_charge(due_of(t), rules, AS_OF).select("profile_id", "due_date", "chargeable_periods", "charge_minor")


@query("j07_debt_detail", f"""
WITH occ AS (SELECT o.commitment_id, o.due_date, o.amount_minor FROM ({occurrences("SELECT c.* FROM fx_commitments c JOIN fx_profiles p ON p.commitment_id = c.commitment_id AND p.repayment_mode = 'FIXED_INSTALLMENTS'", "DATE '2008-06-15'")}) o
   LEFT JOIN fx_overrides v ON v.commitment_id = o.commitment_id AND v.due_date = o.due_date WHERE COALESCE(v.status, 'UNPAID') = 'UNPAID'),
 nxt AS (SELECT commitment_id, MIN(due_date) AS next_due, ANY_VALUE(amount_minor) AS next_amount_minor FROM occ GROUP BY commitment_id),
 base AS (SELECT b.profile_id, b.commitment_id, b.outstanding_minor, b.total_paid_minor, n.next_due, n.next_amount_minor, CAST(COALESCE(a.v, 0) AS BIGINT) AS allocated_minor
   FROM ({BALANCE}) b LEFT JOIN nxt n ON n.commitment_id = b.commitment_id
   LEFT JOIN (SELECT profile_id, due_date, SUM(principal_minor + financing_minor) AS v FROM fx_payments GROUP BY ALL) a ON a.profile_id = b.profile_id AND a.due_date = n.next_due)
SELECT b.profile_id, b.outstanding_minor, b.total_paid_minor, f.financing_type, b.next_due, b.next_amount_minor, b.allocated_minor, c.days_overdue, c.charge_minor
FROM base b LEFT JOIN fx_terms f ON f.profile_id = b.profile_id
LEFT JOIN ({charges("SELECT profile_id, next_due AS due_date, GREATEST(0, next_amount_minor - allocated_minor) AS scheduled_minor, outstanding_minor FROM base WHERE next_due IS NOT NULL")}) c ON c.profile_id = b.profile_id""", dates=["next_due"])
def _(t):
    return O.debt_detail(t.profiles, t.commitments, t.overrides, t.payments, t.terms, t.late_rules, AS_OF).select(
        "profile_id", "outstanding_minor", "total_paid_minor", "financing_type", "next_due", "next_amount_minor", "allocated_minor", "days_overdue", "charge_minor")


ACTIVE = f"""
WITH prog AS ({PROGRESS}), nxt AS (SELECT commitment_id, MIN(due_date) AS due_date FROM prog WHERE due_date >= {NOW} AND state NOT IN ('PAID', 'SKIPPED') GROUP BY commitment_id)
SELECT b.owner_id, b.profile_id, b.original_principal_minor, b.principal_paid_minor, b.outstanding_minor, n.due_date AS next_due, p.amount_minor AS next_amount_minor, COALESCE(p.paid_minor, 0) AS next_paid_minor
FROM ({BALANCE}) b LEFT JOIN nxt n ON n.commitment_id = b.commitment_id LEFT JOIN prog p ON p.commitment_id = n.commitment_id AND p.due_date = n.due_date WHERE NOT b.is_archived"""


def active_of(t):
    return O.active_debts(t.profiles, t.commitments, t.payments, progress_of(t), AS_OF, "DEBTS")


@query("o15_active_debts", ACTIVE, dates=["next_due"])
def _(t):
    return active_of(t).select("owner_id", "profile_id", "original_principal_minor", "principal_paid_minor", "outstanding_minor", "next_due", "next_amount_minor", "next_paid_minor")


@query("o16_debt_portfolio", f"""
SELECT owner_id, CAST(SUM(original_principal_minor) AS BIGINT) AS original_minor, CAST(SUM(principal_paid_minor) AS BIGINT) AS paid_minor, CAST(SUM(outstanding_minor) AS BIGINT) AS outstanding_minor
FROM ({BALANCE}) b WHERE NOT is_archived GROUP BY owner_id""")
def _(t):
    return O.debt_portfolio(O.debt_balance(t.profiles.filter(~F.col("is_archived")), t.payments))


@query("o17_horizon", f"SELECT owner_id, LEAST(MIN(next_due_date), {NOW}) AS from_date, DATE '1999-10-01' AS to_date FROM fx_commitments GROUP BY owner_id", dates=["from_date", "to_date"])
def _(t):
    return O.horizon(t.commitments, AS_OF, dt.date(1998, 9, 1))


@query("o18_month_income_vs_committed", f"""
SELECT owner_id, CAST(SUM(i) AS BIGINT) AS income_minor, CAST(SUM(c) AS BIGINT) AS committed_minor FROM (
  SELECT owner_id, amount_minor AS i, 0 AS c FROM fx_tx WHERE type = 'INCOME' AND tx_date >= DATE '1998-06-01' AND tx_date < DATE '1998-07-01'
  UNION ALL SELECT owner_id, 0, amount_minor FROM ({OCC}) o WHERE {JUNE} AND status <> 'SKIPPED') x GROUP BY owner_id""")
def _(t):
    return O.month_income_vs_committed(t.tx, occ_of(t), AS_OF)


@query("w03_next_occurrence", f"SELECT commitment_id, MIN(due_date) AS next_due, ANY_VALUE(amount_minor) AS next_amount_minor FROM ({OCC}) o WHERE status = 'UNPAID' GROUP BY commitment_id", dates=["next_due"])
def _(t):
    return O.next_occurrence(occ_of(t))
