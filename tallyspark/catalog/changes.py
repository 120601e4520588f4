"""State-change queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalog.assets import CHECK, latest
from tallyspark.catalog.quality import PARTS
from tallyspark.catalog.registry import query
from tallyspark.operators import changes as M
from tallyspark.operators import ledger as L
from tallyspark.plans import keyed
from tallyspark.sources.category_data import MERCHANT_DIRECTORY

CONFIRMS = "SELECT owner_id, normalized_item, normalized_merchant, CAST(category_id AS BIGINT) AS category_id, event_id AS ts, event_id AS seq FROM fx_confirms"
KNOWN = """
SELECT owner_id, normalized_item, CAST(NULL AS STRING) AS normalized_merchant, CAST(MIN(category_id) AS BIGINT) AS category_id, COUNT(*) AS confirmation_count, CAST(-5 AS BIGINT) AS created_at, CAST(-2 AS BIGINT) AS updated_at
FROM fx_confirms WHERE category_id <= 2 GROUP BY owner_id, normalized_item
UNION ALL SELECT -1 - s_suppkey, 'old item', 'shop', CAST(3 AS BIGINT), CAST(2 AS BIGINT), CAST(-5 AS BIGINT), CAST(-2 AS BIGINT) FROM supplier"""


@query("m01_fold_confirmations", f"""
WITH cmds AS ({CONFIRMS}), steps AS (
  SELECT owner_id, normalized_item, normalized_merchant, category_id, -1 AS seq, confirmation_count AS w, created_at AS c, updated_at AS u FROM ({KNOWN}) k
  UNION ALL SELECT owner_id, normalized_item, NULL, category_id, seq, 1, ts, ts FROM cmds
  UNION ALL SELECT owner_id, normalized_item, normalized_merchant, category_id, seq, 1, ts, ts FROM cmds WHERE normalized_merchant IS NOT NULL),
 marked AS (SELECT *, CASE WHEN category_id IS DISTINCT FROM LAG(category_id) OVER w THEN 1 ELSE 0 END AS chg FROM steps WINDOW w AS (PARTITION BY owner_id, normalized_item, normalized_merchant ORDER BY seq)),
 runs AS (SELECT *, SUM(chg) OVER (PARTITION BY owner_id, normalized_item, normalized_merchant ORDER BY seq) AS run, SUM(chg) OVER (PARTITION BY owner_id, normalized_item, normalized_merchant) AS last_run FROM marked)
SELECT owner_id, normalized_item, normalized_merchant, MAX(category_id) FILTER (run = last_run) AS category_id, CAST(SUM(w) FILTER (run = last_run) AS BIGINT) AS confirmation_count,
  arg_min(c, seq) AS created_at, arg_max(u, seq) AS updated_at FROM runs GROUP BY owner_id, normalized_item, normalized_merchant""")
def _(t):
    return M.fold_confirmations(t.sql(KNOWN), t.sql(CONFIRMS))


USES = "SELECT owner_id, merchant_name, CAST(category_id AS BIGINT) AS category_id, used_at, event_id AS seq FROM fx_uses"
SHOPS = """SELECT CAST(s_suppkey % 5 AS BIGINT) AS owner_id, CONCAT('shop ', CAST(s_suppkey % 60 AS STRING)) AS normalized_name, MAX(CONCAT('SHOP ', CAST(s_suppkey % 60 AS STRING))) AS display_name, COUNT(*) AS usage_count,
  CAST(-1 AS BIGINT) AS last_used_at, CAST(8 AS BIGINT) AS default_category_id, 'SEEDED' AS source FROM supplier GROUP BY s_suppkey % 5, s_suppkey % 60"""


@query("m02_fold_merchant_use", f"""
SELECT COALESCE(m.owner_id, u.owner_id) AS owner_id, COALESCE(m.normalized_name, u.k) AS normalized_name, COALESCE(u.shown, m.display_name) AS display_name, COALESCE(m.usage_count, 0) + COALESCE(u.n, 0) AS usage_count,
  COALESCE(u.used_at, m.last_used_at) AS last_used_at, COALESCE(u.category_id, m.default_category_id) AS default_category_id, CASE WHEN u.k IS NOT NULL THEN 'USER' ELSE m.source END AS source
FROM ({SHOPS}) m FULL OUTER JOIN (SELECT owner_id, lower(shown) AS k, arg_max(shown, seq) AS shown, COUNT(*) AS n, MAX(used_at) AS used_at, arg_max(category_id, seq) AS category_id
  FROM (SELECT *, trim(regexp_replace(merchant_name, '\\s+', ' ', 'g')) AS shown FROM ({USES}) a) b GROUP BY owner_id, lower(shown)) u ON u.owner_id = m.owner_id AND u.k = m.normalized_name""")
def _(t):
    return M.fold_merchant_use(t.sql(SHOPS), t.sql(USES))


_SEEDS = ", ".join("('{}', {})".format(n.replace("'", "''"), f"'{c}'" if c else "NULL") for n, c in MERCHANT_DIRECTORY)
SEED_CATS = """SELECT CAST(s_suppkey % 5 AS BIGINT) AS owner_id, c.category_id + 10 * (s_suppkey % 5) AS category_id, CASE c.name WHEN 'ECONOMY' THEN 'Medicine' WHEN 'SMALL' THEN 'Restaurants' WHEN 'MEDIUM' THEN 'Bills' ELSE c.name END AS name
  FROM fx_categories c JOIN supplier ON s_suppkey <= 5"""
SEED_KNOWN = f"{SHOPS} UNION ALL SELECT CAST(3 AS BIGINT), 'kfc', 'Kfc', COUNT(*), CAST(1 AS BIGINT), CAST(2 AS BIGINT), 'USER' FROM supplier"


@query("m03_seed_merchants", f"""
WITH known AS ({SEED_KNOWN}), owners AS (SELECT DISTINCT owner_id FROM known) SELECT * FROM known UNION ALL
SELECT o.owner_id, lower(n), n, 0, 0, c.category_id, 'SEEDED' FROM owners o, (VALUES {_SEEDS}) s(n, cat) LEFT JOIN ({SEED_CATS}) c ON c.name = s.cat AND c.owner_id = o.owner_id
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.owner_id = o.owner_id AND k.normalized_name = lower(n))""")
def _(t):
    return M.seed_merchants(t.sql(SEED_KNOWN), t.sql(SEED_CATS))


STATUS_CMDS = """
SELECT order_id AS commitment_id, @ADDM[order_date, line_no % 3] AS due_date, CASE WHEN tax < 0.05 THEN 'PAID' WHEN tax < 0.07 THEN 'SKIPPED' ELSE 'UNPAID' END AS status, discount < 0.07 AS create_expense,
  part_id AS ts, line_id AS seq FROM fx_lines"""
STATUS_FOLD = f"""
WITH RECURSIVE q AS (
  SELECT c.*, 'commitment-' || c.commitment_id || '-' || CAST(c.due_date AS VARCHAR) AS made_id, ROW_NUMBER() OVER (PARTITION BY c.commitment_id, c.due_date ORDER BY c.seq) AS i
  FROM ({STATUS_CMDS}) c WHERE c.commitment_id IN (SELECT commitment_id FROM fx_commitments)),
fold AS (
  SELECT k.commitment_id, k.due_date, CAST(0 AS BIGINT) AS i, o.status, o.paid_tx_id, o.paid_at, false AS made
  FROM (SELECT DISTINCT commitment_id, due_date FROM q) k LEFT JOIN fx_overrides o ON o.commitment_id = k.commitment_id AND o.due_date = k.due_date
  UNION ALL
  SELECT f.commitment_id, f.due_date, q.i, q.status,
    CASE WHEN q.status = 'PAID' AND q.create_expense AND f.paid_tx_id IS NULL THEN q.made_id ELSE f.paid_tx_id END,
    CASE WHEN q.status = 'PAID' AND q.create_expense AND f.paid_tx_id IS NULL THEN q.ts WHEN q.status = 'PAID' THEN COALESCE(f.paid_at, q.ts) END,
    f.made OR (q.status = 'PAID' AND q.create_expense AND f.paid_tx_id IS NULL)
  FROM fold f JOIN q ON q.commitment_id = f.commitment_id AND q.due_date = f.due_date AND q.i = f.i + 1),
last AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY commitment_id, due_date ORDER BY i DESC) AS r FROM fold) x WHERE r = 1)"""


@query("m04_apply_status", f"""{STATUS_FOLD}
SELECT commitment_id, due_date, status, paid_tx_id, paid_at FROM last
UNION ALL SELECT commitment_id, due_date, status, paid_tx_id, paid_at FROM fx_overrides o
WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.commitment_id = o.commitment_id AND l.due_date = o.due_date)""", dates=["due_date"])
def _(t):
    return M.apply_status(t.overrides, t.sql(STATUS_CMDS), t.commitments)["overrides"].select("commitment_id", "due_date", "status", "paid_tx_id", "paid_at")


@query("m04_status_expenses", f"""{STATUS_FOLD}
SELECT l.paid_tx_id AS tx_id, c.amount_minor, 'Commitment: ' || c.title AS note, l.due_date AS tx_date FROM last l JOIN fx_commitments c ON c.commitment_id = l.commitment_id WHERE l.made""", dates=["tx_date"])
def _(t):
    return M.apply_status(t.overrides, t.sql(STATUS_CMDS), t.commitments)["transactions"].select("tx_id", "amount_minor", "note", "tx_date")


# Payments already recorded: one per key, for orders placed before 1998. Commands: every payment row.
RECORDED = """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idempotency_key ORDER BY payment_id) AS r FROM fx_payments) x WHERE r = 1 AND payment_date < DATE '1998-01-01'"""
PAY_CMDS = """SELECT profile_id, owner_id, idempotency_key, due_date, payment_date, total_minor, CASE WHEN created_at % 10 = 3 THEN principal_minor - 1 ELSE principal_minor END AS principal_minor,
  financing_minor, late_minor, created_at AS ts, payment_id AS seq, financing_minor % 2 = 0 AS create_expense FROM fx_payments"""
FRESH = f"""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idempotency_key ORDER BY seq) AS r FROM ({PAY_CMDS}) c WHERE total_minor = principal_minor + financing_minor + late_minor AND total_minor > 0) x
WHERE r = 1 AND idempotency_key NOT IN (SELECT idempotency_key FROM ({RECORDED}) o)"""


def paid_of(t):
    recorded = t.sql(RECORDED).select("profile_id", "owner_id", "idempotency_key", "due_date", "payment_date", "total_minor", "principal_minor", "financing_minor", "late_minor")
    return M.apply_payments(recorded, t.sql(PAY_CMDS), t.profiles, t.commitments, t.overrides)


@query("m05_apply_payments", f"""
SELECT profile_id, idempotency_key, due_date, total_minor, CAST(NULL AS VARCHAR) AS linked_tx_id FROM ({RECORDED}) r
UNION ALL SELECT profile_id, idempotency_key, due_date, total_minor, CASE WHEN create_expense THEN 'payment-' || idempotency_key END FROM ({FRESH}) f""", dates=["due_date"])
def _(t):
    return paid_of(t)["payments"].select("profile_id", "idempotency_key", "due_date", "total_minor", "linked_tx_id")


@query("m05_payment_overrides", f"""
WITH fresh AS ({FRESH}), pieces AS (SELECT profile_id, due_date, principal_minor + financing_minor AS a FROM ({RECORDED}) r UNION ALL SELECT profile_id, due_date, principal_minor + financing_minor FROM fresh),
 alloc AS (SELECT profile_id, due_date, SUM(a) AS a FROM pieces GROUP BY ALL),
 touched AS (SELECT f.profile_id, f.due_date, c.amount_minor, MAX(f.ts) AS now, arg_min('payment-' || f.idempotency_key, f.seq) FILTER (f.create_expense) AS tx FROM fresh f JOIN fx_commitments c ON c.commitment_id = f.profile_id GROUP BY ALL),
 chg AS (SELECT t.profile_id AS commitment_id, t.due_date, CASE WHEN a.a >= t.amount_minor THEN 'PAID' ELSE 'UNPAID' END AS status, COALESCE(o.paid_tx_id, t.tx) AS paid_tx_id, CASE WHEN a.a >= t.amount_minor THEN t.now END AS paid_at
   FROM touched t JOIN alloc a ON a.profile_id = t.profile_id AND a.due_date = t.due_date LEFT JOIN fx_overrides o ON o.commitment_id = t.profile_id AND o.due_date = t.due_date WHERE COALESCE(o.status, 'UNPAID') <> 'SKIPPED')
SELECT commitment_id, due_date, status, paid_tx_id, paid_at FROM chg
UNION ALL SELECT o.commitment_id, o.due_date, o.status, o.paid_tx_id, o.paid_at FROM fx_overrides o WHERE NOT EXISTS (SELECT 1 FROM chg WHERE chg.commitment_id = o.commitment_id AND chg.due_date = o.due_date)""", dates=["due_date"])
def _(t):
    return paid_of(t)["overrides"].select("commitment_id", "due_date", "status", "paid_tx_id", "paid_at")


PROFILES = "SELECT profile_id, commitment_id, owner_id, creditor_name, original_principal_minor, start_date, expected_end_date, repayment_mode, is_archived, profile_id AS created_at, profile_id AS updated_at FROM fx_profiles WHERE original_principal_minor > 10000000"
DEFS = """
SELECT p.profile_id, p.commitment_id, p.owner_id, CASE WHEN c.order_status = 'F' THEN ' ' ELSE CONCAT(' ', p.creditor_name) END AS creditor_name, CASE WHEN c.priority = '5-LOW' THEN 0 ELSE p.original_principal_minor + 100 END AS original_principal_minor,
  p.start_date, p.expected_end_date, p.repayment_mode, false AS is_archived, CAST(7 AS BIGINT) AS ts, p.profile_id AS seq, c.title, c.amount_minor, c.frequency, c.next_due_date, c.end_date, c.priority,
  CASE WHEN c.order_status = 'O' THEN p.original_principal_minor + 500 WHEN c.order_status = 'F' THEN p.original_principal_minor - 500 END AS repay, c.order_status
FROM fx_profiles p JOIN fx_commitments c ON c.commitment_id = p.commitment_id WHERE c.order_status <> 'P'"""
DEF_OK = f"""SELECT * FROM ({DEFS}) d WHERE original_principal_minor > 0 AND (repayment_mode = 'OPEN_ENDED' OR (amount_minor > 0 AND frequency <> 'CUSTOM')) AND (priority <> '1-URGENT' OR repay >= original_principal_minor)"""


def defs_of(t):
    d = t.sql(DEFS)
    terms = F.when(F.col("priority") == "1-URGENT", F.struct(F.col("owner_id"), F.lit("FIXED_TOTAL").alias("financing_type"), F.col("repay").alias("total_repayable_minor")))
    rule = F.when(F.col("priority") != "4-NOT SPECIFIED", F.struct(F.col("owner_id"), F.lit(3).alias("grace_days"), F.lit("FIXED_ONCE").alias("charge_type")))
    defs = d.withColumn("terms", terms).withColumn("late_rule", rule)
    rules = t.late_rules.select("profile_id", "owner_id", "grace_days", "charge_type")
    return M.apply_debt_defs(t.sql(PROFILES), t.terms, rules, defs)


@query("m06_apply_debt_defs", f"""
WITH ok AS ({DEF_OK}), old AS ({PROFILES})
SELECT COALESCE(k.profile_id, o.profile_id) AS profile_id, CASE WHEN k.profile_id IS NULL THEN o.creditor_name WHEN trim(k.creditor_name) = '' THEN NULL ELSE trim(k.creditor_name) END AS creditor_name,
  COALESCE(k.original_principal_minor, o.original_principal_minor) AS original_principal_minor, COALESCE(o.created_at, k.ts) AS created_at, CASE WHEN k.profile_id IS NULL THEN o.updated_at ELSE k.ts END AS updated_at, COALESCE(o.is_archived, false) AS is_archived
FROM ok k FULL OUTER JOIN old o ON o.commitment_id = k.commitment_id""")
def _(t):
    return defs_of(t)["profiles"].select("profile_id", "creditor_name", "original_principal_minor", "created_at", "updated_at", "is_archived")


@query("m06_debt_terms", f"""
WITH ok AS ({DEF_OK})
SELECT 'terms' AS kind, profile_id, financing_type AS what, total_repayable_minor AS n FROM fx_terms WHERE profile_id NOT IN (SELECT profile_id FROM ok)
UNION ALL SELECT 'terms', profile_id, 'FIXED_TOTAL', repay FROM ok WHERE priority = '1-URGENT'
UNION ALL SELECT 'rule', profile_id, charge_type, grace_days FROM fx_late_rules WHERE profile_id NOT IN (SELECT profile_id FROM ok)
UNION ALL SELECT 'rule', profile_id, 'FIXED_ONCE', 3 FROM ok WHERE priority <> '4-NOT SPECIFIED'""")
def _(t):
    out = defs_of(t)
    a = out["terms"].select(F.lit("terms").alias("kind"), "profile_id", F.col("financing_type").alias("what"), F.col("total_repayable_minor").alias("n"))
    return a.unionByName(out["rules"].select(F.lit("rule").alias("kind"), "profile_id", F.col("charge_type").alias("what"), F.col("grace_days").cast("long").alias("n")))


@query("m07_archive_debts", """
WITH gone AS (SELECT profile_id, commitment_id FROM fx_profiles WHERE repayment_mode = 'OPEN_ENDED')
SELECT 'profile' AS kind, profile_id AS id, is_archived OR profile_id IN (SELECT profile_id FROM gone) AS flag FROM fx_profiles
UNION ALL SELECT 'commitment', commitment_id, is_active AND commitment_id NOT IN (SELECT commitment_id FROM gone) FROM fx_commitments""")
def _(t):
    out = M.archive_debts(t.profiles, t.commitments, t.profiles.filter("repayment_mode = 'OPEN_ENDED'"))
    p = out["profiles"].select(F.lit("profile").alias("kind"), F.col("profile_id").alias("id"), F.col("is_archived").alias("flag"))
    return p.unionByName(out["commitments"].select(F.lit("commitment").alias("kind"), F.col("commitment_id").alias("id"), F.col("is_active").alias("flag")))


DONE = "SELECT asset_id, rule_id, event_date, km, cost_minor, linked_tx_id, event_id AS idempotency_key FROM fx_rule_events WHERE event_date < DATE '1997-01-01'"
# Several tries share a key: the order number's last digit within an item.
MAINT_CMDS = """
SELECT part_id AS asset_id, CASE WHEN line_no < 6 THEN part_id END AS rule_id, CASE WHEN tax > 0.078 THEN ' ' ELSE p_name END AS title, ship_date AS event_date,
  CASE WHEN discount < 0.09 THEN CAST(quantity AS BIGINT) * 100 + order_id * 4 END AS km, CASE WHEN tax < 0.01 THEN NULL ELSE price_minor END AS cost_minor, flag = 'R' AS create_expense,
  CASE WHEN p_size > 3 THEN 1 + order_id % 8 END AS category_id, CONCAT(CAST(part_id AS STRING), ':', CAST(order_id % 10 AS STRING)) AS idempotency_key,
  CONCAT(LPAD(CAST(order_id AS STRING), 12, '0'), ':', line_id) AS seq FROM fx_lines"""
MAINT_FOLD = f"""
WITH RECURSIVE q AS (
  SELECT c.*, a.is_archived, r.asset_id AS r_asset, r.is_active, r.trigger_type, k.category_id IS NOT NULL AS usable, ROW_NUMBER() OVER (PARTITION BY c.asset_id ORDER BY c.seq) AS i
  FROM ({MAINT_CMDS}) c JOIN fx_assets a ON a.asset_id = c.asset_id LEFT JOIN fx_rules r ON r.rule_id = c.rule_id
  LEFT JOIN fx_categories k ON k.category_id = c.category_id AND NOT k.is_archived),
judged AS (
  SELECT *, NOT is_archived AND (rule_id IS NULL OR (r_asset = asset_id AND is_active)) AND trim(title) <> '' AND (cost_minor IS NULL OR cost_minor > 0)
    AND (trigger_type IS NULL OR trigger_type = 'TIME' OR km IS NOT NULL) AND (NOT create_expense OR (cost_minor > 0 AND usable))
    AND idempotency_key NOT IN (SELECT idempotency_key FROM ({DONE}) d) AS sound FROM q),
fold AS (
  SELECT asset_id, CAST(0 AS BIGINT) AS i, CAST(current_km AS BIGINT) AS high, CAST([] AS VARCHAR[]) AS keys, false AS took FROM fx_assets
  UNION ALL
  SELECT asset_id, i, CASE WHEN ok THEN COALESCE(km, high) ELSE high END, CASE WHEN ok THEN list_append(keys, idempotency_key) ELSE keys END, ok FROM (
    SELECT f.asset_id, j.i, f.high, f.keys, j.km, j.idempotency_key,
      COALESCE(j.sound, false) AND NOT list_contains(f.keys, j.idempotency_key) AND (j.km IS NULL OR (j.km >= 0 AND (f.high IS NULL OR j.km >= f.high))) AS ok
    FROM fold f JOIN judged j ON j.asset_id = f.asset_id AND j.i = f.i + 1) s),
accepted AS (SELECT j.*, CASE WHEN j.create_expense THEN 'maintenance-' || j.idempotency_key END AS linked FROM fold f JOIN judged j ON j.asset_id = f.asset_id AND j.i = f.i WHERE f.took)"""


def maintained_of(t):
    return M.apply_maintenance(t.sql(DONE), t.sql(MAINT_CMDS), t.assets, t.rules, t.categories)


@query("m08_apply_maintenance", f"""{MAINT_FOLD}
SELECT idempotency_key, asset_id, rule_id, event_date, km, linked_tx_id FROM ({DONE}) d UNION ALL SELECT idempotency_key, asset_id, rule_id, event_date, km, linked FROM accepted""", dates=["event_date"])
def _(t):
    return maintained_of(t)["events"].select("idempotency_key", "asset_id", "rule_id", "event_date", "km", "linked_tx_id")


@query("m08_maintenance_mileage", f"""{MAINT_FOLD}
SELECT a.asset_id, GREATEST(a.current_km, m.km) AS current_km FROM fx_assets a LEFT JOIN (SELECT asset_id, MAX(km) AS km FROM accepted GROUP BY asset_id) m ON m.asset_id = a.asset_id""")
def _(t):
    return maintained_of(t)["assets"].select("asset_id", "current_km")


CP_CMDS = """SELECT part_id AS checkpoint_id, ship_date AS event_date, CASE WHEN discount < 0.08 THEN CAST(quantity AS BIGINT) * 1500 END AS km, CASE WHEN flag = 'R' THEN ' done ' ELSE ' ' END AS note,
  line_no AS ts, CONCAT(LPAD(CAST(order_id AS STRING), 12, '0'), ':', line_id) AS seq FROM fx_lines"""
CP_FOLD = f"""
WITH RECURSIVE recorded AS (SELECT checkpoint_id, event_date, km FROM {latest('fx_checkpoint_events', 'checkpoint_id')} e),
q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY checkpoint_id ORDER BY seq) AS i FROM ({CP_CMDS}) c),
fold AS (
  SELECT c.checkpoint_id, CAST(0 AS BIGINT) AS i, c.is_active AS live, e.event_date AS newest, CAST(e.km AS BIGINT) AS newest_km, c.rescheduled_date, c.rescheduled_km,
    c.due_date AS own_date, c.due_km AS own_km, c.repeat_months, c.repeat_km, false AS took, CAST(NULL AS DATE) AS due_date, CAST(NULL AS BIGINT) AS due_km
  FROM fx_checkpoints c LEFT JOIN recorded e ON e.checkpoint_id = c.checkpoint_id
  UNION ALL
  SELECT checkpoint_id, qi, CASE WHEN ok THEN repeat_months IS NOT NULL OR repeat_km IS NOT NULL ELSE live END,
    CASE WHEN ok AND (newest IS NULL OR q_date >= newest) THEN q_date ELSE newest END, CASE WHEN ok AND (newest IS NULL OR q_date >= newest) THEN q_km ELSE newest_km END,
    CASE WHEN NOT ok THEN rescheduled_date END, CASE WHEN NOT ok THEN rescheduled_km END, own_date, own_km, repeat_months, repeat_km, ok,
    COALESCE(rescheduled_date, CASE WHEN newest IS NULL THEN own_date ELSE CAST(newest + to_months(CAST(repeat_months AS INTEGER)) AS DATE) END),
    COALESCE(rescheduled_km, CASE WHEN newest IS NULL THEN own_km ELSE newest_km + repeat_km END)
  FROM (SELECT f.*, q.i AS qi, q.event_date AS q_date, q.km AS q_km, f.live AND (f.repeat_km IS NULL OR COALESCE(q.km >= 0, false)) AS ok FROM fold f JOIN q ON q.checkpoint_id = f.checkpoint_id AND q.i = f.i + 1) s)"""


@query("m09_complete_checkpoints", f"""{CP_FOLD}
SELECT f.checkpoint_id, 'completion-' || q.seq AS event_id, q.event_date, q.km, f.due_date, f.due_km, CASE WHEN trim(q.note) <> '' THEN trim(q.note) END AS note
FROM fold f JOIN q ON q.checkpoint_id = f.checkpoint_id AND q.i = f.i WHERE f.took""", dates=["event_date", "due_date"])
def _(t):
    return M.complete_checkpoints(t.checkpoints, t.sql(CP_CMDS), t.checkpoint_events)["events"].select("checkpoint_id", "event_id", "event_date", "km", "due_date", "due_km", "note")


@query("m09_checkpoint_state", f"""{CP_FOLD}
SELECT checkpoint_id, live AS is_active, rescheduled_date, rescheduled_km FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY checkpoint_id ORDER BY i DESC) AS r FROM fold) x WHERE r = 1""", dates=["rescheduled_date"])
def _(t):
    return M.complete_checkpoints(t.checkpoints, t.sql(CP_CMDS), t.checkpoint_events)["checkpoints"].select("checkpoint_id", "is_active", "rescheduled_date", "rescheduled_km")


CP_EDITS = """
SELECT checkpoint_id, asset_id, CONCAT(' ', title) AS title, CASE WHEN warning_days IS NULL THEN 'DATE_OR_MILEAGE' ELSE trigger_mode END AS trigger_mode,
  CASE WHEN due_date IS NOT NULL THEN due_date + 7 END AS due_date, CASE WHEN due_km > 50000 THEN due_km + 500 ELSE due_km END AS due_km, repeat_months, repeat_km, 21 AS warning_days,
  CASE WHEN due_km > 20000 THEN CAST(2000 AS BIGINT) ELSE warning_km END AS warning_km, is_active OR repeat_km IS NOT NULL AS is_active, checkpoint_id AS seq
FROM fx_checkpoints
UNION ALL SELECT 100000000 + checkpoint_id, asset_id, title, trigger_mode, due_date, due_km, CASE WHEN warning_km IS NULL THEN -1 ELSE repeat_months END, repeat_km, warning_days, warning_km, true, 100000000 + checkpoint_id FROM fx_checkpoints"""
CP_SOUND = f"""
SELECT e.* FROM ({CP_EDITS}) e JOIN fx_assets a ON a.asset_id = e.asset_id AND NOT a.is_archived
WHERE trim(title) <> '' AND COALESCE(repeat_months > 0, true) AND COALESCE(repeat_km > 0, true) AND COALESCE(warning_days >= 0, true) AND COALESCE(warning_km >= 0, true) AND COALESCE(due_km >= 0, true)
  AND CASE trigger_mode WHEN 'DATE' THEN due_date IS NOT NULL AND due_km IS NULL AND repeat_km IS NULL WHEN 'MILEAGE' THEN due_km IS NOT NULL AND due_date IS NULL AND repeat_months IS NULL
    ELSE due_date IS NOT NULL AND due_km IS NOT NULL END AND (repeat_months IS NULL OR due_date IS NOT NULL) AND (repeat_km IS NULL OR due_km IS NOT NULL)"""
EDITED = f"""
SELECT e.*, e.trigger_mode <> o.trigger_mode AS sw, o.due_date AS o_due_date, o.due_km AS o_due_km, o.next_date, o.next_km, o.rescheduled_date AS o_rd, o.rescheduled_km AS o_rk, o.trigger_mode AS o_mode, o.warning_days AS o_wd, o.warning_km AS o_wk
FROM ({CP_SOUND}) e JOIN ({CHECK}) o ON o.checkpoint_id = e.checkpoint_id"""
CP_COLS = "checkpoint_id, title, trigger_mode, due_date, due_km, repeat_months, repeat_km, warning_days, warning_km, rescheduled_date, rescheduled_km, is_active"


def edited_of(t):
    return M.edit_checkpoints(t.checkpoints, t.sql(CP_EDITS), t.of_lines("fx_checkpoint_events"), t.reminder_rules, t.assets)


@query("m10_edit_checkpoints", f"""
SELECT checkpoint_id, trim(title) AS title, trigger_mode, CASE WHEN sw THEN due_date ELSE o_due_date END AS due_date, CASE WHEN sw THEN due_km ELSE o_due_km END AS due_km, repeat_months, repeat_km, warning_days, warning_km,
  CASE WHEN NOT sw THEN COALESCE(CASE WHEN due_date IS DISTINCT FROM next_date THEN due_date END, o_rd) END AS rescheduled_date, CASE WHEN NOT sw THEN COALESCE(CASE WHEN due_km IS DISTINCT FROM next_km THEN due_km END, o_rk) END AS rescheduled_km, is_active
FROM ({EDITED}) e
UNION ALL SELECT checkpoint_id, trim(title), trigger_mode, due_date, due_km, repeat_months, repeat_km, warning_days, warning_km, NULL, NULL, is_active FROM ({CP_SOUND}) n WHERE checkpoint_id NOT IN (SELECT checkpoint_id FROM fx_checkpoints)
UNION ALL SELECT {CP_COLS} FROM fx_checkpoints WHERE checkpoint_id NOT IN (SELECT checkpoint_id FROM ({EDITED}) k)""", dates=["due_date", "rescheduled_date"])
def _(t):
    return edited_of(t)["checkpoints"].select(*CP_COLS.split(", "))


@query("m10_rule_deltas", f"""
WITH w AS (SELECT checkpoint_id, 'DAYS_BEFORE' AS trigger_kind, CASE WHEN o_mode <> 'MILEAGE' THEN o_wd END AS o, CASE WHEN trigger_mode <> 'MILEAGE' THEN warning_days END AS n FROM ({EDITED}) e
   UNION ALL SELECT checkpoint_id, 'KM_BEFORE', CASE WHEN o_mode <> 'DATE' THEN o_wk END, CASE WHEN trigger_mode <> 'DATE' THEN warning_km END FROM ({EDITED}) e),
 x AS (SELECT * FROM w WHERE o IS DISTINCT FROM n AND checkpoint_id IN (SELECT source_id FROM fx_reminder_rules WHERE source_type = 'CHECKPOINT'))
SELECT checkpoint_id AS source_id, trigger_kind, CAST(o AS BIGINT) AS lead_value, false AS is_enabled FROM x WHERE o IS NOT NULL UNION ALL SELECT checkpoint_id, trigger_kind, n, true FROM x WHERE n > 0""")
def _(t):
    return edited_of(t)["rule_deltas"].select("source_id", "trigger_kind", "lead_value", "is_enabled")


OWN_CMDS = "SELECT part_id AS asset_id, CASE flag WHEN 'R' THEN 'OWNED' WHEN 'A' THEN 'SOLD' ELSE 'LOST' END AS status, ship_date AS effective_date, ' ' AS note, order_id AS ts, line_id AS seq FROM fx_lines"


@query("m11_apply_ownership", f"""
SELECT asset_id, status, effective_date, seq FROM (SELECT c.*, COALESCE(LAG(c.status) OVER (PARTITION BY c.asset_id ORDER BY c.ts, c.seq), a.ownership_status) AS before
FROM ({OWN_CMDS}) c JOIN fx_assets a ON a.asset_id = c.asset_id AND NOT a.is_archived) x WHERE status <> before""", dates=["effective_date"])
def _(t):
    return M.apply_ownership(t.assets, t.by_part(OWN_CMDS))["events"].select("asset_id", "status", "effective_date", "seq")


@query("m11_ownership_state", f"""
SELECT a.asset_id, CASE WHEN a.is_archived THEN a.ownership_status ELSE COALESCE(l.status, a.ownership_status) END AS ownership_status FROM fx_assets a
LEFT JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY asset_id ORDER BY ts DESC, seq DESC) AS r FROM ({OWN_CMDS}) c) x WHERE r = 1) l ON l.asset_id = a.asset_id""")
def _(t):
    return M.apply_ownership(t.assets, t.sql(OWN_CMDS))["assets"].select("asset_id", "ownership_status")


DESIRED = """
SELECT p_partkey AS asset_id, 'WARRANTY' AS source_type, p_partkey AS source_id, 'DAYS_BEFORE' AS trigger_kind, CAST(30 AS BIGINT) AS lead_value, p_size < 30 AS is_enabled FROM part WHERE p_type <> 'PROMO'
UNION ALL SELECT p_partkey, 'WARRANTY', p_partkey, 'DAYS_BEFORE', CAST(7 AS BIGINT), true FROM part WHERE p_type <> 'PROMO'"""


@query("m12_configure_rules", f"""
SELECT COALESCE(r.source_type, d.source_type) AS source_type, COALESCE(r.source_id, d.source_id) AS source_id, COALESCE(r.trigger_kind, d.trigger_kind) AS trigger_kind, COALESCE(r.lead_value, d.lead_value) AS lead_value,
  CASE WHEN d.source_id IS NOT NULL THEN d.is_enabled WHEN s.source_id IS NOT NULL THEN false ELSE r.is_enabled END AS is_enabled
FROM fx_reminder_rules r FULL OUTER JOIN ({DESIRED}) d ON d.source_type = r.source_type AND d.source_id = r.source_id AND d.trigger_kind = r.trigger_kind AND d.lead_value = r.lead_value
LEFT JOIN (SELECT DISTINCT source_type, source_id FROM ({DESIRED}) q) s ON s.source_type = r.source_type AND s.source_id = r.source_id""")
def _(t):
    return M.configure_rules(t.reminder_rules, t.sql(DESIRED)).select("source_type", "source_id", "trigger_kind", "lead_value", "is_enabled")


@query("m13_to_minor", "SELECT o_orderkey, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS amount_minor FROM orders")
def _(t):
    return t.raw("orders").select("o_orderkey", M.to_minor(F.col("o_totalprice")).alias("amount_minor"))


BOUGHT = f"SELECT *, CASE WHEN p_n = 1 THEN 'MANUAL' ELSE 'RECEIPT' END AS source, CAST(1000 AS BIGINT) AS ts FROM (SELECT *, CASE WHEN tx_date < DATE '1998-01-01' THEN 1 ELSE 2 END AS p_n FROM ({PARTS}) p) q"


@query("m14_post_purchases", f"""
SELECT purchase_key || '-' || part_no AS tx_id, owner_id, amount_minor, category_id, source, 1000 + part_no AS created_at, source = 'RECEIPT' OR n > 1 AS grouped, tx_date
FROM (SELECT *, COUNT(*) OVER (PARTITION BY purchase_key) AS n FROM ({BOUGHT}) b) x""", dates=["tx_date"])
def _(t):
    rows = M.post_purchases(t.sql(BOUGHT))["transactions"]
    return rows.select("tx_id", "owner_id", "amount_minor", "category_id", "source", "created_at", F.col("purchase_group_id").isNotNull().alias("grouped"), "tx_date")


@query("m14_learned_category", f"""
SELECT purchase_key, category_id, n AS n_parts FROM (SELECT *, COUNT(*) OVER (PARTITION BY purchase_key) AS n, ROW_NUMBER() OVER (PARTITION BY purchase_key ORDER BY amount_minor DESC, part_no, category_id DESC NULLS LAST) AS r FROM ({BOUGHT}) b) x WHERE r = 1""")
def _(t):
    return M.post_purchases(t.sql(BOUGHT))["learned"]


CAT_CMDS = """
SELECT CAST(s_suppkey % 8 + 1 AS BIGINT) AS category_id, CASE WHEN s_nationkey = 7 AND s_suppkey > 20 THEN 'ARCHIVE' ELSE 'RENAME' END AS action, CONCAT('Name ', CAST(s_suppkey AS STRING)) AS name, s_suppkey AS seq FROM supplier"""


@query("m15_edit_categories", f"""
WITH c AS ({CAT_CMDS}), e AS (SELECT category_id, MIN(seq) AS stop FROM c WHERE action = 'ARCHIVE' GROUP BY category_id),
 n AS (SELECT c.category_id, arg_max(c.name, c.seq) AS name FROM c LEFT JOIN e ON e.category_id = c.category_id WHERE c.action = 'RENAME' AND (e.stop IS NULL OR c.seq < e.stop) GROUP BY c.category_id)
SELECT k.category_id, CASE WHEN k.type = 'CUSTOM' AND NOT k.is_archived THEN COALESCE(n.name, k.name) ELSE k.name END AS name, k.type, k.is_archived OR (k.type = 'CUSTOM' AND e.stop IS NOT NULL) AS is_archived
FROM fx_categories k LEFT JOIN n ON n.category_id = k.category_id LEFT JOIN e ON e.category_id = k.category_id""")
def _(t):
    return M.edit_categories(t.categories, t.sql(CAT_CMDS))


TYPE_NAMES = """SELECT CAST(p_partkey % 2 AS BIGINT) AS owner_id, CONCAT(' ', REPLACE(p_name, ' ', '   '), ' ') AS name, p_partkey AS seq FROM part
UNION ALL SELECT CAST(r_regionkey % 2 AS BIGINT), 'BICYCLE', -1 - r_regionkey FROM region UNION ALL SELECT CAST(0 AS BIGINT), ' BOAT', -20 - r_regionkey FROM region"""


@query("m15_create_custom_types", f"""
SELECT COALESCE(o.owner_id, w.owner_id) AS owner_id, COALESCE(o.key, w.key) AS key, COALESCE(o.name, w.shown) AS name, CASE WHEN w.key IS NOT NULL THEN false ELSE o.is_archived END AS is_archived
FROM (SELECT owner_id, lower(name) AS key, name, is_archived FROM fx_custom_types) o
FULL OUTER JOIN (SELECT owner_id, lower(shown) AS key, arg_min(shown, seq) AS shown FROM (SELECT owner_id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS shown, seq FROM ({TYPE_NAMES}) a) b GROUP BY owner_id, lower(shown)) w
  ON w.owner_id = o.owner_id AND w.key = o.key""")
def _(t):
    return M.create_custom_types(t.custom_types, t.sql(TYPE_NAMES))


OLD_TX = "SELECT owner_id, tx_id, type, CASE WHEN category_id = 2 THEN CONCAT(' ', merchant, ' ') ELSE merchant END AS merchant, purchase_group_id AS receipt_group_id, amount_minor FROM fx_tx"
SHOP_IDS = "SELECT owner_id, LOWER(merchant) AS normalized_name, owner_id * 1000000 + MIN(merchant_id) AS merchant_id FROM fx_tx WHERE merchant IS NOT NULL AND category_id <> 3 GROUP BY owner_id, LOWER(merchant)"


@query("m16_backfill_merchant_ids", f"""SELECT t.owner_id, t.tx_id, m.merchant_id, t.receipt_group_id AS purchase_group_id FROM ({OLD_TX}) t
LEFT JOIN ({SHOP_IDS}) m ON t.type = 'EXPENSE' AND m.owner_id = t.owner_id AND m.normalized_name = lower(trim(t.merchant))""")
def _(t):
    return M.backfill_merchant_ids(t.sql(OLD_TX), t.sql(SHOP_IDS)).select("owner_id", "tx_id", "merchant_id", "purchase_group_id")


MANUAL = "SELECT tx_id, type, amount_minor, COALESCE(category_id, 3) AS category_id, CASE WHEN created_at = 2 THEN '  ' ELSE merchant END AS merchant, CASE WHEN created_at = 3 THEN '' ELSE note END AS note FROM fx_tx"


@query("m17_ingest_manual", f"""
SELECT tx_id, type, CASE WHEN trim(merchant) <> '' THEN merchant END AS merchant, CASE WHEN trim(note) <> '' THEN note END AS note, CASE WHEN type = 'EXPENSE' THEN category_id END AS category_id, 'MANUAL' AS source FROM ({MANUAL}) m""")
def _(t):
    return L.ingest_manual(t.sql(MANUAL)).select("tx_id", "type", "merchant", "note", "category_id", "source")


COMMIT_CMDS = """
SELECT CASE WHEN o_orderpriority = '5-LOW' THEN -1 - o_orderkey ELSE o_orderkey END AS commitment_id, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE CONCAT('New ', CAST(o_custkey AS STRING)) END AS title,
  CAST(ROUND(o_totalprice) AS BIGINT) - 50000 AS amount_minor, o_orderkey AS seq FROM orders"""
HELD = "SELECT commitment_id, title, amount_minor FROM fx_commitments"


@query("m18_upsert_commitments", f"""
WITH ok AS (SELECT * FROM ({COMMIT_CMDS}) c WHERE trim(title) <> '' AND amount_minor > 0)
SELECT COALESCE(k.commitment_id, h.commitment_id) AS commitment_id, COALESCE(k.title, h.title) AS title, COALESCE(k.amount_minor, h.amount_minor) AS amount_minor FROM ok k FULL OUTER JOIN ({HELD}) h ON h.commitment_id = k.commitment_id""")
def _(t):
    return M.upsert_commitments(t.sql(HELD), t.sql(COMMIT_CMDS))["commitments"]


MERGE_CMDS = "SELECT merchant_id, name, amount_minor, seq FROM (SELECT supplier_id * 2 AS merchant_id, CONCAT('c', CAST(part_id AS STRING)) AS name, price_minor AS amount_minor, line_id AS seq FROM fx_lines) x"
MERGE_HELD = "SELECT s_suppkey AS merchant_id, s_name AS name, CAST(ROUND(s_acctbal) AS BIGINT) AS amount_minor FROM supplier"
MERGE_WON = f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY seq DESC) AS r FROM ({MERGE_CMDS}) c) y WHERE r = 1"


@query("m19_merge", f"""
WITH h AS ({MERGE_HELD}), w AS ({MERGE_WON})
SELECT 'REPLACE' AS policy, COALESCE(w.merchant_id, h.merchant_id) AS merchant_id, COALESCE(w.name, h.name) AS name, COALESCE(w.amount_minor, h.amount_minor) AS amount_minor FROM h FULL OUTER JOIN w ON w.merchant_id = h.merchant_id
UNION ALL SELECT 'IGNORE', COALESCE(h.merchant_id, w.merchant_id), COALESCE(h.name, w.name), COALESCE(h.amount_minor, w.amount_minor) FROM h FULL OUTER JOIN w ON w.merchant_id = h.merchant_id
UNION ALL SELECT 'UPDATE', h.merchant_id, COALESCE(w.name, h.name), COALESCE(w.amount_minor, h.amount_minor) FROM h LEFT JOIN w ON w.merchant_id = h.merchant_id
UNION ALL SELECT 'DELETE', h.merchant_id, h.name, h.amount_minor FROM h WHERE h.merchant_id NOT IN (SELECT merchant_id FROM w)""")
def _(t):
    held, cmds, out = t.sql(MERGE_HELD), t.sql(MERGE_CMDS), None
    for policy in ("REPLACE", "IGNORE", "UPDATE", "DELETE"):
        part = keyed.merge(held, cmds, ["merchant_id"], policy, [F.desc("seq")]).select(F.lit(policy).alias("policy"), "merchant_id", "name", "amount_minor")
        out = part if out is None else out.unionByName(part)
    return out


RULE_CMDS = """
SELECT rule_id, CASE WHEN interval_km = 10000 THEN asset_id + 1 ELSE asset_id END AS asset_id, CASE WHEN interval_months = 5 THEN ' ' ELSE CONCAT(' ', title, ' v2') END AS title,
  CASE WHEN interval_months = 9 THEN 'OTHER' ELSE kind END AS kind, trigger_type, CASE WHEN interval_months = 7 THEN 0 ELSE interval_months + 1 END AS interval_months, interval_km, baseline_date, baseline_km, warning_days, warning_km,
  is_active, CAST(99 AS BIGINT) AS created_at, CASE WHEN interval_months > 20 THEN 'ARCHIVE' ELSE 'SAVE' END AS action, rule_id AS seq FROM fx_rules WHERE kind = 'SERVICE_SCHEDULE'"""
RULE_JUDGED = f"""
SELECT c.*, CASE WHEN o.asset_id <> c.asset_id OR (c.action = 'SAVE' AND o.kind <> c.kind) THEN 'Item and kind cannot change' WHEN c.action = 'SAVE' AND trim(c.title) = '' THEN 'blank title'
  WHEN c.action = 'SAVE' AND c.trigger_type <> 'MILEAGE' AND c.interval_months <= 0 THEN 'time trigger needs interval and baseline' END AS violation FROM ({RULE_CMDS}) c JOIN fx_rules o ON o.rule_id = c.rule_id"""


@query("m20_apply_rules", f"""
WITH j AS ({RULE_JUDGED})
SELECT r.rule_id, CASE WHEN s.rule_id IS NOT NULL THEN trim(s.title) ELSE r.title END AS title, COALESCE(s.interval_months, r.interval_months) AS interval_months, r.created_at, r.is_active AND a.rule_id IS NULL AS is_active
FROM fx_rules r LEFT JOIN (SELECT * FROM j WHERE violation IS NULL AND action = 'SAVE') s ON s.rule_id = r.rule_id LEFT JOIN (SELECT * FROM j WHERE violation IS NULL AND action = 'ARCHIVE') a ON a.rule_id = r.rule_id""")
def _(t):
    return M.apply_rules(t.rules, t.sql(RULE_CMDS))["rules"].select("rule_id", "title", "interval_months", "created_at", "is_active")


@query("m20_rejected_rules", f"SELECT rule_id, action, violation FROM ({RULE_JUDGED}) j WHERE violation IS NOT NULL")
def _(t):
    return M.apply_rules(t.rules, t.sql(RULE_CMDS))["rejected"]
