"""Item, attention and reminder queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalog.ledger import egp
from tallyspark.catalog.obligations import months_between
from tallyspark.catalog.registry import query
from tallyspark.operators import assets as A
from tallyspark.sources.fixtures import AS_OF

NOW = f"DATE '{AS_OF}'"
LABEL = """COALESCE(c.name, CASE WHEN a.asset_type = 'COMPUTER' THEN 'Laptop / Computer' ELSE upper(a.asset_type[1]) || lower(a.asset_type[2:]) END)"""


def latest(table: str, key: str) -> str:
    return f"(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY event_date DESC, created_at DESC, event_id DESC) AS r FROM {table}) z WHERE r = 1)"


def comp(rem: str, warn: str) -> str:
    return f"CASE WHEN {rem} IS NULL THEN -1 WHEN {rem} < 0 THEN 3 WHEN {rem} = 0 THEN 2 WHEN {rem} <= {warn} THEN 1 ELSE 0 END"


MAINT = f"""
SELECT *, CASE CASE trigger_type WHEN 'TIME' THEN ts WHEN 'MILEAGE' THEN ks ELSE GREATEST(ts, ks) END WHEN 3 THEN 'OVERDUE' WHEN 2 THEN 'DUE' WHEN 1 THEN 'DUE_SOON' ELSE 'OK' END AS due_status,
  CASE WHEN ts < 0 AND ks < 0 THEN 'UNKNOWN' WHEN ts = ks AND ts >= 1 THEN 'BOTH' WHEN ts >= ks THEN 'TIME' ELSE 'MILEAGE' END AS trigger_reason
FROM (SELECT *, {comp('remaining_days', 'warning_days')} AS ts, {comp('remaining_km', 'warning_km')} AS ks
  FROM (SELECT *, date_diff('day', {NOW}, next_date) AS remaining_days, next_km - current_km AS remaining_km
    FROM (SELECT r.*, a.current_km, a.owner_id,
        CASE WHEN r.trigger_type <> 'MILEAGE' THEN CAST(COALESCE(e.event_date, r.baseline_date) + to_months(CAST(r.interval_months AS INTEGER)) AS DATE) END AS next_date,
        CASE WHEN r.trigger_type <> 'TIME' THEN COALESCE(e.km, r.baseline_km) + r.interval_km END AS next_km
      FROM fx_rules r LEFT JOIN {latest('fx_rule_events', 'rule_id')} e ON e.rule_id = r.rule_id LEFT JOIN fx_assets a ON a.asset_id = r.asset_id) x) y) w"""
CHECK = f"""
SELECT c.*, COALESCE(c.rescheduled_date, CASE WHEN e.event_id IS NULL THEN c.due_date ELSE CAST(e.event_date + to_months(CAST(c.repeat_months AS INTEGER)) AS DATE) END) AS next_date,
  COALESCE(c.rescheduled_km, CASE WHEN e.event_id IS NULL THEN c.due_km ELSE e.km + c.repeat_km END) AS next_km
FROM fx_checkpoints c LEFT JOIN {latest('fx_checkpoint_events', 'checkpoint_id')} e ON e.checkpoint_id = c.checkpoint_id"""


def prio(rem: str, warn: str) -> str:
    return f"CASE WHEN {rem} IS NULL THEN NULL WHEN {rem} < 0 THEN 4 WHEN {rem} = 0 THEN 3 WHEN {warn} IS NOT NULL AND {rem} <= {warn} THEN 2 ELSE 1 END"


ATTENTION = f"""
SELECT *, CASE priority WHEN 4 THEN 'OVERDUE' WHEN 3 THEN 'DUE' WHEN 2 THEN 'DUE_SOON' ELSE 'UPCOMING' END AS status,
  CASE WHEN n IS NULL THEN 'Due point set; update mileage to check progress'
    WHEN source_type = 'WARRANTY' AND n < 0 THEN title || ' expired ' || abs(n) || ' days ago' WHEN source_type = 'WARRANTY' AND n = 0 THEN title || ' expires today'
    WHEN source_type = 'WARRANTY' THEN title || ' expires in ' || n || ' days' WHEN n < 0 THEN title || ' overdue by ' || abs(n) || ' ' || unit
    WHEN n = 0 THEN title || ' due now' ELSE title || ' due in ' || n || ' ' || unit END AS message,
  COALESCE(CAST(date_diff('day', DATE '1970-01-01', due_date) AS VARCHAR), '-') || ':' || COALESCE(CAST(due_km AS VARCHAR), '-') AS occurrence_key
FROM (SELECT *, COALESCE(GREATEST(dp, kp), 1) AS priority, CASE WHEN remaining_days IS NULL OR (kp IS NOT NULL AND kp > COALESCE(dp, 1)) THEN remaining_km ELSE remaining_days END AS n,
    CASE WHEN remaining_days IS NULL OR (kp IS NOT NULL AND kp > COALESCE(dp, 1)) THEN 'km' ELSE 'days' END AS unit
  FROM (SELECT *, {prio('remaining_days', 'warning_days')} AS dp, {prio('remaining_km', 'warning_km')} AS kp
    FROM (SELECT i.*, a.owner_id, date_diff('day', {NOW}, i.due_date) AS remaining_days, i.due_km - a.current_km AS remaining_km FROM (
        SELECT asset_id, 'WARRANTY' AS source_type, warranty_id AS source_id, name AS title, end_date AS due_date, CAST(NULL AS BIGINT) AS due_km, 30 AS warning_days, CAST(NULL AS BIGINT) AS warning_km FROM fx_warranties
        UNION ALL SELECT asset_id, 'MAINTENANCE', rule_id, title, next_date, next_km, warning_days, warning_km FROM ({MAINT}) m WHERE is_active AND (next_date IS NOT NULL OR next_km IS NOT NULL)
        UNION ALL SELECT asset_id, 'CHECKPOINT', checkpoint_id, title, next_date, next_km, warning_days, warning_km FROM ({CHECK}) k WHERE is_active AND (next_date IS NOT NULL OR next_km IS NOT NULL)) i
      JOIN fx_assets a ON a.asset_id = i.asset_id AND NOT a.is_archived) b) c) d"""
ORDER = "priority DESC, COALESCE(LEAST(abs(remaining_days), abs(remaining_km)), 9223372036854775807), asset_id, source_id, CASE source_type WHEN 'WARRANTY' THEN 0 WHEN 'MAINTENANCE' THEN 1 ELSE 2 END"
ATT = "owner_id, asset_id, source_type, source_id, title, status, due_date, due_km, remaining_days, remaining_km, priority, message, occurrence_key"
ATTC = [c.strip() for c in ATT.split(",")]
FIRES = """CASE trigger_kind WHEN 'DAYS_BEFORE' THEN remaining_days > 0 AND remaining_days <= lead_value WHEN 'KM_BEFORE' THEN remaining_km > 0 AND remaining_km <= lead_value
  ELSE COALESCE(remaining_days <= 0, false) OR COALESCE(remaining_km <= 0, false) END"""
# Deliveries: the reminders of OWNED phones and vehicles have already gone out.
DELIVERED = f"""SELECT r.rule_id, i.occurrence_key FROM ({ATTENTION}) i JOIN fx_reminder_rules r USING (asset_id, source_type, source_id)
JOIN fx_assets s ON s.asset_id = i.asset_id WHERE s.asset_type IN ('PHONE', 'VEHICLE')"""
ELIGIBLE = f"""SELECT i.*, r.rule_id, r.trigger_kind, r.lead_value FROM ({ATTENTION}) i JOIN fx_reminder_rules r USING (asset_id, source_type, source_id)
LEFT JOIN ({DELIVERED}) d ON d.rule_id = r.rule_id AND d.occurrence_key = i.occurrence_key WHERE r.is_enabled AND d.rule_id IS NULL AND {FIRES}"""


def items_of(t):
    return A.attention(t.assets, t.warranties, t.rules, t.of_lines("fx_rule_events"), t.checkpoints, t.of_lines("fx_checkpoint_events"), AS_OF)


def delivered_of(t, items):
    seen = t.assets.filter(F.col("asset_type").isin("PHONE", "VEHICLE")).select("asset_id")
    return A.reminder_candidates(items, t.reminder_rules).join(seen, "asset_id").select("rule_id", "occurrence_key")


@query("f08_browse_assets", f"""
SELECT 'owned' AS view, a.asset_id, {LABEL} AS type_label FROM fx_assets a LEFT JOIN fx_custom_types c ON c.custom_type_id = a.custom_type_id
WHERE a.ownership_status = 'OWNED' AND a.asset_type IN ('PHONE', 'COMPUTER', 'TABLET', 'ELECTRONICS', 'APPLIANCE')
  AND (contains(lower(a.name), 'ra') OR contains(lower(a.brand), 'ra') OR contains(lower(COALESCE(a.model, '')), 'ra') OR contains(lower({LABEL}), 'ra'))
UNION ALL SELECT 'history', a.asset_id, {LABEL} FROM fx_assets a LEFT JOIN fx_custom_types c ON c.custom_type_id = a.custom_type_id WHERE a.ownership_status <> 'OWNED'""")
def _(t):
    one = A.browse_assets(t.assets, t.custom_types, False, "Electronics", " RA ").select(F.lit("owned").alias("view"), "asset_id", "type_label")
    return one.unionByName(A.browse_assets(t.assets, t.custom_types, True).select(F.lit("history").alias("view"), "asset_id", "type_label"))


@query("p01_item_type_label", f"SELECT a.asset_id, {LABEL} AS type_label FROM fx_assets a LEFT JOIN fx_custom_types c ON c.custom_type_id = a.custom_type_id")
def _(t):
    return A.item_type_label(t.assets, t.custom_types).select("asset_id", "type_label")


@query("p02_item_capabilities", """
SELECT asset_id, custom_type_id IS NULL AND asset_type = 'VEHICLE' AS has_mileage, custom_type_id IS NULL AND asset_type = 'VEHICLE' AS has_maintenance,
  custom_type_id IS NULL AND asset_type IN ('VEHICLE', 'PHONE', 'COMPUTER', 'TABLET', 'ELECTRONICS') AS has_identifiers, true AS has_warranty, true AS has_documents FROM fx_assets""")
def _(t):
    return A.item_capabilities(t.assets).select("asset_id", "has_mileage", "has_maintenance", "has_identifiers", "has_warranty", "has_documents")


@query("p06_labels", """
SELECT 'ownership' AS domain, asset_id AS id, CASE ownership_status WHEN 'OWNED' THEN 'Owned' WHEN 'SOLD' THEN 'Sold' WHEN 'GIVEN_AWAY' THEN 'Given away' END AS shown FROM fx_assets
UNION ALL SELECT 'document', document_id, CASE document_type WHEN 'RECEIPT' THEN 'Receipt' WHEN 'INVOICE' THEN 'Purchase invoice' WHEN 'WARRANTY_CARD' THEN 'Warranty card'
  WHEN 'OTHER' THEN 'Other document' ELSE 'Service receipt' END FROM fx_documents""")
def _(t):
    a = t.assets.select(F.lit("ownership").alias("domain"), F.col("asset_id").alias("id"), A.label(F.col("ownership_status"), "ownership").alias("shown"))
    return a.unionByName(t.documents.select(F.lit("document").alias("domain"), F.col("document_id").alias("id"), A.label(F.col("document_type"), "document").alias("shown")))


@query("x20_warranty_status", f"""
SELECT warranty_id, d AS remaining_days, CASE WHEN d < 0 THEN 'EXPIRED' WHEN d <= 30 THEN 'EXPIRING_SOON' ELSE 'ACTIVE' END AS warranty_state
FROM (SELECT warranty_id, date_diff('day', {NOW}, end_date) AS d FROM fx_warranties) x""")
def _(t):
    return A.warranty_status(t.warranties, AS_OF).select("warranty_id", "remaining_days", "warranty_state")


@query("x21_warranty_label", f"""
SELECT warranty_id, CASE WHEN d < 0 THEN 'Warranty expired ' || -d || ' days ago' WHEN d <= 30 THEN 'Warranty expires in ' || d || ' days' ELSE (m // 12) || ' years ' || (m % 12) || ' months remaining' END AS shown
FROM (SELECT warranty_id, date_diff('day', {NOW}, end_date) AS d, {months_between(NOW, 'end_date')} AS m FROM fx_warranties) x""")
def _(t):
    return t.warranties.select("warranty_id", A.warranty_label(F.col("end_date"), AS_OF).alias("shown"))


@query("x22_warranty_expiry", "SELECT warranty_id, CAST(CAST(start_date + to_years(CAST(years AS INTEGER)) AS DATE) + to_months(7) AS DATE) AS expiry FROM fx_warranties", dates=["expiry"])
def _(t):
    return t.warranties.select("warranty_id", A.warranty_expiry(F.col("start_date"), F.col("years"), F.lit(7)).alias("expiry"))


@query("x23_maintenance_due", f"SELECT rule_id, next_date, next_km, remaining_days, remaining_km, due_status, trigger_reason FROM ({MAINT}) m", dates=["next_date"])
def _(t):
    return A.maintenance_due(t.rules, t.of_lines("fx_rule_events"), t.assets, AS_OF).select("rule_id", "next_date", "next_km", "remaining_days", "remaining_km", "due_status", "trigger_reason")


@query("x24_checkpoint_due", f"SELECT checkpoint_id, next_date, next_km FROM ({CHECK}) c", dates=["next_date"])
def _(t):
    return A.checkpoint_due(t.checkpoints, t.of_lines("fx_checkpoint_events")).select("checkpoint_id", "next_date", "next_km")


@query("x25_attention", f"SELECT {ATT} FROM ({ATTENTION}) a", dates=["due_date"])
def _(t):
    return items_of(t).select(*ATTC)


@query("x26_rank_attention", f"""
SELECT asset_id, source_type, source_id, priority, COALESCE(LEAST(abs(remaining_days), abs(remaining_km)), 9223372036854775807) AS nearness FROM ({ATTENTION}) a""")
def _(t):
    return A.rank_attention(items_of(t)).select("asset_id", "source_type", "source_id", "priority", A.nearness().alias("nearness"))


OWN = "(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY asset_id ORDER BY created_at DESC, event_id DESC) AS r FROM fx_ownership_events) z WHERE r = 1)"


@query("x27_asset_cards", f"""
SELECT a.asset_id, a.owner_id, m.message AS attention, o.status AS last_event_status, o.effective_date
FROM fx_assets a LEFT JOIN (SELECT asset_id, message FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY asset_id ORDER BY {ORDER}) AS r FROM ({ATTENTION}) i WHERE status <> 'UPCOMING') j WHERE r = 1) m ON m.asset_id = a.asset_id
LEFT JOIN {OWN} o ON o.asset_id = a.asset_id""", dates=["effective_date"])
def _(t):
    return A.asset_cards(t.assets, items_of(t), t.of_lines("fx_ownership_events")).select("asset_id", "owner_id", "attention", "last_event_status", "effective_date")


@query("x27_attention_counts", f"""
SELECT a.owner_id, COUNT(m.asset_id) AS n_with_attention, COUNT(*) AS n_items FROM fx_assets a
LEFT JOIN (SELECT DISTINCT asset_id FROM ({ATTENTION}) i WHERE status <> 'UPCOMING') m ON m.asset_id = a.asset_id GROUP BY a.owner_id""")
def _(t):
    return A.attention_counts(A.asset_cards(t.assets, items_of(t), t.of_lines("fx_ownership_events")))


@query("x27_urgent_items", f"""
SELECT owner_id, asset_id, source_type, source_id, message, r AS position FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY owner_id ORDER BY {ORDER}) AS r FROM ({ATTENTION}) i WHERE status <> 'UPCOMING') j WHERE r <= 3""")
def _(t):
    return A.urgent_items(items_of(t)).select("owner_id", "asset_id", "source_type", "source_id", "message", "position")


@query("j10_reminder_candidates", f"SELECT i.asset_id, source_type, source_id, r.rule_id, r.trigger_kind, i.occurrence_key FROM ({ATTENTION}) i JOIN fx_reminder_rules r USING (asset_id, source_type, source_id)")
def _(t):
    return A.reminder_candidates(items_of(t), t.reminder_rules).select("asset_id", "source_type", "source_id", "rule_id", "trigger_kind", "occurrence_key")


@query("x28_eligible_reminders", f"SELECT rule_id, asset_id, source_type, source_id, occurrence_key FROM ({ELIGIBLE}) e")
def _(t):
    items = items_of(t)
    return A.eligible_reminders(items, t.reminder_rules, delivered_of(t, items)).select("rule_id", "asset_id", "source_type", "source_id", "occurrence_key")


@query("x29_reminder_batch", f"""
SELECT 'DATE' AS mode, rule_id, occurrence_key FROM ({ELIGIBLE}) e WHERE trigger_kind = 'DAYS_BEFORE' OR (trigger_kind = 'ON_DUE' AND remaining_days <= 0)
UNION ALL SELECT 'MILEAGE', rule_id, occurrence_key FROM ({ELIGIBLE}) e WHERE trigger_kind = 'KM_BEFORE' OR (trigger_kind = 'ON_DUE' AND remaining_km <= 0)""")
def _(t):
    items = items_of(t)
    sent = delivered_of(t, items)
    parts = [A.eligible_reminders(items, t.reminder_rules, sent, mode=m).select(F.lit(m).alias("mode"), "rule_id", "occurrence_key") for m in ("DATE", "MILEAGE")]
    return parts[0].unionByName(parts[1])


@query("x30_default_rules", f"""
WITH bare AS (SELECT i.* FROM ({ATTENTION}) i WHERE NOT EXISTS (SELECT 1 FROM fx_reminder_rules r WHERE r.source_type = i.source_type AND r.source_id = i.source_id))
SELECT asset_id, source_type, source_id, 'ON_DUE' AS trigger_kind, CAST(0 AS BIGINT) AS lead_value FROM bare
UNION ALL SELECT asset_id, source_type, source_id, 'DAYS_BEFORE', warning_days FROM bare WHERE source_type = 'WARRANTY' OR (warning_days > 0 AND (source_type = 'CHECKPOINT' OR due_date IS NOT NULL))
UNION ALL SELECT asset_id, source_type, source_id, 'KM_BEFORE', warning_km FROM bare WHERE source_type <> 'WARRANTY' AND warning_km > 0 AND (source_type = 'CHECKPOINT' OR due_km IS NOT NULL)""")
def _(t):
    return A.default_rules(items_of(t), t.reminder_rules)


@query("x31_linked_documents", "SELECT document_id, COUNT(*) AS n_links FROM fx_document_links GROUP BY document_id")
def _(t):
    return A.linked_documents(t.document_links)


@query("us3_missing_rules", """
SELECT a.source_type, a.source_id, a.trigger_kind, a.lead_value FROM (
  SELECT 'WARRANTY' AS source_type, warranty_id AS source_id, 'DAYS_BEFORE' AS trigger_kind, CAST(30 AS BIGINT) AS lead_value FROM fx_warranties
  UNION ALL SELECT 'WARRANTY', warranty_id, 'DAYS_BEFORE', 7 FROM fx_warranties) a
WHERE NOT EXISTS (SELECT 1 FROM fx_reminder_rules r WHERE r.source_type = a.source_type AND r.source_id = a.source_id AND r.trigger_kind = a.trigger_kind AND r.lead_value = a.lead_value)""")
def _(t):
    w = t.warranties.select(F.lit("WARRANTY").alias("source_type"), F.col("warranty_id").alias("source_id"), F.lit("DAYS_BEFORE").alias("trigger_kind"),
                            F.explode(F.array(F.lit(30).cast("long"), F.lit(7).cast("long"))).alias("lead_value"))
    return A.missing_rules(w, t.reminder_rules)


@query("w01_latest_event", f"SELECT rule_id, event_id AS last_event_id, event_date AS last_date, km AS last_km FROM {latest('fx_rule_events', 'rule_id')} e", dates=["last_date"])
def _(t):
    return A.latest_event(t.rule_events, "rule_id")


@query("w09_current_ownership", f"SELECT asset_id, status, effective_date, event_id FROM {OWN} o", dates=["effective_date"])
def _(t):
    return A.current_ownership(t.ownership_events)


@query("w10_most_urgent_rule", f"""
SELECT asset_id, kind, rule_id, due_status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY asset_id, kind ORDER BY CASE due_status WHEN 'OVERDUE' THEN 3 WHEN 'DUE' THEN 2 WHEN 'DUE_SOON' THEN 1 ELSE 0 END DESC, remaining_days NULLS LAST, rule_id) AS r
FROM ({MAINT}) m WHERE is_active) x WHERE r = 1""")
def _(t):
    return A.most_urgent_rule(A.maintenance_due(t.rules, t.of_lines("fx_rule_events"), t.assets, AS_OF)).select("asset_id", "kind", "rule_id", "due_status")


@query("w11_monotone_mileage", """
SELECT event_id, km, m AS highest_before, COALESCE(km >= 0 AND (m IS NULL OR km >= m), false) AS accepted
FROM (SELECT *, MAX(km) OVER (PARTITION BY asset_id ORDER BY event_date, created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM fx_rule_events) x""")
def _(t):
    return A.monotone_mileage(t.rule_events).select("event_id", "km", "highest_before", "accepted")


@query("j09_asset_links", f"""
SELECT l.asset_id, 'FINANCING' AS link, CAST(l.commitment_id AS VARCHAR) AS ref_id, 'Financing: ' || {egp('c.amount_minor')} || ' · ' || CAST(c.next_due_date AS VARCHAR) AS summary
FROM (SELECT asset_id, MIN(commitment_id) AS commitment_id FROM fx_commitment_links WHERE relation = 'FINANCING' GROUP BY asset_id) l JOIN fx_commitments c ON c.commitment_id = l.commitment_id
UNION ALL SELECT l.asset_id, 'COMMITMENT', CAST(l.commitment_id AS VARCHAR), c.title FROM fx_commitment_links l JOIN fx_commitments c ON c.commitment_id = l.commitment_id
UNION ALL SELECT part_id, 'PURCHASE', line_id, NULL FROM fx_lines WHERE line_no = 3""")
def _(t):
    bought = t.lines.filter(F.col("line_no") == 3).select(F.col("part_id").alias("asset_id"), F.col("line_id").alias("tx_id"), F.lit("PURCHASE").alias("relation"))
    return A.asset_links(t.assets, t.commitment_links, t.commitments, bought)


@query("j15_asset_detail", """
SELECT asset_id, 'IDENTIFIER' AS section, CAST(identifier_id AS VARCHAR) AS entry_id, value AS entry, CAST(NULL AS DATE) AS entry_date FROM fx_identifiers
UNION ALL SELECT asset_id, 'WARRANTY', CAST(warranty_id AS VARCHAR), name, end_date FROM fx_warranties
UNION ALL SELECT asset_id, 'RULE', CAST(rule_id AS VARCHAR), title, baseline_date FROM fx_rules WHERE is_active
UNION ALL SELECT asset_id, 'EVENT', event_id, CAST(km AS VARCHAR), event_date FROM fx_rule_events
UNION ALL SELECT asset_id, 'CHECKPOINT', CAST(checkpoint_id AS VARCHAR), title, due_date FROM fx_checkpoints
UNION ALL SELECT checkpoint_id, 'CHECKPOINT_EVENT', event_id, CAST(km AS VARCHAR), event_date FROM fx_checkpoint_events
UNION ALL SELECT asset_id, 'DOCUMENT', CAST(document_id AS VARCHAR), title, NULL FROM fx_documents
UNION ALL SELECT asset_id, 'OWNERSHIP', event_id, status, effective_date FROM fx_ownership_events
UNION ALL SELECT asset_id, 'COMMITMENT', CAST(commitment_id AS VARCHAR), relation, NULL FROM fx_commitment_links""", dates=["entry_date"])
def _(t):
    cp = t.checkpoint_events.withColumn("asset_id", F.col("checkpoint_id"))
    return A.asset_detail({
        "IDENTIFIER": (t.identifiers, "identifier_id", "value", None), "WARRANTY": (t.warranties, "warranty_id", "name", "end_date"),
        "RULE": (t.rules.filter("is_active"), "rule_id", "title", "baseline_date"), "EVENT": (t.rule_events, "event_id", "km", "event_date"),
        "CHECKPOINT": (t.checkpoints, "checkpoint_id", "title", "due_date"), "CHECKPOINT_EVENT": (cp, "event_id", "km", "event_date"),
        "DOCUMENT": (t.documents, "document_id", "title", None), "OWNERSHIP": (t.ownership_events, "event_id", "status", "effective_date"),
        "COMMITMENT": (t.commitment_links, "commitment_id", "relation", None),
    })


@query("j16_maintenance_history", """
SELECT e.event_id, e.event_date, e.km, COALESCE(d.n, 0) AS n_documents, e.linked_tx_id IS NOT NULL AS has_expense
FROM fx_rule_events e LEFT JOIN (SELECT l.event_id, COUNT(*) AS n FROM fx_document_links l JOIN fx_documents d ON d.document_id = l.document_id GROUP BY l.event_id) d ON d.event_id = e.event_id""", dates=["event_date"])
def _(t):
    return A.maintenance_history(t.rule_events, t.document_links, t.documents).select("event_id", "event_date", "km", "n_documents", "has_expense")
