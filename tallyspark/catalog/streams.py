"""Streaming queries: each runs its stream to the end and returns the sink."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.catalog.assets import ATTENTION, FIRES, items_of
from tallyspark.catalog.obligations import occ_of
from tallyspark.catalog.registry import query
from tallyspark.operators import assets as A
from tallyspark.operators import ledger as L
from tallyspark.operators import obligations as O
from tallyspark.plans.session import work_folder
from tallyspark.sources.fixtures import AS_OF
from tallyspark.streaming import calendar
from tallyspark.streaming import jobs as J


def category():
    kind = F.col("event_type")
    return F.when(kind == "click", 1).when(kind == "view", 2).when(kind == "purchase", 3).when(kind == "signup", 4).otherwise(5).cast("long")


# Events arrive in four deliveries by day; every tenth comes three days after its time, some of them after their day was closed.
ARRIVED = """SELECT user_id AS owner_id, event_id % 7 AS category_id, ts, CAST(ts AS DATE) AS day, CAST(ROUND(value * 100) AS BIGINT) AS amount_minor,
  least(3, (date_diff('day', (SELECT CAST(MIN(ts) AS DATE) FROM events), CAST(ts AS DATE)) + CASE WHEN event_id % 10 = 0 THEN 3 ELSE 0 END) // 8) AS delivery FROM events WHERE event_type = 'purchase'"""


@query("st01_stream_spend", f"""
WITH e AS ({ARRIVED}), w AS (SELECT delivery, MAX(MAX(ts)) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e GROUP BY delivery),
 m AS (SELECT e.*, COALESCE(day + INTERVAL 1 DAY <= seen - INTERVAL 1 DAY, FALSE) AS late FROM e JOIN w USING (delivery))
SELECT part, owner_id, category_id, period, CAST(SUM(amount_minor) AS BIGINT) AS amount_minor, COUNT(*) AS n_rows FROM (
  SELECT CASE WHEN late THEN 'late' ELSE 'day' END AS part, owner_id, category_id, day AS period, amount_minor FROM m
  UNION ALL SELECT 'month', owner_id, category_id, CAST(date_trunc('month', day) AS DATE), amount_minor FROM m WHERE NOT late) x GROUP BY ALL""", dates=["period"])
def _(t):
    """Totals of every day and month after four deliveries, open ones too, and the rows that came too late by day."""
    base = work_folder(t.spark, "spend")
    events = t.raw("events")
    began = events.agg(F.min("ts").cast("date")).first()[0]
    delay = F.when(F.col("event_id") % 10 == 0, 3).otherwise(0)
    delivery = F.least(F.lit(3), F.floor((F.date_diff(F.col("ts").cast("date"), F.lit(began)) + delay) / 8))
    for k in range(4):
        events.filter(delivery == k).write.mode("append").parquet(f"{base}/in")
        arriving = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{base}/in")
        J.stream_spend(J.ledger_stream(arriving), f"{base}/out", f"{base}/ck").awaitTermination()
    late = J.read_late(t.spark, f"{base}/out").groupBy("owner_id", "category_id", F.to_date("ts").alias("period")).agg(F.sum("amount_minor").alias("amount_minor"), F.count("*").alias("n_rows"))
    parts = [J.read_spend(t.spark, f"{base}/out", g).withColumnRenamed(g, "period").withColumn("part", F.lit(g)) for g in J.GRAINS]
    return parts[0].unionByName(parts[1]).unionByName(late.withColumn("part", F.lit("late"))).select("part", "owner_id", "category_id", "period", "amount_minor", "n_rows")


PAY = "event_id BIGINT, idempotency_key STRING, ts TIMESTAMP, amount_minor BIGINT"


def in_deliveries(t, base, start, parts=3):
    """The events in ``parts`` deliveries by id, ``start(stream)`` run to its end after each."""
    events = t.raw("events")
    for k in range(parts):
        events.filter(F.floor(F.col("event_id") / 64) % parts == k).write.mode("append").parquet(f"{base}/in")
        start(t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{base}/in")).awaitTermination()


@query("st02_stream_payments", "SELECT CAST(user_id AS VARCHAR) || ':' || CAST(CAST(ROUND(value) AS BIGINT) AS VARCHAR) AS idempotency_key, COUNT(*) > 0 AS recorded FROM events GROUP BY ALL")
def _(t):
    """Keys that come again in the same delivery and in later ones, each recorded once."""
    base = work_folder(t.spark, "payments")
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.round("value").cast("long").cast("string"))
    in_deliveries(t, base, lambda events: J.stream_payments(events.select(
        "event_id", key.alias("idempotency_key"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("amount_minor")), f"{base}/sink", f"{base}/ck", PAY))
    return J.read_versions(t.spark, f"{base}/sink", PAY).groupBy("idempotency_key").agg((F.count("*") == 1).alias("recorded"))


@query("st03_stream_merchant_use", """
SELECT owner_id, lower(shown) AS normalized_name, arg_max(shown, event_id) AS display_name, COUNT(*) AS usage_count, MAX(event_id) AS last_used_at, arg_max(c, event_id) AS default_category_id FROM (
  SELECT CAST(user_id AS BIGINT) AS owner_id, 'Shop ' || (CAST(ROUND(value) AS BIGINT) % 50) AS shown, event_id,
    CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS c FROM events) x GROUP BY owner_id, lower(shown)""")
def _(t):
    base = work_folder(t.spark, "uses")
    in_deliveries(t, base, lambda events: J.stream_merchant_use(events.select(
        F.col("user_id").cast("long").alias("owner_id"), F.concat(F.lit(" Shop  "), (F.round("value").cast("long") % 50).cast("string")).alias("merchant_name"), category().alias("category_id"),
        F.col("event_id").alias("used_at"), F.col("event_id").alias("seq")), f"{base}/out", f"{base}/ck"))
    return J.read_latest(t.spark, f"{base}/out", J.MERCHANT_STATE, J.MERCHANT_KEYS).select("owner_id", "normalized_name", "display_name", "usage_count", "last_used_at", "default_category_id")


@query("st04_stream_confirmations", """
WITH steps AS (SELECT owner_id, normalized_item, m AS normalized_merchant, category_id, event_id AS seq, event_id // 64 % 3 AS d FROM (SELECT *, unnest(CASE WHEN normalized_merchant IS NULL THEN [NULL] ELSE [NULL, normalized_merchant] END) AS m FROM fx_confirms) u),
 marked AS (SELECT *, CASE WHEN category_id IS DISTINCT FROM LAG(category_id) OVER (PARTITION BY owner_id, normalized_item, normalized_merchant ORDER BY d, seq) THEN 1 ELSE 0 END AS chg FROM steps),
 runs AS (SELECT *, SUM(chg) OVER (PARTITION BY owner_id, normalized_item, normalized_merchant ORDER BY d, seq) AS run, SUM(chg) OVER (PARTITION BY owner_id, normalized_item, normalized_merchant) AS last_run FROM marked)
SELECT owner_id, normalized_item, normalized_merchant, CAST(MAX(category_id) FILTER (run = last_run) AS BIGINT) AS category_id, COUNT(*) FILTER (run = last_run) AS confirmation_count,
  arg_min(seq, d * 1000000000000 + seq) AS created_at, arg_max(seq, d * 1000000000000 + seq) AS updated_at FROM runs GROUP BY owner_id, normalized_item, normalized_merchant""")
def _(t):
    """Three deliveries; within one the commands are put in order, a later delivery counts as later."""
    base = work_folder(t.spark, "confirmations")
    in_deliveries(t, base, lambda events: J.stream_confirmations(events.select(
        F.col("user_id").alias("owner_id"), F.concat(F.lit("item"), (F.round("value").cast("long") % 10).cast("string")).alias("normalized_item"),
        F.when(F.col("user_id") % 2 == 0, F.lit("shop")).alias("normalized_merchant"), category().alias("category_id"), F.col("event_id").alias("ts"), F.col("event_id").alias("seq")), f"{base}/out", f"{base}/ck"))
    return J.read_latest(t.spark, f"{base}/out", J.MAPPING_STATE, J.MAPPING_KEYS)


@query("st05_stream_reminders", f"SELECT DISTINCT r.rule_id, i.occurrence_key FROM ({ATTENTION}) i JOIN fx_reminder_rules r USING (asset_id, source_type, source_id) WHERE r.is_enabled AND {FIRES}")
def _(t):
    """Ticks over the attention list; each reminder is recorded once."""
    base = work_folder(t.spark, "reminders")
    J.stream_reminders(J.events_stream(t.spark, t.folder), lambda spark, sent: A.eligible_reminders(items_of(t), t.reminder_rules, sent), f"{base}/outbox", f"{base}/ck").awaitTermination()
    return J.read_versions(t.spark, f"{base}/outbox/recorded", J.REMINDERS)


@query("st06_run_daily", """
SELECT asset_id, warranty_state FROM (SELECT asset_id, CASE WHEN d < 0 THEN 'EXPIRED' WHEN d <= 30 THEN 'EXPIRING_SOON' ELSE 'ACTIVE' END AS warranty_state FROM (SELECT asset_id, date_diff('day', DATE '1998-06-15', end_date) AS d FROM fx_warranties) x) y""")
def _(t):
    """The daily jobs written for one date; the warranty states are read back."""
    base = work_folder(t.spark, "daily")
    done = J.run_daily(AS_OF, {
        "warranties": lambda d: A.warranty_status(t.warranties, d).select("asset_id", "warranty_state"),
        "overdue": lambda d: O.overdue(occ_of(t), d).select("owner_id", "commitment_id", "due_date", "amount_minor"),
        "spend": lambda d: L.period_totals(t.tx, d.replace(day=1), d),
    }, base)
    return t.spark.read.schema("asset_id BIGINT, warranty_state STRING").parquet(done["warranties"])


@query("st06_due_calendar", f"SELECT asset_id, source_type, source_id, status, occurrence_key FROM ({ATTENTION}) a")
def _(t):
    """The attention list after a first full tick sixty days before and two that follow the calendar."""
    base = work_folder(t.spark, "calendar")

    def evaluate(touched, as_of):
        return A.attention(t.assets.join(touched, "asset_id", "left_semi"), t.warranties, t.rules, t.of_lines("fx_rule_events"), t.checkpoints, t.of_lines("fx_checkpoint_events"), as_of)

    for days, some in ((60, t.assets), (31, t.assets.limit(0)), (0, t.assets.limit(0))):
        calendar.tick(t.spark, base, AS_OF - dt.timedelta(days=days), some, evaluate)
    return calendar.attention_list(t.spark, base).select("asset_id", "source_type", "source_id", "status", "occurrence_key")
