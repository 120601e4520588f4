"""Items: warranties, maintenance, checkpoints, the attention list and reminders."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import dates, money, text
from tallyspark.operators.ledger import OWNER
from tallyspark.plans import keyed

# Display texts that are not the plain capitalised enum name.
TYPE_LABELS = {"COMPUTER": "Laptop / Computer"}
DOCUMENT_LABELS = {
    "RECEIPT": "Receipt",
    "INVOICE": "Purchase invoice",
    "WARRANTY_CARD": "Warranty card",
    "PURCHASE_CONTRACT": "Purchase contract",
    "OTHER": "Other document",
}
LABELS: dict[str, dict[str, str]] = {"ownership": {}, "document": DOCUMENT_LABELS, "item_type": TYPE_LABELS}
# Item classes of the browse screen and of the identifier capability.
BUCKETS = {
    "Vehicles": ["VEHICLE"],
    "Electronics": ["PHONE", "COMPUTER", "TABLET", "ELECTRONICS", "APPLIANCE"],
    "Other": ["OTHER"],
}
WITH_IDENTIFIERS = ["PHONE", "COMPUTER", "TABLET", "ELECTRONICS"]
# Severity order of maintenance states and attention states.
DUE_ORDER = ["OK", "DUE_SOON", "DUE", "OVERDUE"]
ATTENTION_ORDER = ["UPCOMING", "DUE_SOON", "DUE", "OVERDUE"]
SOURCES = ["WARRANTY", "MAINTENANCE", "CHECKPOINT"]


def _ordinal(c: Column, names: Sequence[str]) -> Column:
    return F.when(c.isNotNull(), F.array_position(F.array(*[F.lit(n) for n in names]), c).cast("int") - 1)


def label(c: Column, domain: str) -> Column:
    """Display text of an enum value: a fixed text or the capitalised words."""
    words = F.replace(F.lower(c), F.lit("_"), F.lit(" "))
    out = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))
    for value, shown in LABELS[domain].items():
        out = F.when(c == value, F.lit(shown)).otherwise(out)
    return out


def item_type_label(assets: DataFrame, custom: DataFrame) -> DataFrame:
    """``type_label``: the custom type's name, else the built-in label."""
    names = custom.select("custom_type_id", F.col("name").alias("__custom"))
    plain = F.concat(F.substring("asset_type", 1, 1), F.lower(F.expr("substring(asset_type, 2)")))
    built_in = F.when(F.col("asset_type") == "COMPUTER", F.lit(TYPE_LABELS["COMPUTER"])).otherwise(plain)
    return assets.join(names, "custom_type_id", "left").withColumn("type_label", F.coalesce("__custom", built_in)).drop("__custom")


def item_capabilities(assets: DataFrame) -> DataFrame:
    """Which sections an item has; custom types only keep warranty and documents."""
    plain = F.col("custom_type_id").isNull()
    vehicle = plain & (F.col("asset_type") == "VEHICLE")
    return assets.withColumns({
        "has_mileage": vehicle,
        "has_maintenance": vehicle,
        "has_identifiers": vehicle | (plain & F.col("asset_type").isin(WITH_IDENTIFIERS)),
        "has_warranty": F.lit(True),
        "has_documents": F.lit(True),
    })


def browse_assets(assets: DataFrame, custom: DataFrame, history: bool, bucket: str = "All", query: str = "") -> DataFrame:
    """Owned items or history, one class bucket, and a case-insensitive search."""
    owned = F.col("ownership_status") == "OWNED"
    rows = assets.filter(~owned if history else owned)
    if bucket in BUCKETS:
        rows = rows.filter(F.col("asset_type").isin(BUCKETS[bucket]))
    rows = item_type_label(rows, custom)
    needle = query.strip().lower()
    if needle:
        hit = F.lit(False)
        for c in ("name", "brand", "model", "type_label"):
            hit = hit | F.coalesce(F.lower(c).contains(needle), F.lit(False))
        rows = rows.filter(hit)
    return rows


# --- due points --------------------------------------------------------------


def warranty_expiry(start: Column, years: Column, months: Column) -> Column:
    return F.add_months(F.add_months(start, years * 12), months)


def warranty_status(w: DataFrame, as_of: dt.date, soon: int = 30) -> DataFrame:
    days = F.datediff("end_date", F.lit(as_of))
    state = F.when(days < 0, "EXPIRED").when(days <= soon, "EXPIRING_SOON").otherwise("ACTIVE")
    return w.withColumn("remaining_days", days).withColumn("warranty_state", state)


def warranty_label(end: Column, as_of: dt.date) -> Column:
    days = F.datediff(end, F.lit(as_of))
    whole = dates.whole_months(F.lit(as_of), end)
    return (
        F.when(days < 0, F.concat(F.lit("Warranty expired "), (-days).cast("string"), F.lit(" days ago")))
        .when(days <= 30, F.concat(F.lit("Warranty expires in "), days.cast("string"), F.lit(" days")))
        .otherwise(F.concat(F.floor(whole / 12).cast("string"), F.lit(" years "), (whole % 12).cast("string"), F.lit(" months remaining")))
    )


def latest_event(events: DataFrame, key: str) -> DataFrame:
    """Newest event per key by (event date, created, id), combined before the shuffle."""
    newest = F.max(F.struct("event_date", "created_at", "event_id", "km"))
    return events.filter(F.col(key).isNotNull()).groupBy(key).agg(newest.alias("__e")).select(
        key, F.col("__e.event_id").alias("last_event_id"), F.col("__e.event_date").alias("last_date"), F.col("__e.km").alias("last_km")
    )


def _component(remaining: Column, warning: Column) -> Column:
    return (
        F.when(remaining.isNull(), F.lit(None).cast("string")).when(remaining < 0, "OVERDUE").when(remaining == 0, "DUE")
        .when(remaining <= warning, "DUE_SOON").otherwise("OK")
    )


def maintenance_due(rules: DataFrame, events: DataFrame, assets: DataFrame, as_of: dt.date) -> DataFrame:
    """Next date and mileage, what remains, the status and what triggers it.

    The status looks at the relevant triggers only, the reason at both.
    """
    j = rules.join(latest_event(events, "rule_id"), "rule_id", "left").join(
        assets.select("asset_id", OWNER, "current_km", "is_archived"), "asset_id", "left"
    )
    trigger = F.col("trigger_type")
    base_date = F.coalesce("last_date", "baseline_date")
    base_km = F.coalesce("last_km", "baseline_km")
    j = j.withColumns({
        "next_date": F.when(trigger != "MILEAGE", F.add_months(base_date, F.col("interval_months"))),
        "next_km": F.when(trigger != "TIME", base_km + F.col("interval_km")),
    })
    j = j.withColumns({
        "remaining_days": F.datediff("next_date", F.lit(as_of)).cast("long"),
        "remaining_km": F.col("next_km") - F.col("current_km"),
    })
    time = _component(F.col("remaining_days"), F.col("warning_days"))
    km = _component(F.col("remaining_km"), F.col("warning_km"))
    t = F.coalesce(_ordinal(time, DUE_ORDER), F.lit(-1))
    m = F.coalesce(_ordinal(km, DUE_ORDER), F.lit(-1))
    worst = F.when(trigger == "TIME", t).when(trigger == "MILEAGE", m).otherwise(F.greatest(t, m))
    status = F.element_at(F.array(*[F.lit(x) for x in DUE_ORDER]), F.greatest(worst, F.lit(0)) + 1)
    reason = (
        F.when((t < 0) & (m < 0), "UNKNOWN").when((t == m) & (t >= 1), "BOTH").when(t >= m, "TIME").otherwise("MILEAGE")
    )
    return j.withColumn("due_status", status).withColumn("trigger_reason", reason)


def checkpoint_due(checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    """Next occurrence: own due point, or the repeating parts after an event; reschedules win."""
    j = checkpoints.join(latest_event(events, "checkpoint_id"), "checkpoint_id", "left")
    done = F.col("last_event_id").isNotNull()
    date = F.when(done, F.add_months(F.col("last_date"), F.col("repeat_months"))).otherwise(F.col("due_date"))
    km = F.when(done, F.col("last_km") + F.col("repeat_km")).otherwise(F.col("due_km"))
    return j.withColumn("next_date", F.coalesce("rescheduled_date", date)).withColumn("next_km", F.coalesce("rescheduled_km", km))


# --- attention ---------------------------------------------------------------


def attention(
    assets: DataFrame, warranties: DataFrame, rules: DataFrame, events: DataFrame,
    checkpoints: DataFrame, checkpoint_events: DataFrame, as_of: dt.date,
) -> DataFrame:
    """One row per warranty, active rule and active checkpoint with a due point, with status and message."""
    live = assets.filter(~F.col("is_archived")).select("asset_id", OWNER, "current_km")
    days = lambda c: F.col(c).cast("long")
    none_long = F.lit(None).cast("bigint")
    from_warranty = warranties.select(
        "asset_id", F.lit("WARRANTY").alias("source_type"), F.col("warranty_id").alias("source_id"), F.col("name").alias("title"),
        F.col("end_date").alias("due_date"), none_long.alias("due_km"), F.lit(30).cast("long").alias("warning_days"), none_long.alias("warning_km"),
    )
    due = maintenance_due(rules.filter(F.col("is_active")), events, assets, as_of)
    from_rules = due.filter(F.col("next_date").isNotNull() | F.col("next_km").isNotNull()).select(
        "asset_id", F.lit("MAINTENANCE").alias("source_type"), F.col("rule_id").alias("source_id"), "title",
        F.col("next_date").alias("due_date"), F.col("next_km").alias("due_km"), days("warning_days").alias("warning_days"), "warning_km",
    )
    nxt = checkpoint_due(checkpoints.filter(F.col("is_active")), checkpoint_events)
    from_checkpoints = nxt.filter(F.col("next_date").isNotNull() | F.col("next_km").isNotNull()).select(
        "asset_id", F.lit("CHECKPOINT").alias("source_type"), F.col("checkpoint_id").alias("source_id"), "title",
        F.col("next_date").alias("due_date"), F.col("next_km").alias("due_km"), days("warning_days").alias("warning_days"), "warning_km",
    )
    items = from_warranty.unionByName(from_rules).unionByName(from_checkpoints).join(live, "asset_id")
    return described(items, as_of)


def described(items: DataFrame, as_of: dt.date) -> DataFrame:
    """Status, priority, message and occurrence of items with a due point, as of a day."""

    def status(remaining: Column, warning: Column) -> Column:
        soon = warning.isNotNull() & (remaining <= warning)
        return F.when(remaining.isNull(), F.lit(None).cast("int")).when(remaining < 0, 4).when(remaining == 0, 3).when(soon, 2).otherwise(1)

    x = items.withColumns({
        "remaining_days": F.datediff("due_date", F.lit(as_of)).cast("long"),
        "remaining_km": F.col("due_km") - F.col("current_km"),
    })
    d, k = F.col("remaining_days"), F.col("remaining_km")
    x = x.withColumns({"__d": status(d, F.col("warning_days")), "__k": status(k, F.col("warning_km"))})
    by_km = (F.col("__k").isNotNull() & (F.col("__k") > F.coalesce("__d", F.lit(1)))) | d.isNull()
    x = x.withColumns({
        "priority": F.coalesce(F.greatest("__d", "__k"), F.lit(1)),
        "__left": F.when(by_km, k).otherwise(d),
        "__unit": F.when(by_km, F.lit("km")).otherwise(F.lit("days")),
    })
    left, title = F.col("__left"), F.col("title")
    size = F.abs(left).cast("string")
    warranty = F.col("source_type") == "WARRANTY"
    message = (
        F.when(left.isNull(), F.lit("Due point set; update mileage to check progress"))
        .when(warranty & (left < 0), F.concat(title, F.lit(" expired "), size, F.lit(" days ago")))
        .when(warranty & (left == 0), F.concat(title, F.lit(" expires today")))
        .when(warranty, F.concat(title, F.lit(" expires in "), size, F.lit(" days")))
        .when(left < 0, F.concat(title, F.lit(" overdue by "), size, F.lit(" "), F.col("__unit")))
        .when(left == 0, F.concat(title, F.lit(" due now")))
        .otherwise(F.concat(title, F.lit(" due in "), size, F.lit(" "), F.col("__unit")))
    )
    states = F.array(*[F.lit(s) for s in ATTENTION_ORDER])
    return x.withColumns({
        "status": F.element_at(states, F.col("priority")),
        "message": message,
        "occurrence_key": text.occurrence_key(F.col("due_date"), F.col("due_km")),
    }).drop("__d", "__k", "__left", "__unit")


def nearness() -> Column:
    """Distance to the nearer due point; the largest long when there is none."""
    return F.coalesce(F.least(F.abs("remaining_days"), F.abs("remaining_km")), F.lit(9223372036854775807))


def attention_order() -> list[Column]:
    return [F.desc("priority"), nearness().asc(), F.asc("asset_id"), F.asc("source_id"), _ordinal(F.col("source_type"), SOURCES).asc()]


def rank_attention(items: DataFrame) -> DataFrame:
    """Most urgent first (range sort over the whole list)."""
    return items.orderBy(*attention_order())


def urgent_items(items: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most urgent items of each owner that are not merely upcoming."""
    return keyed.top_per_key(items.filter(F.col("status") != "UPCOMING"), [OWNER], attention_order(), k, rank="position")


def asset_cards(assets: DataFrame, items: DataFrame, ownership_events: DataFrame) -> DataFrame:
    """Each item with its most urgent message and latest ownership event."""
    first = F.min(F.struct((-F.col("priority")).alias("p"), nearness().alias("n"), F.col("source_id"),
                           _ordinal(F.col("source_type"), SOURCES).alias("s"), F.col("message")))
    top = items.filter(F.col("status") != "UPCOMING").groupBy("asset_id").agg(first.alias("__m")).select(
        "asset_id", F.col("__m.message").alias("attention")
    )
    owned = current_ownership(ownership_events).select("asset_id", F.col("status").alias("last_event_status"), "effective_date")
    return assets.join(top, "asset_id", "left").join(owned, "asset_id", "left")


def attention_counts(cards: DataFrame) -> DataFrame:
    return cards.groupBy(OWNER).agg(F.count("attention").alias("n_with_attention"), F.count("*").alias("n_items"))


# --- reminders ---------------------------------------------------------------


def reminder_candidates(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Attention items paired with the rules of the same item and source."""
    return items.join(
        rules.select("rule_id", "asset_id", "source_type", "source_id", "trigger_kind", "lead_value", "is_enabled"),
        ["asset_id", "source_type", "source_id"],
    )


def _fires() -> Column:
    d, k, lead = F.col("remaining_days"), F.col("remaining_km"), F.col("lead_value")
    before_d, before_k = (d > 0) & (d <= lead), (k > 0) & (k <= lead)
    due = F.coalesce(d <= 0, F.lit(False)) | F.coalesce(k <= 0, F.lit(False))
    kind = F.col("trigger_kind")
    return F.coalesce(F.when(kind == "DAYS_BEFORE", before_d).when(kind == "KM_BEFORE", before_k).otherwise(due), F.lit(False))


def eligible_reminders(items: DataFrame, rules: DataFrame, deliveries: DataFrame, enabled: bool = True, mode: str | None = None) -> DataFrame:
    """Reminders to send now: enabled, firing, and not delivered for this occurrence.

    ``mode`` DATE or MILEAGE restricts the rules to one kind of evaluation.
    """
    pairs = reminder_candidates(items, rules.filter(F.col("is_enabled") & F.lit(enabled))).filter(_fires())
    if mode:
        kind, d, k = F.col("trigger_kind"), F.col("remaining_days"), F.col("remaining_km")
        keep = {
            "DATE": (kind == "DAYS_BEFORE") | ((kind == "ON_DUE") & F.coalesce(d <= 0, F.lit(False))),
            "MILEAGE": (kind == "KM_BEFORE") | ((kind == "ON_DUE") & F.coalesce(k <= 0, F.lit(False))),
        }[mode]
        pairs = pairs.filter(keep)
    return pairs.join(deliveries.select("rule_id", "occurrence_key"), ["rule_id", "occurrence_key"], "left_anti")


def default_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules for sources that have none: their own warnings, and always ON_DUE."""
    bare = items.join(rules.select("source_type", "source_id").distinct(), ["source_type", "source_id"], "left_anti")
    rule = lambda kind, lead: F.struct(F.lit(kind).alias("trigger_kind"), lead.cast("long").alias("lead_value"))
    src, days, km = F.col("source_type"), F.col("warning_days"), F.col("warning_km")
    maintained = src == "MAINTENANCE"
    by_days = F.when((src == "WARRANTY") | ((days > 0) & (~maintained | F.col("due_date").isNotNull())), rule("DAYS_BEFORE", days))
    by_km = F.when((src != "WARRANTY") & (km > 0) & (~maintained | F.col("due_km").isNotNull()), rule("KM_BEFORE", km))
    made = F.filter(F.array(by_days, by_km, rule("ON_DUE", F.lit(0))), lambda r: r.isNotNull())
    return bare.select("asset_id", "source_type", "source_id", F.explode(made).alias("r")).select("asset_id", "source_type", "source_id", "r.*")


def missing_rules(available: DataFrame, rules: DataFrame) -> DataFrame:
    """Available (kind, lead) options a source has no rule for."""
    return available.join(rules, ["source_type", "source_id", "trigger_kind", "lead_value"], "left_anti")


# --- history and bundles -----------------------------------------------------


def current_ownership(events: DataFrame) -> DataFrame:
    newest = F.max(F.struct("created_at", "event_id", "status", "effective_date"))
    return events.groupBy("asset_id").agg(newest.alias("__e")).select(
        "asset_id", F.col("__e.status").alias("status"), F.col("__e.effective_date").alias("effective_date"), F.col("__e.event_id").alias("event_id")
    )


def most_urgent_rule(due: DataFrame) -> DataFrame:
    """Per (item, kind) the active rule with the worst status, then the fewest days left."""
    order = [_ordinal(F.col("due_status"), DUE_ORDER).desc(), F.asc_nulls_last("remaining_days"), F.asc("rule_id")]
    return keyed.top_per_key(due.filter(F.col("is_active")), ["asset_id", "kind"], order, 1)


def monotone_mileage(readings: DataFrame) -> DataFrame:
    """Readings with ``accepted``: not negative and not below any earlier reading of the item."""
    order = [F.asc("created_at"), F.asc("event_id")]
    out = keyed.prefix_before(readings, ["asset_id"], "event_date", order, F.when(F.col("km") >= 0, F.col("km")), "highest_before")
    ok = (F.col("km") >= 0) & (F.col("highest_before").isNull() | (F.col("km") >= F.col("highest_before")))
    return out.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def linked_documents(links: DataFrame) -> DataFrame:
    """Documents attached to maintenance history, which must not be deleted."""
    return links.groupBy("document_id").agg(F.count("*").alias("n_links"))


def maintenance_history(events: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """Events newest first with their number of documents and whether an expense is linked."""
    per_event = links.join(documents.select("document_id"), "document_id").groupBy("event_id").agg(F.count("*").alias("n_documents"))
    out = events.join(per_event, "event_id", "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0).cast("long")))
    out = out.withColumn("has_expense", F.col("linked_tx_id").isNotNull())
    return out.orderBy(F.desc("event_date"), F.desc("created_at"), "event_id")


def asset_links(assets: DataFrame, commitment_links: DataFrame, commitments: DataFrame, tx_links: DataFrame) -> DataFrame:
    """Long list of an item's links: FINANCING (first of them, summarised), COMMITMENT and PURCHASE."""
    c = commitments.select("commitment_id", "title", "amount_minor", "next_due_date")
    with_c = commitment_links.join(c, "commitment_id")
    shown = F.concat(F.lit("Financing: "), money.format_minor(F.col("amount_minor")), F.lit(" · "), F.col("next_due_date").cast("string"))
    first = commitment_links.filter(F.col("relation") == "FINANCING").groupBy("asset_id").agg(F.min("commitment_id").alias("commitment_id"))
    financing = first.join(c, "commitment_id").select(
        "asset_id", F.lit("FINANCING").alias("link"), F.col("commitment_id").cast("string").alias("ref_id"), shown.alias("summary"))
    linked = with_c.select("asset_id", F.lit("COMMITMENT").alias("link"), F.col("commitment_id").cast("string").alias("ref_id"), F.col("title").alias("summary"))
    bought = tx_links.filter(F.col("relation") == "PURCHASE").select(
        "asset_id", F.lit("PURCHASE").alias("link"), F.col("tx_id").alias("ref_id"), F.lit(None).cast("string").alias("summary"))
    return financing.unionByName(linked).unionByName(bought).join(assets.select("asset_id"), "asset_id", "left_semi")


def asset_detail(sections: dict[str, tuple[DataFrame, str, str, str | None]]) -> DataFrame:
    """Everything known about each item, as one long frame.

    ``sections`` maps a section name to (frame, id column, text column, date
    column). Long rows replace nested lists, so an item with a huge history is
    never gathered into one value; callers filter on ``asset_id``.
    """
    out = None
    for name, (df, key, shown, date) in sections.items():
        part = df.select(
            "asset_id", F.lit(name).alias("section"), F.col(key).cast("string").alias("entry_id"),
            F.col(shown).cast("string").alias("entry"), (F.col(date) if date else F.lit(None)).cast("date").alias("entry_date"),
        )
        out = part if out is None else out.unionByName(part)
    return out
