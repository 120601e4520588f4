"""Filters, joins and aggregations over the transactions table.

All aggregations are keyed by ``owner_id`` and use partial aggregation, so an
owner with most of the ledger costs one partial row per task and group.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import dates, money
from tallyspark.plans import keyed

OWNER = "owner_id"
UNCATEGORIZED = "Uncategorized"


def zero_sum(amount: Column, when: Column | None = None) -> Column:
    picked = F.when(when, amount) if when is not None else amount
    return F.coalesce(F.sum(picked), F.lit(0).cast("long"))


# --- filters and projections -------------------------------------------------


def _within(day: Column, start: dt.date | None, end: dt.date | None) -> Column:
    cond = F.lit(True)
    if start is not None:
        cond = cond & (day >= F.lit(start))
    if end is not None:
        cond = cond & (day < F.lit(end))
    return cond


def transactions_between(tx: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    """Rows with ``start <= tx_date < end``; a missing bound is open."""
    return tx.filter(_within(F.col("tx_date"), start, end))


def expenses_between(tx: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    return transactions_between(tx.filter(F.col("type") == "EXPENSE"), start, end)


def filter_type(tx: DataFrame, kind: str) -> DataFrame:
    """ALL, EXPENSES or INCOME."""
    wanted = {"ALL": None, "EXPENSES": "EXPENSE", "INCOME": "INCOME"}[kind]
    return tx if wanted is None else tx.filter(F.col("type") == wanted)


def active(df: DataFrame, archived: str = "is_archived", flag: str | None = None) -> DataFrame:
    """Rows not archived, or with the active ``flag`` set."""
    return df.filter(F.col(flag)) if flag else df.filter(~F.col(archived))


def purchase_prefill(tx: DataFrame) -> DataFrame:
    """Expenses outside any split purchase, as candidates for a new item."""
    return tx.filter((F.col("type") == "EXPENSE") & F.col("purchase_group_id").isNull()).select(
        OWNER, "tx_id", F.col("tx_date").alias("purchase_date"), "amount_minor", "merchant_id", "merchant", "category_id"
    )


def selectable_categories(items: DataFrame, cats: DataFrame, item_key: str = "asset_id") -> DataFrame:
    """(item, category) choices: every active category plus the item's own, even archived.

    The catalog's active ids are packed into one row and attached by a salted
    equality, so the item table is neither shuffled nor crossed.
    """
    packed = cats.filter(~F.col("is_archived")).agg(F.collect_set("category_id").alias("__active"))
    attached = keyed.attach_catalog(items.select(item_key, "category_id"), packed, item_key)
    own = cats.select(F.col("category_id").alias("__own"), F.lit(True).alias("__exists"))
    joined = attached.join(own, F.col("category_id") == F.col("__own"), "left")
    extra = F.when(F.col("__exists"), F.array("category_id")).otherwise(F.array().cast("array<bigint>"))
    return joined.select(
        item_key, F.explode(F.array_union("__active", extra)).alias("selectable_id")
    )


#: Wanted keys that are broadcast as they are (some 50 bytes each).
LOOKUP_KEYS = 200_000
#: Bits of the filter for more keys, in pages of 4 KB: 32 MB on every executor, whatever the number of keys.
LOOKUP_BITS = 1 << 28
PAGE_BITS = 32_768


def key_filter(keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(page, bits): a bitmap of the keys' hashes, at most ``LOOKUP_BITS`` bits in pages; pages without keys are left out."""
    place = F.pmod(F.xxhash64(*columns), F.lit(LOOKUP_BITS))
    x = keys.select(F.floor(place / PAGE_BITS).alias("page"), (place % PAGE_BITS).alias("bit"))
    return x.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))


def maybe_wanted(df: DataFrame, pages: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows whose key may be in the filter, found where they are read: no shuffle, no wanted row is lost."""
    place = F.pmod(F.xxhash64(*columns), F.lit(LOOKUP_BITS))
    x = df.withColumn("__page", F.floor(place / PAGE_BITS)).withColumn("__bit", (place % PAGE_BITS).cast("int"))
    p = F.broadcast(pages.select(F.col("page").alias("__page"), F.col("bits").alias("__bits")))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(F.col("__bit") / 8) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("__byte div cast(power(2, __bit % 8) as int) % 2 = 1")
    return x.join(p, "__page").withColumn("__byte", byte).filter(hit).drop("__page", "__bit", "__bits", "__byte")


def lookup(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``wanted`` (nulls compare equal); absent keys give no row.

    The distinct keys are counted. Up to ``LOOKUP_KEYS`` they are broadcast and the table is not shuffled. Of more keys a
    bitmap of fixed size is broadcast; what passes it, the wanted rows and a few others, meets the keys exactly.
    """
    w = keyed.cut(wanted.select(*keys).distinct(), "wanted")
    if w.count() <= LOOKUP_KEYS:
        return df.join(F.broadcast(w), [df[k].eqNullSafe(w[k]) for k in keys], "left_semi")
    near = maybe_wanted(df, key_filter(w, keys), keys)
    return near.join(w, [near[k].eqNullSafe(w[k]) for k in keys], "left_semi")


def ingest_manual(rows: DataFrame) -> DataFrame:
    """Defaults of manual entry: blank texts to null, income without category, no group."""
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    return (
        rows.withColumn("merchant", blank("merchant"))
        .withColumn("note", blank("note"))
        .withColumn("category_id", F.when(F.col("type") == "EXPENSE", F.col("category_id")))
        .withColumn("source", F.lit("MANUAL"))
        .withColumn("merchant_id", F.lit(None).cast("bigint"))
        .withColumn("purchase_group_id", F.lit(None).cast("string"))
    )


# --- joins -------------------------------------------------------------------


def with_category(tx: DataFrame, cats: DataFrame) -> DataFrame:
    """Left join to the category dimension; ``category_name`` is never null."""
    c = cats.select(F.col("category_id").alias("__cid"), F.col("name").alias("__cname"))
    return (
        tx.join(c, F.col("category_id") == F.col("__cid"), "left")
        .withColumn("category_name", F.coalesce("__cname", F.lit(UNCATEGORIZED)))
        .drop("__cid", "__cname")
    )


# --- aggregations ------------------------------------------------------------


def period_totals(tx: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Spent, income, remaining, expense count and average expense per owner."""
    spent, income = F.col("type") == "EXPENSE", F.col("type") == "INCOME"
    out = transactions_between(tx, start, end).groupBy(OWNER).agg(
        zero_sum(F.col("amount_minor"), spent).alias("spent_minor"),
        zero_sum(F.col("amount_minor"), income).alias("income_minor"),
        F.count_if(spent).alias("expense_count"),
    )
    return out.withColumn("remaining_minor", F.col("income_minor") - F.col("spent_minor"))


def average_expense(tx: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    t = period_totals(tx, start, end)
    return t.select(OWNER, money.average_minor(F.col("spent_minor"), F.col("expense_count")).alias("average_minor"))


def income_spent_share(tx: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Tenths of a percent of income spent; null without income."""
    t = period_totals(tx, start, end)
    share = F.when(F.col("income_minor") > 0, money.share_tenths(F.col("spent_minor"), F.col("income_minor")))
    return t.select(OWNER, share.alias("spent_share_tenths"))


def spend_by_category(tx: DataFrame, cats: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Expense total and share per owner and category, with the display position.

    Grouped on the nullable id and labelled afterwards. The windows see one row
    per (owner, category), never transactions.
    """
    sums = expenses_between(tx, start, end).groupBy(OWNER, "category_id").agg(
        F.sum("amount_minor").alias("amount_minor")
    )
    named = with_category(sums, cats)
    owner = Window.partitionBy(OWNER)
    total = F.sum("amount_minor").over(owner)
    order = owner.orderBy(F.desc("amount_minor"), "category_name", "category_id")
    return named.select(
        OWNER, "category_id", "category_name", "amount_minor",
        money.share_tenths(F.col("amount_minor"), total).alias("share_tenths"),
        F.row_number().over(order).alias("position"),
    )


def period_comparison(tx: DataFrame, start: dt.date, end: dt.date, previous_start: dt.date) -> DataFrame:
    """Spend of ``[start, end)`` against ``[previous_start, start)``, one scan."""
    both = expenses_between(tx, previous_start, end)
    now = F.col("tx_date") >= F.lit(start)
    out = both.groupBy(OWNER).agg(
        zero_sum(F.col("amount_minor"), now).alias("current_minor"),
        zero_sum(F.col("amount_minor"), ~now).alias("previous_minor"),
    )
    pct = money.change_percent(F.col("current_minor"), F.col("previous_minor"))
    direction = F.when(pct.isNotNull(), F.when(F.col("current_minor") > F.col("previous_minor"), "more").otherwise("less"))
    return out.withColumn("change_percent", pct).withColumn("direction", direction)


def _zero_filled(spine: DataFrame, sums: DataFrame, slot: str) -> DataFrame:
    zeros = spine.withColumn("amount_minor", F.lit(0).cast("long"))
    return zeros.unionByName(sums).groupBy(OWNER, slot).agg(F.sum("amount_minor").alias("amount_minor"))


def trend_daily(tx: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Expense per day of ``[start, end)``, zero-filled for every owner of the ledger."""
    sums = expenses_between(tx, start, end).groupBy(OWNER, F.col("tx_date").alias("day")).agg(
        F.sum("amount_minor").alias("amount_minor")
    )
    out = _zero_filled(keyed.day_spine(tx.select(OWNER).distinct(), start, end), sums, "day")
    return out.withColumn("label", F.dayofmonth("day").cast("string"))


def trend_monthly(tx: DataFrame, start: dt.date, months: int) -> DataFrame:
    """Expense per month, ``months`` months from ``start``, zero-filled, labelled ``MMM``."""
    end = dates.add_months(dates.month_start(start), months)
    sums = (
        expenses_between(tx, start, end)
        .groupBy(OWNER, dates.month_of(F.col("tx_date")).alias("month"))
        .agg(F.sum("amount_minor").alias("amount_minor"))
    )
    out = _zero_filled(keyed.month_spine(tx.select(OWNER).distinct(), start, months), sums, "month")
    return out.withColumn("label", F.date_format("month", "MMM"))


def categories_for_entry(cats: DataFrame, tx: DataFrame) -> DataFrame:
    """Active categories by use: count desc, last use desc, id; unused ones kept.

    The ledger is reduced to one row per category before the join.
    """
    keys = [k for k in (OWNER, "category_id") if k in cats.columns]
    used = (
        tx.filter((F.col("type") == "EXPENSE") & F.col("category_id").isNotNull())
        .groupBy(*keys)
        .agg(F.count("*").alias("usage_count"), F.max("tx_date").alias("last_used"))
    )
    return (
        active(cats).join(used, keys, "left")
        .select(*keys, "name", F.coalesce("usage_count", F.lit(0).cast("long")).alias("usage_count"), "last_used")
        .orderBy(F.desc("usage_count"), F.desc_nulls_last("last_used"), "category_id")
    )


def recent_per_category(tx: DataFrame, n: int = 10, keys: Sequence[str] = ("category_id",)) -> DataFrame:
    """The ``n`` newest expenses of every category."""
    rows = tx.filter((F.col("type") == "EXPENSE") & F.col("category_id").isNotNull())
    order = [F.desc("tx_date"), F.desc("created_at"), F.asc("tx_id")]
    return keyed.top_per_key(rows, list(keys), order, n, rank="position")


def category_explorer(
    cats: DataFrame, tx: DataFrame, assets: DataFrame, as_of: dt.date, period: str = "THIS_MONTH", n: int = 10
) -> DataFrame:
    """Explorer in long form: one TOTAL row per active category, its RECENT expenses and OWNED items.

    Long rows keep an owner's items in as many tasks as they need; nothing is
    collected into a list. Item purchase prices never enter the totals.
    """
    keys = [k for k in (OWNER, "category_id") if k in cats.columns]
    start, end = dates.spending_range(as_of, period)
    spent = expenses_between(tx, start, end).filter(F.col("category_id").isNotNull())
    sums = spent.groupBy(*keys).agg(F.sum("amount_minor").alias("__sum"))
    live = active(cats).select(*keys)
    total = live.join(sums, keys, "left").select(
        *keys, F.lit("TOTAL").alias("section"), F.lit(None).cast("string").alias("entry_id"),
        F.lit(0).alias("position"), F.coalesce("__sum", F.lit(0).cast("long")).alias("amount_minor"),
    )
    recent = recent_per_category(spent, n, keys).join(live, keys, "left_semi").select(
        *keys, F.lit("RECENT").alias("section"), F.col("tx_id").alias("entry_id"), "position", "amount_minor"
    )
    owned = assets.filter((F.col("ownership_status") == "OWNED") & ~F.col("is_archived"))
    owned = owned.join(live, keys, "left_semi").select(
        *keys, F.lit("OWNED").alias("section"), F.col("asset_id").cast("string").alias("entry_id"),
        F.lit(0).alias("position"), F.lit(None).cast("bigint").alias("amount_minor"),
    )
    return total.unionByName(recent).unionByName(owned)


def group_purchases(tx: DataFrame) -> DataFrame:
    """Split purchases shown once, at their newest row's position, with the summed amount."""
    group = F.coalesce("purchase_group_id", F.concat(F.lit("tx"), F.col("tx_id")))
    return tx.groupBy(OWNER, group.alias("display_id")).agg(
        F.sum("amount_minor").alias("amount_minor"),
        F.count("*").alias("n_rows"),
        F.max(F.struct("tx_date", "created_at")).alias("__pos"),
    ).select(
        OWNER, "display_id", "amount_minor", "n_rows",
        F.col("__pos.tx_date").alias("shown_date"), F.col("__pos.created_at").alias("shown_at"),
    )


def insights(tx: DataFrame, cats: DataFrame, start: dt.date, end: dt.date, previous_start: dt.date) -> DataFrame:
    """Insight sentences per owner, one row each, in display order."""
    top = spend_by_category(tx, cats, start, end).filter(F.col("position") == 1)
    change = period_comparison(tx, start, end, previous_start)
    everyone = tx.select(OWNER).distinct()
    wide = everyone.join(top, OWNER, "left").join(change, OWNER, "left")
    name = F.col("category_name")
    empty = F.when(name.isNull(), F.lit("No spending recorded for this period."))
    highest = F.concat(name, F.lit(" is your highest spending category at "), money.format_minor(F.col("amount_minor")), F.lit("."))
    share = F.concat(name, F.lit(" represents "), money.format_tenths(F.col("share_tenths")), F.lit(" of your spending."))
    trend = F.when(name.isNotNull(), F.concat(
        F.lit("You spent "), F.col("change_percent").cast("string"), F.lit("% "), F.col("direction"),
        F.lit(" than the previous comparable period."),
    ))
    lines = F.filter(F.array(F.coalesce(highest, empty), share, trend), lambda s: s.isNotNull())
    return wide.select(OWNER, F.posexplode(lines).alias("seq", "sentence"))


def month_insight(tx: DataFrame, cats: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """The home sentence: top category, and overspending against recorded income."""
    top = spend_by_category(tx, cats, start, end).filter(F.col("position") == 1)
    wide = period_totals(tx, start, end).join(top.select(OWNER, "category_name", "amount_minor"), OWNER, "left")
    first = F.when(F.col("category_name").isNull(), F.lit("No spending recorded this month yet.")).otherwise(F.concat(
        F.lit("Your highest spending category this month is "), F.col("category_name"), F.lit(" at "),
        money.format_minor(F.col("amount_minor")), F.lit("."),
    ))
    over = (F.col("income_minor") > 0) & (F.col("spent_minor") > F.col("income_minor"))
    extra = F.concat(
        F.lit(" You have spent "), money.format_minor(F.col("spent_minor") - F.col("income_minor")),
        F.lit(" more than your recorded income this month."),
    )
    return wide.select(OWNER, F.concat(first, F.when(over, extra).otherwise(F.lit(""))).alias("sentence"))


def backfill_merchants(tx: DataFrame) -> DataFrame:
    """Merchant rows for the names found in old expenses."""
    name = F.trim("merchant")
    rows = tx.filter((F.col("type") == "EXPENSE") & F.col("merchant").isNotNull() & (name != ""))
    return rows.groupBy(OWNER, F.lower(name).alias("normalized_name")).agg(
        F.min(name).alias("display_name"),
        F.count("*").alias("usage_count"),
        F.max("tx_date").alias("last_used"),
        F.min("created_at").alias("created_at"),
        F.lit(None).cast("bigint").alias("default_category_id"),
        F.lit("USER").alias("source"),
    )


# --- orderings ---------------------------------------------------------------

# The display order of each listing.
ORDERINGS: Mapping[str, Sequence[tuple[str, str]]] = {
    "assets": [("updated_at", "desc"), ("name", "asc"), ("asset_id", "asc")],
    "warranties": [("end_date", "asc"), ("warranty_id", "asc")],
    "maintenance_events": [("event_date", "desc"), ("created_at", "desc"), ("event_id", "asc")],
    "checkpoints": [("is_active", "desc"), ("due_date", "asc"), ("checkpoint_id", "asc")],
    "documents": [("created_at", "desc"), ("document_id", "asc")],
    "merchants": [("last_used_at", "desc"), ("usage_count", "desc"), ("display_name", "asc")],
}


def ordered(df: DataFrame, listing: str) -> DataFrame:
    """Global range sort by a listing's fixed order."""
    return df.orderBy(*[F.desc(c) if way == "desc" else F.asc(c) for c, way in ORDERINGS[listing]])


def custom_types_by_name(types: DataFrame) -> DataFrame:
    """Active custom types, ASCII case-insensitive by name."""
    return active(types).orderBy(F.lower("name"), "custom_type_id")
