"""Recurring commitments: occurrences, forecasts, debt balances and late charges.

Occurrences are generated row-wise (``explode`` of a bounded index range), so
expansion needs no shuffle and a hot owner stays spread over the input tasks.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import dates
from tallyspark.functions.money import compound_charge
from tallyspark.operators.ledger import OWNER, zero_sum
from tallyspark.plans import keyed

# Months between occurrences of each month-based frequency.
STEP_MONTHS = {"MONTHLY": 1, "QUARTERLY": 3, "SEMI_ANNUAL": 6, "ANNUAL": 12, "CUSTOM": 1}


def _step() -> Column:
    col = F.lit(1)
    for name, n in STEP_MONTHS.items():
        col = F.when(F.col("frequency") == name, F.lit(n)).otherwise(col)
    return col


def _month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def _expand(c: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Rows ``lo..hi`` (inclusive index range) of each commitment with ``due_date``."""
    anchor = F.col("next_due_date")
    idx = c.withColumn("__i", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))))
    due = F.when(F.col("frequency") == "WEEKLY", F.date_add(anchor, F.col("__i") * 7)).otherwise(
        F.add_months(anchor, F.col("__i") * _step())
    )
    return idx.withColumn("due_date", due).drop("__i")


def generate_occurrences(c: DataFrame, start: dt.date | None, end: dt.date) -> DataFrame:
    """Dated occurrences of active commitments with ``start <= due < end`` and due <= end_date.

    Each occurrence is anchored at the first date (31 Jan, 29 Feb, 31 Mar). The
    index range is computed from the horizon per row, so nothing past it exists.
    """
    anchor, freq = F.col("next_due_date"), F.col("frequency")
    last = F.date_sub(F.lit(end), 1)
    last = F.when(F.col("end_date").isNotNull(), F.least(last, F.col("end_date"))).otherwise(last)
    # Calendar-month distance never undercounts; the exact bound is the filter below.
    hi = (
        F.when(last < anchor, F.lit(-1))
        .when(freq == "ONE_TIME", F.lit(0))
        .when(freq == "WEEKLY", F.floor(F.datediff(last, anchor) / 7).cast("int"))
        .otherwise(F.floor((_month_index(last) - _month_index(anchor)) / _step()).cast("int"))
    )
    lo = F.lit(0)
    if start is not None:
        s = F.lit(start)
        lo = F.when(freq == "WEEKLY", F.floor(F.datediff(s, anchor) / 7).cast("int")).otherwise(
            F.floor((_month_index(s) - _month_index(anchor)) / _step()).cast("int") - 1
        )
        lo = F.when(freq == "ONE_TIME", F.lit(0)).otherwise(F.greatest(F.lit(0), lo))
    out = _expand(c.filter(F.col("is_active")), lo, hi)
    out = out.filter((F.col("due_date") < F.lit(end)) & (F.col("end_date").isNull() | (F.col("due_date") <= F.col("end_date"))))
    return out.filter(F.col("due_date") >= F.lit(start)) if start is not None else out


def preview(c: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` dates; ONE_TIME shows its date whatever the end date."""
    freq, end = F.col("frequency"), F.col("end_date")
    hi = F.when(F.lit(k <= 0), F.lit(-1)).when(freq == "ONE_TIME", F.lit(0)).otherwise(F.lit(k - 1))
    out = _expand(c, F.lit(0), hi)
    return out.filter((freq == "ONE_TIME") | end.isNull() | (F.col("due_date") <= end))


def overlay_overrides(occ: DataFrame, overrides: DataFrame) -> DataFrame:
    """Status, paid transaction and paid time from the override of (commitment, due date); default UNPAID."""
    ov = overrides.select("commitment_id", "due_date", "status", "paid_tx_id", "paid_at")
    return occ.join(ov, ["commitment_id", "due_date"], "left").withColumn("status", F.coalesce("status", F.lit("UNPAID")))


def horizon_end(as_of: dt.date, month: dt.date | None = None) -> dt.date:
    """Exclusive end: the month twelve after the later of ``as_of`` and ``month``, whole."""
    later = max(dates.month_start(as_of), dates.month_start(month or as_of))
    return dates.add_months(later, 13)


def horizon(c: DataFrame, as_of: dt.date, month: dt.date | None = None) -> DataFrame:
    """Per owner: from = the earliest due date, at most ``as_of``; to = ``horizon_end``."""
    return c.groupBy(OWNER).agg(F.least(F.min("next_due_date"), F.lit(as_of)).alias("from_date")).withColumn(
        "to_date", F.lit(horizon_end(as_of, month))
    )


def schedule(c: DataFrame, profiles: DataFrame, overrides: DataFrame, as_of: dt.date, month: dt.date | None = None) -> DataFrame:
    """Occurrences of the schedulable commitments over the dynamic horizon, with their status.

    The lower bound is the earliest due date, which no occurrence precedes.
    """
    occ = generate_occurrences(schedulable(c, profiles), None, horizon_end(as_of, month))
    return overlay_overrides(occ, overrides)


# --- filters -----------------------------------------------------------------


def filter_group(c: DataFrame, group: str) -> DataFrame:
    """ALL, INSTALLMENTS, DEBTS or OTHER (neither)."""
    kind = F.col("type")
    return {
        "ALL": lambda: c,
        "INSTALLMENTS": lambda: c.filter(kind == "INSTALLMENT"),
        "DEBTS": lambda: c.filter(kind == "DEBT_PAYMENT"),
        "OTHER": lambda: c.filter(~kind.isin("INSTALLMENT", "DEBT_PAYMENT")),
    }[group]()


def schedulable(c: DataFrame, profiles: DataFrame) -> DataFrame:
    """Commitments without a profile or whose profile is not open-ended."""
    open_ended = profiles.filter(F.col("repayment_mode") == "OPEN_ENDED").select("commitment_id")
    return c.join(open_ended, "commitment_id", "left_anti")


def occurrence_view(occ: DataFrame, mode: str, as_of: dt.date, month: dt.date | None = None) -> DataFrame:
    """MONTH, NEXT_30_DAYS (both ends inclusive, any status) or ALL_UPCOMING, by due date."""
    d = F.col("due_date")
    if mode == "MONTH":
        first = dates.month_start(month or as_of)
        kept = occ.filter((d >= F.lit(first)) & (d < F.lit(dates.add_months(first, 1))))
    elif mode == "NEXT_30_DAYS":
        kept = occ.filter((d >= F.lit(as_of)) & (d <= F.lit(as_of + dt.timedelta(days=30))))
    elif mode == "ALL_UPCOMING":
        kept = occ.filter(d >= F.lit(as_of))
    else:
        raise ValueError(f"unknown view {mode}")
    return kept.orderBy("due_date", "commitment_id")


def overdue(occ: DataFrame, as_of: dt.date) -> DataFrame:
    return occ.filter((F.col("due_date") < F.lit(as_of)) & (F.col("status") == "UNPAID"))


def with_merchant(c: DataFrame, merchants: DataFrame) -> DataFrame:
    m = merchants.select("merchant_id", F.col("display_name").alias("merchant_name"))
    return c.join(m, "merchant_id", "left").orderBy("next_due_date", "title")


def canonical_debt(defs: DataFrame) -> DataFrame:
    """Open-ended debts lose their schedule; ``violation`` names what a fixed one lacks."""
    is_open = F.col("repayment_mode") == "OPEN_ENDED"
    bad = F.when(is_open, F.lit(None)).when(F.col("amount_minor") <= 0, "Installment amount is required").when(
        F.col("frequency") == "CUSTOM", "Select a supported frequency"
    )
    return defs.withColumns({
        "violation": bad,
        "amount_minor": F.when(is_open, F.lit(0).cast("long")).otherwise(F.col("amount_minor")),
        "frequency": F.when(is_open, F.lit("ONE_TIME")).otherwise(F.col("frequency")),
        "next_due_date": F.when(is_open, F.col("start_date")).otherwise(F.col("next_due_date")),
        "end_date": F.when(~is_open, F.col("end_date")),
    })


# --- summaries ---------------------------------------------------------------


def forecast(occ: DataFrame, start: dt.date, n: int = 12) -> DataFrame:
    """Amount per owner and month, zero-filled, SKIPPED excluded and PAID included."""
    first = dates.month_start(start)
    d = F.col("due_date")
    rows = occ.filter((d >= F.lit(first)) & (d < F.lit(dates.add_months(first, n))) & (F.col("status") != "SKIPPED"))
    sums = rows.groupBy(OWNER, dates.month_of(d).alias("month")).agg(F.sum("amount_minor").alias("amount_minor"))
    zeros = keyed.month_spine(occ.select(OWNER).distinct(), start, n).withColumn("amount_minor", F.lit(0).cast("long"))
    return zeros.unionByName(sums).groupBy(OWNER, "month").agg(F.sum("amount_minor").alias("amount_minor"))


def commitment_summary(occ: DataFrame, as_of: dt.date) -> DataFrame:
    """Portfolio summary per owner; one scan, reduced to (owner, month) rows first.

    next 30 days means ``as_of .. as_of + 29`` and UNPAID only.
    """
    first = dates.month_start(as_of)
    d, amount, status = F.col("due_date"), F.col("amount_minor"), F.col("status")
    unpaid = status == "UNPAID"
    soon = (d >= F.lit(as_of)) & (d <= F.lit(as_of + dt.timedelta(days=29))) & unpaid
    nxt = F.when((d >= F.lit(as_of)) & unpaid, F.struct(d.alias("due"), F.col("commitment_id").alias("cid"), amount.alias("amt")))
    by_month = occ.groupBy(OWNER, dates.month_of(d).alias("month")).agg(
        zero_sum(amount, status != "SKIPPED").alias("counted"),
        zero_sum(amount, status == "PAID").alias("paid"),
        zero_sum(amount, unpaid).alias("unpaid"),
        zero_sum(amount, soon).alias("soon"),
        F.min(nxt).alias("nxt"),
    )
    m = F.col("month")
    this = m == F.lit(first)
    in_year = (m >= F.lit(first)) & (m < F.lit(dates.add_months(first, 12)))
    best = F.max(F.when(in_year, F.struct(F.col("counted").alias("amt"), (-F.unix_date(m)).alias("neg"))))
    out = by_month.groupBy(OWNER).agg(
        zero_sum(F.col("counted"), this).alias("committed_this_month_minor"),
        zero_sum(F.col("paid"), this).alias("paid_this_month_minor"),
        zero_sum(F.col("unpaid"), this).alias("remaining_this_month_minor"),
        F.sum("soon").alias("next_30_days_minor"),
        zero_sum(F.col("counted"), in_year).alias("next_12_months_minor"),
        best.alias("best"), F.min("nxt").alias("nxt"),
    )
    has = F.coalesce(F.col("best.amt"), F.lit(0)) > 0
    return out.select(
        OWNER, "committed_this_month_minor", "paid_this_month_minor", "remaining_this_month_minor",
        "next_30_days_minor", "next_12_months_minor",
        F.when(has, F.date_from_unix_date(-F.col("best.neg"))).otherwise(F.lit(first)).alias("highest_month"),
        F.when(has, F.col("best.amt")).otherwise(F.lit(0).cast("long")).alias("highest_month_minor"),
        F.col("nxt.due").alias("next_due_date"), F.col("nxt.cid").alias("next_commitment_id"), F.col("nxt.amt").alias("next_amount_minor"),
    )


def period_summary(occ: DataFrame) -> DataFrame:
    """Committed, paid and remaining by status; SKIPPED excluded."""
    a, s = F.col("amount_minor"), F.col("status")
    return occ.groupBy(OWNER).agg(
        zero_sum(a, s != "SKIPPED").alias("committed_minor"),
        zero_sum(a, s == "PAID").alias("paid_minor"),
        zero_sum(a, s == "UNPAID").alias("remaining_minor"),
    )


def period_summary_paid(progress: DataFrame) -> DataFrame:
    """Committed, paid and remaining from payment progress; the due date selects the period."""
    live = F.col("state") != "SKIPPED"
    return progress.groupBy(OWNER).agg(
        zero_sum(F.col("amount_minor"), live).alias("committed_minor"),
        zero_sum(F.col("paid_minor"), live).alias("paid_minor"),
        zero_sum(F.col("remaining_minor"), live).alias("remaining_minor"),
    )


def upcoming_by_month(occ: DataFrame, as_of: dt.date) -> DataFrame:
    """Upcoming occurrences per owner and month: count, amount and the first of them."""
    rows = occ.filter(F.col("due_date") >= F.lit(as_of))
    return rows.groupBy(OWNER, dates.month_of(F.col("due_date")).alias("month")).agg(
        F.count("*").alias("n_occurrences"), F.sum("amount_minor").alias("amount_minor"),
        F.min("due_date").alias("first_due_date"),
    )


def month_income_vs_committed(tx: DataFrame, occ: DataFrame, as_of: dt.date) -> DataFrame:
    """This month's income against what falls due in it."""
    first = dates.month_start(as_of)
    end = dates.add_months(first, 1)
    t, d = F.col("tx_date"), F.col("due_date")
    income = tx.filter((F.col("type") == "INCOME") & (t >= F.lit(first)) & (t < F.lit(end))).select(
        OWNER, F.col("amount_minor").alias("income_minor"), F.lit(0).cast("long").alias("committed_minor")
    )
    due = occ.filter((d >= F.lit(first)) & (d < F.lit(end)) & (F.col("status") != "SKIPPED")).select(
        OWNER, F.lit(0).cast("long").alias("income_minor"), F.col("amount_minor").alias("committed_minor")
    )
    return income.unionByName(due).groupBy(OWNER).agg(
        F.sum("income_minor").alias("income_minor"), F.sum("committed_minor").alias("committed_minor")
    )


# --- debts -------------------------------------------------------------------


def debt_balance(profiles: DataFrame, payments: DataFrame) -> DataFrame:
    """Paid principal, paid total and outstanding principal (never negative)."""
    paid = payments.groupBy("profile_id").agg(
        F.sum("principal_minor").alias("__p"), F.sum("total_minor").alias("__t")
    )
    zero = F.lit(0).cast("long")
    out = profiles.join(paid, "profile_id", "left").withColumns({
        "principal_paid_minor": F.coalesce("__p", zero), "total_paid_minor": F.coalesce("__t", zero),
    })
    return out.withColumn(
        "outstanding_minor", F.greatest(zero, F.col("original_principal_minor") - F.col("principal_paid_minor"))
    ).drop("__p", "__t")


def allocated(payments: DataFrame) -> DataFrame:
    """Principal plus financing paid towards each (profile, due date)."""
    return payments.groupBy("profile_id", "due_date").agg(
        F.sum(F.col("principal_minor") + F.col("financing_minor")).alias("allocated_minor")
    )


def occurrence_progress(occ: DataFrame, profiles: DataFrame, payments: DataFrame) -> DataFrame:
    """Paid and remaining amount and state of every occurrence.

    Payments are first reduced to one row per (profile, due date).
    """
    prof = profiles.select("commitment_id", "profile_id")
    joined = occ.join(prof, "commitment_id", "left").join(allocated(payments), ["profile_id", "due_date"], "left")
    amount, zero = F.col("amount_minor"), F.lit(0).cast("long")
    skipped = F.col("status") == "SKIPPED"
    raw = (
        F.when(skipped, zero)
        .when(F.col("profile_id").isNotNull(), F.coalesce("allocated_minor", zero))
        .when(F.col("status") == "PAID", amount)
        .otherwise(zero)
    )
    paid = F.least(F.greatest(raw, zero), amount)
    out = joined.withColumn("paid_minor", paid).drop("allocated_minor")
    left = F.when(skipped, zero).otherwise(F.greatest(zero, amount - F.col("paid_minor")))
    state = (
        F.when(skipped, "SKIPPED").when(F.col("paid_minor") <= 0, "UNPAID")
        .when(F.col("paid_minor") < amount, "PARTIALLY_PAID").otherwise("PAID")
    )
    return out.withColumn("remaining_minor", left).withColumn("state", state)


def one_time_amount(debts: DataFrame, terms: DataFrame) -> DataFrame:
    """Contractual amount of a one-time debt and its source; null when not positive."""
    j = debts.join(terms.select("profile_id", "financing_type", "total_repayable_minor"), "profile_id", "left")
    kind = F.col("financing_type")
    value = F.when(kind.isNull(), F.col("original_principal_minor")).when(
        kind == "FIXED_TOTAL", F.col("total_repayable_minor")).otherwise(F.col("explicit_amount_minor"))
    source = F.when(kind.isNull(), "PRINCIPAL").when(kind == "FIXED_TOTAL", "FIXED_TOTAL_REPAYABLE").otherwise("EXPLICIT_AMOUNT_DUE")
    return j.withColumn("one_time_minor", F.when(value > 0, value)).withColumn("amount_source", F.when(value > 0, source))


def financing_cost(profiles: DataFrame, terms: DataFrame) -> DataFrame:
    """Repayable beyond the principal for fixed-total terms, else null."""
    j = profiles.join(terms.select("profile_id", "financing_type", "total_repayable_minor"), "profile_id", "left")
    cost = F.when(
        (F.col("financing_type") == "FIXED_TOTAL") & F.col("total_repayable_minor").isNotNull(),
        F.greatest(F.lit(0).cast("long"), F.col("total_repayable_minor") - F.col("original_principal_minor")),
    )
    return j.withColumn("financing_cost_minor", cost)


def payment_history(payments: DataFrame) -> DataFrame:
    """Payments of each profile, newest first (range sort, safe for a hot profile)."""
    return payments.orderBy("profile_id", F.desc("payment_date"), F.desc("created_at"), "payment_id")


def late_charge(due: DataFrame, rules: DataFrame, as_of: dt.date, compounding: bool = True) -> DataFrame:
    """Overdue days, grace flag, chargeable periods and estimated charge.

    ``due`` has profile_id, due_date, scheduled_minor and outstanding_minor. The
    exact power of compounding rules is worked out for their rows only;
    ``compounding=False`` leaves it out of the plan where no rule compounds.
    """
    r = rules.select(
        "profile_id", "grace_days", "charge_type", "charge_interval", "charge_basis", "fixed_minor",
        "rate_points", "is_compounding", "minimum_minor", "maximum_minor",
    )
    j = due.join(r, "profile_id", "left")
    now, zero = F.lit(as_of), F.lit(0).cast("long")
    days = F.greatest(F.lit(0), F.datediff(now, F.col("due_date")))
    kind, grace = F.col("charge_type"), F.col("grace_days")
    beyond = kind.isNotNull() & (F.col("days_overdue") > grace)
    late_days = F.col("days_overdue") - grace
    by_interval = (
        F.when(F.col("charge_interval") == "ONCE", F.lit(1))
        .when(F.col("charge_interval") == "DAILY", late_days)
        .when(F.col("charge_interval") == "WEEKLY", F.floor(late_days / 7))
        .otherwise(dates.whole_months(F.date_add(F.col("due_date"), grace), now))
    )
    periods = F.when(~beyond, F.lit(0)).when(kind.isin("FIXED_ONCE", "PERCENT_ONCE"), F.lit(1)).otherwise(
        F.greatest(F.lit(0), by_interval)
    )
    j = j.withColumn("days_overdue", days)
    j = j.withColumn("chargeable_periods", F.coalesce(periods, F.lit(0)).cast("long"))
    basis = F.greatest(zero, F.when(F.col("charge_basis") == "OVERDUE_INSTALLMENT", F.col("scheduled_minor")).otherwise(F.col("outstanding_minor")))
    n, rate, fixed = F.col("chargeable_periods"), F.coalesce("rate_points", zero), F.coalesce("fixed_minor", zero)
    d = lambda c: c.cast("decimal(19,0)")
    once = F.round(d(basis) * d(rate).cast("decimal(10,0)") / F.lit(10000).cast("decimal(5,0)"), 0)
    repeated = F.round(d(basis) * rate.cast("decimal(6,0)") * n.cast("decimal(6,0)") / F.lit(10000).cast("decimal(5,0)"), 0)
    raw = (
        F.when(kind == "FIXED_ONCE", fixed)
        .when(kind == "FIXED_PERIODIC", (d(fixed) * n.cast("decimal(10,0)")).cast("long"))
        .when(kind == "PERCENT_ONCE", once.cast("long"))
    )
    simple = repeated.cast("long")
    if compounding:
        grows = (kind == "PERCENT_PERIODIC") & F.col("is_compounding") & (n > 0)
        power = compound_charge(F.when(grows, basis), F.when(grows, rate), F.when(grows, n))
        raw = raw.when(grows, power)
    raw = raw.otherwise(simple)
    charge = F.greatest(zero, F.least(F.greatest(raw, "minimum_minor"), "maximum_minor"))  # a null bound is none; raw is written once
    out = j.withColumn("charge_minor", F.when(n > 0, charge).otherwise(zero))
    in_grace = kind.isNotNull() & (F.col("days_overdue") > 0) & (F.col("days_overdue") <= grace)
    return out.withColumn("in_grace_period", in_grace).drop(
        "grace_days", "charge_type", "charge_interval", "charge_basis", "fixed_minor", "rate_points",
        "is_compounding", "minimum_minor", "maximum_minor",
    )


def next_occurrence(occ: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """First UNPAID occurrence per commitment, from ``as_of`` on when given.

    A minimum over a small struct, so it is combined before the shuffle.
    """
    rows = occ.filter(F.col("status") == "UNPAID")
    if as_of is not None:
        rows = rows.filter(F.col("due_date") >= F.lit(as_of))
    return rows.groupBy("commitment_id").agg(F.min(F.struct("due_date", "amount_minor")).alias("__n")).select(
        "commitment_id", F.col("__n.due_date").alias("next_due"), F.col("__n.amount_minor").alias("next_amount_minor")
    )


def first_unpaid(c: DataFrame, overrides: DataFrame, as_of: dt.date, years: int = 10) -> DataFrame:
    """First UNPAID occurrence of each commitment over ``years`` from ``as_of``.

    At most one occurrence per settled override can precede it, so only that
    many (plus one) are generated instead of the whole ten years.
    """
    settled = overrides.filter(F.col("status") != "UNPAID").groupBy("commitment_id").agg(F.count("*").cast("int").alias("__n"))
    limit = dates.add_months(as_of, 12 * years)
    rows = c.filter(F.col("is_active")).join(settled, "commitment_id", "left")
    hi = F.when(F.col("frequency") == "ONE_TIME", F.lit(0)).otherwise(F.coalesce("__n", F.lit(0)))
    occ = _expand(rows, F.lit(0), hi).drop("__n").filter(
        (F.col("due_date") < F.lit(limit)) & (F.col("end_date").isNull() | (F.col("due_date") <= F.col("end_date")))
    )
    return next_occurrence(overlay_overrides(occ, overrides))


def debt_detail(
    profiles: DataFrame, c: DataFrame, overrides: DataFrame, payments: DataFrame, terms: DataFrame, rules: DataFrame, as_of: dt.date
) -> DataFrame:
    """One row per profile: balance, terms, next unpaid instalment, its allocation and late charge."""
    fixed = profiles.filter(F.col("repayment_mode") == "FIXED_INSTALLMENTS").select("commitment_id")
    nxt = first_unpaid(c.join(fixed, "commitment_id", "left_semi"), overrides, as_of)
    base = debt_balance(profiles, payments).join(c.select("commitment_id", "title", "amount_minor", "frequency"), "commitment_id")
    base = base.join(terms.select("profile_id", "financing_type", "total_repayable_minor"), "profile_id", "left")
    base = base.join(nxt, "commitment_id", "left")
    alloc = allocated(payments).withColumnRenamed("due_date", "next_due")
    zero = F.lit(0).cast("long")
    base = base.join(alloc, ["profile_id", "next_due"], "left").withColumn("allocated_minor", F.coalesce("allocated_minor", zero))
    due = base.withColumn("due_date", F.col("next_due")).withColumn(
        "scheduled_minor", F.greatest(zero, F.col("next_amount_minor") - F.col("allocated_minor"))
    )
    charged = late_charge(due, rules, as_of)
    known = F.col("next_due").isNotNull()
    return charged.withColumn("charge_minor", F.when(known, F.col("charge_minor"))).withColumn(
        "days_overdue", F.when(known, F.col("days_overdue"))
    ).drop("due_date", "scheduled_minor")


def active_debts(
    profiles: DataFrame, c: DataFrame, payments: DataFrame, progress: DataFrame, as_of: dt.date, group: str = "ALL"
) -> DataFrame:
    """Live profiles of the group with their balance and next unsettled occurrence from ``as_of``."""
    live = profiles.filter(~F.col("is_archived"))
    kinds = {"ALL": None, "INSTALLMENTS": "INSTALLMENT", "DEBTS": "DEBT_PAYMENT", "OTHER": ""}[group]
    defs = c.select("commitment_id", "title", "type")
    if kinds is not None:
        defs = defs.filter(F.col("type") == kinds)
    upcoming = progress.filter((F.col("due_date") >= F.lit(as_of)) & ~F.col("state").isin("PAID", "SKIPPED"))
    nxt = upcoming.groupBy("commitment_id").agg(F.min(F.struct("due_date", "amount_minor", "paid_minor")).alias("__n")).select(
        "commitment_id", F.col("__n.due_date").alias("next_due"), F.col("__n.amount_minor").alias("next_amount_minor"),
        F.col("__n.paid_minor").alias("next_paid_minor"),
    )
    out = debt_balance(live, payments).join(defs, "commitment_id").join(nxt, "commitment_id", "left")
    return out.withColumn("next_paid_minor", F.coalesce("next_paid_minor", F.lit(0).cast("long")))


def debt_portfolio(active: DataFrame) -> DataFrame:
    """Totals over the active debts of an owner."""
    return active.groupBy(OWNER).agg(
        F.sum("original_principal_minor").alias("original_minor"),
        F.sum("principal_paid_minor").alias("paid_minor"),
        F.sum("outstanding_minor").alias("outstanding_minor"),
    )
