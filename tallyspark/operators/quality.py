"""Validation jobs: the violating rows with the rule they break."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT_INVALID = "Every split needs a positive amount and category."
SPLIT_SHORT = "Assign the remaining amount before saving."
SPLIT_OVER = "Split amounts exceed the purchase total."


def _explain(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """One row per (key, broken rule); a rule is the condition that breaks it."""
    broken = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("violation"))


def check_splits(parts: DataFrame, totals: DataFrame) -> DataFrame:
    """Allocation of each purchase: assigned, remaining and the message, if any."""
    good = (F.coalesce("amount_minor", F.lit(0)) > 0) & F.col("category_id").isNotNull()
    per = parts.groupBy("purchase_key").agg(F.sum(F.coalesce("amount_minor", F.lit(0).cast("long"))).alias("assigned"), F.count_if(~good).alias("bad"))
    j = totals.select("purchase_key", "total_minor").join(per, "purchase_key", "left")
    assigned = F.coalesce("assigned", F.lit(0).cast("long"))
    left = F.col("total_minor") - assigned
    message = F.when(F.col("bad").isNull() | (F.col("bad") > 0), SPLIT_INVALID).when(left > 0, SPLIT_SHORT).when(left < 0, SPLIT_OVER)
    return j.select("purchase_key", assigned.alias("assigned_minor"), left.alias("remaining_minor"), message.isNull().alias("is_exact"), message.alias("message"))


def check_payments(pay: DataFrame) -> DataFrame:
    """Payments whose parts are negative or do not add up to a positive total."""
    p, f, late, total = (F.col(c) for c in ("principal_minor", "financing_minor", "late_minor", "total_minor"))
    return pay.filter(~((total > 0) & (p >= 0) & (f >= 0) & (late >= 0) & (total == p + f + late)))


def _checkpoint_conditions() -> dict[str, Column]:
    date, km, months, every = F.col("due_date"), F.col("due_km"), F.col("repeat_months"), F.col("repeat_km")
    mode = F.col("trigger_mode")
    return {
        "blank title": F.trim("title") == "",
        "repeat months not positive": months <= 0,
        "repeat km not positive": every <= 0,
        "negative warning days": F.col("warning_days") < 0,
        "negative warning km": F.col("warning_km") < 0,
        "negative due km": km < 0,
        "date trigger": (mode == "DATE") & ~(date.isNotNull() & km.isNull() & every.isNull()),
        "mileage trigger": (mode == "MILEAGE") & ~(km.isNotNull() & date.isNull() & months.isNull()),
        "date or mileage trigger": (mode == "DATE_OR_MILEAGE") & ~(date.isNotNull() & km.isNotNull()),
        "repeat months without date": months.isNotNull() & date.isNull(),
        "repeat km without km": every.isNotNull() & km.isNull(),
    }


def checkpoint_violation() -> Column:
    """The first condition a checkpoint breaks, or null."""
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in _checkpoint_conditions().items()])


def check_checkpoints(cp: DataFrame) -> DataFrame:
    """Checkpoint rules by trigger mode."""
    return _explain(cp, "checkpoint_id", _checkpoint_conditions())


def _rule_conditions() -> dict[str, Column]:
    trigger = F.col("trigger_type")
    by_time = F.coalesce(F.col("interval_months") > 0, F.lit(False)) & F.col("baseline_date").isNotNull()
    by_km = F.coalesce(F.col("interval_km") > 0, F.lit(False)) & F.col("baseline_km").isNotNull()
    return {
        "blank title": F.trim("title") == "",
        "time trigger needs interval and baseline": (trigger != "MILEAGE") & ~by_time,
        "mileage trigger needs interval and baseline": (trigger != "TIME") & ~by_km,
        "negative warning": (F.col("warning_days") < 0) | (F.col("warning_km") < 0),
    }


def rule_violation() -> Column:
    """The first condition a maintenance rule breaks, or null."""
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in _rule_conditions().items()])


def check_rules(rules: DataFrame) -> DataFrame:
    return _explain(rules, "rule_id", _rule_conditions())


def check_receipts(receipts: DataFrame, items: DataFrame, cats: DataFrame) -> DataFrame:
    """The first problem of each receipt draft.

    Items are reduced to counters per receipt before the join.
    """
    live = cats.filter(~F.col("is_archived")).select("category_id").withColumn("__live", F.lit(True))
    per = items.join(live, "category_id", "left").groupBy("receipt_id").agg(
        F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("name", F.lit(""))) == "").alias("unnamed"),
        F.count_if(F.coalesce("amount_minor", F.lit(0)) <= 0).alias("unpriced"), F.count_if(F.col("__live").isNull()).alias("uncategorised"))
    j = receipts.select("receipt_id", "receipt_date").join(per, "receipt_id", "left")
    message = (
        F.when(F.col("receipt_date").isNull(), "Select a receipt date.").when(F.coalesce("n", F.lit(0)) == 0, "Add at least one receipt item.")
        .when(F.col("unnamed") > 0, "Every item needs a name.").when(F.col("unpriced") > 0, "Every item needs a valid positive price.")
        .when(F.col("uncategorised") > 0, "Every item needs an active category.")
    )
    return j.select("receipt_id", message.alias("message")).filter(F.col("message").isNotNull())


def foreign_key(child: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Child keys without a parent, with the number of rows that carry them."""
    keys = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n_rows"))
    lost = keys.join(parent.select(F.col(key).alias("k")), "k", "left_anti")
    return lost.select(F.lit(name).alias("violation"), F.col("k").cast("string").alias("value"), "n_rows")


def unique_key(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Keys found more than once."""
    dup = df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)
    return dup.select(F.lit(name).alias("violation"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("value"), "n_rows")


def enum_domain(df: DataFrame, column: str, allowed: Sequence[str], name: str) -> DataFrame:
    """Values outside an enum's domain."""
    bad = df.filter(~F.col(column).isin(list(allowed)) | F.col(column).isNull()).groupBy(column).agg(F.count("*").alias("n_rows"))
    return bad.select(F.lit(name).alias("violation"), F.col(column).alias("value"), "n_rows")


def check_integrity(checks: Sequence[DataFrame]) -> DataFrame:
    """All findings of foreign-key, unique-key and enum checks in one frame."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def check_identifiers(identifiers: DataFrame) -> DataFrame:
    """Blank identifiers, and values repeated within (item, type) after trimming."""
    value = F.trim("value")
    blank = identifiers.filter(value == "").groupBy("asset_id", "identifier_type").agg(F.count("*").alias("n_rows")).select(
        "asset_id", "identifier_type", F.lit("").alias("value"), F.lit("Enter an identifier value.").alias("violation"), "n_rows")
    dup = identifiers.filter(value != "").groupBy("asset_id", "identifier_type", value.alias("value")).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
    return blank.unionByName(dup.select("asset_id", "identifier_type", "value", F.lit("This identifier is already added.").alias("violation"), "n_rows"))


def check_active(parts: DataFrame, cats: DataFrame) -> DataFrame:
    """Expense parts whose category is missing or archived."""
    live = cats.filter(~F.col("is_archived")).select("category_id")
    return parts.join(live, "category_id", "left_anti")


def check_paths(documents: DataFrame) -> DataFrame:
    """Documents stored outside the private folder or with a parent step in their path."""
    slashed = F.translate("stored_path", "\\", "/")
    return documents.filter(~(slashed.startswith("assets/documents/") & ~F.col("stored_path").contains("..")))


def check_debts(debts: DataFrame) -> DataFrame:
    """Definitions without a title or principal, or repaying less than the principal; commitments without amount."""
    fixed = (F.col("financing_type") == "FIXED_TOTAL") & (F.col("total_repayable_minor") < F.col("original_principal_minor"))
    return _explain(debts, "profile_id", {
        "blank title": F.trim("title") == "",
        "principal not positive": F.col("original_principal_minor") <= 0,
        "repayable below principal": fixed,
        "amount not positive": F.col("amount_minor") <= 0,
    })
