"""State changes as batch jobs: a snapshot and a command batch in, new frames out.

Commands carry ``ts`` and a unique ``seq``. Jobs that produce several frames
return them in a dict. Ids of created rows derive from their keys, so a re-run
of a batch produces the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import assets as A
from tallyspark.operators import obligations as O
from tallyspark.operators.quality import checkpoint_violation, rule_violation
from tallyspark.plans import keyed
from tallyspark.sources.category_data import MERCHANT_DIRECTORY


def _latest(cmds: DataFrame, keys: Sequence[str]) -> DataFrame:
    return keyed.latest_command(cmds, keys, [F.desc("seq")])


def _present(c: str) -> Column:
    return text.none_if_blank(F.trim(F.col(c)))


# --- learning ----------------------------------------------------------------


CONFIRMED = ["owner_id", "normalized_item", "mk"]


def _merchant_mark() -> Column:
    """A null merchant is a key of its own: carried as a marker through the joins."""
    return F.concat(F.when(F.col("normalized_merchant").isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce("normalized_merchant", F.lit("")))


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A join on keys that may be null; they stay once, of either side."""
    other = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    j = left.join(other, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], how)
    return j.withColumns({k: F.coalesce(k, f"__{k}") for k in keys}).drop(*[f"__{k}" for k in keys])


def confirmation_runs(cmds: DataFrame) -> DataFrame:
    """What commands say of each key: ``win`` (last category, its last time and number), ``switched`` (the last time of any other
    category, null without one), ``run`` (confirmations since then) and ``first`` (first time).

    Each command is for the generic key and, if it names a merchant, for the merchant's. Only the last run of equal
    categories matters: it starts after the last command of any other category, so this is two combinable aggregations
    instead of a scan of each key in order. Commands of one time and number are ordered by category.
    """
    both = F.when(F.col("normalized_merchant").isNull(), F.array(F.lit(None).cast("string"))).otherwise(
        F.array(F.lit(None).cast("string"), F.col("normalized_merchant"))
    )
    rows = cmds.filter(F.trim("normalized_item") != "").select(
        "owner_id", "normalized_item", F.explode(both).alias("normalized_merchant"), "category_id", F.struct("ts", "seq", "category_id").alias("at")
    )
    rows, kk = rows.withColumn("mk", _merchant_mark()), CONFIRMED
    per_cat = rows.groupBy(*kk, "category_id").agg(F.max("at").alias("last"), F.min("at").alias("first"), F.count("*").alias("n"))
    ranked = keyed.top_per_key(per_cat, kk, [F.desc("last")], 2, rank="r")
    ends = ranked.groupBy(*kk).agg(
        F.max(F.when(F.col("r") == 1, F.struct("category_id", "last", "n"))).alias("win"), F.max(F.when(F.col("r") == 2, F.col("last"))).alias("switched")
    )
    first = per_cat.groupBy(*kk).agg(F.min("first").alias("first"))
    ends = _meet(ends, first, kk, "inner")
    switched = ends.filter(F.col("switched").isNotNull()).select(*kk, F.col("win.category_id").alias("category_id"), "switched")
    run = _meet(rows.select(*kk, "category_id", "at"), switched, [*kk, "category_id"], "inner")
    run = run.filter(F.col("at") > F.col("switched")).groupBy(*kk).agg(F.count("*").alias("run"))
    return _meet(ends, run, kk, "left")


def advance_mappings(mappings: DataFrame, runs: DataFrame) -> DataFrame:
    """Mappings after the commands that ``runs`` sums up; ``is_touched`` marks those it names. Further columns of the mappings stay.

    A new key counts 1, the same category adds 1, another category switches and restarts at 1.
    """
    own = ["owner_id", "normalized_item", "normalized_merchant", "category_id", "confirmation_count", "created_at", "updated_at"]
    rest = [c for c in mappings.columns if c not in own]
    old = mappings.withColumn("mk", _merchant_mark()).select(
        *CONFIRMED, F.col("category_id").alias("o_cat"), F.col("confirmation_count").alias("o_n"), F.col("created_at").alias("o_created"), F.col("updated_at").alias("o_updated"), *rest
    )
    j = _meet(old, runs, CONFIRMED, "full_outer")
    same = F.col("o_cat") == F.col("win.category_id")
    count = (
        F.when(F.col("win").isNull(), F.col("o_n")).when(F.col("switched").isNotNull(), F.col("run"))
        .when(same, F.col("o_n") + F.col("win.n")).otherwise(F.col("win.n"))
    )
    return j.select(
        "owner_id", "normalized_item", F.when(F.substring("mk", 1, 1) == "+", F.expr("substring(mk, 2)")).alias("normalized_merchant"),
        F.coalesce("win.category_id", "o_cat").alias("category_id"), count.alias("confirmation_count"),
        F.coalesce("o_created", "first.ts").alias("created_at"), F.coalesce("win.last.ts", "o_updated").alias("updated_at"), F.col("win").isNotNull().alias("is_touched"), *rest,
    )


def fold_confirmations(mappings: DataFrame, cmds: DataFrame) -> DataFrame:
    """Confirmations folded into the learned mappings."""
    return advance_mappings(mappings, confirmation_runs(cmds)).drop("is_touched")


def fold_merchant_use(merchants: DataFrame, uses: DataFrame) -> DataFrame:
    """Uses folded into their owner's merchants: count, last use, latest name and category; unknown names are added."""
    keys = ["owner_id", "normalized_name"]
    clean = F.trim(F.regexp_replace("merchant_name", r"\s+", " "))
    rows = uses.filter(clean != "").select("owner_id", text.normalize_merchant(clean).alias("normalized_name"), clean.alias("shown"), "category_id", "used_at", "seq")
    new = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.struct("used_at", "seq", "shown", "category_id")).alias("last"))
    m = merchants.select(*keys, "display_name", "usage_count", "last_used_at", "default_category_id", "source")
    j = m.join(new, keys, "full_outer")
    used = F.col("n").isNotNull()
    return j.select(
        *keys, F.coalesce("last.shown", "display_name").alias("display_name"),
        (F.coalesce("usage_count", F.lit(0).cast("long")) + F.coalesce("n", F.lit(0).cast("long"))).alias("usage_count"),
        F.coalesce("last.used_at", "last_used_at").alias("last_used_at"), F.coalesce("last.category_id", "default_category_id").alias("default_category_id"),
        F.when(used, F.lit("USER")).otherwise(F.col("source")).alias("source"),
    )


def seed_merchants(merchants: DataFrame, cats: DataFrame, directory: Sequence[tuple[str, str | None]] = tuple(MERCHANT_DIRECTORY)) -> DataFrame:
    """The directory's merchants that an owner does not know yet, added with that owner's default category by name.

    Owners are those of ``merchants`` and ``cats``; each gets the directory, a fixed list.
    """
    keys = ["owner_id", "normalized_name"]
    owners = merchants.select("owner_id").union(cats.select("owner_id")).distinct()
    listed = F.array(*[F.struct(F.lit(n).alias("display_name"), F.lit(c).cast("string").alias("category_name")) for n, c in directory])
    seeds = owners.select("owner_id", F.explode(listed).alias("s")).select("owner_id", "s.*")
    seeds = seeds.withColumn("normalized_name", text.normalize_merchant(F.col("display_name")))
    ids = cats.select("owner_id", F.col("name").alias("category_name"), F.col("category_id").alias("default_category_id"))
    fresh = seeds.join(merchants.select(*keys), keys, "left_anti").join(ids, ["owner_id", "category_name"], "left")
    zero = F.lit(0).cast("long")
    fresh = fresh.select(*keys, "display_name", zero.alias("usage_count"), zero.alias("last_used_at"), "default_category_id", F.lit("SEEDED").alias("source"))
    return merchants.select(*fresh.columns).unionByName(fresh)


# --- commitments and debts ---------------------------------------------------


def apply_status(overrides: DataFrame, cmds: DataFrame, commitments: DataFrame) -> dict[str, DataFrame]:
    """Occurrence statuses after all commands of each (commitment, due date), in ``seq`` order.

    The first PAID with ``create_expense`` while no transaction is linked makes one
    expense, whatever follows; the link stays. ``paid_at`` belongs to the last run
    of PAID commands: the expense's time if it is made there, else the time kept
    from before or that of the run's first command. All parts are aggregates.
    """
    keys = ["commitment_id", "due_date"]
    c = commitments.select("commitment_id", "owner_id", "title", "amount_minor", "merchant_id")
    rows = cmds.join(c.select("commitment_id"), "commitment_id", "left_semi")
    pays = F.col("status") == "PAID"
    ends = rows.groupBy(*keys).agg(
        F.max(F.struct("seq", "status")).alias("last"), F.max(F.when(~pays, F.col("seq"))).alias("other"),
        F.min(F.when(pays & F.col("create_expense"), F.struct("seq", "ts"))).alias("make"))
    run = rows.filter(pays).join(ends.select(*keys, "other"), keys).filter(F.col("other").isNull() | (F.col("seq") > F.col("other")))
    run = run.groupBy(*keys).agg(F.min(F.struct("seq", "ts")).alias("run"))
    old = overrides.select(*keys, F.col("paid_tx_id").alias("o_tx"), F.col("paid_at").alias("o_at"))
    j = ends.join(run, keys, "left").join(old, keys, "left").join(c, "commitment_id")
    makes = F.col("make").isNotNull() & F.col("o_tx").isNull()
    made_id = F.concat(F.lit("commitment-"), F.col("commitment_id").cast("string"), F.lit("-"), F.col("due_date").cast("string"))
    j = j.withColumn("new_tx", F.when(makes, made_id))
    in_run = F.col("new_tx").isNotNull() & (F.col("other").isNull() | (F.col("make.seq") > F.col("other")))
    kept = F.coalesce(F.when(F.col("other").isNull(), F.col("o_at")), F.col("run.ts"))
    paid_at = F.when(F.col("last.status") == "PAID", F.when(in_run, F.col("make.ts")).otherwise(kept))
    changed = j.select("owner_id", *keys, F.col("last.status").alias("status"), F.coalesce("new_tx", "o_tx").alias("paid_tx_id"), paid_at.alias("paid_at"))
    expenses = j.filter(F.col("new_tx").isNotNull()).select(
        "owner_id", F.col("new_tx").alias("tx_id"), F.lit("EXPENSE").alias("type"), "amount_minor", "merchant_id",
        F.concat(F.lit("Commitment: "), F.col("title")).alias("note"), F.col("due_date").alias("tx_date"),
    )
    snapshot = overrides.select(*changed.columns)
    return {"overrides": keyed.merge(snapshot, changed, keys, "REPLACE"), "transactions": expenses}


def apply_payments(
    payments: DataFrame, cmds: DataFrame, profiles: DataFrame, commitments: DataFrame, overrides: DataFrame
) -> dict[str, DataFrame]:
    """Valid debt payments recorded once per idempotency key, with expenses and occurrence statuses.

    An occurrence becomes PAID when its allocation reaches the instalment,
    unless it is SKIPPED.
    """
    parts = [F.col(c) for c in ("principal_minor", "financing_minor", "late_minor")]
    valid = (F.col("total_minor") > 0) & (F.col("total_minor") == parts[0] + parts[1] + parts[2])
    for p in parts:
        valid = valid & (p >= 0)
    first = keyed.top_per_key(cmds.filter(valid), ["idempotency_key"], [F.asc("seq")], 1)
    fresh = first.join(payments.select("idempotency_key"), "idempotency_key", "left_anti")
    defs = profiles.select("profile_id", "commitment_id", "creditor_name").join(
        commitments.select("commitment_id", "title", F.col("amount_minor").alias("instalment"), "merchant_id"), "commitment_id")
    fresh = fresh.join(defs, "profile_id").withColumn("linked_tx_id", F.when(F.col("create_expense"), F.concat(F.lit("payment-"), F.col("idempotency_key"))))
    cols = ["profile_id", "owner_id", "idempotency_key", "due_date", "payment_date", "total_minor", "principal_minor", "financing_minor", "late_minor", "linked_tx_id"]
    old = payments.withColumn("linked_tx_id", F.lit(None).cast("string")) if "linked_tx_id" not in payments.columns else payments
    all_payments = old.select(*cols).unionByName(fresh.select(*cols))
    expenses = fresh.filter("create_expense").select(
        "owner_id", F.col("linked_tx_id").alias("tx_id"), F.lit("EXPENSE").alias("type"), F.col("total_minor").alias("amount_minor"), "merchant_id",
        F.concat(F.lit("Debt payment: "), F.col("title")).alias("note"), F.col("payment_date").alias("tx_date"),
    )
    touched = fresh.filter(F.col("due_date").isNotNull()).groupBy("owner_id", "profile_id", "commitment_id", "due_date").agg(
        F.max("instalment").alias("instalment"), F.max("ts").alias("now"), F.min(F.when(F.col("linked_tx_id").isNotNull(), F.struct("seq", "linked_tx_id"))).alias("tx")
    )
    paid = O.allocated(all_payments)
    ov = overrides.select("commitment_id", "due_date", F.col("status").alias("o_status"), F.col("paid_tx_id").alias("o_tx"))
    j = touched.join(paid, ["profile_id", "due_date"], "left").join(ov, ["commitment_id", "due_date"], "left")
    j = j.filter(F.coalesce("o_status", F.lit("UNPAID")) != "SKIPPED")
    full = F.col("allocated_minor") >= F.col("instalment")
    changed = j.select(
        "owner_id", "commitment_id", "due_date", F.when(full, "PAID").otherwise("UNPAID").alias("status"),
        F.coalesce("o_tx", "tx.linked_tx_id").alias("paid_tx_id"), F.when(full, F.col("now")).alias("paid_at"),
    )
    merged = keyed.merge(overrides.select(*changed.columns), changed, ["commitment_id", "due_date"], "REPLACE")
    return {"payments": all_payments, "transactions": expenses, "overrides": merged}


def apply_debt_defs(profiles: DataFrame, terms: DataFrame, rules: DataFrame, defs: DataFrame) -> dict[str, DataFrame]:
    """Debt definitions saved: canonical, validated, creation kept; absent terms or rule are deleted.

    ``defs`` has the columns of ``profiles`` plus title, amount_minor, frequency,
    next_due_date, end_date and the nullable structs ``terms`` and ``late_rule``.
    """
    canon = O.canonical_debt(_latest(defs, ["commitment_id"]))
    t = F.col("terms")
    enough = t.isNull() | (t["financing_type"] != "FIXED_TOTAL") | t["total_repayable_minor"].isNull() | (t["total_repayable_minor"] >= F.col("original_principal_minor"))
    ok = canon.filter(F.col("violation").isNull() & (F.trim("title") != "") & (F.col("original_principal_minor") > 0) & enough)
    ids = profiles.select("commitment_id", F.col("profile_id").alias("o_id"), F.col("created_at").alias("o_created"), F.col("is_archived").alias("o_archived"))
    j = ok.join(ids, "commitment_id", "left")
    saved = j.withColumns({
        "profile_id": F.coalesce("o_id", "profile_id"), "created_at": F.coalesce("o_created", "ts"), "updated_at": F.col("ts"),
        "is_archived": F.coalesce("o_archived", F.lit(False)), "creditor_name": _present("creditor_name"),
    })
    keep = lambda df: df.join(saved.select("profile_id"), "profile_id", "left_anti")
    put = lambda name, df: keep(df).unionByName(
        saved.filter(F.col(name).isNotNull()).select("profile_id", f"{name}.*").select(*df.columns))
    return {
        "profiles": keyed.merge(profiles, saved.select(*profiles.columns), ["commitment_id"], "REPLACE"),
        "terms": put("terms", terms), "rules": put("late_rule", rules),
        "commitments": saved.select("commitment_id", "title", "amount_minor", "frequency", "next_due_date", "end_date"),
    }


def archive_debts(profiles: DataFrame, commitments: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Profiles archived and their commitments deactivated."""
    hit = ids.select("profile_id").distinct().withColumn("__hit", F.lit(True))
    p = profiles.join(hit, "profile_id", "left")
    gone = p.filter(F.col("__hit")).select("commitment_id").distinct().withColumn("__gone", F.lit(True))
    c = commitments.join(gone, "commitment_id", "left").withColumn("is_active", F.col("is_active") & F.col("__gone").isNull()).drop("__gone")
    return {"profiles": p.withColumn("is_archived", F.col("is_archived") | F.col("__hit").isNotNull()).drop("__hit"), "commitments": c}


def upsert_commitments(commitments: DataFrame, cmds: DataFrame) -> dict[str, DataFrame]:
    """Commitments inserted or replaced; a blank title or non-positive amount is rejected."""
    ok = (F.trim("title") != "") & (F.col("amount_minor") > 0)
    good = cmds.filter(ok)
    return {
        "commitments": keyed.merge(commitments, good, ["commitment_id"], "REPLACE", [F.desc("seq")]),
        "rejected": cmds.filter(~F.coalesce(ok, F.lit(False))),
    }


# --- items -------------------------------------------------------------------


def accepted_in_order(rows: DataFrame) -> DataFrame:
    """Maintenance commands that are accepted when each item's are taken in ``seq`` order.

    ``rows`` has passed every check that does not depend on other commands. A key
    that is already accepted is done; a mileage below the highest accepted one is
    refused, and the key may be tried again. Rows are sorted into their item and
    streamed, so a task holds one item's reading and keys only.
    """
    dealt = rows.repartition("asset_id").sortWithinPartitions("asset_id", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item, high, keys = None, None, set()
        for batch in batches:
            take = []
            for asset, now, km, key in zip(batch["asset_id"], batch["current_km"], batch["km"], batch["idempotency_key"], strict=True):
                if asset != item:
                    item, high, keys = asset, None if pd.isna(now) else now, set()
                ok = key not in keys and (pd.isna(km) or (km >= 0 and (high is None or km >= high)))
                take.append(ok)
                if ok:
                    keys.add(key)
                    if not pd.isna(km):
                        high = km
            yield batch[take]

    return dealt.mapInPandas(run, dealt.schema)


def apply_maintenance(events: DataFrame, cmds: DataFrame, assets: DataFrame, rules: DataFrame, categories: DataFrame) -> dict[str, DataFrame]:
    """Maintenance completions: valid ones, once per idempotency key, optional expense, mileage only upward.

    Invalid tries do not use up their key and leave the mileage alone. The
    category of an expense must be active.
    """
    fresh = cmds.join(events.select("idempotency_key"), "idempotency_key", "left_anti")
    a = assets.select("asset_id", "owner_id", "current_km", F.col("is_archived").alias("__arch"))
    r = rules.select("rule_id", F.col("asset_id").alias("__r_asset"), F.col("is_active").alias("__r_active"), "trigger_type")
    c = categories.filter(~F.col("is_archived")).select("category_id", F.lit(True).alias("__usable")).distinct()
    j = fresh.join(a, "asset_id").join(r, "rule_id", "left").join(c, "category_id", "left")
    rule_ok = F.col("rule_id").isNull() | ((F.col("__r_asset") == F.col("asset_id")) & F.col("__r_active"))
    needs_km = F.coalesce(F.col("trigger_type") != "TIME", F.lit(False))
    cost_ok = F.col("cost_minor").isNull() | (F.col("cost_minor") > 0)
    pays = ~F.col("create_expense") | ((F.col("cost_minor") > 0) & F.coalesce("__usable", F.lit(False)))
    ok = ~F.col("__arch") & rule_ok & (F.trim("title") != "") & cost_ok & (~needs_km | F.col("km").isNotNull()) & pays
    good = j.filter(F.coalesce(ok, F.lit(False))).select("asset_id", "owner_id", "rule_id", "title", "event_date", "km", "cost_minor", "create_expense", "category_id", "idempotency_key", "seq", "current_km")
    done = accepted_in_order(good)
    done = keyed.top_per_key(done, ["idempotency_key"], [F.asc("seq")], 1).withColumn(
        "linked_tx_id", F.when(F.col("create_expense"), F.concat(F.lit("maintenance-"), F.col("idempotency_key").cast("string"))))
    cols = ["asset_id", "rule_id", "event_date", "km", "cost_minor", "linked_tx_id", "idempotency_key"]
    expenses = done.filter("create_expense").select(
        "owner_id", F.col("linked_tx_id").alias("tx_id"), F.lit("EXPENSE").alias("type"), F.col("cost_minor").alias("amount_minor"), "category_id",
        F.col("title").alias("note"), F.col("event_date").alias("tx_date"))
    links = done.filter("create_expense").select("asset_id", F.col("linked_tx_id").alias("tx_id"), F.lit("MAINTENANCE").alias("relation"))
    high = done.groupBy("asset_id").agg(F.max("km").alias("__km"))
    moved = assets.join(high, "asset_id", "left").withColumn("current_km", F.greatest("current_km", "__km")).drop("__km")
    return {"events": events.select(*cols).unionByName(done.select(*cols)), "transactions": expenses, "links": links, "assets": moved}


def complete_checkpoints(checkpoints: DataFrame, cmds: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """Every valid completion of an active checkpoint, in ``seq`` order, with the due point it satisfied.

    The first one answers the current due point. It clears the reschedule and ends
    a checkpoint that does not repeat; the due point of a later one comes from the
    newest event so far, recorded or of this batch.
    """
    live = checkpoints.filter("is_active").join(A.latest_event(events, "checkpoint_id"), "checkpoint_id", "left").select(
        "checkpoint_id", F.col("due_date").alias("own_date"), F.col("due_km").alias("own_km"), "repeat_months", "repeat_km", "rescheduled_date", "rescheduled_km",
        F.when(F.col("last_event_id").isNotNull(), F.struct(F.col("last_date").alias("event_date"), F.lit(0).alias("turn"), F.col("last_km").alias("km"))).alias("recorded"))
    j = cmds.join(live, "checkpoint_id").filter(F.col("repeat_km").isNull() | (F.col("km") >= 0))
    order = Window.partitionBy("checkpoint_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("turn", F.row_number().over(order))
    at = F.struct("event_date", "turn", F.col("km").cast("long").alias("km"))
    j = j.withColumn("newest", F.greatest("recorded", F.max(at).over(before)))
    repeats = F.col("repeat_months").isNotNull() | F.col("repeat_km").isNotNull()
    j = j.filter((F.col("turn") == 1) | repeats)
    first, done = F.col("turn") == 1, F.col("newest").isNotNull()
    date = F.when(done, F.add_months(F.col("newest.event_date"), F.col("repeat_months"))).otherwise(F.col("own_date"))
    km = F.when(done, F.col("newest.km") + F.col("repeat_km")).otherwise(F.col("own_km"))
    made = j.select(
        "checkpoint_id", F.concat(F.lit("completion-"), F.col("seq").cast("string")).alias("event_id"), "event_date", "km",
        F.coalesce(F.when(first, F.col("rescheduled_date")), date).alias("due_date"), F.coalesce(F.when(first, F.col("rescheduled_km")), km).alias("due_km"),
        _present("note").alias("note"), F.col("ts").alias("created_at"))
    hit = made.select("checkpoint_id").distinct().withColumn("__hit", F.lit(True))
    x = checkpoints.join(hit, "checkpoint_id", "left")
    answered = F.col("__hit").isNotNull()
    after = x.withColumns({
        "is_active": F.when(answered, repeats).otherwise(F.col("is_active")),
        "rescheduled_date": F.when(~answered, F.col("rescheduled_date")), "rescheduled_km": F.when(~answered, F.col("rescheduled_km")),
    }).drop("__hit")
    return {"events": made, "checkpoints": after}


def edit_checkpoints(checkpoints: DataFrame, edits: DataFrame, events: DataFrame, rules: DataFrame, assets: DataFrame) -> dict[str, DataFrame]:
    """All checkpoints after the edits, new ones included, and the reminder rule deltas.

    Edits that break a checkpoint rule, belong to an archived or another item, are
    refused; of the others the last of a checkpoint counts. A changed due point
    becomes a reschedule, a changed trigger clears it. An edit without an id, or
    with one that is not known, is a new checkpoint. A changed warning disables the
    old lead and enables the new one, for checkpoints that already have rules.
    """
    # Dealt, not broadcast: Spark takes the keys for as small as their packed file.
    live = assets.filter(~F.col("is_archived")).select("asset_id").hint("merge")
    sound = edits.filter(checkpoint_violation().isNull()).join(live, "asset_id", "left_semi").withColumn("title", F.trim("title"))
    made_id = F.coalesce(F.when(F.col("checkpoint_id") != 0, F.col("checkpoint_id")), F.abs(F.xxhash64("asset_id", "title", "seq") % 2**62))
    known = checkpoints.select("checkpoint_id").hint("merge")
    none = F.lit(None)
    new = sound.withColumn("checkpoint_id", made_id).join(known, "checkpoint_id", "left_anti")
    new = _latest(new, ["checkpoint_id"]).withColumns({c: none.cast(checkpoints.schema[c].dataType) for c in ("rescheduled_date", "rescheduled_km")})
    old = A.checkpoint_due(checkpoints, events)
    cols = ["trigger_mode", "due_date", "due_km", "warning_days", "warning_km", "rescheduled_date", "rescheduled_km", "asset_id", "next_date", "next_km"]
    own = sound.join(old.select("checkpoint_id", *[F.col(c).alias(f"o_{c}") for c in cols]), "checkpoint_id").filter(F.col("asset_id") == F.col("o_asset_id"))
    j = _latest(own, ["checkpoint_id"])
    switched = F.col("trigger_mode") != F.col("o_trigger_mode")
    moved = lambda new, cur, kept: F.coalesce(F.when(~new.eqNullSafe(cur), new), kept)
    changed = j.withColumns({
        "due_date": F.when(switched, F.col("due_date")).otherwise(F.col("o_due_date")), "due_km": F.when(switched, F.col("due_km")).otherwise(F.col("o_due_km")),
        "rescheduled_date": F.when(~switched, moved(F.col("due_date"), F.col("o_next_date"), F.col("o_rescheduled_date"))),
        "rescheduled_km": F.when(~switched, moved(F.col("due_km"), F.col("o_next_km"), F.col("o_rescheduled_km"))),
    })
    names = checkpoints.columns
    edited = keyed.merge(checkpoints, changed.select(*names).unionByName(new.select(*names)), ["checkpoint_id"], "REPLACE")
    with_rules = rules.filter(F.col("source_type") == "CHECKPOINT").select(F.col("source_id").alias("checkpoint_id")).distinct()
    k = j.join(with_rules, "checkpoint_id", "left_semi")
    by_day = lambda c, mode: F.when(F.col(mode) != "MILEAGE", F.col(c).cast("long"))
    by_km = lambda c, mode: F.when(F.col(mode) != "DATE", F.col(c).cast("long"))
    pair = lambda kind, o, n: F.struct(F.lit(kind).alias("trigger_kind"), o.alias("old"), n.alias("new"))
    k = k.select("checkpoint_id", "asset_id", F.explode(F.array(
        pair("DAYS_BEFORE", by_day("o_warning_days", "o_trigger_mode"), by_day("warning_days", "trigger_mode")),
        pair("KM_BEFORE", by_km("o_warning_km", "o_trigger_mode"), by_km("warning_km", "trigger_mode")))).alias("w"))
    k = k.filter(~F.col("w.old").eqNullSafe(F.col("w.new")))
    delta = F.filter(F.array(
        F.when(F.col("w.old").isNotNull(), F.struct(F.col("w.old").alias("lead_value"), F.lit(False).alias("is_enabled"))),
        F.when(F.col("w.new") > 0, F.struct(F.col("w.new").alias("lead_value"), F.lit(True).alias("is_enabled")))), lambda x: x.isNotNull())
    deltas = k.select(F.lit("CHECKPOINT").alias("source_type"), F.col("checkpoint_id").alias("source_id"), "asset_id", "w.trigger_kind", F.explode(delta).alias("d")).select(
        "source_type", "source_id", "asset_id", "trigger_kind", "d.*")
    return {"checkpoints": edited, "rule_deltas": deltas}


def apply_ownership(assets: DataFrame, cmds: DataFrame) -> dict[str, DataFrame]:
    """Ownership changes: repeats of the current status are dropped, others logged and applied.

    Commands are dealt by item once, for the join and for the status before each
    of them; an item's history passes in order with one row held. Items are dealt
    too, not broadcast: their keys alone are more than a driver can hold.
    """
    now = assets.filter(~F.col("is_archived")).select("asset_id", F.col("ownership_status").alias("__now"))
    before = F.lag("status").over(Window.partitionBy("asset_id").orderBy("ts", "seq", "status"))
    rows = cmds.join(now.hint("merge"), "asset_id").withColumn("__before", before)
    log = rows.filter(F.col("status") != F.coalesce(F.col("__before"), F.col("__now"))).select(
        "asset_id", "status", "effective_date", text.none_if_blank(F.trim("note")).alias("note"), F.col("ts").alias("created_at"), "seq")
    last = cmds.groupBy("asset_id").agg(F.max(F.struct("ts", "seq", "status")).alias("__l")).select("asset_id", F.col("__l.status").alias("__new"))
    moved = assets.join(last, "asset_id", "left").withColumn(
        "ownership_status", F.when(~F.col("is_archived"), F.coalesce("__new", "ownership_status")).otherwise(F.col("ownership_status"))).drop("__new")
    return {"events": log, "assets": moved}


def configure_rules(rules: DataFrame, desired: DataFrame) -> DataFrame:
    """Reminder rules after configuration: flags set per source, missing options added.

    ``desired`` lists the available options of each configured source with the
    wanted flag; existing rules of such a source outside it are switched off.
    """
    keys = ["source_type", "source_id", "trigger_kind", "lead_value"]
    d = desired.select("asset_id", *keys, F.col("is_enabled").alias("__want"))
    sources = desired.select("source_type", "source_id").distinct().withColumn("__touched", F.lit(True))
    r = rules.select(*keys, F.col("asset_id").alias("__asset"), "is_enabled").join(sources, ["source_type", "source_id"], "left")
    j = r.join(d, keys, "full_outer")
    flag = F.when(F.col("__want").isNotNull(), F.col("__want")).when(F.col("__touched"), F.lit(False)).otherwise(F.col("is_enabled"))
    return j.select(F.coalesce("__asset", "asset_id").alias("asset_id"), *keys, flag.alias("is_enabled"))


def apply_rules(rules: DataFrame, cmds: DataFrame) -> dict[str, DataFrame]:
    """Maintenance rules saved or archived; item and kind cannot change and creation is kept.

    ``action`` is SAVE or ARCHIVE.
    """
    won = _latest(cmds, ["rule_id"])
    old = rules.select("rule_id", F.col("asset_id").alias("o_asset"), F.col("kind").alias("o_kind"), F.col("created_at").alias("o_created"))
    j = won.join(old, "rule_id", "left")
    known = F.col("o_asset").isNotNull()
    broken = rule_violation()
    mismatch = known & ((F.col("o_asset") != F.col("asset_id")) | ((F.col("action") == "SAVE") & (F.col("o_kind") != F.col("kind"))))
    why = (
        F.when(mismatch, F.lit("Item and kind cannot change"))
        .when((F.col("action") == "ARCHIVE") & ~known, F.lit("Unknown rule")).when(F.col("action") == "SAVE", broken)
    )
    j = j.withColumn("violation", why)
    good = j.filter(F.col("violation").isNull())
    saved = good.filter(F.col("action") == "SAVE").withColumn("title", F.trim("title")).withColumn("created_at", F.coalesce("o_created", "created_at")).select(*rules.columns)
    gone = good.filter(F.col("action") == "ARCHIVE").select("rule_id").withColumn("__gone", F.lit(True))
    after = keyed.merge(rules, saved, ["rule_id"], "REPLACE").join(gone, "rule_id", "left")
    after = after.withColumn("is_active", F.col("is_active") & F.col("__gone").isNull()).drop("__gone").select(*rules.columns)
    return {"rules": after, "rejected": j.filter(F.col("violation").isNotNull()).select("rule_id", "action", "violation")}


# --- ledger ------------------------------------------------------------------


def to_minor(amount: Column) -> Column:
    """Legacy decimal amount to whole minor units."""
    return F.round(amount * 100).cast("long")


def post_purchases(parts: DataFrame) -> dict[str, DataFrame]:
    """Purchase parts as expense rows, and the category each purchase teaches.

    ``parts``: purchase_key, part_no, source (MANUAL or RECEIPT), owner, amount,
    category, note and date. Single-part manual purchases have no group; the
    group id is a hash of the key, so a re-run gives the same rows.
    """
    largest = F.max(F.struct("amount_minor", (-F.col("part_no")).alias("first"), "category_id"))
    per = parts.groupBy("purchase_key").agg(F.count("*").alias("__n"), largest.alias("__l"))
    learned = per.select("purchase_key", F.col("__l.category_id").alias("category_id"), F.col("__n").alias("n_parts"))
    j = parts.join(per.select("purchase_key", "__n"), "purchase_key")
    group = F.when((F.col("source") == "RECEIPT") | (F.col("__n") > 1), F.sha2("purchase_key", 256))
    rows = j.select(
        "owner_id", F.concat_ws("-", "purchase_key", F.col("part_no").cast("string")).alias("tx_id"), F.lit("EXPENSE").alias("type"), "amount_minor", "category_id",
        text.none_if_blank(F.col("note")).alias("note"), "tx_date", "source", (F.col("ts") + F.col("part_no")).alias("created_at"), group.alias("purchase_group_id"))
    return {"transactions": rows, "learned": learned}


def edit_categories(cats: DataFrame, cmds: DataFrame) -> DataFrame:
    """Renames and archivals of active CUSTOM categories.

    ``action`` is RENAME (with ``name``) or ARCHIVE; renames after the first
    archival have no effect.
    """
    end = cmds.filter(F.col("action") == "ARCHIVE").groupBy("category_id").agg(F.min("seq").alias("__end"))
    named = cmds.filter(F.col("action") == "RENAME").join(end, "category_id", "left").filter(F.col("__end").isNull() | (F.col("seq") < F.col("__end")))
    name = named.groupBy("category_id").agg(F.max(F.struct("seq", "name")).alias("__n")).select("category_id", F.col("__n.name").alias("__name"))
    j = cats.join(name, "category_id", "left").join(end, "category_id", "left")
    own = (F.col("type") == "CUSTOM") & ~F.col("is_archived")
    return j.select(
        "category_id", F.when(own, F.coalesce("__name", "name")).otherwise(F.col("name")).alias("name"), "type",
        (F.col("is_archived") | (own & F.col("__end").isNotNull())).alias("is_archived"))


def create_custom_types(types: DataFrame, names: DataFrame) -> DataFrame:
    """An owner's custom item types after creation: an archived one of that name is restored, an active one kept."""
    keys = ["owner_id", "key"]
    wanted = names.select("owner_id", F.trim(F.regexp_replace("name", r"\s+", " ")).alias("shown"), "seq").withColumn("key", text.normalize_type(F.col("shown")))
    wanted = keyed.top_per_key(wanted.filter(F.col("key") != ""), keys, [F.asc("seq")], 1).drop("seq")
    old = types.select("owner_id", text.normalize_type(F.col("name")).alias("key"), "name", "is_archived")
    j = old.join(wanted, keys, "full_outer")
    return j.select(*keys, F.coalesce("name", "shown").alias("name"), F.when(F.col("shown").isNotNull(), F.lit(False)).otherwise(F.col("is_archived")).alias("is_archived"))


def backfill_merchant_ids(tx: DataFrame, merchants: DataFrame) -> DataFrame:
    """Old transactions with their owner's merchant id by normalised name (expenses only) and receipt group."""
    m = merchants.select(F.col("owner_id").alias("__owner"), F.col("normalized_name").alias("__name"), F.col("merchant_id").alias("__id"))
    key = F.when(F.col("type") == "EXPENSE", F.lower(F.trim("merchant")))
    joined = tx.drop("merchant_id", "purchase_group_id").join(m, (F.col("owner_id") == F.col("__owner")) & (key == F.col("__name")), "left").drop("__name", "__owner")
    return joined.withColumnRenamed("__id", "merchant_id").withColumn("purchase_group_id", F.col("receipt_group_id"))
