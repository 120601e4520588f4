"""Plan shapes that stay balanced when one key holds a large share of the rows.

* ``top_per_key``   rank filter; Spark limits each key per input partition
  before the shuffle (WindowGroupLimit), so a hot key ships k rows per task.
* ``prefix_before`` / ``number_rows`` running values in two levels: a partial
  aggregate per (key, slot), a scan over the slots, and a scan inside a slot.
* ``merge``         keyed upsert of a command batch into a snapshot.
* ``month_spine`` / ``day_spine`` zero-fill calendars per owner.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.plans.session import work_folder

Order = Sequence[Column]


def top_per_key(df: DataFrame, keys: Sequence[str], order: Order, k: int = 1, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of every key under ``order``; ``rank`` keeps the position."""
    name = rank or "__rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row.

    A filter or projection on an ordinary alias gets the whole expression copied
    into every place that mentions it; costly text expressions are generated
    from a one-element array instead, which the optimizer does not copy.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def cut(df: DataFrame, label: str) -> DataFrame:
    """The frame written once to the work folder and read back.

    For results that several branches of a plan read: they scan the columns they
    need instead of recomputing the lineage, and a lost executor costs a re-read.
    """
    path = work_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_before(
    df: DataFrame, keys: Sequence[str], slot: str, order: Order, value: Column, out: str, how: str = "max"
) -> DataFrame:
    """Aggregate of ``value`` over all earlier rows of the key, in (slot, order) order.

    ``slot`` is a coarse ordering column (a date). The first level scans one row
    per (key, slot), the second only the rows inside a slot, so the work of a hot
    key is spread over its slots.
    """
    fn = {"max": F.max, "sum": F.sum}[how]
    slots = df.groupBy(*keys, slot).agg(fn(value).alias("__slot_value"))
    earlier = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.withColumn("__carried", fn("__slot_value").over(earlier)).drop("__slot_value")
    on = [df[c].eqNullSafe(carried[c]) for c in [*keys, slot]]
    inside = Window.partitionBy(*keys, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(carried, on, "left").select(df["*"], "__carried")
    local = fn(value).over(inside)
    if how == "max":
        return joined.withColumn(out, F.greatest("__carried", local)).drop("__carried")
    return joined.withColumn(
        out, F.coalesce("__carried", F.lit(0)) + F.coalesce(local, F.lit(0))
    ).drop("__carried")


def number_rows(df: DataFrame, keys: Sequence[str], slot: str, order: Order, out: str) -> DataFrame:
    """0-based position of each row in its key, in (slot, order) order."""
    return prefix_before(df, keys, slot, order, F.lit(1).cast("long"), out, how="sum")


def day_spine(owners: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """One row per owner and day of ``[start, end)``; ``owners`` must be distinct."""
    days = F.sequence(F.lit(start), F.date_sub(F.lit(end), 1))
    return owners.withColumn("day", F.explode(days))


def month_spine(owners: DataFrame, start: dt.date, months: int) -> DataFrame:
    """One row per owner and month start, ``months`` months from ``start``'s month."""
    steps = F.sequence(F.lit(0), F.lit(months - 1))
    first = F.trunc(F.lit(start), "month")
    return owners.withColumn("month", F.explode(F.transform(steps, lambda i: F.add_months(first, i))))


def latest_command(cmds: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """The winning command of every key (``order`` puts it first)."""
    return top_per_key(cmds, keys, order, 1)


def merge(
    snapshot: DataFrame, cmds: DataFrame, keys: Sequence[str], policy: str, order: Order | None = None
) -> DataFrame:
    """Apply a command batch to a snapshot with one keyed shuffle.

    Policies: INSERT (duplicate keys keep the snapshot row and are dropped, as
    IGNORE), IGNORE, REPLACE (command row wins, new keys are added), UPDATE
    (command row wins, unknown keys ignored) and DELETE. Commands carry the
    snapshot's columns; ``order`` picks the winner among commands of one key.
    """
    policy = policy.upper()
    if policy not in {"INSERT", "IGNORE", "REPLACE", "UPDATE", "DELETE"}:
        raise ValueError(f"unknown merge policy {policy}")
    cols = snapshot.columns
    won = latest_command(cmds, keys, order) if order else cmds.dropDuplicates(list(keys))
    if policy == "DELETE":
        gone = won.select(*keys)
        return snapshot.join(gone, [snapshot[k].eqNullSafe(gone[k]) for k in keys], "left_anti")
    s = snapshot.withColumn("__in_s", F.lit(True)).alias("s")
    c = won.select(*[x for x in cols if x in won.columns]).withColumn("__in_c", F.lit(True)).alias("c")
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    how = {"UPDATE": "left"}.get(policy, "full_outer")
    joined = s.join(c, on, how)
    present = set(won.columns)
    command_wins = F.col("c.__in_c").isNotNull()
    if policy in {"INSERT", "IGNORE"}:
        command_wins = F.col("s.__in_s").isNull()
    out = []
    for x in cols:
        if x in present:
            out.append(F.when(command_wins, F.col(f"c.{x}")).otherwise(F.col(f"s.{x}")).alias(x))
        else:
            out.append(F.col(f"s.{x}").alias(x))
    return joined.select(*out)


#: Bytes of a catalog that every executor may hold; beyond it rows and catalog meet in a shuffle.
BROADCAST_BYTES = 64 << 20


def attach_catalog(rows: DataFrame, catalog: DataFrame, salt_by: str, salts: int | None = None) -> DataFrame:
    """Give every row every catalog row, without a cross join.

    The catalog is a handful of packed rows. It is written once and its size
    measured there: up to ``BROADCAST_BYTES`` it is broadcast on a constant key and
    the rows stay where they are. Beyond that rows get a salt from ``salt_by`` and the catalog one copy
    per salt, as many as there are shuffle partitions.
    """
    catalog = cut(catalog, "catalog")
    held = catalog.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    if held <= BROADCAST_BYTES:
        one = rows.withColumn("__salt", F.lit(0))
        return one.join(F.broadcast(catalog.withColumn("__salt", F.lit(0))), "__salt").drop("__salt")
    salts = salts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    copies = catalog.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, "__salt").drop("__salt")


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "median", width: float = 1 / 4096, upper: bool = False
) -> DataFrame:
    """Exact median per key without gathering a key's values (``upper`` takes the upper middle of an even count).

    A histogram finds the bins that hold the middle ranks; only the distinct
    values of those bins are counted and scanned.
    """
    rows = df.select(*keys, F.col(value).alias("__v")).filter(F.col("__v").isNotNull()).withColumn("__bin", F.floor(F.col("__v") / width))
    bins = rows.groupBy(*keys, "__bin").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("__total", F.sum("__n").over(whole))
    bins = bins.withColumn("__r1", F.floor((F.col("__total") - 1) / 2)).withColumn("__r2", F.floor(F.col("__total") / 2))
    end = F.col("__before") + F.col("__n")
    holds = lambda r: (F.col(r) >= F.col("__before")) & (F.col(r) < end)
    middle = bins.filter(holds("__r1") | holds("__r2")).select(*keys, "__bin", "__before", "__r1", "__r2")
    values = rows.join(middle, [*keys, "__bin"]).groupBy(*keys, "__bin", "__before", "__r1", "__r2", "__v").agg(F.count("*").alias("__n"))
    inside = Window.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    end = F.col("__before") + F.col("__n")
    high = F.max(F.when(holds("__r2") & (F.col("__r2") < end), F.col("__v")))
    if upper:
        return values.groupBy(*keys).agg(high.alias(out))
    low = F.max(F.when(holds("__r1") & (F.col("__r1") < end), F.col("__v")))
    return values.groupBy(*keys).agg(((low + high) / 2).alias(out))
