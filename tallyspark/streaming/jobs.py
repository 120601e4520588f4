"""Structured Streaming counterparts of the jobs that are naturally incremental.

Every job takes a streaming frame and folders, and returns the started query. Replays are harmless: what a batch writes is
named after its batch id and depends on earlier batches only, and keyed state lives in the state store (RocksDB), where a
batch costs what it touches. Rows behind the watermark are kept in a table of their own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.functions import dates, text
from tallyspark.operators import changes
from tallyspark.sources.schemas import DRIVER_TABLES

DELAY = dt.timedelta(days=1)


def events_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The events table as a file stream."""
    return (
        spark.readStream.schema(DRIVER_TABLES["events"]).option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def ledger_stream(events: DataFrame) -> DataFrame:
    """Purchases as expenses and signups as income, in minor units."""
    kept = events.filter(F.col("event_type").isin("purchase", "signup"))
    return kept.select(
        F.col("user_id").alias("owner_id"), F.col("event_id").cast("string").alias("tx_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "purchase", "EXPENSE").otherwise("INCOME").alias("type"),
        F.round(F.col("value") * 100).cast("long").alias("amount_minor"), (F.col("event_id") % 7).alias("category_id"),
    )


# --- folders of batches ------------------------------------------------------


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Batch ids with a finished version below ``folder`` (a directory listing, not data)."""
    path, fs = _fs(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in names if n.startswith("v=") and fs.exists(_fs(spark, f"{folder}/{n}/_SUCCESS")[0])]
    return sorted(int(n[2:]) for n in done)


def read_state(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest finished version, or an empty frame."""
    ids = [v for v in _versions(spark, folder) if before is None or v < before]
    if not ids:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/v={ids[-1]}")


def read_versions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The union of all batch folders of a keyed sink."""
    ids = _versions(spark, folder)
    empty = spark.createDataFrame([], schema)
    if not ids:
        return empty
    return spark.read.schema(schema).option("basePath", folder).parquet(*[f"{folder}/v={v}" for v in ids]).select(empty.columns)


def read_latest(spark: SparkSession, folder: str, schema: str, keys: list[str]) -> DataFrame:
    """The last row of every key of a sink that holds, batch by batch, the keys that changed."""
    ids = _versions(spark, folder)
    empty = spark.createDataFrame([], schema)
    if not ids:
        return empty
    rows = spark.read.schema(f"{schema}, v BIGINT").option("basePath", folder).parquet(*[f"{folder}/v={v}" for v in ids])
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*empty.columns), "v").alias("last"))  # null keys are keys too
    return last.select("last.*")


# --- running totals with open days -------------------------------------------

TOTALS = "owner_id BIGINT, category_id BIGINT, amount_minor BIGINT, n_rows BIGINT"
LATE = "owner_id BIGINT, tx_id STRING, ts TIMESTAMP, category_id BIGINT, amount_minor BIGINT"
GRAINS = ("day", "month")


def _newest(spark: SparkSession, folder: str, grain: str, periods: list | None, before: int) -> dict[str, list[int]]:
    """Versions under ``before`` of each period's partition, ascending; of the given periods or all."""
    _, fs = _fs(spark, folder)
    which = "*" if periods is None else "{" + ",".join(str(p) for p in periods) + "}"
    found: dict[str, list[int]] = {}
    for status in fs.globStatus(_fs(spark, f"{folder}/{grain}={which}/v=*")[0]) or []:
        path = status.getPath()
        v = int(path.getName()[2:])
        if v < before:
            found.setdefault(path.getParent().getName().split("=", 1)[1], []).append(v)
    return {p: sorted(vs) for p, vs in found.items()}


def _read_newest(spark: SparkSession, folder: str, schema: str, grain: str, newest: dict[str, list[int]]) -> DataFrame:
    if not newest:
        return spark.createDataFrame([], schema)
    paths = [f"{folder}/{grain}={p}/v={vs[-1]}" for p, vs in sorted(newest.items())]
    return spark.read.schema(f"{schema}, v BIGINT").option("basePath", folder).parquet(*paths).drop("v")


def _read_periods(spark: SparkSession, folder: str, grain: str, newest: dict[str, list[int]]) -> DataFrame:
    return _read_newest(spark, folder, f"{TOTALS}, {grain} DATE", grain, newest)


def _forget(spark: SparkSession, folder: str, grain: str, old: dict[str, list[int]]) -> None:
    """Of the versions before the one just written, only the last stays."""
    for p, vs in old.items():
        for v in vs[:-1]:
            path, fs = _fs(spark, f"{folder}/{grain}={p}/v={v}")
            fs.delete(path, True)


def _upsert(spark: SparkSession, folder: str, grain: str, delta: DataFrame, batch_id: int) -> None:
    """The delta added to the partitions of its periods: each touched period gets a new version, the others are not read.

    The last two versions of a period stay, so that a replay of the batch finds what it began with.
    """
    keys = ["owner_id", "category_id", grain]
    periods = [r[0] for r in delta.select(grain).distinct().collect()]  # open periods only: as many as the delay lets be open
    if not periods:
        return
    old = _newest(spark, folder, grain, periods, batch_id)
    total = _read_periods(spark, folder, grain, old).select(*keys, "amount_minor", "n_rows").unionByName(delta.select(*keys, "amount_minor", "n_rows"))
    total = total.groupBy(*keys).agg(F.sum("amount_minor").alias("amount_minor"), F.sum("n_rows").alias("n_rows")).withColumn("v", F.lit(batch_id).cast("long"))
    total.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(grain, "v").parquet(folder)
    _forget(spark, folder, grain, old)


def stream_spend(tx: DataFrame, out: str, checkpoint: str, delay: dt.timedelta = DELAY) -> StreamingQuery:
    """Expense per owner, category and day and month, brought up to date by every batch.

    The watermark is the latest time of all earlier batches less ``delay``. Rows of days that it has passed go to
    ``out/late`` as they are and change no total; all others are added to the partitions of their days and months.
    ``out/progress`` is written last and holds what the next batch needs of this one. A null time is late.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = read_state(spark, f"{out}/progress", "seen BIGINT", before=batch_id).first()
        seen = seen["seen"] if seen else None
        rows = batch.filter(F.col("type") == "EXPENSE").withColumn("day", F.to_date("ts")).persist()
        try:
            ends = F.unix_micros(F.date_add("day", 1).cast("timestamp"))
            open_ = F.col("ts").isNotNull() if seen is None else F.coalesce(ends > seen - delay // dt.timedelta(microseconds=1), F.lit(False))
            late = rows.filter(~open_).select("owner_id", "tx_id", "ts", "category_id", "amount_minor")
            late.write.mode("overwrite").parquet(f"{out}/late/v={batch_id}")
            daily = rows.filter(open_).groupBy("owner_id", "category_id", "day").agg(F.sum("amount_minor").alias("amount_minor"), F.count("*").alias("n_rows")).persist()
            try:
                _upsert(spark, f"{out}/day", "day", daily, batch_id)
                _upsert(spark, f"{out}/month", "month", months_of(daily), batch_id)
            finally:
                daily.unpersist()
            latest = rows.agg(F.greatest(F.max(F.unix_micros("ts")), F.lit(seen).cast("long")).alias("seen"))
            latest.write.mode("overwrite").parquet(f"{out}/progress/v={batch_id}")
        finally:
            rows.unpersist()

    return tx.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def months_of(daily: DataFrame) -> DataFrame:
    """Month totals of days."""
    return daily.groupBy("owner_id", "category_id", dates.month_of(F.col("day")).alias("month")).agg(
        F.sum("amount_minor").alias("amount_minor"), F.sum("n_rows").alias("n_rows"))


def read_spend(spark: SparkSession, out: str, grain: str = "day") -> DataFrame:
    """Totals of all days or months after the last finished batch, without the late rows."""
    done = _versions(spark, f"{out}/progress")
    return _read_periods(spark, f"{out}/{grain}", grain, _newest(spark, f"{out}/{grain}", grain, None, done[-1] + 1 if done else 0))


def read_late(spark: SparkSession, out: str) -> DataFrame:
    """The rows behind the watermark of all finished batches."""
    return read_versions(spark, f"{out}/late", LATE)


# --- keyed state in the state store -------------------------------------------

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _with_state_store(df: DataFrame) -> DataFrame:
    for k, v in STATE_STORE.items():
        df.sparkSession.conf.set(k, v)
    return df


def _changes(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the keys that a batch has changed to a folder of its own."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/v={batch_id}")

    return df.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MERCHANT_STATE = "owner_id BIGINT, normalized_name STRING, display_name STRING, usage_count BIGINT, last_used_at BIGINT, default_category_id BIGINT, source STRING"
MERCHANT_KEYS = ["owner_id", "normalized_name"]
MAPPING_STATE = "owner_id BIGINT, normalized_item STRING, normalized_merchant STRING, category_id BIGINT, confirmation_count BIGINT, created_at BIGINT, updated_at BIGINT"
MAPPING_KEYS = ["owner_id", "normalized_item", "normalized_merchant"]


def stream_merchant_use(uses: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running merchant usage: count, last use, and name and category of the last use.

    Partial aggregates combine a batch before it meets the state, so a hot merchant is one row a task.
    """
    clean = F.trim(F.regexp_replace("merchant_name", r"\s+", " "))
    rows = _with_state_store(uses).filter(clean != "").select("owner_id", text.normalize_merchant(clean).alias("normalized_name"), clean.alias("shown"), "category_id", "used_at", "seq")
    running = rows.groupBy(*MERCHANT_KEYS).agg(F.count("*").alias("usage_count"), F.max(F.struct("used_at", "seq", "shown", "category_id")).alias("last"))
    return _changes(running.select(
        *MERCHANT_KEYS, F.col("last.shown").alias("display_name"), "usage_count", F.col("last.used_at").alias("last_used_at"), F.col("last.category_id").alias("default_category_id"), F.lit("USER").alias("source"),
    ), out, checkpoint)


# --- mappings in buckets ------------------------------------------------------

#: Parts of tables that are kept by hash of the key; a batch reads the parts its keys fall into.
BUCKETS = 256
MAPPED = f"{MAPPING_STATE}, touched_in BIGINT, seen_at BIGINT, bucket INT"


def stream_confirmations(cmds: DataFrame, out: str, checkpoint: str, keep: dt.timedelta | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Running mapping confirmations: a batch is summed up by key and meets the mappings of the buckets it touches.

    What came in an earlier batch was earlier; rows of a batch may come in any order. A touched bucket gets a new version in
    ``out/state``, of which the last two stay for a replay; the changed mappings go to the batch's folder. A command without a
    category confirms nothing. Mappings have no expiry unless ``keep`` is given: then one that nobody confirms for so long is
    forgotten, by the times of the batches.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    rows = cmds.filter(F.col("category_id").isNotNull()).select(
        long("owner_id"), "normalized_item", "normalized_merchant", long("category_id"), long("ts"), long("seq"), F.unix_millis(F.current_timestamp()).alias("now"))
    state = f"{out}/state"

    def bucket() -> Column:
        return F.pmod(F.xxhash64("owner_id", "normalized_item", "normalized_merchant"), F.lit(buckets)).cast("int").alias("bucket")

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = batch.select("now").first()  # the batch's time, one for all rows and the same in a replay
        runs = changes.confirmation_runs(batch).persist()
        try:
            merchant = F.when(F.substring("mk", 1, 1) == "+", F.expr("substring(mk, 2)")).alias("normalized_merchant")
            touched = [r["bucket"] for r in runs.select("owner_id", "normalized_item", merchant).select(bucket()).distinct().collect()]  # at most ``buckets``
            before = _newest(spark, state, "bucket", touched, batch_id) if touched else {}
            old = _read_newest(spark, state, MAPPED, "bucket", before)
            if keep is not None and now is not None:
                old = old.filter(F.col("seen_at") > now["now"] - keep // dt.timedelta(milliseconds=1))
            if touched:
                new = changes.advance_mappings(old.drop("bucket"), runs)
                hit = F.col("is_touched")
                new = new.withColumns({"touched_in": F.when(hit, F.lit(batch_id).cast("long")).otherwise(F.col("touched_in")), "seen_at": F.when(hit, F.lit(now["now"]).cast("long")).otherwise(F.col("seen_at"))})
                new.drop("is_touched").select("*", bucket(), F.lit(batch_id).cast("long").alias("v")).hint("rebalance", "bucket").write.mode("overwrite").option(
                    "partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(state)
            written = {str(b): [batch_id] for b in touched}
            _read_newest(spark, state, MAPPED, "bucket", written).filter(F.col("touched_in") == batch_id).drop("touched_in", "seen_at", "bucket").write.mode("overwrite").parquet(f"{out}/v={batch_id}")
            _forget(spark, state, "bucket", before)
        finally:
            runs.unpersist()

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- keyed intake ------------------------------------------------------------

def history_of(spark: SparkSession, sink: str, keys: list[str], schema: str, buckets: list[int], without: int) -> DataFrame:
    """Keys recorded by other batches in the given buckets; the files of other buckets are not read."""
    paths = [f"{sink}/v={v}" for v in _versions(spark, sink) if v != without]
    full = spark.read.schema(f"{schema}, bucket INT").option("basePath", sink).parquet(*paths)
    return full.filter(F.col("bucket").isin(buckets)).select(*keys, "bucket")


def append_new(sink: str, keys: list[str], schema: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A batch writer that appends rows whose key is in no other batch's folder. Folders are divided by hash of the key."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        if any(v != batch_id for v in _versions(spark, sink)):
            fresh = fresh.persist()
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
            seen = history_of(spark, sink, keys, schema, touched, batch_id)
            on = [fresh[k].eqNullSafe(seen[k]) for k in keys]
            left = fresh.join(seen, [*on, fresh["bucket"] == seen["bucket"]], "left_anti")
        else:
            left = fresh
        left.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/v={batch_id}")
        fresh.unpersist()

    return apply


def stream_payments(
    payments: DataFrame, sink: str, checkpoint: str, schema: str, key: str = "idempotency_key", recent: str = "7 days", buckets: int = BUCKETS
) -> StreamingQuery:
    """Each payment key recorded once, however late it comes.

    Repeats within ``recent`` of their arrival are dropped by the state store, older ones by their part of the history.
    The watermark follows the arrival, not the payment's own time, so a late payment is no late row.
    """
    arrived = _with_state_store(payments).withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", recent)
    once = arrived.dropDuplicatesWithinWatermark([key]).drop("arrived_at")
    return once.writeStream.foreachBatch(append_new(sink, [key], schema, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- reminders ---------------------------------------------------------------

REMINDERS = "rule_id STRING, occurrence_key STRING"
OUTBOX = f"{REMINDERS}, batch BIGINT, number BIGINT"


def stream_reminders(
    ticks: DataFrame, eligible: Callable[[SparkSession, DataFrame], DataFrame], outbox: str, checkpoint: str,
    post: Callable[[DataFrame], None] = lambda df: None,
) -> StreamingQuery:
    """Reminders delivered once per (rule, occurrence), through an outbox with two marks.

    A tick asks ``eligible(spark, recorded)`` for what is due and records it with (batch, number); then it posts the record
    and marks it as acknowledged. A record that is finished is never made anew: after a failure or a lost driver the same
    rows go out again under the same numbers, by which the receiver knows what it has. An acknowledged batch is not posted
    again.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty() or batch_id in _versions(spark, f"{outbox}/acknowledged"):
            return
        if batch_id not in _versions(spark, f"{outbox}/recorded"):
            due = eligible(spark, read_versions(spark, f"{outbox}/recorded", REMINDERS)).select("rule_id", "occurrence_key").dropDuplicates()
            numbered = due.select("*", F.lit(batch_id).cast("long").alias("batch"), F.monotonically_increasing_id().alias("number"))
            numbered.write.mode("overwrite").parquet(f"{outbox}/recorded/v={batch_id}")
        post(spark.read.schema(OUTBOX).parquet(f"{outbox}/recorded/v={batch_id}"))
        spark.createDataFrame([(batch_id,)], "batch BIGINT").write.mode("overwrite").parquet(f"{outbox}/acknowledged/v={batch_id}")

    return ticks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_daily(as_of, jobs: dict[str, Callable], out: str) -> dict[str, str]:
    """The daily tick: every job re-evaluated for ``as_of`` and written to its dated folder."""
    paths = {}
    for name, job in jobs.items():
        paths[name] = f"{out}/{name}/as_of={as_of.isoformat()}"
        job(as_of).write.mode("overwrite").parquet(paths[name])
    return paths


__all__ = [
    "events_stream", "ledger_stream", "months_of", "read_late", "read_latest", "read_spend", "read_state", "read_versions", "run_daily",
    "stream_confirmations", "stream_merchant_use", "stream_payments", "stream_reminders", "stream_spend",
]
