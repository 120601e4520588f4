"""A due calendar: the daily tick evaluates only what changes by date or by new events.

The status of an attention item changes by itself on three days at most: when its warning begins, when it is due, and the
day after. Every evaluated item is filed under the next of these days (``changes_on``); a tick reads the days since the last
tick, re-evaluates those items and files them again. Items of assets with new events are evaluated in full, and what was
filed for them before is void. All writes are named after the tick, so a repeated tick writes the same again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import assets as A
from tallyspark.streaming.jobs import _fs, _versions

ITEM = ["asset_id", "source_type", "source_id"]
FILED = [*ITEM, "title", "due_date", "due_km", "warning_days", "warning_km", "owner_id", "current_km"]
STATUS = [*ITEM, "owner_id", "due_date", "due_km", "status", "priority", "occurrence_key"]
_TYPES = "asset_id BIGINT, source_type STRING, source_id BIGINT, title STRING, due_date DATE, due_km BIGINT, warning_days BIGINT, warning_km BIGINT, owner_id BIGINT, current_km BIGINT"
_STATUS = "asset_id BIGINT, source_type STRING, source_id BIGINT, owner_id BIGINT, due_date DATE, due_km BIGINT, status STRING, priority INT, occurrence_key STRING"


def with_next_change(items: DataFrame, as_of: dt.date) -> DataFrame:
    """Adds ``changes_on``: the first day after ``as_of`` on which an item's status changes by date alone; null if there is none."""
    due, now = F.col("due_date"), F.lit(as_of)
    days = F.array(F.date_sub(due, F.coalesce("warning_days", F.lit(0)).cast("int")), due, F.date_add(due, 1))
    return items.withColumn("changes_on", F.array_min(F.filter(days, lambda d: d > now)))


def _logged(spark: SparkSession, folder: str, schema: str, before: int) -> DataFrame:
    """All earlier ticks' rows with their tick ``v``."""
    paths = [f"{folder}/v={v}" for v in _versions(spark, folder) if v < before]
    if not paths:
        return spark.createDataFrame([], f"{schema}, v BIGINT")
    return spark.read.schema(f"{schema}, v BIGINT").option("basePath", folder).parquet(*paths)


def _filed(spark: SparkSession, folder: str, after: dt.date, upto: dt.date, before: int) -> DataFrame:
    """Items filed by earlier ticks under the days after ``after`` up to ``upto``; other days are not read."""
    _, fs = _fs(spark, folder)
    found = []
    for status in fs.globStatus(_fs(spark, f"{folder}/changes_on=*/v=*")[0]) or []:
        path = status.getPath()
        day, v = dt.date.fromisoformat(path.getParent().getName().split("=", 1)[1]), int(path.getName()[2:])
        if after < day <= upto and v < before:
            found.append(f"{folder}/changes_on={day.isoformat()}/v={v}")
    if not found:
        return spark.createDataFrame([], f"{_TYPES}, v BIGINT")
    return spark.read.schema(f"{_TYPES}, changes_on DATE, v BIGINT").option("basePath", folder).parquet(*found).drop("changes_on")


def _void(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """The rows whose asset had no new event since they were written."""
    t = touched.groupBy("asset_id").agg(F.max("v").alias("__touched"))
    return rows.join(t, "asset_id", "left").filter(F.col("__touched").isNull() | (F.col("__touched") <= F.col("v"))).drop("__touched")


def tick(spark: SparkSession, folder: str, as_of: dt.date, touched: DataFrame, evaluate: Callable[[DataFrame, dt.date], DataFrame]) -> int:
    """Brings the attention list up to ``as_of``; returns the number of items evaluated.

    ``touched`` (asset_id): assets with events, rules or edits since the last tick, at the first tick all.
    ``evaluate(touched, as_of)`` is their full attention list.
    """
    now = as_of.toordinal()
    done = [v for v in _versions(spark, f"{folder}/ticks") if v < now]
    last = dt.date.fromordinal(done[-1]) if done else dt.date.min
    touched = touched.select("asset_id").distinct()
    touched.write.mode("overwrite").parquet(f"{folder}/touched/v={now}")
    fresh = spark.read.schema("asset_id BIGINT").parquet(f"{folder}/touched/v={now}")
    due = _void(_filed(spark, f"{folder}/filed", last, as_of, now), _logged(spark, f"{folder}/touched", "asset_id BIGINT", now))
    due = due.join(fresh, "asset_id", "left_anti").select(*FILED)
    items = A.described(due, as_of)
    if not fresh.isEmpty():  # without touched assets their histories need not be read
        items = items.unionByName(evaluate(fresh, as_of), allowMissingColumns=True)
    items = with_next_change(items.select(*FILED, "status", "priority", "occurrence_key"), as_of)
    items.select(*STATUS, *[c for c in [*FILED, "changes_on"] if c not in STATUS]).write.mode("overwrite").parquet(f"{folder}/changes/v={now}")
    written = spark.read.parquet(f"{folder}/changes/v={now}")
    filed = written.filter("changes_on is not null").select(*FILED, "changes_on").withColumn("v", F.lit(now).cast("long"))
    filed.repartition("changes_on").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("changes_on", "v").parquet(f"{folder}/filed")
    n = written.count()
    spark.createDataFrame([(n,)], "evaluated BIGINT").write.mode("overwrite").parquet(f"{folder}/ticks/v={now}")
    return n


def attention_list(spark: SparkSession, folder: str) -> DataFrame:
    """Every item with its status after the last finished tick."""
    done = _versions(spark, f"{folder}/ticks")
    before = done[-1] + 1 if done else 0
    changes = _logged(spark, f"{folder}/changes", _STATUS, before)
    newest = changes.groupBy(*ITEM).agg(F.max_by(F.struct(*[c for c in STATUS if c not in ITEM]), "v").alias("x"), F.max("v").alias("v")).select(*ITEM, "x.*", "v")
    return _void(newest, _logged(spark, f"{folder}/touched", "asset_id BIGINT", before)).select(*STATUS)
