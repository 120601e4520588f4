"""Typed readers and report sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.schemas import DRIVER_TABLES, TABLES


def read_table(spark: SparkSession, folder: str, name: str, suffix: str = "") -> DataFrame:
    """One table of the catalog with its declared columns (no schema inference)."""
    ddl = TABLES.get(name) or DRIVER_TABLES[name]
    return spark.read.schema(ddl).parquet(f"{folder.rstrip('/')}/{name}{suffix}")


def load_tables(
    spark: SparkSession, folder: str, names: Iterable[str] | None = None, suffix: str = "", views: bool = False
) -> dict[str, DataFrame]:
    """The catalog's tables as typed frames, optionally registered as temp views."""
    out = {n: read_table(spark, folder, n, suffix) for n in (names or TABLES)}
    if views:
        for name, df in out.items():
            df.createOrReplaceTempView(name)
    return out


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table (answered from Parquet footers)."""
    parts = [df.agg(F.count("*").alias("n_rows")).withColumn("table_name", F.lit(n)) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "n_rows")


def ledger(tx: DataFrame) -> DataFrame:
    """Transactions, newest first."""
    return tx.orderBy(F.desc("tx_date"), F.desc("created_at"), F.asc("tx_id"))


def read_labelled(
    spark: SparkSession, path: str, required: Sequence[str], labels: DataFrame, label_col: str = "category"
) -> tuple[DataFrame, DataFrame]:
    """A labelled CSV as strings, and its rows whose label is not in ``labels``.

    Raises when a required column is missing; unknown labels are returned, not
    collected, so the caller decides whether to stop.
    """
    header = spark.read.option("header", True).csv(path)
    missing = sorted(set(required) - set(header.columns))
    if missing:
        raise ValueError(f"labelled data lacks columns: {missing}")
    known = labels.select(F.col(label_col)).distinct()
    return header, header.join(known, label_col, "left_anti")


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a result frame as csv, json or parquet, one file per task."""
    if fmt not in {"csv", "json", "parquet"}:
        raise ValueError(f"unknown report format {fmt}")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
