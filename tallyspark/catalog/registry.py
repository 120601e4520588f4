"""Registration of a query with its check."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.plans.session import SETTINGS
from tallyspark.sources.fixtures import DriverTables, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, dates: Sequence[str] = (), doubles: Sequence[str] = ()):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``dates`` leave both engines as ISO text and ``doubles`` rounded to six
    places, so that the comparison does not depend on either engine's client
    types.
    """

    def add(fn: Callable[[DriverTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
                spark.conf.set(k, SETTINGS[k])
            df = fn(DriverTables(spark, sf_dir))
            for c in dates:
                df = df.withColumn(c, F.col(c).cast("string"))
            for c in doubles:
                df = df.withColumn(c, F.round(F.col(c).cast("double"), 6) + F.lit(0.0))
            return df

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            swaps = [f"CAST({c} AS VARCHAR) AS {c}" for c in dates]
            swaps += [f"ROUND(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in doubles]
            star = f"* REPLACE ({', '.join(swaps)})" if swaps else "*"
            ORACLES[name] = with_fixtures(f"SELECT {star} FROM (\n{oracle.strip()}\n) checked", "duckdb")
        return fn

    return add
