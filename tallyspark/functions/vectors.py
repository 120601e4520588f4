"""Vector algebra on ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column) -> Column:
    """Unit vector, the norm floored at 1e-12."""
    n = F.greatest(l2_norm(a), F.lit(FLOOR))
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(l2_norm(a) * l2_norm(b), F.lit(FLOOR))


def blend(a: Column, b: Column, weight: float = 0.5) -> Column:
    return F.zip_with(a, b, lambda x, y: F.lit(weight) * x + F.lit(1.0 - weight) * y)


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def vector_sums(
    df: DataFrame, keys: Sequence[str], vec: str, out: str = "vec_sum", n: str = "n_vec", dim: int | None = None
) -> DataFrame:
    """Element-wise sum and count per key, combined before the shuffle.

    With a known ``dim`` one sum per position travels in one row per key. Without
    it the vectors are exploded and re-packed, which costs one row per (key,
    position); either way a hot key costs its dimension, not its row count.
    """
    if dim is not None:
        sums = [F.sum(F.col(vec)[i]).alias(f"__s{i}") for i in range(dim)]
        wide = df.groupBy(*keys).agg(*sums, F.count(vec).alias(n))
        return wide.select(*keys, F.array(*[F.col(f"__s{i}") for i in range(dim)]).alias(out), n)
    long = df.select(*keys, F.posexplode(vec).alias("__pos", "__x"))
    cells = long.groupBy(*keys, "__pos").agg(F.sum("__x").alias("__s"), F.count("__x").alias("__n"))
    packed = cells.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("__pos", "__s"))).alias("__cells"), F.max("__n").alias(n)
    )
    return packed.select(*keys, F.transform("__cells", lambda c: c["__s"]).alias(out), n)


def centroid(df: DataFrame, keys: Sequence[str], vec: str, out: str = "centroid", dim: int | None = None) -> DataFrame:
    """Element-wise mean per key."""
    sums = vector_sums(df, keys, vec, dim=dim)
    return sums.select(
        *keys, scale(F.col("vec_sum"), F.lit(1.0) / F.col("n_vec")).alias(out), F.col("n_vec")
    )
