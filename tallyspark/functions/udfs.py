"""The Python functions Spark SQL has no counterpart for, as Arrow batches."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.money import compound_charge  # noqa: F401  its former place

ASCII = r"^[\x00-\x7F]*$"

# The prefixes the embedding models expect for each text role.
ROLE_PREFIX = {"QUERY": "query: ", "PASSAGE": "passage: "}


def _normal_form(form: str) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def convert(text: pd.Series) -> pd.Series:
        return text.map(lambda s: None if s is None else unicodedata.normalize(form, s))

    def apply(text: Column) -> Column:
        # ASCII text is its own normal form; only the rest carries a payload to Python.
        plain = text.rlike(ASCII)
        return F.when(plain, text).otherwise(convert(F.when(~plain, text)))

    return apply


nfkc = _normal_form("NFKC")
nfkd = _normal_form("NFKD")
nfd = _normal_form("NFD")


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's matching-block ratio."""
    return pd.Series(
        [None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)],
        dtype="float64",
    )


def embed(
    df: DataFrame,
    text: str,
    role: str,
    model: Callable[[list[str]], Sequence[Sequence[float]]],
    out: str = "embedding",
) -> DataFrame:
    """Embed each distinct text once with the caller's model and join the vectors back.

    ``model`` must give a text the same vector whatever else is in its batch.
    """
    prefix = ROLE_PREFIX[role]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            vectors = model([prefix + (t or "") for t in batch])
            yield pd.Series([[float(x) for x in v] for v in vectors])

    texts = df.select(F.col(text).alias("__text")).filter(F.col("__text").isNotNull()).distinct()
    vectors = texts.withColumn(out, run("__text"))
    return df.join(vectors, df[text] == vectors["__text"], "left").drop("__text")
