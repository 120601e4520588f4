"""Imports every subject so that the registry is complete."""

from tallyspark.catalog import (  # noqa: F401
    assets,
    categorisation,
    changes,
    evaluation,
    ledger,
    obligations,
    quality,
    ranking,
    receipts,
    scalars,
    streams,
)
from tallyspark.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
