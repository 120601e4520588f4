"""Ledger, obligation, asset, categorisation and receipt analytics as Spark jobs.

Every public function takes DataFrames (and plain parameters such as ``as_of``)
and returns a lazily planned DataFrame; nothing reads the clock or a global
session.
"""
