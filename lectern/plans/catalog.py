"""Registered queries by name, and the SQL that must give the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from . import queries as q

#: Queries without SQL, which the tests hold against plain Python.
PLAIN = ("chunk_recursive", "corpus_sketches")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(q, name) for name in (*oracles.SQL, *PLAIN)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
