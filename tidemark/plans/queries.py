"""Queries of the core operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import instants, relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**relational.QUERIES, "p4_found": instants.p4_found}
SQL: dict[str, str] = dict(relational.SQL)
