"""The queries that the driver runs, by name, and the SQL that each has to equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyproof.plans import arithmetic, documents, evidence, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**arithmetic.Q, **records.Q, **documents.Q, **evidence.Q}
ORACLE_SQL: dict[str, str] = {**arithmetic.SQL, **records.SQL, **documents.SQL, **evidence.SQL}
