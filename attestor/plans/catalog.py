"""Queries of the engine by name, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestor.plans import evaluation, evidence, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**retrieval.QUERIES, **evidence.QUERIES, **evaluation.QUERIES}
ORACLE_SQL: dict[str, str] = {**retrieval.ORACLE_SQL, **evidence.ORACLE_SQL, **evaluation.ORACLE_SQL}
