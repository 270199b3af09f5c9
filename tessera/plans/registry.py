"""All queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import annotation, corpus, features, graphs, relational, views

MODULES = (features, annotation, graphs, corpus, relational, views)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature catalog with each feature's top categories."""
    return features.catalog_with_genes(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
