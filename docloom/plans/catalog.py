"""All registered queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import answers, chunks, dialogue, extras, ingest, layout, questions, runs, search, stores  # noqa: F401  they register their queries
from .base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["TOP2"](spark, sf_dir)
