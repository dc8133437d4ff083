"""What a session needs before this package's plans run in it."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    """Python workers find this package; a union does not claim the partitioning of its children.

    With that claim (the default of Spark 4.1) two lists that are united, grouped and joined
    with themselves lose the exchange between union and grouping once exchanges are reused,
    and groups come out twice.
    """
    home = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``; a local session without that setting uses its machine's."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{(base or tempfile.mkdtemp(prefix='docloom-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Shuffle files go when the statement that made them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(rows: DataFrame, path: str) -> DataFrame:
    """Rows as a table at ``path``; the shuffle files of making it do not stay beside it."""
    spark, schema = rows.sparkSession, rows.schema
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        rows.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)
