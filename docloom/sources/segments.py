"""Tables that grow by segments: every change of a key is a row of a later segment, and the latest one counts.

A segment is a partition folder ``segment=n``; writing it again replaces it alone, so a
repeated write changes nothing, and no earlier file is touched. A row whose ``deleted``
is true ends its key.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_segment(rows: DataFrame, folder: str, segment: int, *parts: str) -> None:
    """Makes ``rows`` the segment of this number; ``parts`` are columns with folders of their own inside it."""
    numbered = rows.withColumn("segment", F.lit(segment).cast("long"))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment", *parts).parquet(folder)


def read_segments(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame:
    """All segments (with their number), or those below ``before``; no rows while nothing has been written."""
    try:
        rows = spark.read.schema(f"{schema}, segment long").parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, segment long")
    return rows if before is None else rows.where(F.col("segment") < before)


def latest(rows: DataFrame, *key: str, where: Column | None = None) -> DataFrame:
    """The row of the latest segment of each key; a key is once in a segment. ``where`` filters the rows that are left."""
    rest = [c for c in rows.columns if c not in key]
    found = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "segment").alias("_r")).select(*key, "_r.*").select(*rows.columns)
    return found if where is None else found.where(where)


def last_segment(spark: SparkSession, folder: str) -> int:
    """The highest number written so far; -1 if there is none. Only folder names are read."""
    found = read_segments(spark, folder, "deleted boolean").agg(F.max("segment")).first()[0]
    return -1 if found is None else found
