"""The two chunk collections, main and parents: keyed upserts and deletions as segments, reads of what is live.

A chunk goes to the parents' collection if it is one, else to the main one. Every change
is one segment in each collection, in folders by a hash of chunk_id, so that a look-up by id
opens one folder in each segment; earlier files stay untouched. ``compact`` writes
what is live to another place as one segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import prepare
from ..sources import files
from ..sources.segments import latest, read_segments, write_segment

CHUNK = "chunk_id string, doc_id string, text string, token_count int, deleted boolean, bucket int"
NAMES = ("main", "parents")
BUCKETS = 16
#: Parts of a bucket that are written side by side.
PARTS = 32


def _bucket():
    return F.pmod(F.xxhash64("chunk_id"), F.lit(BUCKETS)).cast("int")


def _all(spark: SparkSession, folder: str, name: str, before: int | None = None) -> DataFrame:
    return read_segments(spark, f"{folder}/{name}", CHUNK, before)


def _live(rows: DataFrame) -> DataFrame:
    return latest(rows, "bucket", "chunk_id", where=~F.col("deleted"))


def upsert(chunks: DataFrame, folder: str, segment: int) -> None:
    """Chunks (chunk_id, doc_id, text, token_count, is_parent) into their collections; of equal ids in it the greatest row counts."""
    prepare(chunks.sparkSession)
    rows = chunks.select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("token_count").cast("int").alias("token_count"), F.lit(False).alias("deleted"), "is_parent")
    # Texts are shuffled once: dealt by bucket and part, rows of equal ids are together and files stay few.
    dealt = rows.withColumn("bucket", _bucket()).withColumn("part", F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(PARTS)).cast("int"))
    for name, of_it in zip(NAMES, (~F.col("is_parent"), F.col("is_parent")), strict=True):
        own = dealt.where(of_it).drop("is_parent").repartition("bucket", "part")
        one = own.groupBy("bucket", "part", "chunk_id").agg(F.max(F.struct("doc_id", "text", "token_count", "deleted")).alias("r")).select("chunk_id", "r.*", "bucket")
        write_segment(one, f"{folder}/{name}", segment, "bucket")


def delete(ids: DataFrame, folder: str, segment: int, by: str = "chunk_id") -> None:
    """Ends the live chunks of the ids (a column doc_id or chunk_id) in both collections; unknown ids change nothing."""
    spark = ids.sparkSession
    prepare(spark)
    gone = ids.select(F.col(by).cast("string").alias(by)).distinct()
    for name in NAMES:
        rows = _live(_all(spark, folder, name, before=segment).drop("text", "token_count")).join(gone, by, "left_semi")
        ended = rows.select("chunk_id", "doc_id", F.lit(None).cast("string").alias("text"), F.lit(0).alias("token_count"), F.lit(True).alias("deleted"), "bucket")
        write_segment(ended.hint("rebalance", "bucket"), f"{folder}/{name}", segment, "bucket")


def read(spark: SparkSession, folder: str, name: str, text: Column | None = None) -> DataFrame:
    """Live chunks of a collection; none if it was reset or never written. ``text`` stands for the text where not all of it is needed."""
    rows = _all(spark, folder, name)
    return _live(rows if text is None else rows.withColumn("text", text)).select("chunk_id", "doc_id", "text", "token_count", "bucket", "segment")


def find(spark: SparkSession, folder: str, name: str, chunk_ids: list[str]) -> DataFrame:
    """Live chunks of some ids; only their buckets are read."""
    asked = spark.createDataFrame([(i,) for i in chunk_ids], "chunk_id string").withColumn("bucket", _bucket())
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]
    rows = _all(spark, folder, name).where(F.col("bucket").isin(buckets) & F.col("chunk_id").isin(chunk_ids))
    return _live(rows).select("chunk_id", "doc_id", "text", "token_count")


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """name, n of both collections."""
    rows = [_live(_all(spark, folder, name).select("chunk_id", "deleted", "bucket", "segment")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name in NAMES]
    return rows[0].unionByName(rows[1])


def compact(spark: SparkSession, folder: str, target: str) -> None:
    for name in NAMES:
        rows = read(spark, folder, name).drop("segment").withColumn("deleted", F.lit(False))
        write_segment(rows.hint("rebalance", "bucket"), f"{target}/{name}", 0, "bucket")


def reset(spark: SparkSession, folder: str) -> None:
    """Removes both collections with all their segments."""
    for name in NAMES:
        files.reset(spark, f"{folder}/{name}")
