"""Incremental ingestion: new and changed documents of a growing folder become registry versions and chunks.

Every micro-batch is a segment of two tables. ``registry`` has a row for each document that
the batch changed: its version, digest, outcome and counts. ``chunks`` has the parents and
the lines of these documents, in folders of their own, as two collections. What counts
is the latest version of a document, so chunks of older versions need no deletion. A
batch that is repeated compares with the segments before it and writes its own again.
"""

from __future__ import annotations

import logging

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.folds import pack_groups, pack_starts
from ..functions.session import prepare
from ..functions.text import estimate_tokens
from ..operators import registry as R
from ..sources.segments import latest, read_segments, write_segment

log = logging.getLogger(__name__)

SOURCE = "doc_id long, text string, lang string, source string, n_chars long"
REGISTRY = "doc_id string, version int, content_hash string, status string, lang string, source string, retry_count int, parents int, main int"
CHUNKS = "doc_id string, version int, chunk_no int, text string, token_count int, kind string"


def arrivals(batch: DataFrame) -> DataFrame:
    """Rows (doc_id, text, lang, source, stamp) -> one for each document: that of the latest stamp, then of the greatest digest.

    A row without an id is named after its digest, as an upload is.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    named = batch.select(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("doc_"), F.substring(digest, 1, 12))).alias("doc_id"), "text", "lang", "source", digest.alias("content_hash"), "stamp")
    order = F.struct("stamp", "content_hash", "lang", "source")
    return named.groupBy("doc_id").agg(F.max_by(F.struct("text", "lang", "source", "content_hash"), order).alias("r")).select("doc_id", "r.*")


def processed(rows: DataFrame, held: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Arrivals that are new, changed or failed before, with their next version and both lists of chunk texts.

    Lines are packed to parents; lines of chunk_min_tokens and more are chunks of the main
    collection; a text that repeats inside a document counts once. A document without a
    line fails, and its retries count on.
    """
    known = held.select("doc_id", F.col("version").alias("_version"), F.col("content_hash").alias("_hash"), F.col("status").alias("_status"), F.col("retry_count").alias("_retries"))
    both = rows.join(known, "doc_id", "left").withColumnsRenamed({"content_hash": "now", "_hash": "content_hash", "_status": "status"})
    work = both.where(F.col("_version").isNull() | R.needs_reindex(F.col("now")))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda p: F.trim(p) != "")
    cut = work.withColumn("lines", lines).withColumn("starts", pack_starts(F.transform("lines", estimate_tokens), s.parent_max_tokens))
    parents = F.array_distinct(F.transform(pack_groups(F.col("lines"), F.col("starts")), lambda g: F.array_join(g, "\n\n")))
    main = F.array_distinct(F.filter("lines", lambda p: estimate_tokens(p) >= s.chunk_min_tokens))
    ok = F.size("lines") > 0
    return cut.select(
        "doc_id", (F.coalesce("_version", F.lit(0)) + 1).alias("version"), F.col("now").alias("content_hash"), F.when(ok, "indexed").otherwise("failed").alias("status"), "lang", "source",
        (F.coalesce("_retries", F.lit(0)) + F.when(ok, 0).otherwise(1)).alias("retry_count"), F.when(ok, parents).otherwise(F.array().cast("array<string>")).alias("parent_texts"), main.alias("main_texts"),
    )


def take_in(batch: DataFrame, number: int, folder: str, s: Settings = DEFAULTS) -> dict[str, int]:
    """Writes one batch (doc_id, text, lang, source, stamp) as segment ``number``; counts of what it did."""
    spark = batch.sparkSession
    held = latest(read_segments(spark, f"{folder}/registry", REGISTRY, before=number), "doc_id")
    rows = processed(arrivals(batch), held, s).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kinds = [rows.select("doc_id", "version", F.posexplode(f"{kind}_texts").alias("chunk_no", "text"), F.lit(kind).alias("kind")) for kind in ("parent", "main")]
        chunks = kinds[0].unionByName(kinds[1]).select("doc_id", "version", "chunk_no", "text", estimate_tokens(F.col("text")).alias("token_count"), "kind")
        write_segment(chunks, f"{folder}/chunks", number, "kind")
        # Counted before the registry is written: a write drops what was kept of a plan that reads the same path, and all would be computed again.
        n = rows.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("version") == 1).alias("new"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum(F.size("parent_texts") + F.size("main_texts")), F.lit(0)).alias("chunks")).first()
        # The registry comes last: a version that it does not name yet has no chunks for a reader.
        write_segment(rows.select("doc_id", "version", "content_hash", "status", "lang", "source", "retry_count", F.size("parent_texts").alias("parents"), F.size("main_texts").alias("main")), f"{folder}/registry", number)
    finally:
        rows.unpersist()
    return n.asDict()


def intake(spark: SparkSession, source: str, folder: str, checkpoint: str, files: int = 256, s: Settings = DEFAULTS) -> list[dict[str, int]]:
    """Takes in the Parquet files of ``source`` (a folder, one file, or a pattern) that are new since the last call; the counts of each batch.

    The stream's checkpoint remembers the files and numbers the batches; ``files`` of them
    make a batch. A run that broke off goes on with the batch it was in.
    """
    prepare(spark)
    done: list[dict[str, int]] = []

    def work(batch: DataFrame, number: int) -> None:
        counts = take_in(batch, number, folder, s)
        log.info("batch %d: wrote %s", number, counts)
        done.append({"batch": number, **counts})

    stamp = F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("path"))
    rows = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", files).parquet(as_pattern(source)).select("doc_id", "text", "lang", "source", stamp.alias("stamp"))
    query = rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d rows of new files", sum(p.numInputRows for p in query.recentProgress))
    return done


def as_pattern(path: str) -> str:
    """The path as a pattern that matches it alone: a file stream takes a single file only by a pattern."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """The latest version of every document."""
    return latest(read_segments(spark, f"{folder}/registry", REGISTRY), "doc_id")


def collection(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """Chunks of the latest versions, of one kind (parent, main) or of both."""
    chunks = read_segments(spark, f"{folder}/chunks", CHUNKS)
    chunks = chunks if kind is None else chunks.where(F.col("kind") == kind)
    return chunks.join(registry(spark, folder).select("doc_id", "version"), ["doc_id", "version"], "left_semi")
