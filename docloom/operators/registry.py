"""Document registry: discovery, change detection, keyed merge, life cycle, run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def discover(links: DataFrame, registry: DataFrame) -> DataFrame:
    """Links (url, title) against the registry by url: every one comes out, with state new or known.

    Links keep the type pdf (missing: pdf); blank urls go; urls and titles are trimmed.
    """
    kept = links.where(F.coalesce("type", F.lit("pdf")) == "pdf").select(F.trim("url").alias("url"), F.trim("title").alias("title")).where(F.coalesce("url", F.lit("")) != "")
    held = registry.select(F.col("source_url").alias("url"), F.col("doc_id").alias("known_id"), "status")
    return kept.join(held, "url", "left").select("url", "title", F.when(F.col("known_id").isNull(), "new").otherwise("known").alias("state"), "known_id", F.coalesce("status", F.lit("pending")).alias("status"))


def detect_changes(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Listing (file_id, md5, modified) against registry (file_id, md5, modified, status): file_id, change.

    new: unknown; updated: both digests known and different, or both times known and the
    listing's later; deleted: indexed, but no longer listed. Others do not come out.
    """
    new = listing.select("file_id", F.col("md5").alias("md5_now"), F.col("modified").alias("modified_now"), F.lit(True).alias("listed"))
    old = registry.select("file_id", F.col("md5").alias("md5_then"), F.col("modified").alias("modified_then"), "status", F.lit(True).alias("held"))
    both = new.join(old, "file_id", "full_outer")
    digest = (F.coalesce("md5_now", F.lit("")) != "") & (F.coalesce("md5_then", F.lit("")) != "") & (F.col("md5_now") != F.col("md5_then"))
    later = F.coalesce(F.col("modified_now") > F.col("modified_then"), F.lit(False))
    change = F.when(F.col("held").isNull(), "new").when(F.col("listed").isNotNull() & (digest | later), "updated").when(F.col("listed").isNull() & (F.col("status") == "indexed"), "deleted")
    return both.select("file_id", change.alias("change")).where("change is not null")


def merge(current: DataFrame, changes: DataFrame, key: str, keep: list[str], order: str) -> DataFrame:
    """Keyed upsert of rows with equal columns: the latest change of a key wins; columns in keep stay as first set.

    Of changes that are equally late the one with the greatest values, column by column, wins.
    """
    rest = F.struct(*[c for c in changes.columns if c not in (key, order)])
    latest = changes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(rest)))).where("_r = 1").drop("_r")
    old, new = current.alias("o"), latest.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")

    def column(c: str) -> Column:
        if c == key or c in keep:
            return F.coalesce(f"o.{c}", f"n.{c}").alias(c)
        return F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*[column(c) for c in current.columns])


def violations(rows: DataFrame, column: str) -> DataFrame:
    """Non-empty values that more than one row holds."""
    return rows.where(F.coalesce(column, F.lit("")) != "").groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def needs_reindex(new_hash: Column, force: bool = False) -> Column:
    return F.lit(force) | F.col("status").isin("pending", "failed") | (F.col("content_hash") != new_hash)


def unchanged(new_hash: Column, force: bool = False) -> Column:
    return (F.coalesce(new_hash, F.lit("")) != "") & (F.col("content_hash") == new_hash) & (F.col("status") == "indexed") & F.lit(not force)


def lifecycle(ok: Column, chunk_count: Column) -> dict[str, Column]:
    """Columns after a document was processed: indexed with its counts, or failed with a retry more."""
    return {"status": F.when(ok, "indexed").otherwise("failed"), "chunk_count": F.when(ok, chunk_count).otherwise(F.lit(0)), "retry_count": F.when(ok, F.col("retry_count")).otherwise(F.col("retry_count") + 1)}


def run_stats(changes: DataFrame) -> DataFrame:
    """One row of counts over rows (change, ok, chunks)."""
    n = lambda c: F.count_if(F.col("change") == c).alias(c)
    return changes.agg(F.count(F.lit(1)).alias("discovered"), n("new"), n("updated"), n("deleted"), F.count_if(F.col("change") == "unchanged").alias("skipped"), F.count_if(~F.col("ok")).alias("failed"), F.sum(F.when(F.col("ok"), F.col("chunks")).otherwise(0)).alias("chunks"))


def cached(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (text) against a cache (text_hash, value) by md5: the hits, and the distinct texts still to compute."""
    hashed = texts.withColumn("text_hash", F.md5("text"))
    return hashed.join(cache, "text_hash"), hashed.join(cache, "text_hash", "left_anti").dropDuplicates(["text_hash"])
