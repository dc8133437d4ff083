"""Model-backed steps with deterministic stand-ins: embedding, rewriting, evidence, answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.session import prepare
from ..functions.text import COMPOUND, is_compound, words
from ..sources.segments import latest, read_segments, write_segment

DIMENSION = 64
NO_EVIDENCE = "NO_RELEVANT_EVIDENCE"


def hash_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """Unit vector of hashed word counts; zeros for a text without words."""
    slots = F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda c: F.when(norm > 0, c / norm).otherwise(0.0))


def embed(texts: DataFrame) -> DataFrame:
    """Texts (text, ...) with their vectors; each distinct text is computed once and joined back by digest."""
    hashed = texts.withColumn("text_hash", F.md5("text"))
    return hashed.join(text_vectors(hashed.groupBy("text_hash").agg(F.first("text").alias("text"))), "text_hash")


CACHE = "text_hash string, vec array<double>"


def text_vectors(texts: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """Distinct (text_hash, text) -> text_hash, vec as ``hash_embedding`` has it, by counting words; linear in texts of any length."""
    slots = texts.select("text_hash", F.explode(words(F.col("text"))).alias("w")).groupBy("text_hash", F.pmod(F.xxhash64("w"), F.lit(dimension)).cast("int").alias("slot")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    counts = slots.groupBy("text_hash").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at("m", i) / F.col("size"), F.lit(0.0)))
    return texts.select("text_hash").join(counts, "text_hash", "left").select("text_hash", vec.alias("vec"))


def embed_rows(texts: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """Texts (id, text) -> id, vec as ``hash_embedding`` has it, each text where it is: nothing is shuffled, and copies are computed again."""
    prepare(texts.sparkSession)
    slots = texts.select("id", F.transform(words(F.col("text")), lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)).cast("int")).alias("slots"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = batch.num_rows, batch.column(1)
            row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            counts = np.bincount(row * dimension + lists.flatten().to_numpy(zero_copy_only=False), minlength=n * dimension).reshape(n, dimension).astype(float)
            size = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            vec = np.divide(counts, size, out=np.zeros_like(counts), where=size > 0)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dimension), pa.array(vec.ravel()))], names=["id", "vec"])

    return slots.mapInArrow(count, StructType([texts.schema["id"], StructField("vec", ArrayType(DoubleType()))]))


def embed_cached(texts: DataFrame, folder: str, segment: int) -> DataFrame:
    """Texts (text, ...) with text_hash, vec and the segment of the cache that holds it.

    Digests that the cache lacks are computed once each and become its segment of this
    number; a second run computes nothing. Runs at the same time take different numbers;
    where both computed a digest, the higher one counts.
    """
    spark = texts.sparkSession
    hashed = texts.withColumn("text_hash", F.md5(F.coalesce("text", F.lit(""))))
    held = read_segments(spark, folder, CACHE, before=segment)
    fresh = hashed.join(held.select("text_hash").distinct(), "text_hash", "left_anti").groupBy("text_hash").agg(F.first(F.coalesce("text", F.lit(""))).alias("_t"))
    write_segment(text_vectors(fresh.withColumnRenamed("_t", "text")), folder, segment)
    return hashed.join(latest(read_segments(spark, folder, CACHE, before=segment + 1), "text_hash"), "text_hash")


_JOINING = "|".join(COMPOUND)


def sub_queries(query: Column) -> Column:
    """Parts of a compound question, cut behind question marks and at joining phrases; others stay whole."""
    parts = F.filter(F.transform(F.split(query, rf"(?i)(?<=\?)(?!{_JOINING})|{_JOINING}"), lambda p: F.trim(p)), lambda p: F.length(p) > 5)
    return F.when(is_compound(query) & (F.size(parts) > 0), parts).otherwise(F.array(query))


def evidence(question: Column, chunks: Column, least: int = 2) -> Column:
    """Numbered chunks that share enough words with the question, or the mark of none."""
    asked = F.array_distinct(words(question))
    found = F.filter(F.transform(chunks, lambda c, i: F.when(F.size(F.array_intersect(asked, words(c))) >= least, F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("] "), c))), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.array_join(found, "\n")).otherwise(F.lit(NO_EVIDENCE))
