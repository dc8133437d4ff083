"""Documents to chunks: paragraphs, parents, children, structure chunks, gates, deduplication."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.folds import pack_groups, pack_starts, pack_with_overlap
from ..functions.text import estimate_tokens, sentences

REQUIRED = ("doc_id", "doc_title", "source_url", "doc_category", "section_path", "chunk_type", "text")


def paragraphs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each non-blank line: doc_id, the columns to keep, ord (from 1), text."""
    parts = F.filter(F.split(F.col(text), "\n"), lambda p: F.trim(p) != "")
    return docs.select("doc_id", *keep, F.posexplode(parts).alias("ord", "text")).withColumn("ord", F.col("ord") + 1)


def parents(docs: DataFrame, s: Settings = DEFAULTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines packed to parents of parent_max_tokens: doc_id, the columns to keep, chunk_no, text, token_count."""
    texts = F.transform("groups", lambda g: F.array_join(g, "\n\n"))
    out = parent_lines(docs, s, keep).select("doc_id", *keep, F.posexplode(texts).alias("chunk_no", "text"))
    return out.withColumn("token_count", estimate_tokens(F.col("text")))


def parent_lines(docs: DataFrame, s: Settings = DEFAULTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep and groups: the lines of each parent, in arrays; documents without a line are left out."""
    parts = F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")
    packed = docs.select("doc_id", *keep, parts.alias("parts")).withColumn("starts", pack_starts(F.transform("parts", estimate_tokens), s.parent_max_tokens))
    return packed.where(F.size("parts") > 0).select("doc_id", *keep, pack_groups(F.col("parts"), F.col("starts")).alias("groups"))


def children(parent_rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Sentences packed with overlap; a parent within child_max_tokens is its own only child."""
    packed = F.when(F.col("token_count") <= s.child_max_tokens, F.array("text")).otherwise(pack_with_overlap(sentences(F.col("text")), s.child_max_tokens, s.child_overlap_tokens, " "))
    out = parent_rows.select("doc_id", F.col("chunk_no").alias("parent_no"), F.posexplode(packed).alias("child_no", "text"))
    return out.withColumn("token_count", estimate_tokens(F.col("text")))


def structure_chunks(docs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Greedy packing of paragraphs with overlap, joined by blank lines."""
    parts = F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")
    packed = pack_with_overlap(parts, s.chunk_max_tokens, s.chunk_overlap_tokens, "\n\n")
    return docs.select("doc_id", F.posexplode(packed).alias("chunk_no", "text")).withColumn("token_count", estimate_tokens(F.col("text")))


def chunk_id(*parts: str) -> Column:
    """Ids follow from content, so a rerun gives the same ones."""
    return F.sha2(F.concat_ws(":", *[F.col(p).cast("string") for p in parts]), 256)


def reject_reason(s: Settings = DEFAULTS) -> Column:
    """Why a chunk fails the gate; null if it passes. Parents may be short."""
    missing = F.filter(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in REQUIRED]), lambda c: c.isNotNull())
    short = ~F.col("is_parent") & (F.col("token_count") < s.chunk_min_tokens)
    return F.when(short, "short").when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))).when(F.coalesce("page_number", F.lit(0)) < 0, "page")


def first_of_equal_texts(chunks: DataFrame, order: list[str], by_parent: bool = True) -> DataFrame:
    """The first chunk in emission order of each md5(doc_id:text); with by_parent, parents and children apart."""
    key = ["doc_id", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text"))] + (["is_parent"] if by_parent else [])
    return chunks.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


@dataclass(frozen=True)
class Strategy:
    """A way to chunk: ``build`` makes rows (doc_id, chunk_no, text) of documents, ``fault`` says why it cannot take one (null: it can)."""

    name: str
    build: Callable[[DataFrame], DataFrame]
    fault: Column | None = None


def orchestrate(docs: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """All strategies in order: doc_id, place, strategy, chunk_no, text, error.

    A document that a strategy cannot take gives one row with the error in its place, and
    neither the other strategies nor the other documents lose anything.
    """
    none, out = F.lit(None).cast("string"), None
    for place, one in enumerate(strategies):
        judged = docs.withColumn("_fault", none if one.fault is None else one.fault)
        made = one.build(judged.where("_fault is null").drop("_fault")).select("doc_id", F.lit(place).alias("place"), F.lit(one.name).alias("strategy"), F.col("chunk_no").cast("int").alias("chunk_no"), "text", none.alias("error"))
        lost = judged.where("_fault is not null").select("doc_id", F.lit(place).alias("place"), F.lit(one.name).alias("strategy"), F.lit(None).cast("int").alias("chunk_no"), none.alias("text"), F.col("_fault").alias("error"))
        both = made.unionByName(lost)
        out = both if out is None else out.unionByName(both)
    return out
