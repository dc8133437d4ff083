"""The whole retrieval run: variants, filters, search, deduplication, rerank, compression, parents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.folds import greedy_distinct
from . import retrieval as S


def retrieve(queries: DataFrame, corpus: DataFrame, parents: DataFrame, scorer: Callable[[Column, Column], Column] = S.word_overlap, near: float | None = None, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(chunks, counts) of a run.

    queries (query_id, variant, qvec, only, text, rerank_works): a row for each variant
    of a query, all with its text; corpus (id, vec, label, text, parent_id); parents
    (id, text). A variant whose vector is missing finds nothing, the others go on; where
    the reranker fails the candidates keep their order; a child whose parent is missing
    stays itself. chunks: query_id, id, text, score, kind. counts, a row for each query:
    outcome (answered or insufficient), candidates, reranked, compressed, expanded, top_score.
    An id of ``parents`` is there once, so the counts follow from the children.
    """
    asked = queries.withColumn("query_id", F.struct("query_id", "variant"))
    found = S.dense_top_k(asked.select("query_id", "qvec", "only"), corpus, s.final_k)
    whole = found.withColumn("query_id", F.col("query_id.query_id"))
    info = queries.groupBy("query_id").agg(F.first("text").alias("query_text"), F.first("rerank_works").alias("rerank_works"))
    return refine(S.best_score(whole), info, corpus, parents, scorer, near, s)


def refine(found: DataFrame, info: DataFrame, corpus: DataFrame, parents: DataFrame, scorer: Callable[[Column, Column], Column] = S.word_overlap, near: float | None = None, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """What follows a search (query_id, id, score), as (chunks, counts) of ``retrieve``; info (query_id, query_text, rerank_works)."""
    candidates = found.withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    read = candidates.join(info, "query_id").join(corpus.select("id", "vec", "text", "parent_id"), "id")
    ranked = S.rerank(read, scorer(F.col("query_text"), F.col("text")), s.rerank_k, F.col("rerank_works"))
    # Texts are a list of their own, so that the counts move none behind the scorer.
    listed = lambda *c: F.array_sort(F.collect_list(F.struct("rank", *c)))
    grouped = ranked.withColumn("parent_id", F.col("parent_id").cast("string")).groupBy("query_id").agg(listed("id", "score", "vec", "parent_id").alias("r"), listed("text").alias("texts"), F.max("candidates").alias("candidates"))
    limit = s.near_dup_cosine if near is None else near
    kept = grouped.select("query_id", "candidates", "texts", F.size("r").cast("long").alias("reranked"), greedy_distinct(F.col("r"), limit).alias("kept"))
    hits = kept.select("query_id", "texts", F.explode("kept").alias("x")).select("query_id", F.col("x.id").cast("string").alias("id"), "x.parent_id", F.element_at("texts", F.col("x.rank"))["text"].alias("text"), "x.score")
    chunks = S.expand_parents(hits, parents)
    above = F.col("kept.parent_id")
    grown = F.size(F.filter(above, lambda p: p.isNull())) + F.size(F.array_distinct(F.filter(above, lambda p: p.isNotNull())))
    stages = kept.select("query_id", "candidates", "reranked", F.size("kept").cast("long").alias("compressed"), grown.alias("expanded"), F.array_max("kept.score").alias("top_score"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    counts = info.select("query_id").join(stages, "query_id", "left")
    outcome = F.when(F.col("expanded") > 0, "answered").otherwise("insufficient")
    return chunks, counts.select("query_id", outcome.alias("outcome"), n("candidates"), n("reranked"), n("compressed"), n("expanded"), "top_score")
