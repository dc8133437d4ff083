"""From the turns of conversations to searches and chunks: rewriting, parts, filters, variants, hybrid search, the whole run."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.session import saved
from ..functions.text import category_of, clean_rewrite, variants
from ..functions.words import PRODUCTS
from . import retrieval as S
from .models import sub_queries
from .search_run import refine

#: Searches that meet the corpus in one statement, about; what a statement shuffles grows with these and the corpus.
ROUND = 1 << 18
#: A question with such a word speaks of something said before.
REFERENCE = r"(?i)(^|[^a-z0-9])(it|its|this|that|these|those|they|them|their|one)([^a-z0-9]|$)"
#: A product's name as words of their own.
PRODUCT = "(^|[^a-z0-9]){}([^a-z0-9]|$)"
#: Other words for the same thing; none on the right stands on the left.
RESTATED = (("home loan", "housing loan"), ("car loan", "vehicle loan"), ("net banking", "internet banking"), ("interest rate", "rate of interest"), ("complaint", "grievance"))


def asked(turns: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Turns (conv_id, turn, role, text) -> the user's, with the messages before them: conv_id, turn, text, history.

    history, in order, has (turn, role, text) of the last ``2 * history_turns`` messages;
    blank ones are no messages. Messages of equal turn are in the order of role and text.
    """
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(-2 * s.history_turns, -1)
    said = turns.where("trim(text) <> ''").withColumn("history", F.collect_list(F.struct("turn", "role", "text")).over(before))
    return said.where("role = 'user'").select("conv_id", "turn", "text", "history")


def named(text: Column) -> Column:
    """Products that a text names, sorted."""
    low = F.lower(text)
    return F.array_sort(F.filter(F.array(*[F.when(low.rlike(PRODUCT.format(p)), F.lit(p)) for p in PRODUCTS]), lambda p: p.isNotNull()))


def refer_back(query: Column, history: Column) -> Column:
    """Stand-in for a rewriting model: a question that refers to something, and names no product, gets those named last."""
    last = F.try_element_at(F.filter(F.transform(history, lambda m: named(m["text"])), lambda p: F.size(p) > 0), F.lit(-1))
    return F.when(query.rlike(REFERENCE) & (F.size(named(query)) == 0) & last.isNotNull(), F.concat(query, F.lit(" ("), F.array_join(last, ", "), F.lit(")"))).otherwise(query)


def standalone(query: Column, history: Column, works: Column | bool = True, generate: Callable[[Column, Column], Column] = refer_back) -> Column:
    """The query as it reads without its history; as it is where there is none, or where the model fails or writes under five characters."""
    works = works if isinstance(works, Column) else F.lit(works)
    out = clean_rewrite(generate(query, history), query)
    return F.when(works & (F.size(history) > 0), F.coalesce(out, query)).otherwise(query)


def restated(query: Column) -> Column:
    """Stand-in for a model that lists variants: other words for the same thing, and the words of over three letters."""
    flat = F.trim(F.regexp_replace(query, r"\s+", " "))
    other = flat
    for a, b in RESTATED:
        other = F.regexp_replace(other, rf"(?i)\b{a}\b", b)
    keywords = F.array_join(F.filter(F.split(flat, " "), lambda w: F.length(w) > 3), " ")
    line = lambda n, text: F.when(text != flat, F.concat(F.lit(f"{n}. "), text))
    return F.concat_ws("\n", line(1, other), line(2, keywords))


def searches(questions: DataFrame, generate: Callable[[Column], Column] = restated, s: Settings = DEFAULTS) -> DataFrame:
    """Questions (query_id, rewritten) -> query_id, part, variant, text, only: a row for each search.

    A compound question is searched part by part, each part with a filter of its own
    (``only``, a category or null) and in up to ``variants`` other wordings after its own;
    where the model gives none, its own remains.
    """
    parts = questions.select("query_id", F.posexplode(sub_queries(F.col("rewritten"))).alias("part", "asks"))
    every = F.concat(F.array("asks"), F.coalesce(variants(generate(F.col("asks")), s.variants), F.array().cast("array<string>")))
    return parts.select("query_id", "part", category_of(F.col("asks")).alias("only"), F.posexplode(every).alias("variant", "text"))


def hybrid(wanted: DataFrame, corpus: DataFrame, embed: Callable[[DataFrame], DataFrame], folder: str, s: Settings = DEFAULTS) -> DataFrame:
    """Searches (query_id, part, variant, text, only) -> query_id, part, variant, id, score: of each search the best by rank fusion.

    corpus (id, vec, label, text). ``embed`` adds vec to rows with a text. The filter
    holds for the vectors; the word search reads all of the corpus. Searches go in rounds of about ``ROUND``, and each round's two lists are
    tables in ``folder``: the shuffle files of one list are gone when the next begins.
    """
    one, lists = wanted.withColumn("query_id", F.struct("query_id", "part", "variant")), []
    vectors = saved(embed(one).select("query_id", F.col("vec").alias("qvec"), "only"), f"{folder}/asked")
    rounds = max(-(-wanted.count() // ROUND), 1)
    for i in range(rounds):
        # Not the bits that deal the searches to blocks.
        now = lambda rows, i=i: rows.where(F.pmod(F.hash("query_id"), F.lit(rounds)) == i)
        dense = S.dense_top_k(now(vectors), corpus, s.dense_k)
        lists.append(saved(dense.select("query_id", "id", "rank"), f"{folder}/dense-{i}"))
        sparse = S.bm25_top_k(now(one).select("query_id", "text"), corpus.select("id", "text"), s.sparse_k)
        lists.append(saved(sparse.select("query_id", "id", "rank"), f"{folder}/sparse-{i}"))
    fused = S.reciprocal_rank_fusion(reduce(DataFrame.unionByName, lists), s.rrf_k).withColumn("score", F.round("score", 8))
    return S.top(fused, ["query_id"], [F.desc("score"), F.asc("id")], s.final_k).select("query_id.*", "id", "score")


def answer_rows(questions: DataFrame, corpus: DataFrame, parents: DataFrame, embed: Callable[[DataFrame], DataFrame], folder: str, scorer: Callable[[Column, Column], Column] = S.word_overlap, near: float | None = None, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(chunks, counts) of the whole run over questions (query_id, rewritten, rerank_works).

    Parts, filters, variants and hybrid search; of each chunk the best score over all
    searches; then as ``search_run.retrieve``, which has the columns of both results.
    counts has the number of searches too. The searches, which every list reads, and
    what they found are tables in ``folder``.
    """
    wanted = saved(searches(questions, s=s), f"{folder}/searches")
    found = saved(S.best_score(hybrid(wanted, corpus, embed, folder, s).select("query_id", "id", "score")), f"{folder}/found")
    info = questions.select("query_id", F.col("rewritten").alias("query_text"), "rerank_works")
    chunks, counts = refine(found, info, corpus, parents, scorer, near, s)
    return chunks, counts.join(wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("searches")), "query_id")
