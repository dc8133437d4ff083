"""Answers against their sources: citations, confidence, guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import cited_numbers, clamp, claim_words, numeric_sentences
from .models import NO_EVIDENCE


def retrieval_confidence(scores: Column) -> Column:
    """Mean of the scores, over their maximum unless that is above one half; 0 without a positive score."""
    top = F.array_max(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return F.when((F.size(scores) == 0) | (F.coalesce(top, F.lit(0.0)) <= 0), 0.0).when(top > 0.5, clamp(mean)).otherwise(clamp(mean / top))


def citation_completeness(answer: Column, n_sources: Column) -> Column:
    cited = cited_numbers(answer)
    valid = F.size(F.filter(cited, lambda c: (c >= 1) & (c <= n_sources)))
    share = 0.7 * valid / F.greatest(F.size(cited), F.lit(1)) + 0.3 * F.least(valid / F.greatest(n_sources, F.lit(1)), F.lit(1.0))
    return F.when(F.size(cited) == 0, F.when(F.length(answer) < 100, 0.6).otherwise(0.2)).otherwise(clamp(share))


def _grounded(sentence: Column, chunks: Column, least: float) -> Column:
    """Whether a cited chunk covers enough of the sentence's words."""
    own = claim_words(sentence)
    cited = F.filter(cited_numbers(sentence), lambda c: (c >= 1) & (c <= F.size(chunks)))
    return F.exists(cited, lambda c: F.size(F.array_intersect(own, claim_words(F.get(chunks, c - 1)))) / F.greatest(F.size(own), F.lit(1)) >= least)


def numeric_faithfulness(answer: Column, chunks: Column, s: Settings = DEFAULTS) -> Column:
    """Share of numeric sentences that a cited source covers; those under three words pass if cited."""
    found = numeric_sentences(answer)
    good = F.filter(found, lambda x: (F.size(cited_numbers(x)) > 0) & ((F.size(claim_words(x)) < 3) | _grounded(x, chunks, s.guard_min_overlap)))
    return F.when(F.size(found) == 0, 0.75).otherwise(F.size(good) / F.size(found))


def harmonic_mean(scores: list[Column], weights: list[float]) -> Column:
    total = F.lit(0.0)
    for score, weight in zip(scores, weights, strict=True):
        total = total + F.lit(weight) / F.greatest(score, F.lit(0.01))
    return F.lit(sum(weights)) / total


def label(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "HIGH").when(confidence >= 0.5, "MEDIUM").when(confidence >= 0.35, "LOW").otherwise("VERY_LOW")


def guard_issues(answer: Column, chunks: Column, confidence: Column, s: Settings = DEFAULTS) -> Column:
    """Number of issues: bad citations, none in a long answer, ungrounded numeric sentences, low confidence.

    Sentences are only looked at where some citation resolves; uncited ones are left to the citation check.
    """
    cited = cited_numbers(answer)
    bad = F.size(F.filter(cited, lambda c: (c < 1) | (c > F.size(chunks))))
    silent = ((F.size(cited) == 0) & (F.length(answer) > 100)).cast("int")
    resolved = F.size(cited) - bad > 0
    loose = F.size(F.filter(numeric_sentences(answer), lambda x: (F.size(cited_numbers(x)) > 0) & (F.size(claim_words(x)) >= 3) & ~_grounded(x, chunks, s.guard_min_overlap)))
    return bad + silent + F.when(resolved, loose).otherwise(0) + (confidence < s.confidence_min).cast("int")


def guard_result(issues: Column, confidence: Column, s: Settings = DEFAULTS) -> Column:
    return F.when(issues == 0, "PASS").when((confidence < s.confidence_min * 0.7) | (issues >= 3), "FAIL").otherwise("WARN")


REFUSAL = "The available documents do not hold enough information to answer this."
NOTE = "\n\n---\nNote: parts of this answer could not be checked against its sources."


def replies(rows: DataFrame, refusal: str = REFUSAL, note: str = NOTE, s: Settings = DEFAULTS) -> DataFrame:
    """Rows (answer, chunks, evidence, overall, issues, ...) through the three gates of a turn: adds outcome, reason, reply.

    A turn is refused without sources, then without evidence in them, then if the guard
    fails the answer or its confidence is too low. A failed answer is replaced; one that is
    only doubtful keeps its text, with a note.
    """
    guard = guard_result(F.col("issues"), F.col("overall"), s)
    reason = (
        F.when(F.coalesce(F.size("chunks"), F.lit(0)) <= 0, "no sources")
        .when(F.upper(F.trim(F.coalesce("evidence", F.lit("")))).isin("", NO_EVIDENCE), "no evidence")
        .when((guard == "FAIL") | (F.col("overall") < s.confidence_min), "low confidence")
    )
    judged = rows.withColumn("reason", reason)
    silent = F.coalesce(F.col("reason").isin("no sources", "no evidence"), F.lit(False)) | (guard == "FAIL")
    reply = F.when(silent, refusal).when(guard == "WARN", F.concat("answer", F.lit(note))).otherwise(F.col("answer"))
    return judged.withColumn("outcome", F.when(F.col("reason").isNull(), "answered").otherwise("refused")).withColumn("reply", reply)
