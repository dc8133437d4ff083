"""Toxicity: a weighted lexicon, learned from labels, matched by Aho-Corasick.

Texts are folded first (case, look-alike letters, digits and signs that stand for
letters; everything else that is no letter becomes a space). Lexicon entries are
whole words or word beginnings with log-odds weights. Phrases that hold an entry but
occur in clean documents alone are exceptions: a hit inside one does not count. The
sum of weights, alone and over the length of the text, is calibrated to a score.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Workspace, short_batches, table

#: Labelled rows to learn from, chosen by a hash of doc_id: at most about this many of each label.
TRAIN_ROWS = 5000
#: An entry's count among toxic and clean training documents must be this far from chance (likelihood ratio, one degree of freedom, p = 0.001).
LEAST_SURPRISE = 10.83
MIN_WEIGHT = 3.0
PREFIXES = (4, 5, 6, 7)
#: A phrase is an exception with this many clean documents and at most a twentieth as many toxic ones.
EXCEPTION_DOCS = 5

# Letters that look like Latin ones, and digits or signs used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i",
}


def _fold_table() -> dict[int, str]:
    folded = {code: " " for code in range(0x250) if not chr(code).isalpha()}
    folded |= {ord(a): b for a, b in LOOKALIKES.items()}
    wide = {code: chr(code - 0xFEE0) for code in (*range(0xFF41, 0xFF5B),)}
    spaces = dict.fromkeys([*range(0x2000, 0x2070), 0x3000, 0xFEFF], " ")
    hidden = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060], "")
    return folded | wide | spaces | hidden


_FOLD = _fold_table()
_SHOUT = re.compile(r"!+(?!\w)")


def fold(text: str | None) -> str:
    """The folded text between spaces; ``!`` stands for a letter only before another."""
    low = (text or "").lower()
    if "!" in low:
        low = _SHOUT.sub(" ", low)
    return f" {low.translate(_FOLD)} "


@dataclass(frozen=True)
class Lexicon:
    """Entries are folded strings that begin with a space; a whole word also ends with one."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    bias: tuple[float, float, float]

    def matcher(self):
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found


def hits(automaton, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of hits outside exception phrases; a word counts once, by its largest weight."""
    if not len(automaton):
        return []
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for last, (size, weight) in automaton.iter(folded):
        start = last + 1 - size
        if weight is None:
            spared.append((start, last + 1))
        elif start not in best or best[start][1] < weight:
            best[start] = (last + 1, weight)
    if not spared:
        return [(s, e, w) for s, (e, w) in sorted(best.items())]
    # By start, and how far the phrases that start no later reach.
    spared.sort()
    begin, reach = [a for a, _ in spared], list(itertools.accumulate((b for _, b in spared), max))
    inside = lambda s, e: (k := bisect.bisect_right(begin, s)) > 0 and e <= reach[k - 1] + 1
    return [(s, e, w) for s, (e, w) in sorted(best.items()) if not inside(s, e)]


def features(found, folded: str) -> tuple[float, float]:
    total = sum(w for _, _, w in found)
    return math.log1p(total), total / math.sqrt(1 + folded.count(" "))


def _entries(batches):
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = set()
            for word in set(fold(text).split()):
                if len(word) > 1:
                    own.add(f" {word} ")
                    own.update(f" {word[:k]}" for k in PREFIXES if k < len(word))
            seen[toxic].update(own)
    for toxic, counts in seen.items():
        items = list(counts.items())
        for lo in range(0, len(items), 50_000):
            part = items[lo : lo + 50_000]
            yield pa.record_batch([pa.array([k for k, _ in part]), pa.array([toxic] * len(part), pa.int32()), pa.array([n for _, n in part], pa.int64())], names=["entry", "toxic", "n"])


def _phrases(weights):
    def work(batches):
        automaton = Lexicon(weights, (), (0, 0, 0)).matcher()
        seen: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded, own = " ".join(["", *fold(text).split(), ""]), set()
                for start, end, _ in hits(automaton, folded):
                    stop = folded.index(" ", max(end - 1, start + 1))
                    before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
                    if before >= 0:
                        own.add(folded[before : stop + 1])
                    if after >= 0:
                        own.add(folded[start : after + 1])
                seen.update((p, toxic) for p in own)
        yield pa.record_batch([pa.array([p for p, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["entry", "toxic", "n"])

    return work


def _measured(lexicon):
    def work(batches):
        automaton = lexicon.matcher()
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                folded = fold(text)
                rows.append(features(hits(automaton, folded), folded))
            yield pa.record_batch([pa.array([a for a, _ in rows], pa.float64()), pa.array([b for _, b in rows], pa.float64()), batch.column(1)], names=["a", "b", "toxic"])

    return work


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(3)
        beta += np.linalg.solve(hessian, design.T @ (y - p) - 0.05 * beta)
    return tuple(float(b) for b in beta)


def _surprise(bad: Column, good: Column, totals: dict[int, int]) -> Column:
    """Likelihood ratio statistic of the counts against shares equal to the classes' sizes."""
    n = totals[0] + totals[1]
    part = lambda seen, total: F.when(seen > 0, seen * F.log(seen * n / ((bad + good) * total))).otherwise(0.0)
    return 2 * (part(bad, totals[1]) + part(good, totals[0]))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from the documents with a non-null label; without both labels, an empty one."""
    ws = Workspace(spark)
    own = F.col("doc_id").cast("string")
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(F.crc32(own) % 5 != 0)
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("doc_id").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, TRAIN_ROWS / n))).otherwise(share)
    chosen = marks.where(F.pmod(F.xxhash64(own), F.lit(1 << 20)) < share * (1 << 20)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # About 2 * TRAIN_ROWS rows of two numbers, whatever the size of the tables.
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    sample = ws.save(sample, "sample")
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return Lexicon({}, (), (-3.0, 0.0, 0.0))
    shape = "entry string, toxic int, n long"
    tally = lambda work: sample.mapInArrow(work, shape).groupBy("entry").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    weight = F.log((F.col("bad") + 0.5) / (totals[1] + 1)) - F.log((F.col("good") + 0.5) / (totals[0] + 1))
    # What the sample's bounded number of documents says beyond chance; the whole list comes back.
    ranked = tally(_entries).where(_surprise(F.col("bad"), F.col("good"), totals) >= LEAST_SURPRISE).withColumn("w", weight).where(F.col("w") >= MIN_WEIGHT).orderBy(F.desc("bad"), F.length("entry"), "entry").collect()
    weights: dict[str, float] = {}
    for r in ranked:
        if not any(r["entry"][:k] in weights for k in range(2, len(r["entry"]))):
            weights[r["entry"]] = float(r["w"])
    spared = tally(_phrases(weights)).where((F.col("good") >= EXCEPTION_DOCS) & (F.col("bad") * 20 <= F.col("good"))).orderBy(F.desc("good"), "entry").collect()
    lexicon = Lexicon(weights, tuple(r["entry"] for r in spared), (0.0, 0.0, 0.0))
    measured = sample.mapInArrow(_measured(lexicon), "a double, b double, toxic int").toPandas()
    ws.drop("sample")
    return Lexicon(weights, lexicon.exceptions, _calibrate(measured[["a", "b"]].to_numpy(), measured["toxic"].to_numpy().astype(float)))


def scorer(lexicon: Lexicon):
    """A Column function: text -> struct(score, n_hits); null and blank texts get the score of no hit."""

    @F.arrow_udf("score double, n_hits long")
    def score(texts: pa.Array) -> pa.Array:
        automaton = lexicon.matcher()
        c, a, b = lexicon.bias
        scores, counts = [], []
        for text in texts.to_pylist():
            folded = fold(text)
            found = hits(automaton, folded)
            x, y = features(found, folded)
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, c + a * x + b * y)))))
            counts.append(len(found))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(counts, pa.int64())], names=["score", "n_hits"])

    return score


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted, n_hits.

    Labels are learned only from rows whose crc32(doc_id) mod 5 is not 0; a null label
    or doc_id is not learned from. Rows with a null doc_id are scored, held_out false.
    Repeated rows are scored alike; an empty table gives an empty result; without
    labels of both kinds every score is that of no hit. Of entries that hit at one
    place the heaviest counts; a document labelled twice is toxic if one label says so.
    Long texts are one value each; other columns of both tables are not read.
    """
    short_batches(spark)
    score = scorer(learn(spark, docs, labels))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text").cast("string")).alias("found"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "found.score", (F.col("found.score") >= 0.5).cast("int").alias("predicted"), "found.n_hits")


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text the lexicon does not reject, all columns as they were, null ids too."""
    short_batches(spark)
    score = scorer(learn(spark, docs, labels))
    return docs.where(score(F.col("text").cast("string"))["score"] < 0.5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; nulls, empty and long texts as in ``toxicity``."""
    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
