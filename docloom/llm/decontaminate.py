"""Benchmark decontamination: BM25 over test items, block-max WAND, overlap check.

The test items form an inverted index whose postings carry BM25 impacts divided by the
item's score for itself, so one threshold serves all items. Items stand in blocks, and
each term knows its largest impact in every block that has it. Passages (overlapping
windows of words) of every document query the index: sums of the block maxima of a
passage's terms rule out almost every block; in the remaining ones WAND walks the
postings document at a time. Every item above the threshold is retrieved and
verified by the overlap of its question and answer parts with the passage. Items longer
than a passage's step form classes by length, each with passages and steps twice as long
as the class before, so that every item fits whole into a passage wherever it stands.
A large benchmark is indexed in shards of bounded size, each searched by all documents,
with document frequencies and lengths counted over all of it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Workspace, prefix_hash, short_batches, slices, span_hash, table, text_bytes, unused, word_spans

K1, B = 1.2, 0.75
#: Least BM25 score of a passage, as a share of the item's score for itself.
THRESHOLD = 0.6
#: Words of a passage, and from one start to the next; items of up to the difference fit into one passage. Doubled for each class of longer items.
PASSAGE, STEP = 128, 64
#: Shares of the question's and the answer's word 3-grams that must occur in the passage.
QUESTION_SHARE, ANSWER_SHARE = 0.6, 0.6
GRAM = 3
ANSWER_WORDS = 5
#: Items in a block of the index.
BLOCK = 4
#: Bytes of test items in one index, which goes to every executor; more of them make more indexes, one pass each.
SHARD_BYTES = 8 << 20
#: Block maxima that are added up at once.
AT_ONCE = 1 << 22

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_is_word = np.zeros(256, bool)
_is_word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the lower-case words of all rows, and their rows."""
    starts, ends, rows = word_spans(data, offsets, _is_word)
    return span_hash(prefix_hash(_lower[data]), starts, ends), rows


def text_words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return _words(raw, np.array([0, len(raw)]))[0]


def _grams(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Distinct fingerprints of all runs of ``size`` words."""
    if not size or len(words) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        out += words[j : len(words) - size + 1 + j] * np.uint64(0x9FB21C651E98DF25 + 2 * j * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1)
    return np.unique(out)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last sentences of five words at least; a lone sentence is cut at two thirds of its words."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    cut = len(parts) - 1
    while cut > 1 and len(" ".join(parts[cut:]).split()) < ANSWER_WORDS:
        cut -= 1
    if cut > 0:
        return " ".join(parts[:cut]), " ".join(parts[cut:])
    words = text.split()
    cut = max(1, 2 * len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


@dataclass
class Index:
    """terms: sorted fingerprints; postings of term t are items and impacts from bounds[t] to bounds[t + 1]."""

    item_ids: list[int] = field(default_factory=list)
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    items: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    impacts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Blocks of term t and its largest impacts there, from block_bounds[t] to block_bounds[t + 1].
    block_bounds: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    block_max: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Question and answer of each item, as words.
    parts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    #: (class, first item, last item + 1): items stand by class, and class c fits steps of STEP << c words.
    classes: list[tuple[int, int, int]] = field(default_factory=list)


def _class(n_words: int) -> int:
    """The least c with n_words <= STEP << c."""
    return (-(-n_words // STEP) - 1).bit_length()


@dataclass
class Counts:
    """Items with words, their mean length, and in how many of them each term stands."""

    items: int
    mean_length: float
    terms: np.ndarray
    frequency: np.ndarray


def build_index(items: list[tuple[int, str]], counts: Counts | None = None) -> Index:
    """Items (id, text); those without a word are left out. counts, if the items are not all."""
    read = [(i, text_words(t), t) for i, t in sorted(items, key=lambda x: (x[0], x[1]))]
    read = sorted((r for r in read if len(r[1])), key=lambda r: _class(len(r[1])))
    if not read:
        return Index()
    terms, where = np.unique(np.concatenate([w for _, w, _ in read]), return_inverse=True)
    owner = np.repeat(np.arange(len(read)), [len(w) for _, w, _ in read])
    pair, count = np.unique(where * len(read) + owner, return_counts=True)
    term, item = pair // len(read), pair % len(read)
    own = np.bincount(term, minlength=len(terms))
    length = np.array([len(w) for _, w, _ in read], float)
    if counts is None:
        counts = Counts(len(read), length.mean(), terms, own)
    frequency = counts.frequency[np.searchsorted(counts.terms, terms)]
    idf = np.log(1 + (counts.items - frequency + 0.5) / (frequency + 0.5))
    impact = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[item] / counts.mean_length))
    impact /= np.bincount(item, weights=impact)[item]
    # Pairs stand by term and item, so those of one block are neighbours.
    block = item // BLOCK
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])))
    top = np.maximum.reduceat(impact, first) + 1e-9
    parts = [tuple(text_words(p) for p in split_item(t)) for _, _, t in read]
    of = np.array([_class(len(w)) for _, w, _ in read])
    classes = [(int(c), int(np.searchsorted(of, c)), int(np.searchsorted(of, c, side="right"))) for c in np.unique(of)]
    bounds = np.concatenate(([0], np.cumsum(own)))
    block_bounds = np.searchsorted(first, bounds)
    return Index([i for i, _, _ in read], terms, bounds, item, impact, block_bounds, block[first], top, parts, classes)


def wand(index: Index, query: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
    """Items of one block with a score of at least threshold for the query's distinct terms.

    Cursors stand on the terms' next postings in the block, in order of item. The first
    cursor at which the block maxima add up to the threshold gives the pivot; items
    before it can't reach the threshold and are skipped.
    """
    lo, hi = block * BLOCK, (block + 1) * BLOCK
    cursors = []
    for t in query:
        a, b = index.block_bounds[t], index.block_bounds[t + 1]
        here = a + np.searchsorted(index.blocks[a:b], block)
        if here == b or index.blocks[here] != block:
            continue
        a, b = index.bounds[t], index.bounds[t + 1]
        begin, end = a + np.searchsorted(index.items[a:b], (lo, hi))
        cursors.append([int(index.items[begin]), float(index.block_max[here]), int(begin), int(end)])
    found = []
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, None
        for c in cursors:
            bound += c[1]
            if bound >= threshold:
                pivot = c[0]
                break
        if pivot is None:
            break
        if cursors[0][0] == pivot:
            score = 0.0
            for c in cursors:
                if c[0] == pivot:
                    score += float(index.impacts[c[2]])
            if score >= threshold:
                found.append((pivot, score))
            target = pivot + 1
        else:
            target = pivot
        for c in cursors:
            while c[2] < c[3] and index.items[c[2]] < target:
                c[2] += 1
            if c[2] < c[3]:
                c[0] = int(index.items[c[2]])
        cursors = [c for c in cursors if c[2] < c[3]]
    return found


def _share(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of the part's word 3-grams (of all its words, if fewer) that the passage has."""
    size = min(GRAM, len(part))
    own = _grams(part, size)
    return 1.0 if not len(own) else float(np.isin(own, _grams(passage, size), assume_unique=True).mean())


def matches(index: Index, words: np.ndarray, rows: np.ndarray, n_rows: int) -> dict[int, dict[int, float]]:
    """For rows of words: row -> {item position: best score} of verified items."""
    out: dict[int, dict[int, float]] = {}
    if not len(words) or not len(index.terms):
        return out
    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    term = np.where(index.terms[at] == words, at, len(index.terms))
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    for grade, lo, hi in index.classes:
        _match_class(index, words, term, first, PASSAGE << grade, STEP << grade, lo, hi, out)
    return {r: own for r, own in out.items() if own}


def _open_blocks(index: Index, passage: np.ndarray, known: np.ndarray, lo: int, hi: int):
    """(passage, block) with a sum of block maxima of at least the threshold, for pairs of passage and term, passages in order.

    What is added up is one entry for each term and block that has it, some passages at a time.
    """
    size = index.block_bounds[known + 1] - index.block_bounds[known]
    ends = np.cumsum(size)
    first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    first, n, at = np.append(first, len(passage)), len(first), 0
    while at < n:
        before = ends[first[at] - 1] if first[at] else 0
        stop = int(np.searchsorted(ends[first[1:] - 1], before + AT_ONCE, side="right"))
        stop = min(max(stop, at + 1), at + max(1, AT_ONCE // (hi - lo)))
        own = slice(first[at], first[stop])
        entry = np.arange(int(size[own].sum())) + np.repeat(index.block_bounds[known[own]] - (ends[own] - size[own] - before), size[own])
        owner = np.repeat(np.repeat(np.arange(stop - at), np.diff(first[at : stop + 1])), size[own])
        block = index.blocks[entry]
        inside = (block >= lo) & (block < hi)
        bound = np.bincount(owner[inside] * (hi - lo) + block[inside] - lo, weights=index.block_max[entry[inside]], minlength=(stop - at) * (hi - lo))
        good = np.flatnonzero(bound >= THRESHOLD)
        yield from zip(passage[first[at + good // (hi - lo)]].tolist(), (lo + good % (hi - lo)).tolist(), strict=True)
        at = stop


def _match_class(index: Index, words: np.ndarray, term: np.ndarray, first: np.ndarray, passage_words: int, step: int, lo: int, hi: int, out: dict[int, dict[int, float]]) -> None:
    """Adds the verified items from lo to hi, by passages of their class, to out."""
    n_rows, size = len(first) - 1, np.diff(first)
    count = np.where(size > 0, np.maximum(1, -(-(size - (passage_words - step)) // step)), 0)
    owner = np.repeat(np.arange(n_rows), count)
    start = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * step
    end = np.minimum(start + passage_words, first[owner + 1])
    # Each passage's distinct terms, passage by passage.
    length = end - start
    word = np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)
    pair = np.repeat(np.arange(len(start)), length) * (len(index.terms) + 1) + term[word]
    pair = np.unique(pair[term[word] < len(index.terms)])
    if not len(pair):
        return
    passage, known = pair // (len(index.terms) + 1), pair % (len(index.terms) + 1)
    begin = np.searchsorted(passage, np.arange(len(start) + 1))
    for p, block in _open_blocks(index, passage, known, lo // BLOCK, -(-hi // BLOCK)):
        found = wand(index, known[begin[p] : begin[p + 1]], block, THRESHOLD)
        found = [(item, score) for item, score in found if lo <= item < hi]
        if found:
            held = words[start[p] : end[p]]
            own = out.setdefault(int(owner[p]), {})
            for item, score in found:
                question, answer = index.parts[item]
                if _share(question, held) >= QUESTION_SHARE and _share(answer, held) >= ANSWER_SHARE:
                    own[item] = max(own.get(item, 0.0), score)


def finder(index: Index):
    """A Column function: text -> struct(item_ids, best_score) of the index's items."""

    @F.arrow_udf("item_ids array<long>, best_score double")
    def find(texts: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        rows: list[dict[int, float]] = []
        for lo, hi in slices(offsets, 1 << 20):
            words, owner = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            found = matches(index, words, owner, hi - lo)
            rows += [found.get(i, {}) for i in range(hi - lo)]
        ids = [sorted({index.item_ids[k] for k in r}) for r in rows]
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int64())), pa.array([max(r.values(), default=0.0) for r in rows], pa.float64())], names=["item_ids", "best_score"])

    return find


def _terms(batches):
    """Each item's number of words, as term null, and its distinct terms."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        words, rows = _words(data, offsets)
        size = np.bincount(rows, minlength=batch.num_rows)
        own = [np.unique(words[rows == i]) for i in np.flatnonzero(size)]
        n = int((size > 0).sum())
        yield pa.record_batch([pa.nulls(n, pa.int64()), pa.array(size[size > 0], pa.int64())], names=["term", "n"])
        if own:
            terms = np.concatenate(own).astype(np.int64)
            yield pa.record_batch([pa.array(terms), pa.array(np.ones(len(terms), np.int64))], names=["term", "n"])


def indexes(spark: SparkSession, items: DataFrame, shard_bytes: int = SHARD_BYTES):
    """The indexes of the items' shards, one after another; a single one if the items are few."""
    listed = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    read = lambda rows: [(r["item_id"], r["text"]) for r in rows.collect()]
    size = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // shard_bytes)
    if shards <= 1:
        yield build_index(read(listed))
        return
    ws = Workspace(spark)
    counted = ws.save(listed.select("text").mapInArrow(_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")), "terms")
    total = counted.where("term is null").first()
    if total is None:
        # Nothing but blank items.
        ws.close()
        yield build_index([])
        return
    for k in range(shards):
        part = listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        # A shard's items and their terms: bounded by its bytes.
        own = counted.where("term is not null").join(part.select("text").mapInArrow(_terms, "term long, n long").select("term").distinct(), "term", "left_semi").toPandas()
        terms, frequency = own["term"].to_numpy(np.int64).astype(np.uint64), own["n"].to_numpy(np.int64)
        order = np.argsort(terms)
        yield build_index(read(part), Counts(total["rows"], total["n"] / total["rows"], terms[order], frequency[order]))
    ws.close()


def with_matches(spark: SparkSession, docs: DataFrame, items: DataFrame, name: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with a column struct(item_ids, best_score) of that name.

    With several shards of items the rows are numbered in a table that is written once;
    each shard reads the texts of it and writes the rows with matches, and these few are
    joined to it at the end.
    """
    short_batches(spark)
    shards = indexes(spark, items, shard_bytes)
    first, second = next(shards), next(shards, None)
    text = F.col("text").cast("string")
    if second is None:
        return docs.withColumn(name, finder(first)(text))
    ws, key = Workspace(spark), unused(docs, "_row")
    numbered = ws.save(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    parts = []
    for k, index in enumerate(chain([first, second], shards)):
        hits = numbered.select(F.col(key).alias("row"), finder(index)(text).alias("f")).where(F.size("f.item_ids") > 0)
        parts.append(ws.save(hits.select("row", "f.*"), f"hits_{k}"))
    found = reduce(DataFrame.unionAll, parts).groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("ids"), F.max("best_score").alias("best"))
    found = found.select(F.col("row").alias(f"{key}_next"), F.struct(F.col("ids").alias("item_ids"), F.col("best").alias("best_score")).alias(name))
    none = F.struct(F.array().cast("array<bigint>").alias("item_ids"), F.lit(0.0).alias("best_score"))
    met = numbered.join(found, F.col(key) == F.col(f"{key}_next"), "left")
    return met.withColumn(name, F.coalesce(F.col(name), none)).drop(key, f"{key}_next")


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each row of docs: n_items, item_ids (ascending), best_score, contaminated.

    Null or blank texts match nothing; items with a null id or text are left out; equal
    items are all reported, in order of id. Repeated rows give equal results; a null
    doc_id stays null; empty tables give no match or no row. Items and texts of any
    length are read whole; other columns of both tables are not read. A benchmark of
    more than shard_bytes is searched shard by shard.
    """
    found = with_matches(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), items, "found", shard_bytes)
    ids = F.col("found.item_ids")
    return found.select("doc_id", F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.col("found.best_score").alias("best_score"), (F.size(ids) > 0).alias("contaminated"))


def uncontaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, all columns as they were, null ids too."""
    name = unused(docs, "found")
    return with_matches(spark, docs, items, name).where(F.size(F.col(name)["item_ids"]) == 0).drop(name)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents; awkward rows as in ``decontaminate``."""
    return decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
