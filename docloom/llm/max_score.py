"""Exact top-k by inner product of integer vectors: MaxScore over an inverted index of components.

A component is a term, and a term's posting list holds the rows in order of their id with
their value. A query's term has a score bound: its own value times the largest value of
its sign in the list. Once k scores are known, the terms of small bounds whose joint bound
does not reach the k-th score are non-essential: a row that they alone speak for cannot
enter. The lists of the others are traversed; what they gather for a row, with the bound of
the terms still unread, decides whether the row stays competitive and is probed in the next
few non-essential terms, those of the largest bounds first. The k-th score rises from one
range of rows to the next, so ever more terms become non-essential. The joint bound is the
sum of the terms' bounds or, where that is smaller, the product of the lengths of the two
vectors in these terms (Cauchy-Schwarz).

Rows are dealt to shards and queries to blocks, both of bounded size; each pair of a shard
and a block is one group of a cogrouped shuffle, and the k best of every shard are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import short_batches, table

K, SCALE = 5, 256
#: Rows of a shard and queries of a block, about.
SHARD, BLOCK = 1 << 17, 1 << 17
#: Fewer rows than this are not dealt to several shards for the sake of parallel tasks.
LEAST = 2048
#: Rows of the first range, which all terms of all queries score; every later range is twice as long.
FIRST = 1024
#: Queries whose first range is scored by one matrix product.
TOGETHER = 512
#: Non-essential terms that are probed between two looks at the bound.
PROBED = 4
LOWEST = -(2**63)


def usable(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    good = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    return F.coalesce(F.forall(vector, good), F.lit(False))


def _vectors(ids: pa.ChunkedArray, column: pa.ChunkedArray, scale: int):
    """(ids, matrix of whole numbers) for each length of vectors, ids ascending."""
    ids = ids.to_numpy()
    column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale), LOWEST, 2.0**63 - 1024)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        yield ids[rows], flat[start[rows][:, None] + np.arange(length)]


_whole = np.frompyfunc(int, 1, 1)


def _typed(values: np.ndarray, kind) -> np.ndarray:
    return _whole(values) if kind is object else values.astype(kind)


class Index:
    """Posting lists of one shard's vectors of one length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.most, self.least = rows.max(axis=0, initial=0), rows.min(axis=0, initial=0)
        self.length = float(np.sqrt((rows.astype(float) ** 2).sum(axis=1)).max(initial=0))
        self.lists = {}

    def typed(self, kind):
        """Lists and rows in a number type that holds every score exactly; a list of most rows is kept without their places."""
        if kind not in self.lists:
            rows = np.ascontiguousarray(_typed(self.rows, kind))
            lists = []
            for values in np.ascontiguousarray(rows.T):
                at = np.flatnonzero(values)
                lists.append((None, values) if 2 * len(at) > len(values) else (at, values[at]))
            self.lists = {kind: (rows, lists)}
        return self.lists[kind]

    def ranges(self):
        lo, step = 0, FIRST
        while lo < len(self.ids):
            yield lo, min(lo + step, len(self.ids))
            lo, step = lo + step, 2 * step


def _number(queries: np.ndarray, index: Index):
    """float32 or float64 where every partial sum of every score is exact, else Python's integers."""
    width = min(queries.shape[1], index.rows.shape[1])
    top = np.abs(queries).max(initial=0) * max(np.abs(index.most).max(initial=0), np.abs(index.least).max(initial=0)) * max(width, 1)
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else object


class Best:
    """The k best rows of one query so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if scores.dtype == object:
            scores = np.array([min(max(s, LOWEST), -LOWEST - 1) for s in scores.tolist()], object)
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        kept = np.lexsort((ids, -scores))[: self.k] if scores.dtype != object else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k]
        self.ids, self.scores = ids[kept], scores[kept]

    @property
    def enough(self):
        """What a row must reach; scores of less than a long count as the least long, so there any does."""
        return self.scores[-1] if len(self.scores) == self.k and self.scores[-1] > LOWEST else -np.inf


def max_score(index: Index, query_id: int, query: np.ndarray, best: Best, kind, seeded: bool) -> None:
    """Offers to ``best`` every row of the index that can be among the k best, with its whole score."""
    width = min(len(query), index.rows.shape[1])
    rows, lists = index.typed(kind)
    q = _typed(query[:width], kind)
    wide = q if kind is object else q.astype(float)
    ends = [_typed(m[:width], object if kind is object else float) for m in (index.most, index.least)]
    bound = np.where(wide > 0, wide * ends[0], wide * ends[1])
    order = np.argsort(bound, kind="stable")
    joint = np.cumsum(bound[order])
    if kind is not object:
        joint = np.minimum(joint, np.floor(np.sqrt(np.cumsum(wide[order] ** 2)) * index.length) + 1)
    for lo, hi in list(index.ranges())[seeded:]:
        enough = best.enough
        cut = int(np.searchsorted(joint, enough))
        gathered = np.zeros(hi - lo, kind)
        seen = np.zeros(hi - lo, bool) if cut else None
        for t in order[cut:].tolist():
            at, values = lists[t]
            if at is None:
                gathered += values[lo:hi] * q[t]
                seen = None
            else:
                a, b = np.searchsorted(at, (lo, hi))
                gathered[at[a:b] - lo] += values[a:b] * q[t]
                if seen is not None:
                    seen[at[a:b] - lo] = True
        left = gathered >= enough - (joint[cut - 1] if cut else 0)
        alive = np.flatnonzero(left if seen is None else left & seen)
        scores = gathered[alive]
        while cut and len(alive):
            probed = order[max(0, cut - PROBED) : cut]
            cut = max(0, cut - PROBED)
            for t in probed.tolist():
                scores = scores + rows[lo + alive, t] * q[t]
            kept = np.flatnonzero(scores >= enough - (joint[cut - 1] if cut else 0))
            alive, scores = alive[kept], scores[kept]
        found = index.ids[lo + alive]
        other = found != query_id
        if other.any():
            best.offer(found[other], scores[other])


def _seed(index: Index, ids: np.ndarray, queries: np.ndarray, best: list[Best], kind) -> None:
    """All terms of all queries over the first range, where no score is known yet."""
    width = min(queries.shape[1], index.rows.shape[1])
    first = index.typed(kind)[0][:FIRST, :width]
    own = np.searchsorted(index.ids[: len(first)], ids)
    for lo in range(0, len(ids), TOGETHER):
        scores = _typed(queries[lo : lo + TOGETHER, :width], kind) @ first.T
        for i, row in enumerate(scores, lo):
            order = np.argsort(-row, kind="stable")[: best[i].k + 1] if kind is not object else np.arange(len(row))
            # Ids are unique, so at most one of them is the query's own.
            order = order[order != own[i]] if own[i] < len(first) and index.ids[own[i]] == ids[i] else order
            best[i].offer(index.ids[order], row[order])


def _search(k: int, scale: int):
    def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = ([], [], [])
        indexes = [Index(*x) for x in _vectors(rows.column("vec_id"), rows.column("vec"), scale)]
        for ids, queries in _vectors(asked.column("query_id"), asked.column("qvec"), scale):
            best = [Best(k) for _ in ids]
            for n, index in enumerate(indexes):
                kind = _number(queries, index)
                if not n:
                    _seed(index, ids, queries, best, kind)
                for i, own in enumerate(best):
                    max_score(index, int(ids[i]), queries[i], own, kind, seeded=not n)
            for i, own in enumerate(best):
                found[0].extend([int(ids[i])] * len(own.ids))
                found[1].extend(own.ids.tolist())
                found[2].extend(int(s) for s in own.scores)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    return work


def top_k(spark: SparkSession, queries: DataFrame, corpus: DataFrame, k: int = K, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """queries (query_id, qvec), corpus (vec_id, vec): query_id, rank, vec_id, score of the k best rows that are not the query's own.

    A component x counts as floor(scale * x), within the range of a long; so do scores.
    Ties go to the smaller vec_id. Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part. Vectors of different lengths meet in
    the components that both have; an empty vector scores 0. Rows that repeat an id count
    once, with the least of their vectors. A query without other rows has no result; an
    empty table gives an empty one. Other columns are not read, whatever their names.
    """
    short_batches(spark)
    rows = corpus.select(F.col("vec_id").cast("long").alias("vec_id"), "vec").where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "qvec").where(F.col("query_id").isNotNull() & usable(F.col("qvec")))
    blocks = max(1, -(-queries.count() // block))
    n = corpus.count()
    # More shards than the size asks for, while tasks would stay idle; results do not depend on their number.
    shards = max(1, -(-n // shard), min(-(-2 * spark.sparkContext.defaultParallelism // blocks), n // LEAST))
    rows = rows.groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    asked = asked.groupBy("query_id").agg(F.min("qvec").alias("qvec")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left, right = asked.withColumn("shard", every(shards)), rows.withColumn("block", every(blocks))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(k, scale), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of every vector whose id is divisible by 50, against all others; edge cases as in ``top_k``."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(spark, rows.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS qvec"), rows.selectExpr("vec_id", "embedding AS vec"))


OP11_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score FROM v q JOIN v e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 5"""
