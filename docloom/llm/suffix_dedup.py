"""Removal of repeated byte strings by a sampled suffix array.

A byte goes when a 100-byte string that covers it also starts earlier (in a smaller
doc_id, or earlier in the same document). Every 100-byte window holds a selected
suffix: the one whose 36-byte head has the least fingerprint among the window's (its
leftmost on ties). The choice depends on the window's bytes alone, so equal windows
select equal suffixes at equal distances. About one suffix in 33 is selected; heads are long enough that unrelated texts rarely share one.

A selected suffix stands for the run of windows that select it. Its sort key is a
sequence of tokens: the fingerprint of its head, then that of the run's whole context
(or of one window, at the second level), then doc_id and place. Splitters sampled from
the documents range-partition the suffixes by these leading tokens, each bucket sorts
locally by multikey quicksort, and equal neighbours are repeats of the first of them.
Buckets report their first and last groups, which are compared across boundaries.
Suffixes that share a head but differ in context go to the second level, where the
same procedure runs over blocks of windows, halved until single windows remain.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Workspace, mix64, prefix_hash, short_batches, slices, span_hash, table, text_bytes

WINDOW = 100
HEAD = 36
GRAMS = WINDOW - HEAD + 1
#: Windows of one record at each level.
BLOCKS = (GRAMS, 8, 1)
#: Suffixes of one bucket, on average, at most; a bucket is sorted in memory.
BUCKET_ROWS = 1 << 20
#: Documents sampled for splitters, at least, one record in ``SAMPLE_THIN`` of each; with many buckets, about
#: ``PER_BUCKET`` sampled records for each of them.
SAMPLE_DOCS = 6000
SAMPLE_THIN = 64
PER_BUCKET = 64
#: Bytes of a row that are looked at in one piece.
PIECE = 1 << 22
_MASK = np.uint64((1 << 24) - 1)


def pack_place(start, count, offset, tag):
    """start (32 bits), then windows (7), distance of the suffix from start (7), tag of the text (18): sorts by start."""
    return (start.astype(np.int64) << 32 | count.astype(np.int64) << 25 | offset.astype(np.int64) << 18 | tag.astype(np.int64)) ^ np.int64(-(1 << 63))


def unpack_place(place):
    place = place ^ np.int64(-(1 << 63))
    start = (place >> 32) & 0xFFFFFFFF
    return start, (place >> 25) & 127, (place >> 18) & 127, place & 0x3FFFF


def text_tag(raw: bytes) -> int:
    """18 bits that tell texts apart when rows repeat a doc_id."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=3).digest(), "big") & 0x3FFFF


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values: suffix minima of one block meet prefix minima of the next."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def select_suffixes(data: np.ndarray, offsets: np.ndarray):
    """Runs of windows of the rows: row, first window, number, suffix, head and context fingerprints."""
    empty = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return empty, empty, empty, empty, empty, empty
    prefix = prefix_hash(data)
    at = np.arange(len(data) - HEAD + 1)
    heads = span_hash(prefix, at, at + HEAD)
    least = _least((heads & ~_MASK) | at.astype(np.uint64), GRAMS)
    row = np.searchsorted(offsets, np.arange(len(least)), side="right") - 1
    valid = np.flatnonzero(np.arange(len(least)) + WINDOW <= offsets[row + 1])
    if not len(valid):
        return empty, empty, empty, empty, empty, empty
    suffix, row = (least[valid] & _MASK).astype(np.int64), row[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (suffix[1:] != suffix[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(valid)))
    begin, suffix = valid[first], suffix[first]
    context = span_hash(prefix, begin, begin + count - 1 + WINDOW) + (suffix - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return row[first], begin, count, suffix, heads[suffix].astype(np.int64), mix64(context).astype(np.int64)


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """(first row, data, offsets, bytes before): rows together up to a size, longer rows in overlapping pieces."""
    for lo, hi in slices(offsets, 1 << 19):
        if hi - lo > 1 or offsets[hi] - offsets[lo] <= PIECE:
            yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], 0
            continue
        for at in range(int(offsets[lo]), int(offsets[hi]), PIECE):
            part = data[at : min(at + PIECE + WINDOW - 1, int(offsets[hi]))]
            yield lo, part, np.array([0, len(part)]), at - int(offsets[lo])


def bucket_of(splitters: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """Number of splitters that are not after each key, both compared token by token."""
    first = splitters[0]
    lo, hi = np.searchsorted(first, keys[0], "left"), np.searchsorted(first, keys[0], "right")
    out = lo.copy()
    tied = np.flatnonzero(hi > lo)
    for j in np.unique(np.concatenate([np.arange(a, b) for a, b in sorted({(int(lo[i]), int(hi[i])) for i in tied})])) if len(tied) else []:
        rows = tied[(lo[tied] <= j) & (j < hi[tied])]
        after = np.ones(len(rows), bool)
        for s, k in zip(reversed(splitters[1:]), reversed(keys[1:]), strict=True):
            after = (k[rows] > s[j]) | ((k[rows] == s[j]) & after)
        out[rows] += after
    return out


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key; each further key is looked at only inside runs that are equal so far."""
    order = np.argsort(keys[0], kind="quicksort")
    run = np.zeros(len(order), np.int64)
    for depth, key in enumerate(keys):
        here = key[order]
        if depth:
            size = np.bincount(run)
            tied = np.flatnonzero(size[run] > 1)
            if not len(tied):
                break
            sub = np.lexsort((here[tied], run[tied]))
            order[tied] = order[tied][sub]
            here = key[order]
        change = np.ones(len(order), bool)
        change[1:] = (here[1:] != here[:-1]) | (run[1:] != run[:-1])
        run = np.cumsum(change) - 1
    return order


_RECORD = "bucket int, head long, context long, doc_id long, place long"
_FIELDS = ("bucket", "head", "context", "doc_id", "place")


def _records(arrays, splitters) -> pa.RecordBatch:
    bucket = bucket_of(splitters, arrays) if splitters else np.zeros(len(arrays[0]), np.int64)
    return pa.record_batch([pa.array(bucket.astype(np.int32)), *[pa.array(a) for a in arrays]], names=list(_FIELDS))


def _first_level(splitters):
    def work(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids, whole = batch.column(0).to_numpy(), data.tobytes()
            tags = np.array([text_tag(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
            for lo, part, offs, before in _pieces(data, offsets):
                row, begin, count, suffix, head, context = select_suffixes(part, offs)
                if len(row):
                    yield _records([head, context, ids[lo + row], pack_place(begin - offs[row] + before, count, suffix - begin, tags[lo + row])], splitters)

    return work


def _next_level(block: int, splitters):
    """Rows (doc_id, text, runs): the runs' windows in blocks aligned to the distance from the suffix."""

    def work(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            runs = batch.column(2)
            lengths = runs.value_lengths().fill_null(0).to_numpy()
            place = runs.flatten().to_numpy()
            ends = np.cumsum(lengths)
            ids = batch.column(0).to_numpy()
            for lo, hi in slices(offsets, 1 << 19):
                own = place[ends[lo] - lengths[lo] : ends[hi - 1]]
                if not len(own):
                    continue
                prefix = prefix_hash(data[offsets[lo] : offsets[hi]])
                row = np.repeat(np.arange(lo, hi), lengths[lo:hi])
                start, count, offset, tag = unpack_place(own)
                # Windows counted by distance d = offset - j from start j; blocks hold equal d // block.
                top, bottom = offset // block, (offset - count + 1) // block
                n = top - bottom + 1
                which = np.repeat(np.arange(len(own)), n)
                step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                level = top[which] - step
                far = np.minimum(offset[which], level * block + block - 1)
                near = np.maximum((offset - count + 1)[which], level * block)
                begin = start[which] + offset[which] - far
                windows = far - near + 1
                at = begin + offsets[row[which]] - offsets[lo]
                head = mix64(span_hash(prefix, start[which] + offset[which] + offsets[row[which]] - offsets[lo], start[which] + offset[which] + offsets[row[which]] - offsets[lo] + HEAD) + level.astype(np.uint64))
                context = span_hash(prefix, at, at + windows - 1 + WINDOW)
                context = mix64(context + far.astype(np.uint64))
                if block == 1:
                    head, context = context, np.zeros(len(at), np.uint64)
                yield _records([head.astype(np.int64), context.astype(np.int64), ids[row[which]], pack_place(begin, windows, far, tag[which])], splitters)

    return work


_OUT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("head", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("single", pa.bool_())])
_OUT_DDL = "kind int, bucket int, head long, context long, doc_id long, place long, single boolean"
REPEAT, OPEN, FIRST, LAST = range(4)


def _rows(kind, bucket, keys, at, single=False):
    """Rows of one kind; repeats and open records need no more than their document and place."""
    n = len(at)
    head, context, doc, place = [pa.array(k[at]) for k in keys]
    if kind in (REPEAT, OPEN):
        return pa.record_batch([pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), doc, place, pa.nulls(n, pa.bool_())], schema=_OUT)
    return pa.record_batch([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, bucket, np.int32)), head, context, doc, place, pa.array(np.full(n, single))], schema=_OUT)


def _bucket(bucket: int, keys: list[np.ndarray]):
    order = multikey_order(keys)
    keys = [k[order] for k in keys]
    head, context, doc, place = keys
    n = len(head)
    same_head = np.zeros(n, bool)
    same_head[1:] = head[1:] == head[:-1]
    same = np.zeros(n, bool)
    same[1:] = same_head[1:] & (context[1:] == context[:-1])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    start = unpack_place(place)[0]
    later = same & ((doc != doc[lead]) | (start != start[lead]))
    yield _rows(REPEAT, bucket, keys, np.flatnonzero(later))
    group = np.cumsum(~same_head) - 1
    distinct = np.bincount(group, weights=~same)
    yield _rows(OPEN, bucket, keys, np.flatnonzero(~same & (distinct[group] > 1)))
    yield _rows(FIRST, bucket, keys, np.array([0]), bool(distinct[0] == 1))
    last = np.flatnonzero(~same)[-1]
    # The last group's first record, and the group's identity for the next bucket.
    yield _rows(LAST, bucket, keys, np.array([last]), bool(distinct[-1] == 1))


def _sorted_buckets(batches):
    """Records of one partition; each bucket is sorted by itself."""
    held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.concat_tables(held)
    bucket = rows.column("bucket").to_numpy()
    keys = [rows.column(c).to_numpy() for c in _FIELDS[1:]]
    for b in np.unique(bucket):
        at = np.flatnonzero(bucket == b)
        yield from _bucket(int(b), [k[at] for k in keys])


def _across(edges: list) -> tuple[list, list]:
    """Repeats and open records that only the comparison of neighbouring buckets shows.

    edges: the FIRST and LAST rows of all buckets, in order. A bucket's first group may
    continue the last group of the bucket before, and so may a head.
    """
    repeats, opened, chain = [], [], []
    before = None
    for first, last in edges:
        if before is not None and before["head"] == first["head"]:
            starts = [int(unpack_place(np.array([r["place"]]))[0][0]) for r in (before, first)]
            if before["context"] == first["context"]:
                if (before["doc_id"], starts[0]) != (first["doc_id"], starts[1]):
                    repeats.append(first)
                if not first["single"]:
                    opened += [r for r in chain if r["single"]]
                    chain = []
            else:
                opened += [r for r in (*chain, first) if r["single"]]
                chain = []
        else:
            chain = []
        if first["head"] != last["head"]:
            chain = []
        chain.append(last)
        # Equal groups keep the earliest record as what later buckets compare with.
        if before is None or (before["head"], before["context"]) != (last["head"], last["context"]):
            before = last
    return repeats, opened


def _splitters(rows: DataFrame, buckets: int) -> list[np.ndarray]:
    sample = rows.select(*_FIELDS[1:]).toPandas()
    keys = [sample[c].to_numpy(np.int64) for c in _FIELDS[1:]]
    if not len(keys[0]) or buckets < 2:
        return [np.zeros(0, np.int64) for _ in keys]
    order = multikey_order(keys)
    picks = order[np.unique(np.arange(1, buckets) * len(order) // buckets)]
    return [k[picks] for k in keys]


def _level(ws: Workspace, spark: SparkSession, work, rows: DataFrame, share: float, name: str) -> tuple[DataFrame, DataFrame]:
    """Repeats and open records of one level. work(splitters) makes records from rows."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = ws.save(rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30)).mapInArrow(work(None), _RECORD).where(F.pmod(F.xxhash64("context", "place"), F.lit(SAMPLE_THIN)) == 0), f"{name}_sample")
    total = sample.count() * SAMPLE_THIN / share
    buckets = max(parts, int(total / BUCKET_ROWS) + 1)
    splitters = _splitters(sample, buckets)
    ws.drop(f"{name}_sample")
    records = rows.mapInArrow(work(splitters), _RECORD).repartitionById(buckets, F.col("bucket"))
    found = ws.save(records.mapInArrow(_sorted_buckets, _OUT_DDL), name)
    # Two rows for each bucket.
    edges: dict[int, dict[int, object]] = {}
    for r in found.where(F.col("kind") >= FIRST).collect():
        edges.setdefault(r["bucket"], {})[r["kind"]] = r
    repeats, opened = _across([(edges[b][FIRST], edges[b][LAST]) for b in sorted(edges)])
    extra = lambda some: spark.createDataFrame([(r["doc_id"], r["place"]) for r in some], "doc_id long, place long")
    pick = lambda kind: found.where(F.col("kind") == kind).select("doc_id", "place")
    return pick(REPEAT).union(extra(repeats)), pick(OPEN).union(extra(opened)).distinct()


def _join_runs(docs: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """docs with the packed places of their own text's runs, by doc_id and the text's tag."""
    listed = runs.groupBy("doc_id").agg(F.collect_list("place").alias("runs"))
    return docs.join(listed, "doc_id", how)


def _own_runs(batches):
    """Keeps of each row's runs those that carry the tag of its text."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        whole, runs = data.tobytes(), batch.column(2)
        lengths = runs.value_lengths().fill_null(0).to_numpy()
        place = runs.flatten().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), lengths)
        tags = np.array([text_tag(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
        ok = (unpack_place(place)[3] == tags[row]) if len(place) else np.zeros(0, bool)
        bounds = np.searchsorted(row[ok], np.arange(batch.num_rows + 1))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(place[ok]))], names=["doc_id", "text", "runs"])


def _cut(batches):
    """Removes the bytes that the runs' windows cover."""
    for own in _own_runs(batches):
        data, offsets = text_bytes(own.column(1))
        runs = own.column(2)
        lengths = runs.value_lengths().to_numpy()
        place, ends = runs.flatten().to_numpy(), np.cumsum(lengths)
        out = []
        for i in range(own.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            start, count, _, _ = unpack_place(place[ends[i] - lengths[i] : ends[i]])
            change = np.zeros(len(text) + 1, np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + count - 1 + WINDOW, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = text[~gone].tobytes()
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(text) else 0
            out.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        n, removed, spans, sha, kept = zip(*out, strict=True) if out else ((),) * 5
        yield pa.record_batch([own.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each row of docs: n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    Null texts are empty. Rows that repeat a doc_id are the same document: a string at
    an equal start in two of them starts earlier in neither. Rows with a null doc_id
    come before all others, as one document. An empty table gives an empty result; other
    columns are not read. Texts of any length are searched whole, in overlapping pieces.
    kept_text leaves out what the cuts leave of a character.
    """
    short_batches(spark)
    ws = Workspace(spark)
    none = -(1 << 63)
    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = given.count()
    share = min(1.0, max(SAMPLE_DOCS / max(n, 1), PER_BUCKET * SAMPLE_THIN / BUCKET_ROWS))
    repeats, opened = _level(ws, spark, _first_level, given, share, "level0")
    runs = repeats
    for k, block in enumerate(BLOCKS[1:], 1):
        opened = ws.save(opened, f"open{k}")
        busy = opened.groupBy("doc_id").agg(F.collect_list("place").alias("runs"))
        rows = given.join(busy, "doc_id").mapInArrow(_own_runs, "doc_id long, text string, runs array<long>")
        repeats, opened = _level(ws, spark, lambda s, b=block: _next_level(b, s), rows, min(1.0, 2 * share), f"level{k}")
        ws.drop(f"open{k}")
        runs = runs.union(repeats)
    cut = _join_runs(given, runs, "left").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != none, F.col("doc_id")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of every document; awkward rows as in ``remove_repeats``."""
    return remove_repeats(spark, table(spark, sf_dir, "documents")).drop("kept_text")
