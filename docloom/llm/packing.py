"""Token-id packing: best-fit decreasing into fixed-length rows.

Documents are dealt to buckets by a hash of id and text, so any number of tasks packs at
once, and a lost task is redone alone with the same rows. Equal rows are counted first and
dealt some at a time by a running number, so they spread too. In a bucket, documents longer than a row are cut
into pieces without loss; pieces go, longest first, into the open row with the least
room that still holds them, which a segment tree over capacities finds in O(log row).
Each row is written as an id vector, cumulative segment lengths and positions that
start again at every segment; a bucket's rows form one matrix.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import short_batches, table
from .byte_bpe import ROWS, Encoder, encoded, pattern, read_ranks, split_words, vocabulary_path

ROW_TOKENS = 2048
PAD = 50256
#: Documents of one bucket, on average.
BUCKET_DOCS = 4096
#: Tokens that are packed together at most, beyond one document; a bucket of more goes in several parts.
HELD_TOKENS = 1 << 24
#: Equal rows that go to one bucket together.
TOGETHER = 64


class CapacityTree:
    """Open rows by remaining room; finds the least room of at least a given size."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(top + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of a best fit, removed; None if no open row has the room."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of item numbers; every length is from 1 to capacity."""
    tree, rows = CapacityTree(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = tree.take(lengths[item])
        if fit is None:
            fit = (capacity, len(rows))
            rows.append([])
        rows[fit[1]].append(item)
        if room := fit[0] - lengths[item]:
            tree.add(room, fit[1])
    return rows


class FastEncoder(Encoder):
    """The same words and ids, contracted by the tiktoken library."""

    def __init__(self, path: str):
        import tiktoken

        self.tokens = read_ranks(path)
        rank = {token: i for i, token in enumerate(self.tokens) if token}
        self.byte_ids = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        self.whole = rank
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.core = tiktoken.Encoding("packing", pat_str=pattern(), mergeable_ranks=rank, special_tokens={})._core_bpe
        self.forget()

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.core.encode_single_piece(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum())), sizes

    def contract_long(self, word: bytes) -> np.ndarray:
        return np.array(self.core.encode_single_piece(word), np.int32)


_encoders: dict[str, FastEncoder] = {}


def fast_encoder(path: str) -> FastEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = FastEncoder(path)
    return _encoders[path]


def _pieces(ids: list[tuple[int | None, np.ndarray]], capacity: int) -> list[tuple[int | None, int, np.ndarray]]:
    """(doc_id, first token, ids) of documents, cut at multiples of capacity."""
    return [(doc, at, own[at : at + capacity]) for doc, own in ids for at in range(0, len(own), capacity)]


def _npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


_SHAPE = pa.schema([("bucket", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("positions_sha256", pa.string()), ("ids", pa.binary()), ("positions", pa.binary())])


def pack_bucket(bucket: int, first: int, ids: list[tuple[int | None, np.ndarray]], capacity: int, with_arrays: bool) -> pa.RecordBatch:
    """The rows of a bucket, or of a part of it, numbered from ``first``."""
    pieces = _pieces(ids, capacity)
    out = []
    for number, members in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], capacity), first):
        row, positions = np.full(capacity, PAD, "<i4"), np.zeros(capacity, "<i4")
        bounds = [0]
        for m in members:
            own = pieces[m][2]
            row[bounds[-1] : bounds[-1] + len(own)] = own
            positions[bounds[-1] : bounds[-1] + len(own)] = np.arange(len(own))
            bounds.append(bounds[-1] + len(own))
        positions[bounds[-1] :] = np.arange(capacity - bounds[-1])
        a, b = row.tobytes(), positions.tobytes()
        out.append((bucket, number, bounds[-1], [pieces[m][0] for m in members], [pieces[m][1] for m in members], bounds, hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest(), a if with_arrays else None, b if with_arrays else None))
    columns = list(zip(*out, strict=True)) if out else [[] for _ in _SHAPE]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SHAPE, strict=True)], schema=_SHAPE)


def _slim(packed: pa.RecordBatch):
    """Batches of ROWS rows."""
    for lo in range(0, packed.num_rows, ROWS):
        yield packed.slice(lo, ROWS)


def _work(path: str, capacity: int, with_arrays: bool, held_tokens: int = HELD_TOKENS):
    def work(batches):
        own, bucket, first, held, tokens = fast_encoder(path), None, 0, [], 0
        for batch in batches:
            buckets, docs, copies = (batch.column(k).to_pylist() for k in range(3))
            for lo, ids, bounds in encoded(own, batch.column(3), batch.column(4)):
                for i in range(len(bounds) - 1):
                    at, size, one = buckets[lo + i], int(bounds[i + 1] - bounds[i]), ids[bounds[i] : bounds[i + 1]].copy()
                    for _ in range(copies[lo + i]):
                        if held and (at != bucket or tokens + size > held_tokens):
                            packed = pack_bucket(bucket, first, held, capacity, with_arrays)
                            yield from _slim(packed)
                            first, held, tokens = first + packed.num_rows if at == bucket else 0, [], 0
                        bucket = at
                        held.append((docs[lo + i], one))
                        tokens += size
        if held:
            yield from _slim(pack_bucket(bucket, first, held, capacity, with_arrays))

    return work


def pack(spark: SparkSession, docs: DataFrame, capacity: int = ROW_TOKENS, path: str | None = None, with_arrays: bool = True, held_tokens: int = HELD_TOKENS) -> DataFrame:
    """docs (doc_id, text, ...) -> one row for each packed row of every bucket.

    A bucket with more than ``held_tokens`` tokens is packed in parts of about that size.

    doc_ids and starts name each segment's document and its first token there, so the
    documents can be put together again. Null and empty texts have no token and no
    segment; repeated rows are all packed; null ids stay null; an empty table gives an
    empty result; other columns are not read. Texts of any length are cut without loss.
    Of documents of equal length the one of the smaller id goes first. ids and positions
    are little-endian int32 vectors of ``capacity`` tokens, padded.
    """
    short_batches(spark, ROWS)
    buckets = max(1, -(-docs.count() // BUCKET_DOCS))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = whole.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
    some = counted.select("doc_id", "text", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / TOGETHER))).alias("part"))
    key = F.pmod(F.xxhash64("doc_id", "text", "part"), F.lit(buckets))
    rows = some.select("doc_id", "text", F.least(F.lit(TOGETHER), F.col("n") - F.col("part") * TOGETHER).cast("int").alias("copies"), key.alias("bucket"))
    parts = max(1, min(buckets, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.repartitionById(parts, F.pmod(F.col("bucket"), F.lit(parts)).cast("int")).sortWithinPartitions("bucket", "doc_id", "text", "copies")
    shape = "bucket long, row long, n_tokens long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids_sha256 string, positions_sha256 string, ids binary, positions binary"
    return split_words(dealt, ["bucket", "doc_id", "copies"]).mapInArrow(_work(path or vocabulary_path(), capacity, with_arrays, held_tokens), shape)


def _matrix(group: pa.Table) -> pa.Table:
    group = group.sort_by("row")
    stack = lambda c: np.stack([np.frombuffer(x, "<i4") for x in group.column(c).to_pylist()])
    flat = [x for row in group.column("cu_seqlens").to_pylist() for x in row]
    splits = np.cumsum([0, *map(len, group.column("cu_seqlens").to_pylist())])
    return pa.table({"bucket": group.column("bucket").slice(0, 1), "ids_npy": [_npy(stack("ids"))], "cu_seqlens_npy": [_npy(np.array(flat, "<i4"))], "cu_splits_npy": [_npy(splits.astype("<i8"))], "positions_npy": [_npy(stack("positions"))]})


def write_packed(packed: DataFrame, path: str) -> None:
    """One Parquet row of NPY arrays for each bucket: id matrix, cumulative lengths, their bounds by row, positions."""
    packed.groupBy("bucket").applyInArrow(_matrix, "bucket long, ids_npy binary, cu_seqlens_npy binary, cu_splits_npy binary, positions_npy binary").write.mode("overwrite").parquet(path)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of all documents, id and position vectors included; awkward rows as in ``pack``."""
    return pack(spark, table(spark, sf_dir, "documents"))
