"""Shared plumbing: table access, shared-folder tables, Arrow byte views."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch handed to Python; whole texts may be long, so batches are short.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front that no column of df has (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or f"{name}_next".lower() in taken:
        name = f"_{name}"
    return name


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Python stages get at most ``rows`` rows in one Arrow batch; their workers find this package."""
    home = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    # A union that claims its children's partitioning can lose the exchange before a grouping (Spark 4.1).
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


#: Bytes of rows in one Arrow batch, whatever their number.
ARROW_BYTES = 32 << 20


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """As ``short_batches``; a batch is also closed once its rows have ``size`` bytes."""
    short_batches(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


#: Shuffle files go when the statement that made them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Intermediate tables in the folder the cluster shares (``spark.checkpoint.dir``).

    A saved table cuts lineage and survives the loss of executors. Without that
    setting a local session uses a folder of its machine, and any other fails.
    Tables that a result still reads stay until ``close``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        self.root = f"{(base or tempfile.mkdtemp(prefix='docloom-')).rstrip('/')}/docloom-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        schema, before = df.schema, self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(offsets: np.ndarray, limit: int):
    """Row ranges (lo, hi) of about ``limit`` bytes each; one longer row is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (shift, xor, multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BASE = np.uint64(0x9E6C63D0676A9A99)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64 for the rolling hash, or those of the inverse of b."""
    key = "inv" if inverse else "fwd"
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), _BASE_INV if inverse else _BASE, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= (1 << 20) + 64:
            _powers[key] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of byte values times powers, modulo 2^64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of byte spans, equal for equal bytes wherever they lie."""
    raw = (prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start]
    return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes inside each row, and the words' rows."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= edge[1:n] | ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= edge[1:n] | ~inside[1:]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(finish) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows
