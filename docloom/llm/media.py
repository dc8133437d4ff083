"""Media columns: bytes kept as Netpbm or BMP images, decoded to arrays, resized, hashed.

A payload is a whole number of 192-byte rows, i.e. an image 64 samples wide with
three channels. The caller chooses the format, binary Netpbm (P6) or BMP (rows from
the bottom, blue first). Reading back parses the stored header and inverts that order. Features come from an area resize by integral
images to a 9 x 8 luma tile, written as NPY, and its difference hash.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import short_batches, table, text_bytes

WIDTH = 64
ROW = 3 * WIDTH
TILE = (8, 9)


def pad(raw: bytes) -> bytes:
    """raw and spaces up to a positive multiple of 192."""
    return raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))


def encode_ppm(pixels: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    line = -(-3 * width // 4) * 4
    rows = np.zeros((height, line), np.uint8)
    rows[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, 3 * width)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(stored: bytes) -> np.ndarray:
    """The (height, width, 3) or (height, width) samples of a BMP (24 bits) or binary Netpbm file."""
    if stored[:2] == b"BM":
        at = struct.unpack_from("<I", stored, 10)[0]
        width, height, _, depth, packed = struct.unpack_from("<iiHHI", stored, 18)
        if depth != 24 or packed:
            raise ValueError("only plain 24-bit BMP is read")
        line = -(-3 * width // 4) * 4
        rows = np.frombuffer(stored, np.uint8, line * abs(height), at).reshape(abs(height), line)[:, : 3 * width].reshape(abs(height), width, 3)
        return np.ascontiguousarray((rows[::-1] if height > 0 else rows)[:, :, ::-1])
    if stored[:2] not in (b"P5", b"P6"):
        raise ValueError("neither BMP nor binary Netpbm")
    fields, at = [], 2
    while len(fields) < 3:
        while stored[at : at + 1].isspace():
            at += 1
        if stored[at : at + 1] == b"#":
            at = stored.index(b"\n", at)
            continue
        end = at
        while not stored[end : end + 1].isspace():
            end += 1
        fields.append(int(stored[at:end]))
        at = end
    width, height, top = fields
    if top > 255:
        raise ValueError("only 8-bit Netpbm is read")
    channels = 3 if stored[:2] == b"P6" else 1
    samples = np.frombuffer(stored, np.uint8, width * height * channels, at + 1)
    return samples.reshape((height, width, 3) if channels == 3 else (height, width))


def area_resize(gray: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Mean over each target cell's exact area, read off an integral image at fractional corners."""
    height, width = gray.shape
    integral = np.zeros((height + 1, width + 1))
    np.cumsum(np.cumsum(gray, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])

    def cut(table: np.ndarray, n: int, parts: int) -> np.ndarray:
        at = np.arange(parts + 1) * (n / parts)
        low = np.minimum(at.astype(np.int64), n - 1)
        share = (at - low)[:, None]
        return table[low] * (1 - share) + table[low + 1] * share

    corners = cut(cut(integral, height, shape[0]).T, width, shape[1]).T
    return (corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]) * (shape[0] * shape[1] / (height * width))


def npy_tile(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def difference_hash(tile: np.ndarray) -> str:
    """64 bits in hex: whether a cell is brighter than its left neighbour."""
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


FORMATS = {"ppm": encode_ppm, "bmp": encode_bmp}


def media_row(raw: bytes, image: str = "ppm") -> tuple:
    """n_bytes, stored bytes, payload read back, NPY tile, feature."""
    payload = pad(raw)
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    stored = FORMATS[image](pixels)
    back = decode(stored)
    luma = (back[:, :, 0].astype(np.float32) + 2 * back[:, :, 1] + back[:, :, 2]) / 4
    tile = np.rint(area_resize(luma, TILE)).astype(np.uint8)
    return len(raw), stored, back.tobytes(), npy_tile(tile), difference_hash(tile)


_SHAPE = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, npy_tile binary"


def _work(image: str):
    def work(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            whole = data.tobytes()
            out = []
            for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
                n, stored, back, tile, feature = media_row(whole[lo:hi], image)
                out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, stored, tile))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.record_batch([batch.column(0), *cols], names=[f.split()[0] for f in _SHAPE.split(", ")])

    return work


def media_columns(spark: SparkSession, docs: DataFrame, image: str = "ppm") -> DataFrame:
    """One row for each row of docs (doc_id, text, ...): sizes, digests, feature, the stored image and its NPY tile.

    A null text is empty and stored as one row of spaces. Equal texts give equal
    values; a null doc_id stays null; an empty table gives an empty result. Texts of any
    length are one image each; other columns are not read. Equal neighbours count as
    not brighter in the difference hash. image: "ppm" or "bmp".
    """
    if image not in FORMATS:
        raise ValueError(f"image must be one of {', '.join(FORMATS)}")
    short_batches(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_work(image), _SHAPE)


def _stacked(batches):
    for batch in batches:
        tiles = [np.load(io.BytesIO(t), allow_pickle=False) for t in batch.column(1).to_pylist()]
        if tiles:
            yield pa.record_batch([pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([npy_tile(np.stack(tiles))])], names=["doc_ids", "tiles_npy"])


def write_tiles(media: DataFrame, path: str) -> None:
    """Parquet rows of one NPY array (tiles x height x width) for each batch of rows, with the ids in its order."""
    media.select("doc_id", "npy_tile").mapInArrow(_stacked, "doc_ids array<long>, tiles_npy binary").write.mode("overwrite").parquet(path)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images, tiles and features of all documents; awkward rows as in ``media_columns``."""
    return media_columns(spark, table(spark, sf_dir, "documents"))
