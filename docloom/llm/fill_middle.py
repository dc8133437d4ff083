"""Fill-in-the-middle: documents cut at line ends and rearranged around sentinels, reversibly.

A byte automaton, given as tables, reads the texts of a batch once. Its state is the
longest sentinel prefix that the last bytes form, and whether a unit (a line with its
newline, or what follows the last newline) is open; its transitions emit bits: a code
point begins (no continuation byte), a unit ends, a sentinel is complete. The state
follows from as many bytes as the longest sentinel has, so the stream is cut into lanes
that start so many bytes early and step through the tables side by side. The emitted
transitions are counted for each document; a second pass over the unit ends locates the
two cuts. The same automaton finds the sentinels in an output when a text is restored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, slices, table, text_bytes, unused

#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_SHARE = 7, 100, 50
#: Bytes of texts that are scanned at once; one longer text is scanned alone.
STEP_BYTES = 8 << 20
#: Symbols of one lane.
LANE = 512
POINT, UNIT, FOUND = 1, 2, 4
#: In an output, the order of the parts by form: 0 prefix, 1 suffix, 2 middle.
ORDER = {"psm": (0, 1, 2), "spm": (1, 0, 2)}


class Automaton:
    """Transition and emission tables over classes of bytes and a symbol that ends a document."""

    def __init__(self, sentinels: tuple[str, str, str] = SENTINELS):
        self.marks = [s.encode() for s in sentinels]
        firsts = [m[:1] for m in self.marks]
        # Then no sentinel can arise where a part and a sentinel meet.
        if len({*self.marks}) < 3 or not all(firsts) or any(f in m[1:] for f in firsts for m in self.marks) or b"\n" in b"".join(self.marks):
            raise ValueError("three different sentinels, each starting with a byte that occurs nowhere further on, and no newline")
        stems = sorted({m[:k] for m in self.marks for k in range(len(m))}, key=lambda s: (len(s), s))
        place = {s: i for i, s in enumerate(stems)}
        self.warm = max(map(len, self.marks))
        moves = np.zeros((len(stems), 2, 257), np.int64)
        emits = np.zeros((len(stems), 2, 257), np.uint8)
        for stem, i in place.items():
            for byte in range(256):
                tail, found = stem + bytes([byte]), 0
                if tail in self.marks:
                    found, tail = FOUND * (1 + self.marks.index(tail)), b""
                while tail not in place:
                    tail = tail[1:]
                ends = byte == 10
                moves[i, :, byte] = place[tail] * 2 + (not ends)
                emits[i, :, byte] = found | (POINT if byte & 0xC0 != 0x80 else 0) | (UNIT if ends else 0)
            emits[i, 1, 256] = UNIT
        moves, emits = moves.reshape(-1, 257), emits.reshape(-1, 257)
        _, first, kind = np.unique(np.concatenate([moves, emits]), axis=1, return_index=True, return_inverse=True)
        self.kind = kind.reshape(-1).astype(np.uint8)
        self.n_kinds = len(first)
        # A state is kept as the start of its row, so that row + class is the place in both tables.
        self.moves = (moves[:, first] * self.n_kinds).ravel().astype(np.int32)
        self.emits = emits[:, first].ravel()

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of all symbols and the bounds of documents among them; each has one symbol more than bytes."""
        symbols = np.insert(self.kind[data], offsets[1:], self.kind[256])
        lanes = max(1, -(-len(symbols) // LANE))
        line = np.full(self.warm + lanes * LANE, self.kind[256], np.uint8)
        line[self.warm : self.warm + len(symbols)] = symbols
        steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(line, (LANE + self.warm, lanes), (1, LANE)))
        out = np.empty((LANE, lanes), np.uint8)
        row, at = np.zeros(lanes, np.int32), np.empty(lanes, np.int32)
        for j in range(LANE + self.warm):
            np.add(row, steps[j], out=at)
            if j >= self.warm:
                np.take(self.emits, at, out=out[j - self.warm], mode="clip")
            np.take(self.moves, at, out=row, mode="clip")
        return out.T.reshape(-1)[: len(symbols)], offsets + np.arange(len(offsets))

    def rearranged(self, data: np.ndarray, offsets: np.ndarray, picks: np.ndarray, rate: int, spm_share: int):
        """(n, form, prefix_chars, middle_chars, output) of each text; picks: its four numbers."""
        emitted, bounds = self.scan(data, offsets)
        starts = bounds[:-1]
        units = np.add.reduceat((emitted & UNIT) >> 1, starts, dtype=np.int64)
        marked = np.bitwise_or.reduceat(emitted, starts) >= FOUND
        unit_at, before = np.flatnonzero(emitted & UNIT), np.concatenate([[0], np.cumsum(units)])
        for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            n, raw = int(units[i]), data[lo:hi].tobytes()
            h1, h2, h3, h4 = picks[i].tolist()
            if not raw or marked[i] or h3 % 100 >= rate:
                yield n, "plain", None, None, raw
                continue
            begin, cuts = int(bounds[i]), []
            for k in sorted((h1 % (n + 1), h2 % (n + 1))):
                # The symbol of the k-th unit's end is its newline, or the end of the document.
                cuts.append(min(int(unit_at[before[i] + k - 1]) - begin + 1, hi - lo) if k else 0)
            points = [int(np.count_nonzero(emitted[begin + a : begin + b] & POINT)) for a, b in ((0, cuts[0]), cuts)]
            parts, form = (raw[: cuts[0]], raw[cuts[1] :], raw[cuts[0] : cuts[1]]), "spm" if h4 % 100 < spm_share else "psm"
            yield n, form, *points, b"".join(self.marks[p] + parts[p] for p in ORDER[form])

    def restored(self, data: np.ndarray, offsets: np.ndarray, forms: list[str]):
        """The text of each output; an output that its form does not fit is an error."""
        emitted, bounds = self.scan(data, offsets)
        found = np.flatnonzero(emitted >= FOUND)
        first = np.searchsorted(found, bounds)
        for i, form in enumerate(forms):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            if form == "plain":
                yield raw
                continue
            at = found[first[i] : first[i + 1]]
            if tuple(emitted[at] // FOUND - 1) != ORDER[form]:
                raise ValueError(f"an output of the form {form} has other sentinels")
            ends = (at - bounds[i] + 1).tolist()
            stops = [e - len(self.marks[p]) for e, p in zip(ends[1:], ORDER[form][1:], strict=True)] + [len(raw)]
            parts = {p: raw[a:b] for p, a, b in zip(ORDER[form], ends, stops, strict=True)}
            yield parts[0] + parts[2] + parts[1]


def fill_in_middle(spark: SparkSession, docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n, form, prefix_chars, middle_chars, output.

    The numbers that choose form and cuts are read off the sha256 of seed and doc_id, so a
    row's result depends on nothing but itself. ``rate`` of 100 texts are rearranged, of
    these ``spm_share`` in 100 with the suffix first. Null and empty texts, and those
    that hold a sentinel, stay plain. A null doc_id counts as an empty one; repeated rows
    give repeated results; an empty table gives an empty result; a text of any length is
    scanned whole. Other columns are not read, whatever their names.
    """
    bounded_batches(spark)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    picks = [F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    # Bytes, not a string: what is counted and cut is what is stored.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"), digest.alias("_digest"))

    def work(batches):
        own = Automaton(sentinels)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            numbers = np.stack([batch.column(2 + k).to_numpy() for k in range(4)], axis=1)
            for lo, hi in slices(offsets, STEP_BYTES):
                found = own.rearranged(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], numbers[lo:hi], rate, spm_share)
                n, form, prefix, middle, output = zip(*found, strict=True)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
                yield pa.record_batch(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    made = rows.select("doc_id", "raw", *picks).mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restore(spark: SparkSession, rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Adds ``restored``, the text that an output was made of, to rows (output, form, ...); other columns stay.

    A null output is restored as an empty text. A row whose output does not fit its form
    is an error. A column restored that is there already gets underscores in front of
    the new one's name.
    """
    bounded_batches(spark)
    name, raw = unused(rows, "restored"), unused(rows, "_raw")
    given = rows.withColumn(raw, F.coalesce(F.col("output").cast("string"), F.lit("")).cast("binary"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    form_at = rows.columns.index("form")

    def work(batches):
        own = Automaton(sentinels)
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            for lo, hi in slices(offsets, STEP_BYTES):
                part = batch.slice(lo, hi - lo)
                texts = list(own.restored(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], part.column(form_at).to_pylist()))
                yield pa.record_batch([*part.columns[:-1], pa.array(texts, pa.binary())], names=[*part.schema.names[:-1], name])

    made = given.mapInArrow(work, ", ".join([*kept, f"`{name}` binary"]))
    return made.withColumn(name, F.col(name).cast("string"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's output and of the text restored from it; edge cases as in ``fill_in_middle``."""
    rows = restore(spark, fill_in_middle(spark, table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u FROM d),
h AS (SELECT *, len(u) AS n, ('0x' || x[1:8])::UBIGINT AS h1, ('0x' || x[9:16])::UBIGINT AS h2, ('0x' || x[17:24])::UBIGINT AS h3, ('0x' || x[25:32])::UBIGINT AS h4 FROM u),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
