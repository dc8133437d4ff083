"""Byte-level BPE, contracted by recursive DuckDB queries inside each partition.

Spark's own regular expressions split texts into words, with the tokenizer library's
letters, numbers and spaces in place of Java's (``char_classes``). A partition keeps one DuckDB
connection with the merge table: (left id, right id) -> merged id, whose rank is the
id. Distinct words that are new to it become token-position rows; a recursive query
joins neighbours with the merge table and contracts each word's leftmost pair of
least rank until no word has a pair left. A word that is a token itself has that one
id, as in the tiktoken library, and needs no query. Decoding joins ids with the
vocabulary and aggregates the bytes in order of position, some tokens at a time.

A word of more than ``LONG`` bytes is contracted in overlapping windows. Tokens are the
word's encoding exactly if every two neighbours, contracted together, stay the same two
tokens: inside a window they do, and where the left window's tokens give way to the
right one's, the query says so for the two that meet. Where windows have no common border,
or their tokens do not stand side by side, wider windows take their place.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import short_batches, table, text_bytes
from .char_classes import java_pattern, regex_pattern

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words that one partition remembers; then it starts anew.
REMEMBERED = 1_000_000
#: Rows of one Arrow batch.
ROWS = 1024
#: DuckDB's memory in one Python worker.
MEMORY = "160MB"
#: Bytes of a window in which a longer word is contracted; the next one starts half a window later.
LONG = 64
#: Bytes of words that one query contracts.
STEP_BYTES = 1 << 20
#: Tokens that are decoded or printed at once.
STEP_TOKENS = 1 << 16
#: Texts of more characters are split into words in Python, so that no JVM row holds millions of words.
LONG_TEXT = 1 << 18
#: Characters of a long text that are split at once.
STEP_TEXT = 1 << 16

# Words in ``start`` (w, pos, id): every step holds the whole word, its rows are unnested.
CONTRACT = """
WITH RECURSIVE t(w, ids) AS (
  SELECT w, list(id ORDER BY pos) FROM start GROUP BY w
  UNION ALL
  (WITH rows AS (
     SELECT w, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, unnest(range(1, len(ids))) AS pos FROM t WHERE len(ids) > 1),
   best AS (
     SELECT rows.w, min({'id': m.merged, 'pos': rows.pos}) AS b
     FROM rows JOIN merges m ON rows.l = m.l AND rows.r = m.r GROUP BY rows.w)
   SELECT t.w, t.ids[:b.pos - 1] || [b.id] || t.ids[b.pos + 2:] FROM t JOIN best USING (w)))
SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos
FROM (SELECT w, arg_min(ids, len(ids)) AS ids FROM t GROUP BY w) ORDER BY w, pos
"""

DECODE = """
SELECT doc, unhex(string_agg(v.hex, '' ORDER BY pos)) AS part
FROM tokens JOIN vocabulary v USING (id) GROUP BY doc ORDER BY doc
"""


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id (rank)."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Encoder:
    """Word and id tables of one Python worker."""

    def __init__(self, path: str):
        import duckdb

        self.tokens = read_ranks(path)
        rank = {token: i for i, token in enumerate(self.tokens) if token}
        merges = [(rank[t[:k]], rank[t[k:]], i) for t, i in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank]
        self.byte_ids = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        self.whole = rank
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        left, right, merged = (pa.array(c, pa.int32()) for c in zip(*merges, strict=True))
        self._fill("merges", pa.table({"l": left, "r": right, "merged": merged}))
        self._fill("vocabulary", pa.table({"id": pa.array(range(len(self.tokens)), pa.int32()), "hex": [t.hex() for t in self.tokens]}))
        self.forget()

    def _fill(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.bounds = np.zeros(1 << 14, np.int64)

    def _keep(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Adds words with their ids, one after another."""
        n = len(self.place)
        ends = self.bounds[n] + np.cumsum(sizes)
        if n + len(words) + 1 > len(self.bounds):
            self.bounds = np.concatenate((self.bounds, np.zeros(max(len(self.bounds), len(words)), np.int64)))
        if self.bounds[n] + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)))
        self.ids[self.bounds[n] : self.bounds[n] + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(words)] = ends
        self.place.update(zip(words, range(n, n + len(words)), strict=True))

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and their number in each, by the recursive query."""
        ids, counts, lo = [], [], 0
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP_BYTES, side="right")))
            part = words[lo:hi]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            data = np.frombuffer(b"".join(part), np.uint8)
            rows = np.repeat(np.arange(len(part), dtype=np.int32), sizes)
            position = (np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            self._fill("start", pa.table({"w": rows, "pos": position, "id": self.byte_ids[data]}))
            got = self.db.execute(CONTRACT).fetchnumpy()
            ids.append(got["id"])
            counts.append(np.bincount(got["w"], minlength=len(part)))
            lo = hi
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _encoded(self, words: list[bytes]) -> dict[bytes, np.ndarray]:
        """Ids of distinct short words: the remembered ones, and new ones by the query."""
        new = list({w: None for w in words})
        ids, sizes = self.contract(new)
        return dict(zip(new, np.split(ids, np.cumsum(sizes)[:-1]), strict=True)) if new else {}

    def contract_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word, from windows that are joined where two of them agree."""
        windows = [(at, min(at + LONG, len(word))) for at in range(0, max(1, len(word) - LONG // 2), LONG // 2)]
        known: dict[bytes, np.ndarray] = {}
        while True:
            known |= self._encoded([w for w in {word[a:b] for a, b in windows} if w not in known])
            joined, bad = self._join(word, windows, known)
            if not bad:
                return joined
            again: list[tuple[int, int]] = []
            k = 0
            while k < len(windows):
                if k not in bad:
                    again.append(windows[k])
                    k += 1
                    continue
                stop = k
                while stop in bad:
                    stop += 1
                size = 2 * max(b - a for a, b in windows[k:stop])
                again += self._tiles(word, windows[k][0], windows[stop - 1][1], size, known)
                k = stop
            windows = again

    def _tiles(self, word: bytes, at: int, end: int, size: int, known: dict[bytes, np.ndarray]) -> list[tuple[int, int]]:
        """Windows of about ``size`` bytes from at to end, each starting at a token's border in the one before: repeated strings stay in step."""
        tiles = []
        while True:
            stop = min(at + size, end)
            tiles.append((at, stop))
            if stop == end:
                return tiles
            part = word[at:stop]
            if part not in known:
                known |= self._encoded([part])
            borders = at + np.cumsum(self.sizes[known[part]])[:-1]
            if len(borders):
                at = int(borders[np.argmin(np.abs(borders - (at + stop) / 2))])
            else:
                tiles.pop()
                size *= 2

    def _join(self, word: bytes, windows: list[tuple[int, int]], known: dict[bytes, np.ndarray]) -> tuple[np.ndarray, set[int]]:
        """The windows' tokens side by side, or the numbers of windows that can't be joined with the one before."""
        ids = [known[word[a:b]] for a, b in windows]
        ends = [a + np.cumsum(self.sizes[own]) for (a, _), own in zip(windows, ids, strict=True)]
        meets: list[list[tuple[int, int]]] = []
        for k in range(1, len(windows)):
            left, right = ends[k - 1], ends[k]
            # Common borders, middle of the overlap first; the last token's end and the first one's start are cuts, not borders.
            both = np.intersect1d(left[:-1], right[:-1])
            middle = (windows[k][0] + windows[k - 1][1]) / 2
            meets.append(sorted(zip(np.searchsorted(left, both).tolist(), np.searchsorted(right, both).tolist(), strict=True), key=lambda m: abs(left[m[0]] - middle)))
        pairs = {(int(ids[k][i]), int(ids[k + 1][j + 1])) for k, own in enumerate(meets) for i, j in own}
        text = {p: self.tokens[p[0]] + self.tokens[p[1]] for p in pairs}
        done = self._encoded(list(text.values()))
        stands = {p for p, t in text.items() if done[t].tolist() == list(p)}
        first, out, bad = 0, [], set()
        for k, own in enumerate(ids):
            if k + 1 == len(ids):
                out.append(own[first:])
                break
            good = next(((i, j) for i, j in meets[k] if i >= first and (int(own[i]), int(ids[k + 1][j + 1])) in stands), None)
            if good is None:
                bad |= {k, k + 1}
                first = 0
                continue
            out.append(own[first : good[0] + 1])
            first = good[1] + 1
        return (np.concatenate(out) if not bad else np.zeros(0, np.int32)), bad

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where ``ids`` and ``bounds`` hold each word; new ones are contracted first."""
        if len(self.place) + len(words) > REMEMBERED:
            self.forget()
        whole, short, long = [], [], []
        for word in words:
            if word not in self.place:
                (whole if word in self.whole else long if len(word) > LONG else short).append(word)
        if whole:
            self._keep(whole, np.fromiter((self.whole[w] for w in whole), np.int32, len(whole)), np.ones(len(whole), np.int64))
        if short:
            self._keep(short, *self.contract(short))
        for word in long:
            ids = self.contract_long(word)
            self._keep([word], ids, np.array([len(ids)]))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def encode(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and the n + 1 bounds of each row's part."""
        flat = words.flatten().dictionary_encode()
        row_words = words.value_lengths().fill_null(0).to_numpy()
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(row_words) + 1, np.int64)
        data, offsets = text_bytes(flat.dictionary)
        raw = data.tobytes()
        at = self.places([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        chosen = at[flat.indices.to_numpy()]
        first = self.bounds[chosen]
        size = self.bounds[chosen + 1] - first
        ends = np.cumsum(size)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(first - ends + size, size)]
        return ids, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(row_words)))]

    def encode_text(self, text: str) -> np.ndarray:
        """Ids of one long text, some words at a time."""
        own = [self.encode(pa.array([words], pa.list_(pa.string())))[0] for words in word_groups(text)]
        return np.concatenate(own) if own else np.zeros(0, np.int32)

    def decoded(self, ids: np.ndarray, bounds: np.ndarray):
        """(row, bytes) in order: each row's decoded bytes, in one piece or several."""
        for lo in range(0, len(ids), STEP_TOKENS):
            part = ids[lo : lo + STEP_TOKENS]
            place = np.arange(lo, lo + len(part))
            row = np.searchsorted(bounds, place, side="right") - 1
            self.db.register("tokens", pa.table({"doc": row.astype(np.int32), "pos": (place - lo).astype(np.int32), "id": part}))
            yield from self.db.execute(DECODE).fetchall()
            self.db.unregister("tokens")

    def decoded_sha256(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """SHA-256 of each row's decoded bytes; a row without ids decodes to nothing."""
        digests = [hashlib.sha256() for _ in range(len(bounds) - 1)]
        for row, part in self.decoded(ids, bounds):
            digests[row].update(part)
        return [d.hexdigest() for d in digests]


_decimals = np.zeros(0, object)


def ids_sha256(ids: np.ndarray) -> str:
    """SHA-256 of the decimal ids with a space between them; the digits of an id are made once."""
    global _decimals
    if len(ids) and int(ids.max()) >= len(_decimals):
        _decimals = np.array([str(i) for i in range(int(ids.max()) + 1)], object)
    digest = hashlib.sha256()
    for lo in range(0, len(ids), STEP_TOKENS):
        digest.update((" " * bool(lo) + " ".join(_decimals[ids[lo : lo + STEP_TOKENS]].tolist())).encode())
    return digest.hexdigest()


def word_groups(text: str):
    """The pattern's matches in order, in lists of about ``STEP_TEXT`` characters."""
    import regex

    group, size = [], 0
    for match in regex.finditer(regex_pattern(pattern()), text):
        group.append(match.group())
        size += match.end() - match.start()
        if size >= STEP_TEXT:
            yield group
            group, size = [], 0
    if group:
        yield group


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def split_words(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, then words: the matches of the tokenizer's pattern in the text (null: none), and long: a long text instead."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    long = F.length(text) > LONG_TEXT
    words = F.regexp_extract_all(F.when(long, "").otherwise(text), F.lit(java_pattern(docs.sparkSession, pattern())), F.lit(0))
    return docs.select(*keep, words.alias("words"), F.when(long, text).alias("long"))


def encoded(own: Encoder, words: pa.ListArray, long: pa.Array):
    """(first row, ids, bounds) for groups of rows; a row with a long text is a group of its own."""
    alone = np.flatnonzero(long.is_valid().to_numpy(zero_copy_only=False))
    at = 0
    for stop in [*alone.tolist(), len(words)]:
        if stop > at:
            yield at, *own.encode(words.slice(at, stop - at))
        if stop < len(words):
            ids = own.encode_text(long[stop].as_py())
            yield stop, ids, np.array([0, len(ids)])
        at = stop + 1


def _work(path: str, with_ids: bool):
    def work(batches):
        own = encoder(path)
        for batch in batches:
            for lo, ids, bounds in encoded(own, batch.column(1), batch.column(2)):
                hashes = [ids_sha256(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                cols = [batch.column(0).slice(lo, len(hashes)), pa.array(np.diff(bounds), pa.int64()), pa.array(hashes, pa.string()), pa.array(own.decoded_sha256(ids, bounds), pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
                    names.append("token_ids")
                yield pa.record_batch(cols, names=names)

    return work


def byte_bpe(spark: SparkSession, docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text, ...): n_tokens, digests of the ids and of the decoded bytes.

    ``with_ids`` adds token_ids. Null or empty text: no token. Repeated rows give
    repeated results; a null doc_id stays null; an empty table gives an empty result.
    Of a pair that stands several times at the least rank, the leftmost is contracted.
    Long texts are split, encoded and decoded piece by piece; with with_ids their ids
    are one value. Other columns are not read, whatever their names.
    """
    short_batches(spark, ROWS)
    rows = split_words(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"])
    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return rows.mapInArrow(_work(path or vocabulary_path(), with_ids), shape)


def decode_ids(ids: list[int], path: str | None = None) -> bytes:
    tokens = read_ranks(path or vocabulary_path())
    return b"".join(tokens[i] for i in ids)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; nulls, empty and long texts as in ``byte_bpe``."""
    return byte_bpe(spark, table(spark, sf_dir, "documents"))
