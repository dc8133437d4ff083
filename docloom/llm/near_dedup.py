"""Near-duplicate detection with an LSH forest over MinHash signatures.

Documents with equal shingle sets form a class first. Each class representative then stands in
several sorted orders of its signature (the trees of the forest). Neighbours in an
order that share a prefix of signature slots are candidates: the deeper a region of
an order is populated, the longer the prefix its nearest neighbours share, so depth
adapts to the region without any bucket that could overflow. A compact sketch
discards hopeless candidates, the rest is confirmed on the full shingle sets, and
connected components follow from the confirmed links. Later rounds look, in the same
orders, only across the borders of components found so far. Where candidates between
two components all failed, and one has many members, an exact completion compares the
members of the smaller with those of the larger in blocks, so that no window size
decides whether an outlier of a large group is linked. Runs of equal prefix that are
longer than the window are settled last: all their rows of different components meet,
tile by tile, and those with like sketches are compared on the full sets, whatever the
components' sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Workspace, mix64, prefix_hash, short_batches, slices, span_hash, table, text_bytes, word_spans
from .components import connected_components

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
SLOTS = 64
TREES = 16
#: Signature slots in one tree's sort key.
KEY_SLOTS = 6
#: Neighbours share this many leading slots at least.
MIN_DEPTH = 2
#: Neighbours before a row that are looked at in one order.
WINDOW = 4
#: And before its component's run, where a pass looks across borders; the exact completion needs one meeting only.
CROSSING = 1
#: Sketches (4 bits a slot) must suggest this similarity; 4.3 standard deviations below PERCENT.
SKETCH_LEAST = 0.5
#: Passes over the forest; those after the first look across component borders.
ROUNDS = 2
#: Members of a component, and outsiders, that meet in one task of the exact completion.
BLOCK = 512

_rng = np.random.default_rng(20240501)
_MULT = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDERS = [[(t * SLOTS // TREES + j * (1 + 2 * (t % 5))) % SLOTS for j in range(KEY_SLOTS)] for t in range(TREES)]

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_is_word = np.ones(256, bool)
_is_word[[9, 10, 11, 12, 13, 32]] = False


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles of the rows, and the n + 1 bounds of each row's part."""
    n_rows = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets, _is_word)
    words = span_hash(prefix_hash(_lower[data]), starts, ends)
    per_row = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(per_row)))
    total = len(words)
    if total >= SHINGLE:
        mixed = np.zeros(total - SHINGLE + 1, np.uint64)
        for j in range(SHINGLE):
            mixed += words[j : total - SHINGLE + 1 + j] * _PLACE[j]
        same = rows[: total - SHINGLE + 1] == rows[SHINGLE - 1 :]
        mixed, owner = mix64(mixed[same]), rows[: total - SHINGLE + 1][same]
    else:
        mixed, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((per_row > 0) & (per_row < SHINGLE))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k, row in enumerate(short):
            with np.errstate(over="ignore"):
                part = words[first[row] : first[row + 1]]
                whole[k] = (part * _PLACE[: len(part)]).sum() + np.uint64(len(part))
        mixed, owner = np.concatenate((mixed, mix64(whole))), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        mixed, owner = mixed[order], owner[order]
    return mixed, np.searchsorted(owner, np.arange(n_rows + 1))


def _signature(unique: np.ndarray) -> np.ndarray:
    out = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(unique), 4096):
        np.minimum(out, (unique[lo : lo + 4096, None] * _MULT + _ADD).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(">u4")


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("sig", pa.binary())])


def _sign(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        ids = batch.column(0)
        for lo, hi in slices(offsets, 1 << 20):
            hashes, bounds = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            n, a, b, sig = [], [], [], []
            for i in range(hi - lo):
                unique = np.unique(hashes[bounds[i] : bounds[i + 1]])
                n.append(len(unique))
                with np.errstate(over="ignore"):
                    a.append(unique.sum(dtype=np.uint64).astype(np.int64))
                    b.append(np.bitwise_xor.reduce(mix64(unique)).astype(np.int64) if len(unique) else 0)
                sig.append(_signature(unique).tobytes() if len(unique) else None)
            yield pa.record_batch([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.binary())], schema=_SIGNED)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sig): set_a and set_b are a fingerprint of the set."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sign, "doc_id long, n_shingles long, set_a long, set_b long, sig binary")


def _forest(reps: DataFrame, carry: list[str]) -> DataFrame:
    """A row for each representative and tree: tree, key, id, sketch."""
    slot = lambda p: F.substring("sig", 4 * p + 1, 4)
    keys = F.array(*[F.struct(F.lit(t).alias("tree"), F.concat(*[slot(p) for p in order]).alias("key")) for t, order in enumerate(_ORDERS)])
    return reps.withColumn("at", F.explode(keys)).select("at.tree", "at.key", "id", "sketch", *carry)


_NIBBLES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities that pairs of sketches suggest; a slot agrees by chance once in 16."""
    x = a ^ b
    agree = ((x & 15) == 0).sum(axis=1) + ((x >> 4) == 0).sum(axis=1)
    return (agree / SLOTS - 1 / 16) / (15 / 16)


def _near(tree, key, ids, sketch, comp, window):
    """Pairs of rows at most ``window`` apart in sorted order with a common prefix and like sketches.

    With components known, a row also meets the last rows before its own component's run.
    """
    n = len(ids)
    found = []
    if n < 2:
        return np.zeros((0, 2), np.int64)
    here = np.arange(n)
    if comp is None:
        steps = [(here[d:], here[:-d]) for d in range(1, min(window, n - 1) + 1)]
    else:
        run = np.ones(n, bool)
        run[1:] = comp[1:] != comp[:-1]
        before = np.maximum.accumulate(np.where(run, here, 0)) - 1
        steps = []
        for d in range(window):
            to = before - d
            ok = to >= 0
            steps.append((here[ok], to[ok]))
    for i, j in steps:
        ok = (tree[i] == tree[j]) & (key[i, :MIN_DEPTH] == key[j, :MIN_DEPTH]).all(axis=1) & (ids[i] != ids[j])
        if comp is not None:
            ok &= comp[i] != comp[j]
        i, j = i[ok], j[ok]
        ok = _alike(sketch[i], sketch[j]) >= SKETCH_LEAST
        found.append(np.stack((np.minimum(ids[i], ids[j])[ok], np.maximum(ids[i], ids[j])[ok]), axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


_PAIRS = "a long, b long, tree int, key binary, id long, sketch binary, comp long"
_NEAR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), ("key", pa.binary()), ("id", pa.int64()), ("sketch", pa.binary()), ("comp", pa.int64())])


def _fixed(column, width: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _carried(block, comp, window):
    """The last rows, and the last before the run of components that the block ends in."""
    n = len(comp)
    other = np.flatnonzero(comp != comp[-1])
    start = int(other[-1]) + 1 if len(other) else 0
    return pa.concat_tables([block.slice(max(0, start - window), min(start, window)), block.slice(max(start, n - window))])


def _neighbours(crossing: bool, window: int, edges: bool):
    """Over one sorted partition in blocks; the last rows go along into the next block.

    With ``edges``, the first and last rows come out too, to meet those of the
    partitions before and after.
    """

    def work(batches):
        held, head, tail = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = pa.Table.from_batches([batch])
            if sum(t.num_rows for t in head) < window:
                head.append(block.slice(0, window))
            joined = block if held is None else pa.concat_tables([held, block]).combine_chunks()
            cols = {c: joined.column(c).combine_chunks() for c in ("tree", "key", "id", "sketch", "comp")}
            pairs = _near(cols["tree"].to_numpy(), _fixed(cols["key"], KEY_SLOTS, ">u4"), cols["id"].to_numpy(), _fixed(cols["sketch"], SLOTS // 2, np.uint8), cols["comp"].to_numpy() if crossing else None, window)
            held = tail = _carried(joined, cols["comp"].to_numpy(), window) if crossing else joined.slice(max(0, joined.num_rows - window))
            if none := len(pairs):
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary()), pa.nulls(none, pa.int64())], schema=_NEAR)
        if edges and tail is not None:
            rim = pa.concat_tables([pa.concat_tables(head).slice(0, window), tail])
            m = rim.num_rows
            yield pa.record_batch([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *[rim.column(c).combine_chunks() for c in ("tree", "key", "id", "sketch", "comp")]], schema=_NEAR)

    return work


def _candidates(ws: Workspace, reps: DataFrame, parts: int, crossing: bool, name: str) -> DataFrame:
    """Candidate pairs (a, b) from all trees; sampled splitters range-partition every order."""
    rows = _forest(reps, ["comp"])
    window = CROSSING if crossing else WINDOW
    dealt = rows.repartitionByRange(parts, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    near = ws.save(dealt.mapInArrow(_neighbours(crossing, window, True), _PAIRS), f"{name}_near")
    rims = near.where("id is not null").select("tree", "key", "id", "sketch", "comp").distinct().coalesce(1).sortWithinPartitions("tree", "key", "id")
    return near.where("a is not null").select("a", "b").union(rims.mapInArrow(_neighbours(crossing, window, False), _PAIRS).select("a", "b")).distinct()


def _confirm(batches):
    for batch in batches:
        sides = []
        for c in (2, 3):
            data, offsets = text_bytes(batch.column(c))
            sets = []
            for lo, hi in slices(offsets, 1 << 20):
                hashes, bounds = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                sets += [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(hi - lo)]
            sides.append(sets)
        keep = []
        for x, y in zip(*sides, strict=True):
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            if not len(small):
                keep.append(False)
                continue
            at = np.searchsorted(large, small)
            common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def _full_sets(column) -> list[np.ndarray]:
    data, offsets = text_bytes(column)
    sets = []
    for lo, hi in slices(offsets, 1 << 20):
        hashes, bounds = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        sets += [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(hi - lo)]
    return sets


def _linked(sets: list[np.ndarray], members: np.ndarray, outsiders: np.ndarray):
    """(outsider, the members it is linked with) for each outsider with a link."""
    if not len(members) or not len(outsiders):
        return
    joined = np.concatenate([sets[m] for m in members])
    known = np.unique(joined)
    if not len(known):
        return
    sizes = np.array([len(sets[m]) for m in members])
    owner = np.repeat(np.arange(len(members)), sizes)
    at = np.searchsorted(known, joined)
    order = np.argsort(at, kind="stable")
    owner, starts = owner[order], np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(known)))))
    for o in outsiders:
        x = sets[o]
        pos = np.searchsorted(known, x)
        pos = pos[known[np.minimum(pos, len(known) - 1)] == x]
        picks = np.concatenate([owner[starts[k] : starts[k + 1]] for k in pos]) if len(pos) else np.zeros(0, np.int64)
        common = np.bincount(picks, minlength=len(members))
        good = np.flatnonzero((common > 0) & (100 * common >= PERCENT * (sizes + len(x) - common)))
        if len(good):
            yield o, members[good]


def _settle(group: pa.Table) -> pa.Table:
    """Links between the outsiders and the members of one block, on full sets."""
    group = group.combine_chunks()
    sets = _full_sets(group.column("text").combine_chunks())
    ids, inside = group.column("id").to_numpy(), group.column("member").to_numpy()
    left, right = [], []
    for o, good in _linked(sets, np.flatnonzero(inside), np.flatnonzero(~inside)):
        left.append(ids[o])
        right.append(ids[good[0]])
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _completion(ws: Workspace, reps: DataFrame, known: DataFrame, failed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) across pairs of components that candidates met but did not link."""
    comp = ws.save(reps.select("id").distinct().join(known, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("comp")), "comp_now")
    size = comp.groupBy("comp").agg(F.count("id").alias("size"))
    side = lambda c: comp.select(F.col("id").alias(c), F.col("comp").alias(f"comp_{c}"))
    met = failed.join(side("a"), "a").join(side("b"), "b").where("comp_a <> comp_b").select(F.least("comp_a", "comp_b").alias("comp_a"), F.greatest("comp_a", "comp_b").alias("comp_b")).distinct()
    sized = met.join(size.select(F.col("comp").alias("comp_a"), F.col("size").alias("size_a")), "comp_a").join(size.select(F.col("comp").alias("comp_b"), F.col("size").alias("size_b")), "comp_b").where("size_a > 1 or size_b > 1")
    first = F.col("size_a") >= F.col("size_b")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = ws.save(sized.select(F.when(first, F.col("comp_a")).otherwise(F.col("comp_b")).alias("large"), F.when(first, F.col("comp_b")).otherwise(F.col("comp_a")).alias("small"), F.greatest("size_a", "size_b").alias("n_large")), "open")
    outside = open_.join(comp, F.col("small") == F.col("comp")).select("large", "n_large", "id").distinct()
    outside = ws.save(outside, "outside")
    many = outside.groupBy("large").agg(F.first("n_large").alias("n_large"), F.count("id").alias("n_out"))
    of = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    inner = many.join(comp, F.col("large") == F.col("comp")).select("large", of(F.col("n_large")).alias("block"), "n_out", "id").select("large", "block", every(F.col("n_out")).alias("out_block"), "id", F.lit(True).alias("member"))
    outer = outside.join(many.select("large", "n_out"), "large").select("large", of(F.col("n_out")).alias("out_block"), "n_large", "id").select("large", every(F.col("n_large")).alias("block"), "out_block", "id", F.lit(False).alias("member"))
    rows = inner.unionByName(outer).join(texts, "id").select("large", "block", "out_block", "id", "member", "text")
    return rows.groupBy("large", "block", "out_block").applyInArrow(_settle, "a long, b long")


_OPEN = pa.schema([("run", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("id", pa.int64()), ("comp", pa.int64())])


def _unsettled(group: pa.Table) -> pa.Table:
    """The rows of a tile that have a partner of another component: like sketches and sizes, not compared before."""
    group = group.combine_chunks()
    block, comp, part, n = (group.column(c).to_numpy() for c in ("block", "comp", "part", "n_shingles"))
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    sketch, done = _fixed(group.column("sketch").combine_chunks(), SLOTS // 2, np.uint8), group.column("done").to_pylist()
    right = np.flatnonzero(block == j)
    barred = {int(r): np.array(done[r], np.int64) for r in right if done[r]}
    busy = np.zeros(len(block), bool)
    for r in np.flatnonzero(block == i):
        to = right[(comp[right] != comp[r]) & (100 * np.minimum(n[right], n[r]) >= PERCENT * np.maximum(n[right], n[r]))]
        to = to[_alike(sketch[to], sketch[r]) >= SKETCH_LEAST]
        if len(to) and done[r]:
            to = to[~np.isin(part[to], done[r])]
        if len(to) and barred:
            to = to[[int(t) not in barred or part[r] not in barred[int(t)] for t in to]]
        busy[to] = True
        busy[r] |= len(to) > 0
    return group.select(_OPEN.names).filter(pa.array(busy)).cast(_OPEN)


def _settle_tile(group: pa.Table) -> pa.Table:
    """Links between rows of a tile's two blocks, on full sets: of each row one to every other component."""
    group = group.combine_chunks()
    sets = _full_sets(group.column("text").combine_chunks())
    ids, block, comp = (group.column(c).to_numpy() for c in ("id", "block", "comp"))
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    left, right = [], []
    for o, good in _linked(sets, np.flatnonzero(block == i), np.flatnonzero(block == j)):
        good = good[comp[good] != comp[o]]
        for g in good[np.unique(comp[good], return_index=True)[1]]:
            left.append(ids[o])
            right.append(ids[g])
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _crowded(ws: Workspace, reps: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) in the runs of equal prefix that are longer than the window.

    Shorter runs have met whole in the first pass. In a longer one, the rows of its
    largest component fill the first blocks, all others the next; every two blocks but
    those of the largest component meet. Pairs of components that the exact completion
    has compared (its tables comp_now and open) are not compared again.
    """
    part = ws.spark.read.parquet(ws.path("comp_now")).select("id", F.col("comp").alias("part"))
    done = ws.spark.read.parquet(ws.path("open")).groupBy("small").agg(F.collect_set("large").alias("done"))
    comp = ws.save(part.join(known, F.col("id") == F.col("node"), "left").select("id", "part", F.coalesce("component", "id").alias("comp")), "comp_rest")
    size = comp.groupBy("comp").agg(F.count("id").alias("size"))
    marked = reps.join(comp, "id").join(size, "comp")
    rows = _forest(marked, ["n_shingles", "comp", "part", "size"]).withColumn("run", F.xxhash64("tree", F.substring("key", 1, 4 * MIN_DEPTH)))
    runs = rows.groupBy("run").agg(F.count("id").alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.max(F.struct("size", "comp"))["comp"].alias("top"))
    long = ws.save(runs.where((F.col("n") > WINDOW + 1) & (F.col("least") != F.col("most"))).select("run", "top"), "long_runs")
    inside = ws.save(rows.join(long, "run").select("run", "id", "n_shingles", "sketch", "comp", "part", (F.col("comp") == F.col("top")).alias("of_top")), "run_rows")
    blocks = lambda flag: F.ceil(F.count_if(flag) / BLOCK).cast("int")
    sides = inside.groupBy("run").agg(blocks(F.col("of_top")).alias("t"), blocks(~F.col("of_top")).alias("r"))
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    dealt = inside.join(sides, "run").withColumn("block", F.when(F.col("of_top"), deal(F.col("t"))).otherwise(F.col("t") + deal(F.col("r"))))
    tile = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    here, last = F.col("block"), F.col("t") + F.col("r") - 1
    after = F.transform(F.sequence(F.when(F.col("of_top"), F.col("t")).otherwise(here), last), lambda j: tile(here, j))
    before = F.transform(F.filter(F.sequence(F.lit(0), last), lambda i: ~F.col("of_top") & (i < here)), lambda i: tile(i, here))
    tiles = dealt.withColumn("at", F.explode(F.concat(before, after))).join(done, F.col("part") == F.col("small"), "left")
    tiles = tiles.select("run", "at.i", "at.j", "block", "id", "n_shingles", "sketch", "comp", "part", "done")
    busy = ws.save(tiles.groupBy("run", "i", "j").applyInArrow(_unsettled, "run long, i int, j int, block int, id long, comp long").distinct(), "run_busy")
    return busy.join(texts, "id").select("run", "i", "j", "block", "id", "comp", "text").groupBy("run", "i", "j").applyInArrow(_settle_tile, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text, ...).

    Null or blank text: no shingle, a component of its own, kept. Rows that repeat a
    doc_id count as one document: whatever links one of its texts links it.
    A row with a null doc_id is linked with nothing: component_id null, kept true.
    An empty table gives an empty result; other columns are ignored. Of equal texts the
    smallest doc_id is the component's. Texts of any length give their whole set of
    shingles; a confirmed pair holds two of these sets in memory.
    """
    short_batches(spark)
    ws = Workspace(spark)
    docs = docs.select("doc_id", "text")
    signed = ws.save(signatures(docs), "signed")
    real = signed.where("doc_id is not null and n_shingles > 0")
    classes = ws.save(real.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "classes")
    sketch = F.unhex(F.concat(*[F.substring(F.hex(F.substring("sig", 4 * p + 4, 1)), 2, 1) for p in range(SLOTS)]))
    reps = classes.select("id", "sig", sketch.alias("sketch"), "n_shingles")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    links, known, tried = None, None, None
    for turn in range(ROUNDS):
        marked = reps.withColumn("comp", F.lit(None).cast("long")) if known is None else reps.join(known, F.col("id") == F.col("node"), "left").select("id", "sig", "sketch", F.coalesce("component", "id").alias("comp"))
        pairs = ws.save(_candidates(ws, marked, parts, known is not None, f"r{turn}"), f"pairs{turn}")
        fresh = ws.save(_confirmed(pairs, texts).distinct(), f"links{turn}")
        ws.drop(f"r{turn}_near")
        links = fresh if links is None else links.union(fresh)
        tried = pairs if tried is None else tried.union(pairs)
        known = connected_components(ws, links, f"cc{turn}")
    rest = ws.save(_completion(ws, reps, known, tried, texts), "links_rest")
    known = connected_components(ws, known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest), "cc_rest")
    crowd = ws.save(_crowded(ws, reps, known, texts), "links_crowd")
    known = connected_components(ws, known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(crowd), "cc_all")
    of_class = classes.join(known, F.col("id") == F.col("node"), "left").select("n_shingles", "set_a", "set_b", F.coalesce("component", "id").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(of_class, ["n_shingles", "set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents; awkward rows as in ``near_duplicates``."""
    return near_duplicates(spark, table(spark, sf_dir, "documents"))
