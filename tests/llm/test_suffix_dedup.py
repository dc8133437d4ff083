import hashlib
import random

from docloom.llm import suffix_dedup
from docloom.llm.suffix_dedup import multikey_order, remove_repeats

from .helpers import AWKWARD, docs, empty, plain


def brute(pairs):
    """(n_bytes, n_removed, n_spans, sha) of texts with distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(pairs):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(raw[k : k + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(["ab", "cde", "fé", "ghij", "k"]) + str(rng.randrange(300)) for _ in range(n))
    shared = [say(40), say(25), "x" * 300, "ab" * 120]
    out = []
    for i in range(60):
        text = say(rng.randrange(1, 60))
        for _ in range(rng.randrange(3)):
            part = rng.choice(shared)
            cut = rng.randrange(len(part) // 2)
            text = text + part[cut:] + say(rng.randrange(1, 10))
        out.append((i, text))
    out.append((100, out[3][1]))
    out.append((101, out[4][1] + out[4][1]))
    return out


def test_equals_brute_force(spark):
    for seed in (1, 2):
        pairs = corpus(seed)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(spark, plain(spark, pairs)).collect()}
        assert got == brute(pairs)


def test_awkward_rows(spark):
    rows = remove_repeats(spark, docs(spark)).collect()
    assert len(rows) == len(AWKWARD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].n_bytes == by[3][0].n_bytes == 0 and by[2][0].n_spans == 0
    assert by[6][0].n_removed == 0 and by[7][0].n_removed == by[7][0].n_bytes
    assert {r.n_removed for r in by[1]} == {0}
    assert by[None][0].n_removed == 0


def test_rows_that_repeat_an_id_at_equal_starts_stay(spark):
    text = "abcdefghij" * 3 + "".join(chr(97 + i % 26) + str(i) for i in range(80))
    rows = remove_repeats(spark, plain(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 0, len(text)]


def test_empty_table(spark):
    assert remove_repeats(spark, empty(spark)).collect() == []


def test_multikey_order():
    import numpy as np

    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 4, 500), rng.integers(0, 4, 500), rng.integers(0, 10**6, 500)]
    order = multikey_order(keys)
    assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*[k.tolist() for k in keys]))


def test_text_longer_than_a_piece(spark):
    """A passage across the border of two pieces comes again at the end, and whole in another document."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(suffix_dedup.PIECE + 30_000))
    part = text[suffix_dedup.PIECE - 700 : suffix_dedup.PIECE + 500]
    got = {r.doc_id: r for r in remove_repeats(spark, plain(spark, [(1, text + "#" + part), (2, "~" + part + "~"), (3, "~" * 90)])).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans) == (len(text) + 1201, 1200, 1)
    assert got[1].kept_sha256 == hashlib.sha256((text + "#").encode()).hexdigest()
    assert (got[2].n_removed, got[2].kept_sha256) == (1200, hashlib.sha256(b"~~").hexdigest()) and got[3].n_removed == 0
