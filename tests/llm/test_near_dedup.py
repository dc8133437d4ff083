import random

import pytest

from docloom.llm import near_dedup
from docloom.llm.near_dedup import near_duplicates

from .helpers import AWKWARD, LONG, docs, empty, plain

SPACE = " \t\n\x0b\x0c\r"


def shingles(text):
    words, now = [], ""
    for c in (text or "").translate({i: i + 32 for i in range(65, 91)}) + " ":
        if c in SPACE:
            words += [now] if now else []
            now = ""
        else:
            now += c
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(pairs):
    sets = {i: shingles(t) for i, t in pairs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    out, bases = [], [[rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(rng.randrange(3, 120))] for _ in range(12)]
    for i in range(160):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return out


def test_equals_brute_force(spark):
    pairs = corpus(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark, plain(spark, pairs)).collect()}
    assert got == brute(pairs)


def test_outliers_of_a_large_group(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    pairs = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        pairs.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark, plain(spark, pairs)).collect()}
    assert got == brute(pairs)


def test_awkward_rows(spark):
    rows = near_duplicates(spark, docs(spark)).collect()
    assert len(rows) == len(AWKWARD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.component_id for r in by[1]] == [1, 1] and all(r.kept for r in by[1])
    for blank in (2, 3, 4):
        assert by[blank][0].n_shingles == 0 and by[blank][0].component_id == blank and by[blank][0].kept
    assert by[5][0].n_shingles == 1
    assert by[7][0].component_id == 6 and by[8][0].component_id == 6 and not by[8][0].kept
    assert by[None][0].component_id is None and by[None][0].kept
    assert by[6][0].n_shingles == len(shingles(LONG))


def test_empty_table(spark):
    assert near_duplicates(spark, empty(spark)).collect() == []


def template_region(seed, n=600, width=100):
    """Texts that share a long template at 0.6 to 0.74, unlinked, and a few pairs among them at 0.75 and more."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(width)]
    out = []
    for i in range(n):
        words = base[:82] + [f"x{i}_{k}" for k in range(width - 82)]
        out.append((i, " ".join(words)))
        if i % 10 == 0:
            twin = list(words)
            twin[rng.randrange(82)] = f"y{i}"
            twin[rng.randrange(85, width)] = f"z{i}"
            out.append((n + i, " ".join(twin)))
    rng.shuffle(out)
    return out


def test_pairs_in_a_template_region(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 128)
    pairs = template_region(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark, plain(spark, pairs)).collect()}
    want = brute(pairs)
    assert len({c for _, c in want.values()}) == 600
    assert got == want


def boilerplate(seed, background, n=500, width=100):
    """Texts that share a template at about ``background``, below the limit, and planted pairs at 0.76 and a little more."""
    rng = random.Random(seed)
    shared = round(width * 2 * background / (1 + background)) + 4
    base = [f"b{i}" for i in range(width)]
    out, planted = [], 0
    for i in range(n):
        words = base[:shared] + [f"x{i}_{k}" for k in range(width - shared)]
        out.append((2 * i, " ".join(words)))
        if i % 4 == 0:
            twin = list(words)
            twin[rng.randrange(5, shared - 5)] = f"y{i}"
            twin[rng.randrange(shared + 2, width - 2)] = f"z{i}"
            out.append((2 * i + 1, " ".join(twin)))
            planted += 1
    rng.shuffle(out)
    return out, planted


@pytest.mark.parametrize("background", [0.54, 0.60, 0.70])
def test_recall_among_boilerplate(spark, background):
    pairs, planted = boilerplate(3, background)
    want = brute(pairs)
    assert sum(c != i for i, (_, c) in want.items()) == planted
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark, plain(spark, pairs)).collect()}
    found = sum(got[i][1] == c for i, (_, c) in want.items() if c != i)
    print(f"background {background}: {found} of {planted} planted pairs")
    assert found == planted and got == want
