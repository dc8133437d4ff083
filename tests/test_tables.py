"""Tables from boxes, files from parts, vectors by a cache."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import ingestion as I
from docloom.operators import models as M
from docloom.operators import parsing as P
from docloom.operators import tables as T
from docloom.plans import layout

WORD, RULE = "page int, x0 double, y0 double, x1 double, y1 double, text string", "page int, x0 double, y0 double, x1 double, y1 double"


def laid(page, cells, left=50.0, top=100.0, wide=100.0, high=20.0):
    """Words of cells in a grid."""
    out = []
    for r, row in enumerate(cells):
        for c, cell in enumerate(row):
            at = left + c * wide
            for text in cell.split():
                out.append((page, at, top + r * high, at + 4.0 * len(text), top + r * high + 10, text))
                at += 4.0 * len(text) + 3
    return out


def ruled(page, rows, columns, left=45.0, top=95.0, wide=100.0, high=20.0, rng=None):
    shake = lambda: rng.uniform(-1, 1) if rng else 0.0
    out = []
    for k in range(rows + 1):
        y = top + k * high + shake()
        out.append((page, left, y, left + columns * wide, y))
    for k in range(columns + 1):
        x = left + k * wide + shake()
        # A line in two pieces with a small hole.
        out += [(page, x, top, x, top + high), (page, x + 0.5, top + high + 1, x + 0.5, top + rows * high)]
    return out


def found(spark, words, rules):
    rows = T.extract(spark.createDataFrame(words, WORD), spark.createDataFrame(rules, RULE)).collect()
    return {(r.page, r.tbl): (r.method, r.headers, r.rows, r.error) for r in rows}


GRID = [["Name", "Rate", "Note"], ["Home loan", "8.5", ""], ["Car", "", "two words"], ["", "7", "x"]]
HEAD, BODY = GRID[0], GRID[1:]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ruled_and_unruled_pages(spark, seed):
    rng = random.Random(seed)
    words, rules = laid(1, GRID) + laid(2, GRID), ruled(1, 4, 3, rng=rng)
    rng.shuffle(words)
    rng.shuffle(rules)
    got = found(spark, words, rules)
    assert got == {(1, 1): ("lattice", HEAD, BODY, None), (2, 1): ("stream", HEAD, BODY, None)}


def test_two_tables_on_a_page_and_words_outside(spark):
    small = [["A", "B"], ["1", "2"]]
    words = laid(1, GRID) + laid(1, small, top=400.0) + laid(1, small, top=400.0, left=500.0) + [(1, 50.0, 300.0, 90.0, 310.0, "between")]
    rules = ruled(1, 4, 3) + ruled(1, 2, 2, top=395.0) + ruled(1, 2, 2, top=395.0, left=495.0) + [(1, 45.0, 700.0, 60.0, 700.0)]
    assert found(spark, words, rules) == {(1, 1): ("lattice", HEAD, BODY, None), (1, 2): ("lattice", ["A", "B"], [["1", "2"]], None), (1, 3): ("lattice", ["A", "B"], [["1", "2"]], None)}


def test_poor_tables_and_broken_pages(spark):
    sparse = [["only", "", "", "", "", ""]] + [["k", "", "", "", "", ""]] * 5
    words = laid(1, sparse) + laid(2, [["one line of text"]]) + laid(3, GRID) + laid(4, GRID) + [(3, None, 1.0, 2.0, 2.0, "lost"), (5, 10.0, 10.0, 5.0, 20.0, "back")]
    rules = ruled(1, 6, 6) + [(4, float("nan"), 0.0, 1.0, 1.0)] + ruled(6, 3, 3)
    broken = (None, None, None, "broken box")
    assert found(spark, words, rules) == {(3, None): broken, (4, None): broken, (5, None): broken}
    assert found(spark, [], []) == {}


def test_tables_drawn_as_boxes(spark):
    boxes = [(1, 45.0 + 100 * c, 95.0 + 20 * r, 144.5 + 100 * c, 114.6 + 20 * r) for r in range(4) for c in range(3)] + [(2, 45.0, 95.0, 345.0, 115.0)]
    words = laid(1, GRID) + laid(2, [["a", "b", "c"]])
    got = T.drawn(spark.createDataFrame(words, WORD), spark.createDataFrame(boxes, RULE)).collect()
    assert [(r.page, r.tbl, r.headers, r.rows) for r in got] == [(1, 1, HEAD, BODY)]


def test_words_and_rules_of_a_page_meet_once(spark, capsys):
    """No chain of sorts, windows and joins whose memory a task adds up; a page's rules may lie apart by less than the reach."""
    words, rules = spark.createDataFrame(laid(1, GRID), WORD), spark.createDataFrame(ruled(1, 4, 3), RULE)
    for rows in (T.extract(words, rules), T.drawn(words, rules)):
        rows.explain("simple")
        plan = capsys.readouterr().out
        assert "Window" not in plan and "Join" not in plan and plan.count("Exchange") == 1, plan


def test_boxes_are_dealt_to_the_sessions_partitions_before_lists_begin(spark, capsys):
    """A task's memory follows neither what the boxes are made from, nor their compressed bytes."""
    words = spark.createDataFrame([w for page in range(40) for w in laid(page, GRID)], WORD)
    rules = spark.createDataFrame([r for page in range(0, 40, 2) for r in ruled(page, 4, 3)], RULE)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows, pages in ((T.extract(words, rules), 40), (T.drawn(words, rules.limit(0)), 0)):
        rows.explain("simple")
        assert "Aggregate" not in capsys.readouterr().out.split("Exchange hashpartitioning(page")[1]
        assert rows.rdd.getNumPartitions() == parts
        assert rows.select("page").distinct().count() == rows.count() == pages


def test_words_and_rules_of_orders_are_made_in_the_sessions_partitions(spark, data):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [rows.rdd.getNumPartitions() for rows in layout.drawn(spark, data)] == [parts, parts]


def test_words_snap_to_the_first_line_within_reach(spark):
    rows = [(1, 1, 10.0, 100.04, "Hello"), (1, 2, 60.0, 101.5, "world"), (1, 3, 10.0, 103.0, "near"), (1, 4, 10.0, 104.2, "next"), (2, 1, 30.0, 5.0, "b"), (2, 2, 10.0, 5.0, "a")]
    got = {(r.page, r.y, r.text) for r in P.word_lines(spark.createDataFrame(rows, "page int, ord int, x0 double, y double, text string")).collect()}
    assert got == {(1, 100.0, "Hello near world"), (1, 104.2, "next"), (2, 5.0, "a b")}


def test_files_from_parts(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(60):
        raw = rng.randbytes(rng.randrange(1, 200))
        cuts = sorted({0, *(rng.randrange(len(raw)) for _ in range(4))})
        parts = [(i, a, raw[a : b + rng.choice([0, 0, 7])], len(raw)) for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
        if i % 3 == 1:
            parts += rng.sample(parts, 1)
        if i % 3 == 2:
            parts.pop(rng.randrange(len(parts)))
        have = set().union(*(range(a, a + len(c)) for _, a, c, _ in parts)) if parts else set()
        end = max(have, default=-1) + 1
        if parts:
            want[i] = (raw, None) if have == set(range(len(raw))) else (None, "gap" if have != set(range(end)) else "incomplete")
        rows += parts
    rows += [(100, 0, b"abc", 2), (101, None, None, 5), (102, 0, b"abc", None), (None, 0, b"x", 1)]
    want |= {100: (None, "too long"), 101: (None, "incomplete"), 102: (None, "incomplete")}
    rng.shuffle(rows)
    got = {r.file_id: (None if r.content is None else bytes(r.content), r.error) for r in I.assembled(spark.createDataFrame(rows, "file_id int, start int, content binary, total int")).collect()}
    assert got == want


def test_vectors_in_place_equal_the_column(spark):
    numbered = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "B  a\u00a0c a"), (5, "a b")], "id long, text string")
    inplace = M.embed_rows(numbered)
    assert "Exchange" not in inplace._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, tuple(r.vec)) for r in inplace.collect()} == {(r.id, tuple(r.v)) for r in numbered.select("id", M.hash_embedding(F.coalesce("text", F.lit(""))).alias("v")).collect()}


def test_vectors_are_computed_once(spark, tmp_path):
    folder = str(tmp_path / "v")
    frame = lambda *texts: spark.createDataFrame([(t,) for t in texts], "text string")
    first = {r.text: (list(r.vec), r.segment) for r in M.embed_cached(frame("a b", "a b", "", None), folder, 0).collect()}
    assert {t: s for t, (_, s) in first.items()} == {"a b": 0, "": 0, None: 0}
    again = M.embed_cached(frame("a b", "c", "c"), folder, 1)
    assert sorted((r.text, r.segment) for r in again.collect()) == [("a b", 0), ("c", 1), ("c", 1)]
    assert {r.text: list(r.vec) for r in again.collect()}["a b"] == first["a b"][0]
    assert spark.read.parquet(folder).groupBy("text_hash").count().where("count > 1").count() == 0
    alone = spark.createDataFrame([("a b",), ("",)], "text string").select("text", M.hash_embedding(F.col("text")).alias("v"))
    assert {r.text: r.v for r in alone.collect()} == {t: pytest.approx(v) for t, (v, _) in first.items() if t is not None}
    # Two runs at once that both met a text: one row each, and one vector for the text.
    M.write_segment(M.read_segments(spark, folder, M.CACHE).where("segment = 1").drop("segment"), folder, 2)
    assert M.embed_cached(frame("c"), folder, 3).select("text", "segment").collect() == [("c", 2)]
    assert M.embed_cached(frame(), folder, 4).select(F.col("vec")).collect() == []
