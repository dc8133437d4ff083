"""Collections, the word index and dense search on awkward rows."""

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.operators import collections as K
from docloom.operators import retrieval as S
from docloom.operators import search_run
from docloom.operators.word_index import WordIndex

CHUNKS = "chunk_id string, doc_id string, text string, token_count int, is_parent boolean"


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("part-*")}


def found(spark, folder, name):
    return {r.chunk_id: (r.doc_id, r.text) for r in K.read(spark, folder, name).collect()}


def test_collections(spark, tmp_path):
    folder = str(tmp_path / "c")
    assert found(spark, folder, "main") == {} and K.counts(spark, folder).collect() == [("main", 0), ("parents", 0)]
    rows = [(f"c{i}", f"d{i % 5}", f"text {i}", i, i % 4 == 0) for i in range(40)]
    K.upsert(spark.createDataFrame([*rows, ("c1", "d1", "text 0", 1, False), ("c1", "d1", "text 1", 1, False)], CHUNKS), folder, 0)
    before = files(folder)
    want = {i: (d, t) for i, d, t, _, p in rows if not p}
    assert found(spark, folder, "main") == want and len(found(spark, folder, "parents")) == 10
    K.upsert(spark.createDataFrame([("c1", "d1", "new", 1, False), ("c99", "d9", None, 1, False)], CHUNKS), folder, 1)
    K.upsert(spark.createDataFrame([("c1", "d1", "new", 1, False), ("c99", "d9", None, 1, False)], CHUNKS), folder, 1)
    want |= {"c1": ("d1", "new"), "c99": ("d9", None)}
    assert found(spark, folder, "main") == want
    assert {p: t for p, t in files(folder).items() if p in before} == before
    assert len({p.split("bucket=")[1][:2] for p in files(folder) if "main/segment=1" in p}) <= 2
    K.delete(spark.createDataFrame([("d1",), ("nobody",), (None,)], "doc_id string"), folder, 2, "doc_id")
    K.delete(spark.createDataFrame([("c2",), ("c2",)], "chunk_id string"), folder, 3)
    want = {i: v for i, v in want.items() if v[0] != "d1" and i != "c2"}
    assert found(spark, folder, "main") == want
    assert {r.chunk_id for r in K.find(spark, folder, "main", ["c3", "c2", "c1", "x"]).collect()} == {"c3"}
    assert "bucket" in K.find(spark, folder, "main", ["c3"])._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    K.upsert(spark.createDataFrame([("c2", "d2", "back", 1, False)], CHUNKS), folder, 4)
    K.compact(spark, folder, str(tmp_path / "small"))
    assert found(spark, str(tmp_path / "small"), "main") == found(spark, folder, "main") == want | {"c2": ("d2", "back")}
    K.reset(spark, folder)
    assert found(spark, folder, "main") == {}


def test_counts_and_deletions_shuffle_no_texts(spark, tmp_path):
    folder = str(tmp_path / "c")
    K.upsert(spark.createDataFrame([("c1", "d1", "a text", 1, False), ("c2", "d2", "other", 1, True)], CHUNKS), folder, 0)
    plan = K.counts(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "text#" in line and "Relation" not in line]
    digests = K.read(spark, folder, "main", F.md5("text"))
    assert [r.text for r in digests.collect()] == [hashlib.md5(b"a text").hexdigest()]
    plan = digests._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("md5(") > plan.index("Aggregate")


def test_chunks_keep_columns_without_a_join(spark, data):
    from docloom.plans.chunks import gated

    assert "Join" not in gated(spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_scores_of_an_index_shuffle_no_pairs(spark, tmp_path):
    index = WordIndex(spark, str(tmp_path / "i"))
    index.change(spark.createDataFrame([("1", "a a b"), ("2", "b"), ("3", "c d")], "id string, text string"), 0)
    scores = index.scores(spark.createDataFrame([(1, "a b"), (2, "b b")], "query_id long, text string"))
    assert {(r.query_id, r.id) for r in scores.collect()} == {(1, "1"), (1, "2"), (2, "1"), (2, "2")}
    assert scores._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("MapInArrow")


def test_index_after_changes_equals_a_search_of_the_texts(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["The", "the", "loan", "rate", "x", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(0, 20)))
    texts, index = {}, WordIndex(spark, str(tmp_path / "i"), "long", 8)
    asked = spark.createDataFrame([(1, "the loan the"), (2, "w1 w2 unknown"), (3, ""), (4, "x")], "query_id long, text string")
    for segment in range(4):
        change = {rng.randrange(60): None if rng.random() < 0.2 * segment else text() for _ in range(40)}
        frame = spark.createDataFrame(list(change.items()), "id long, text string")
        index.change(frame, segment)
        if segment == 2:
            index.change(frame, segment)
        texts = {i: t for i, t in (texts | change).items() if t is not None}
        corpus = spark.createDataFrame(list(texts.items()), "id long, text string")
        key = lambda rows: sorted((r.query_id, r["rank"], r.id, round(r.score, 5)) for r in rows.collect())
        assert key(index.search(asked, 5)) == key(S.bm25_top_k(asked, corpus, 5))
    assert index.last() == 3
    small = index.merged(str(tmp_path / "small"))
    assert small.last() == 0 and key(small.search(asked, 5)) == key(index.search(asked, 5))
    plan = index.postings_of(asked.select(F.lit("loan").alias("word")), 3)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1][:300]


def test_a_change_that_broke_off_is_not_seen(spark, tmp_path, monkeypatch):
    from docloom.operators import word_index

    index, write = WordIndex(spark, str(tmp_path / "i")), word_index.write_segment
    asked = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    key = lambda: sorted((r.id, round(r.score, 5)) for r in index.search(asked, 5).collect())
    index.change(spark.createDataFrame([("1", "a c d"), ("2", "b"), ("3", "e f")], "id string, text string"), 0)
    before, more = key(), spark.createDataFrame([("1", "b b"), ("2", None), ("4", "a")], "id string, text string")

    def broken(rows, folder, *more):
        if folder.endswith("stats"):
            raise OSError("lost")
        write(rows, folder, *more)

    monkeypatch.setattr(word_index, "write_segment", broken)
    with pytest.raises(OSError):
        index.change(more, 1)
    assert key() == before
    monkeypatch.setattr(word_index, "write_segment", write)
    index.change(more, 1)
    assert {i for i, _ in key()} == {"1", "3", "4"}


@pytest.mark.parametrize("block", [4096, 3])
def test_odd_vectors_cost_only_themselves(spark, block):
    rng = random.Random(2)
    vec = lambda n: [rng.gauss(0, 1) for _ in range(n)]
    good = [(i, vec(8), i % 3) for i in range(300)]
    odd = [(1000, vec(9), 0), (1001, [], 0), (1002, None, 0), (1003, [1.0, None] * 4, 0), (1004, [float("nan")] * 8, 0), (1005, [0.0] * 8, 0), (1006, [float("inf")] * 8, 0), (None, vec(8), 0)]
    queries = [(i, good[i][1], None if i % 2 else 1) for i in range(10)]
    ask = lambda qs, rows: sorted(map(tuple, S.dense_top_k(spark.createDataFrame(qs, "query_id long, qvec array<double>, only int"), spark.createDataFrame(rows, "id long, vec array<double>, label int").coalesce(1), 5, block).collect()))
    want = ask(queries, good)
    assert len(want) == 50 and {r[1] % 3 for r in want if r[0] % 2 == 0} == {1}
    assert ask([*queries, (20, vec(11), None), (21, None, None), (22, [], None)], [*odd, *good]) == want
    nine = ask([(30, vec(9), None)], [*odd, *good])
    assert [r[1] for r in nine] == [1000]


def test_forty_variants_of_a_query_stay_its_own(spark):
    rng = random.Random(3)
    vecs = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    corpus = spark.createDataFrame([(i, v, 0, f"text {i}", None) for i, v in enumerate(vecs)], "id long, vec array<double>, label int, text string, parent_id string")
    asked = spark.createDataFrame([(q, n, vecs[(k * 7 + n) % 60], None, "text", False) for k, q in enumerate("ab") for n in range(40)], "query_id string, variant int, qvec array<double>, only int, text string, rerank_works boolean")
    parents = spark.createDataFrame([], "id string, text string")
    _, counts = search_run.retrieve(asked, corpus, parents, near=2.0)
    alone = {q: search_run.retrieve(asked.where(F.col("query_id") == q), corpus, parents, near=2.0)[1].first().candidates for q in "ab"}
    assert {r.query_id: r.candidates for r in counts.collect()} == alone


def test_a_failing_strategy_loses_only_its_own_chunks(spark):
    from docloom.operators import chunking as C
    from docloom.operators import parsing as P

    docs = spark.createDataFrame([(1, "a\nb"), (2, "c"), (3, None), (4, " ")], "doc_id int, text string")
    tables = spark.createDataFrame([(1, 2, ["H"], [["x"]]), (1, 1, ["K"], [["y"], ["z"]]), (2, 1, ["H"], []), (9, 1, ["H"], [["lost"]])], "doc_id int, tbl int, headers array<string>, rows array<array<string>>")
    strategies = [
        C.Strategy("line", lambda d: C.paragraphs(d).withColumnRenamed("ord", "chunk_no"), F.expr("CASE WHEN doc_id = 1 THEN 'broken' WHEN text IS NULL THEN 'no text' END")),
        C.Strategy("table", lambda d: P.document_tables(d, tables)),
    ]
    got = {(r.doc_id, r.place, r.strategy, r.chunk_no, r.text, r.error) for r in C.orchestrate(docs, strategies).collect()}
    line = lambda h, *rows: "\n".join([f"| {h} |", "| --- |", *(f"| {x} |" for x in rows)])
    assert got == {(1, 0, "line", None, None, "broken"), (3, 0, "line", None, None, "no text"), (2, 0, "line", 1, "c", None), (1, 1, "table", 0, line("K", "y", "z"), None), (1, 1, "table", 1, line("H", "x"), None)}
    assert C.orchestrate(docs.limit(0), strategies).collect() == []
