"""Every registered query with SQL against DuckDB, and hand-computed values."""

import decimal
import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.config import Settings, lookup
from docloom.functions import text as T
from docloom.functions.folds import pack_groups, pack_starts, pack_with_overlap
from docloom.operators import retrieval as S
from docloom.operators import validation as V
from docloom.plans import catalog
from docloom.plans.answers import answers


def same(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    return v


@pytest.fixture(scope="module")
def con(data):
    found = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return found


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, data, con, name):
    got = catalog.queries()[name](spark, data)
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda some: sorted((tuple(map(same, r)) for r in some), key=repr)
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0


def test_every_query_reads_a_given_table(spark, data):
    """Except those that write first: what they return is read from their own folder."""
    writes = {"SRC1", "SNK4", "SNK5", "SNK6", "STR5", "STR6", "STR7_STREAM", "STR9", "MDL1"}
    without = {name for name, f in catalog.queries().items() if name not in writes and not any(data in p for p in f(spark, data).inputFiles())}
    assert without == set()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_golden_confidence(spark):
    lit = lambda xs: [F.lit(x) for x in xs]
    assert one(spark, V.harmonic_mean(lit([0.9, 0.9, 0.1]), [0.35, 0.35, 0.30])) == pytest.approx(0.264706, abs=1e-6)
    answer, chunks = F.lit("The interest rate is 8.5% [Source 1]."), F.array(F.lit("the interest rate is 8.5% here"), F.lit("other"))
    parts = [V.retrieval_confidence(F.array(F.lit(0.85), F.lit(0.70))), V.numeric_faithfulness(answer, chunks), V.citation_completeness(answer, F.size(chunks))]
    assert [round(one(spark, p), 4) for p in parts] == [0.775, 1.0, 0.85]
    assert round(one(spark, V.harmonic_mean(parts, [0.35, 0.30, 0.35])), 4) == 0.8596


def reference_pack(units, limit, overlap, joiner):
    tok = lambda t: max(1, len(t) // 4)
    out, parts, used, tail = [], [], 0, ""
    for u in units:
        if used + tok(u) > limit and parts:
            out.append(joiner.join(([tail] if tail else []) + parts))
            kept, total = [], 0
            for p in reversed(parts):
                if total + tok(p) > overlap:
                    break
                kept.insert(0, p)
                total += tok(p)
            tail, parts = joiner.join(kept), []
            used = tok(tail)
        parts.append(u)
        used += tok(u)
    return out + ([joiner.join(([tail] if tail else []) + parts)] if parts else [])


def test_packing_folds(spark):
    import random

    rng = random.Random(0)
    for _ in range(15):
        units = ["x" * rng.randrange(1, 90) for _ in range(rng.randrange(0, 25))]
        column = F.array(*map(F.lit, units)) if units else F.array().cast("array<string>")
        assert one(spark, pack_with_overlap(column, 40, 12, " ")) == reference_pack(units, 40, 12, " ")
        if units:
            rows = spark.range(1).select(column.alias("u")).withColumn("s", pack_starts(F.transform("u", T.estimate_tokens), 40))
            groups, used = [[]], 0
            for u in units:
                if groups[-1] and used + max(1, len(u) // 4) > 40:
                    groups, used = [*groups, []], 0
                groups[-1].append(u)
                used += max(1, len(u) // 4)
            assert rows.select(pack_groups(F.col("u"), F.col("s")).alias("g")).first().g == groups


def test_packed_queries_equal_plain_packing(spark, data):
    """CHK3, CHK5 and CHK7 over all documents against loops."""
    import hashlib
    import re

    tok, md5 = (lambda t: max(1, len(t) // 4)), (lambda t: hashlib.md5(t.encode()).hexdigest())
    structure, children = set(), set()
    for doc, text in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        lines = [line for line in text.split("\n") if line.strip(" ")]
        structure |= {(doc, i, md5(t), tok(t)) for i, t in enumerate(reference_pack(lines, 1500, 50, "\n\n"))}
        for k, parent in enumerate(reference_pack(lines, 1200, -1, "\n\n")):
            parts = [p.strip(" ") for p in re.split(r'(?<=[.!?])\s+(?=[A-Z0-9"])', parent, flags=re.ASCII)]
            packed = [parent] if tok(parent) <= 300 else reference_pack([p for p in parts if p] or [parent], 300, 50, " ")
            children |= {(doc, k, i, md5(t), tok(t)) for i, t in enumerate(packed)}
    assert {tuple(r) for r in catalog.queries()["CHK3"](spark, data).collect()} == structure
    assert {tuple(r) for r in catalog.queries()["CHK7"](spark, data).collect()} == children


def test_queries_without_sql_equal_loops(spark, data):
    """CHK9, CHK15, SMP1, MDL4 and MDL5 over whole tables."""
    import hashlib
    import re
    import struct

    import xxhash

    rows = lambda name: {tuple(r) for r in catalog.queries()[name](spark, data).collect()}
    read = lambda name, *columns: spark.read.parquet(f"{data}/{name}.parquet").select(*columns).collect()
    tok, md5 = (lambda t: max(1, len(t) // 4)), (lambda t: hashlib.md5(t.encode()).hexdigest())

    tables, want = {}, set()
    for nation, key, name in sorted(read("customer", "c_nationkey", "c_custkey", "c_name")):
        tables.setdefault(nation, []).append(f"| {key} | {name} |")
    head = "| key | name |\n| --- | --- |"
    for nation, lines in tables.items():
        whole, packs = "\n".join([head, *lines]), [[]]
        for line in (f"{head}\n{x}" for x in lines):
            if packs[-1] and sum(map(tok, packs[-1])) + tok(line) > 2000:
                packs.append([])
            packs[-1].append(line)
        chunks = [whole] if tok(whole) <= 1500 else ["\n".join(p) for p in packs]
        want |= {(nation, i, tok(t), md5(t)) for i, t in enumerate(chunks)}
    assert rows("CHK9") == want

    want = set()
    for doc, text in read("documents", "doc_id", "text"):
        parts = [p.strip(" ") for p in re.split(r'(?<=[.!?])\s+(?=[A-Z0-9"])', text, flags=re.ASCII)]
        packs, now = [], ""
        for s in [p for p in parts if p] or [text]:
            joined = " ".join([now, s]).strip(" ")
            if len([w for w in re.split(r"\s+", joined, flags=re.ASCII) if w]) >= 25:
                packs += [now] * (now != "")
                now = s
            else:
                now = joined
        want |= {(doc, i, t) for i, t in enumerate(packs + [now] * (now != ""))}
    assert rows("CHK15") == want

    def place(i):
        h = xxhash.xxh64(struct.pack("<i", 42), seed=xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()).intdigest()
        return h - (1 << 64) * (h >= 1 << 63), i

    assert rows("SMP1") == {(i,) for i in sorted({i for (i,) in read("conversations", "conv_id")}, key=place)[:50]}

    want, marks = set(), (" and also ", " as well as ", " additionally ", " moreover ")
    for conv, turn, role, text in read("conversations", "conv_id", "turn", "role", "text"):
        if role == "user":
            compound = any(m in text.lower() for m in marks) or text.count("?") > 1
            parts = [p.strip(" ") for p in re.split(r"(?<=\?)|(?i:" + "|".join(marks) + ")", text)]
            parts = [p for p in parts if len(p) > 5] if compound else []
            want |= {(conv, turn, i, p) for i, p in enumerate(parts or [text])}
    assert rows("MDL4") == want

    words, want = (lambda t: {w for w in re.split(r"\s+", t.lower()) if w}), set()
    for r in answers(spark, data).collect():
        found = [f"[Source {i}] {c}" for i, c in enumerate(r.chunks, 1) if len(words(r.answer) & words(c)) >= 2]
        want.add((r.answer_id, "\n".join(found) or "NO_RELEVANT_EVIDENCE"))
    assert rows("MDL5") == want


def test_rerank_reads_both_texts_and_falls_back(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, "x y", "a b"), (1, 2, 0.1, "x y", "y x x"), (2, 1, 0.9, "x y", "a"), (2, 2, 0.1, "x y", "x y")], "query_id long, id long, score double, q string, t string")
    got = S.rerank(rows, S.word_overlap(F.col("q"), F.col("t")), 2, F.col("query_id") == 1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.score) for r in got] == [(1, 2, 1.0), (1, 1, 0.0), (2, 1, 0.9), (2, 2, 0.1)]


def test_dense_search_in_blocks_equals_one(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    asked, corpus = rows.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS qvec"), rows.selectExpr("vec_id AS id", "embedding AS vec")
    awkward = corpus.unionByName(spark.createDataFrame([(-1, None), (-2, []), (-3, [0.0] * 64)], "id long, vec array<float>"))
    key = lambda found: sorted(map(tuple, found.collect()))
    assert key(S.dense_top_k(asked, awkward, 7, block=3)) == key(S.dense_top_k(asked, corpus, 7))
    assert S.dense_top_k(asked.limit(0), corpus, 7).collect() == [] and S.dense_top_k(asked, corpus.limit(0), 7).collect() == []


def test_dense_search_in_blocks_takes_ids_of_parts(spark, data):
    """A struct's fields that cannot be null stay so in the groups' results."""
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    asked = rows.where("vec_id % 50 = 0").select(F.struct("vec_id", F.lit(0).alias("variant")).alias("query_id"), F.col("embedding").alias("qvec"), F.when(F.col("vec_id") % 100 == 50, F.col("label")).alias("only"))
    corpus = rows.selectExpr("vec_id AS id", "embedding AS vec", "label")
    key = lambda found: sorted(map(tuple, found.select("query_id.*", "id", "score", "rank").collect()))
    assert key(S.dense_top_k(asked, corpus, 7, block=1)) == key(S.dense_top_k(asked, corpus, 7)) != []


def test_best_of_equal_scores_in_few_cells(spark, monkeypatch):
    rows = [(i, [1.0, float(i % 3)], i % 2) for i in range(40)]
    asked = spark.createDataFrame([(q, [1.0, float(q)], q if q < 2 else None) for q in range(4)], "query_id long, qvec array<double>, only int")
    corpus = spark.createDataFrame(rows, "id long, vec array<double>, label int").coalesce(1)
    key = lambda: sorted(map(tuple, S.dense_top_k(asked, corpus, 5, block=2).collect()))
    want = key()
    monkeypatch.setattr(S, "CELLS", 1)
    assert key() == want
    assert [r[1] for r in want if r[0] == 0] == [0, 6, 12, 18, 24] and [r[1] for r in want if r[0] == 3] == [2, 5, 8, 11, 14]


def test_word_search_in_blocks_equals_one(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id AS id", "text")
    corpus = docs.unionByName(spark.createDataFrame([(-1, None), (-2, " "), (None, "the of")], "id long, text string"))
    items = spark.read.parquet(f"{data}/benchmark.parquet").select(F.struct("item_id", F.lit(1).alias("part")).alias("query_id"), "text")
    asked = items.unionByName(spark.createDataFrame([((-1, 1), "nothingsuch"), ((-2, 1), None)], items.schema))
    key = lambda found: sorted((*r.query_id, r.id, round(r.score, 6)) for r in found.where("id is not null").collect())
    assert key(S.bm25_top_k(asked, corpus, 7, block=2)) == key(S.bm25_top_k(asked, corpus, 7))
    scores = key(S.bm25_scores(asked, corpus))
    assert key(S.bm25_scores(asked, corpus, block=2)) == scores and len(scores) > 1000


def test_word_search_in_many_small_groups_equals_one(spark, data, monkeypatch):
    """Several blocks and shards, and a shard's rows in several steps; each row's words travel once."""
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id AS id", "text")
    corpus = docs.unionByName(spark.createDataFrame([(-1, None), (-2, " "), (-3, "the of the The"), (-4, "the of the The")], docs.schema))
    asked = spark.read.parquet(f"{data}/benchmark.parquet").selectExpr("item_id AS query_id", "text").unionByName(spark.createDataFrame([(-1, "nothingsuch"), (-2, None), (-3, "the the of")], "query_id long, text string"))
    key = lambda found: sorted((r.query_id, r.id, round(r.score, 6)) for r in found.collect())
    want, scores = key(S.bm25_top_k(asked, corpus, 7)), key(S.bm25_scores(asked, corpus))
    for name, value in (("WORD_BLOCK", 5), ("WORD_SHARD", 80), ("WORD_ROWS", 9), ("CELLS", 50)):
        monkeypatch.setattr(S, name, value)
    assert S._grid(spark, 12, 200, 5, 80) == (3, 3) and S._grid(spark, 0, 0, 5, 80) == (1, spark.sparkContext.defaultParallelism)
    assert key(S.bm25_top_k(asked, corpus, 7, block=2)) == want
    assert key(S.bm25_scores(asked, corpus, block=2)) == scores


def test_dense_search_in_many_small_groups_equals_one(spark, data, monkeypatch):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    asked, corpus = rows.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS qvec"), rows.selectExpr("vec_id AS id", "embedding AS vec")
    key = lambda found: sorted(map(tuple, found.collect()))
    want = key(S.dense_top_k(asked, corpus, 7))
    monkeypatch.setattr(S, "BLOCK", 4)
    monkeypatch.setattr(S, "SHARD", 150)
    assert key(S.dense_top_k(asked, corpus, 7, block=3)) == want


def test_first_of_each_row_equals_sorting():
    rng = np.random.default_rng(3)
    for n in (1, 7, 63, 64, 65, 500, 3000):
        for score in (rng.integers(0, 9, (5, n)) / 7 - 0.5, rng.random((5, n)), np.zeros((2, n)), np.round(rng.random((5, n)), 5) + rng.integers(-4, 5, (5, n)) * 1e-7):
            at, place, found = S._first(score, 7)
            want = [(i, j, v) for i, row in enumerate(np.round(score, 6)) for v, j in sorted((-v, j) for j, v in enumerate(row))[:7]]
            assert [(i, j, -v) for i, j, v in zip(at.tolist(), place.tolist(), found.tolist(), strict=True)] == want


def test_word_search_shuffles_no_pairs(spark, data):
    """Only each query's best are shuffled, not what it shares a word with."""
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id AS id", "text")
    asked = spark.read.parquet(f"{data}/benchmark.parquet").selectExpr("item_id AS query_id", "text")
    plan = S.bm25_scores(asked, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query_id" not in plan.split("MapInArrow")[0]


def test_several_downloads_of_one_url(spark):
    from docloom.operators import ingestion as I

    rows = [("u", r, a, s, b"%PDF-" + bytes([64 + r]), 6) for r, ss in ((1, (None, None, None)), (2, (200, 200, 200)), (3, (None, 404, 200))) for a, s in enumerate(ss, 1)]
    frame = spark.createDataFrame([*rows, ("v", 4, 1, 200, b"%PDF", 5)], "url string, request long, attempt int, status int, content binary, declared int")
    got = sorted(((r.url, r.attempts, r.error or "", r.warning or "", r.content_hash is not None) for r in I.fetched(frame).collect()))
    assert got == [
        ("u", 1, "", "", True), ("u", 1, "timeout", "", False), ("u", 1, "timeout", "", False),
        ("u", 2, "", "", True), ("u", 2, "not found", "", False), ("u", 2, "timeout", "", False),
        ("u", 3, "timeout", "", False), ("v", 1, "", "length differs", True),
    ]
    one = I.fetched(frame.drop("request").where("url = 'v'")).collect()
    assert [(r.url, r.attempts, r.error, r.warning) for r in one] == [("v", 1, None, "length differs")]


def test_expansion_keeps_the_best_child(spark):
    hits = spark.createDataFrame([(1, "c1", "p1", "child", 0.9), (1, "c2", "p1", "other", 0.5), (1, "c3", "p9", "lost", 0.4), (1, "c4", None, "alone", 0.3)], "query_id int, id string, parent_id string, text string, score double")
    parents = spark.createDataFrame([("p1", "parent text")], "id string, text string")
    got = {(r.id, r.text, r.score, r.kind) for r in S.expand_parents(hits, parents).collect()}
    assert got == {("p1", "parent text", 0.9, "parent"), ("c3", "lost", 0.4, "fallback"), ("c4", "alone", 0.3, "standalone")}


def test_fusion_ignores_the_order_of_lists(spark):
    rows = [(1, a, i, r) for a in (0, 1) for r, i in enumerate(("x", "y", "z") if a else ("z", "x", "w"), 1)]
    frame = spark.createDataFrame(rows, "query_id int, list_id int, id string, rank int")
    swapped = frame.withColumn("list_id", 1 - F.col("list_id"))
    key = lambda f: sorted(map(tuple, S.reciprocal_rank_fusion(f, 60).collect()))
    assert key(frame) == key(swapped)


def test_settings():
    with pytest.raises(ValueError):
        Settings(confidence_min=1.5)
    assert lookup({"a": {"b": 3}}, "a.b") == 3 and lookup({"a": 1}, "a.b", 7) == 7


def test_near_copies_are_apart_and_removal_is_idempotent(spark, data):
    from docloom.functions.text import cosine
    from docloom.plans import search

    rows = catalog.queries()["CMP1"](spark, data).join(search.corpus_dense(spark, data).select("id", "vec"), "id")
    left, right = rows.alias("l"), rows.alias("r")
    close = left.join(right, (F.col("l.query_id") == F.col("r.query_id")) & (F.col("l.id") < F.col("r.id"))).where(cosine(F.col("l.vec"), F.col("r.vec")) >= search.NEAR)
    assert close.count() == 0
    assert S.near_distinct(rows, search.NEAR).count() == rows.count()
