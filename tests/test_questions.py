"""Questions: rewriting with history, parts, variants, and the whole run in plain loops."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.operators import models as M
from docloom.operators import questions as Q

TURNS = "conv_id long, turn long, role string, text string"


def rewritten(spark, rows, **options):
    found = Q.asked(spark.createDataFrame(rows, TURNS))
    return {(r.conv_id, r.turn): r.x for r in found.select("conv_id", "turn", Q.standalone(F.col("text"), F.col("history"), **options).alias("x")).collect()}


def test_a_question_that_refers_back_gets_the_products_named_last(spark):
    rows = [
        (1, 0, "user", "Is it safe?"), (1, 1, "assistant", "A Gold Loan and UPI are."), (1, 2, "user", "  "), (1, 3, "user", "What does it cost?"), (1, 4, "user", "What does it cost for a car loan?"), (1, 5, "user", "And the limit"),
        (2, 0, "user", "gold loan"), *[(2, n, "assistant", "well") for n in range(1, 11)], (2, 11, "user", "how about that"), (3, 0, "system", "debit card"), (3, 1, "user", None), (3, 2, "user", '"tell me of these"'),
    ]
    got = rewritten(spark, rows)
    assert got == {
        (1, 0): "Is it safe?", (1, 3): "What does it cost? (gold loan, upi)", (1, 4): "What does it cost for a car loan?", (1, 5): "And the limit",
        (2, 0): "gold loan", (2, 11): "how about that", (3, 2): 'tell me of these" (debit card)',
    }
    assert set(rewritten(spark, rows, works=F.lit(False)).items()) == {((c, t), x) for c, t, role, x in rows if role == "user" and x and x.strip()}


def test_a_model_that_writes_nothing_of_use_leaves_the_question(spark):
    rows = [(1, 0, "assistant", "hello"), (1, 1, "user", "what now")]
    for output, want in (("abc", "what now"), (None, "what now"), ('"Rewritten query: what to do now"', "what to do now")):
        assert rewritten(spark, rows, generate=lambda q, h, o=output: F.lit(o).cast("string")) == {(1, 1): want}


def test_searches_of_a_compound_question(spark):
    asks = "the home loan  interest rate? and also how do I lodge a complaint?"
    rows = spark.createDataFrame([(1, asks), (2, "x")], "query_id long, rewritten string")
    got = sorted((r.query_id, r.part, r.variant, r.text, r.only) for r in Q.searches(rows).collect())
    assert got == [
        (1, 0, 0, "the home loan  interest rate?", "interest_rates"), (1, 0, 1, "the housing loan rate of interest?", "interest_rates"), (1, 0, 2, "home loan interest rate?", "interest_rates"),
        (1, 1, 0, "how do I lodge a complaint?", "grievance"), (1, 1, 1, "how do I lodge a grievance?", "grievance"), (1, 1, 2, "lodge complaint?", "grievance"),
        (2, 0, 0, "x", None),
    ]
    assert [r.text for r in Q.searches(rows.where("query_id = 2"), lambda q: F.lit(None).cast("string")).collect()] == ["x"]
    assert Q.searches(rows.limit(0)).count() == 0


def by_hand(questions, corpus, parents, wanted, vectors, s, near):
    """(chunks, counts) of the run in loops."""
    words = lambda t: t.lower().split()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (math.hypot(*a) * math.hypot(*b))
    tf, n = {c["id"]: Counter(words(c["text"])) for c in corpus}, len(corpus)
    mean = sum(sum(t.values()) for t in tf.values()) / n
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in Counter(w for t in tf.values() for w in t).items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else floor for w, v in raw.items()}
    best = lambda scores, k: sorted(scores, key=lambda x: (-x[0], x[1]))[:k]
    chunks, counts = [], []
    for q in questions:
        found = {}
        own = [w for w in wanted if w["query_id"] == q["query_id"]]
        for w in own:
            fits = [c for c in corpus if any(c["vec"]) and any(vectors[w["text"]]) and w["only"] in (None, c["label"])]
            dense = best([(round(cos(vectors[w["text"]], c["vec"]), 6), c["id"]) for c in fits], s.dense_k)
            score = lambda t, asks: round(sum(k * idf[x] * t[x] * 2.5 / (t[x] + 1.5 * (0.25 + 0.75 * sum(t.values()) / mean)) for x, k in Counter(words(asks)).items() if x in t), 6)
            sparse = best([(score(t, w["text"]), i) for i, t in tf.items()], s.sparse_k)
            fused = Counter()
            for ranked in (dense, sparse):
                for rank, (_, i) in enumerate(ranked, 1):
                    fused[i] += 1 / (s.rrf_k + rank)
            for value, i in best([(round(v, 8), i) for i, v in fused.items()], s.final_k):
                found[i] = max(found.get(i, 0), value)
        asks, by_id = set(words(q["rewritten"])), {c["id"]: c for c in corpus}
        scored = [(round(len(asks & set(tf[i])) / max(1, len(asks)), 6) if q["rerank_works"] else v, i) for i, v in found.items()]
        kept = []
        for value, i in best(scored, s.rerank_k):
            if not any(any(by_id[k]["vec"]) and any(by_id[i]["vec"]) and cos(by_id[k]["vec"], by_id[i]["vec"]) >= near for _, k in kept):
                kept.append((value, i))
        grown = {}
        for value, i in kept:
            p = by_id[i]["parent_id"]
            grown.setdefault(p, (value, str(p) if p in parents else str(i), "parent" if p in parents else "fallback"))
        chunks += [(q["query_id"], i, round(v, 6), kind) for v, i, kind in grown.values()]
        counts.append((q["query_id"], "answered" if grown else "insufficient", len(found), min(len(found), s.rerank_k), len(kept), len(grown), len(own)))
    return sorted(chunks), sorted(counts)


def test_the_run_equals_loops(spark, data, tmp_path):
    s, near = Settings(dense_k=6, sparse_k=5, final_k=4, rerank_k=6), 0.9
    said = [(1, "what of that home loan interest rate and also how to lodge a complaint", True), (2, "the and of whtion in thor", True), (3, "net banking of the thatly", False), (4, "zzzzzz", True)]
    questions = spark.createDataFrame(said, "query_id long, rewritten string, rerank_works boolean")
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 900").select(F.col("doc_id").alias("id"), "text")
    label = F.element_at(F.array(F.lit("grievance"), F.lit("interest_rates"), F.lit("digital")), (F.col("id") % 3 + 1).cast("int"))
    corpus = M.embed_cached(docs, str(tmp_path / "vectors"), 0).select("id", "vec", label.alias("label"), "text", F.floor(F.col("id") / 4).alias("parent_id"))
    parents = docs.where("floor(id / 4) % 7 <> 3").select(F.floor(F.col("id") / 4).cast("string").alias("id"), "text").dropDuplicates(["id"])
    chunks, counts = Q.answer_rows(questions, corpus, parents, M.embed, str(tmp_path), near=near, s=s)
    wanted = [r.asDict() for r in Q.searches(questions, s=s).collect()]
    assert {w["only"] for w in wanted} == {None, "interest_rates", "grievance", "digital"} and max(w["variant"] for w in wanted) == 2
    vectors = {r.text: r.vec for r in M.embed(spark.createDataFrame([(w["text"],) for w in wanted], "text string")).collect()}
    want = by_hand([dict(zip(("query_id", "rewritten", "rerank_works"), q, strict=True)) for q in said], [r.asDict() for r in corpus.collect()], {int(r.id) for r in parents.collect()}, wanted, vectors, s, near)
    assert sorted((r.query_id, r.id, round(r.score, 6), r.kind) for r in chunks.collect()) == want[0]
    names = ("query_id", "outcome", "candidates", "reranked", "compressed", "expanded", "searches")
    assert sorted(tuple(r[n] for n in names) for r in counts.collect()) == want[1]


def test_searches_in_rounds_equal_one(spark, data, tmp_path, monkeypatch):
    """Each round's lists are tables; the counts score each candidate once and move no text behind the scorer."""
    said = [(q, text, q != 3) for q, text in enumerate(("what of that home loan interest rate and also how to lodge a complaint", "the and of whtion in thor", "net banking of the thatly", "zzzzzz"))]
    questions = spark.createDataFrame([*said, (9, None, True)], "query_id long, rewritten string, rerank_works boolean")
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 900").select(F.col("doc_id").alias("id"), "text")
    vectors = M.embed_rows(docs).groupBy("id").agg(F.min("vec").alias("vec"))
    corpus = docs.join(vectors, "id", "left").select("id", "vec", F.lit("grievance").alias("label"), "text", F.floor(F.col("id") / 4).alias("parent_id"))
    parents = docs.where("floor(id / 4) % 7 <> 3").select(F.floor(F.col("id") / 4).cast("string").alias("id"), "text").dropDuplicates(["id"])
    run = lambda folder: Q.answer_rows(questions, corpus, parents, M.embed, str(tmp_path / folder))
    key = lambda found: sorted(tuple(r) for r in found.collect())
    chunks, counts = run("one")
    want = key(chunks), key(counts)
    monkeypatch.setattr(Q, "ROUND", 3)
    assert tuple(map(key, run("rounds"))) == want and len(want[1]) == 5
    assert {p.name for p in (tmp_path / "rounds").iterdir()} > {"dense-0", "sparse-0", "dense-1", "sparse-1", "found"}
    grown = {r.query_id: (r.n, r.top) for r in chunks.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top")).collect()}
    assert {r.query_id: (r.expanded, r.top_score) for r in counts.collect()} == grown
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1 and not [x for x in plan.splitlines() if "collect_list" in x and "text" in x]


def test_patterns_have_no_special_signs():
    assert all(re.fullmatch("[a-z ]+", x) for pair in Q.RESTATED for x in pair)
