"""Queries on retrieval: dense, sparse, fusion, deduplication, expansion, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.text import norm, sigmoid, words
from ..operators import chunking as C
from ..operators import retrieval as S
from ..operators import search_run as R
from .base import query, table
from .chunks import _PARENTS

K = DEFAULTS.dense_k
_QUERIES = "SELECT vec_id AS query_id, embedding AS qvec FROM embeddings WHERE vec_id % 50 = 0"
_DENSE = f"SELECT query_id, id, score, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS integer) AS rank FROM (SELECT q.query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.qvec::DOUBLE[]), 6) AS score FROM embeddings e, ({_QUERIES}) q)"


def queries_dense(spark, d):
    """The stated query set: every vector whose id is divisible by 50, against all vectors."""
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


def corpus_dense(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def dense(spark, d, k=K):
    return S.dense_top_k(queries_dense(spark, d), corpus_dense(spark, d), k)


@query("TOP1", f"SELECT * FROM ({_DENSE}) WHERE rank <= {K}")
def top1(spark, d):
    return dense(spark, d)


@query("FLT1", f"SELECT query_id, id, score, rank FROM ({_DENSE.replace('FROM embeddings e', 'FROM (SELECT * FROM embeddings WHERE label = 3) e')}) WHERE rank <= {K}")
def flt1(spark, d):
    return S.dense_top_k(queries_dense(spark, d), corpus_dense(spark, d).where("label = 3"), K)


@query("FN9", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def fn9(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 5).alias("norm"))


_BM25 = f"""WITH tok AS (SELECT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS word FROM documents),
tf AS (SELECT id, word, count(*) AS tf FROM tok GROUP BY id, word),
len AS (SELECT doc_id AS id, len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS dl FROM documents),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
raw AS (SELECT word, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, stats GROUP BY word, n),
idf AS (SELECT word, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT item_id AS query_id, word, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS word FROM benchmark) GROUP BY 1, 2),
hit AS (SELECT query_id, tf.id, round(sum(qtf * idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN idf USING (word) JOIN tf USING (word) JOIN len ON len.id = tf.id, stats GROUP BY query_id, tf.id),
full_rows AS (SELECT b.item_id AS query_id, d.doc_id AS id, coalesce(h.score, 0.0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN hit h ON h.query_id = b.item_id AND h.id = d.doc_id),
sparse AS (SELECT * FROM (SELECT query_id, id, score, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS integer) AS rank FROM full_rows) WHERE rank <= {DEFAULTS.sparse_k})
"""


def sparse(spark, d, k=DEFAULTS.sparse_k):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return S.bm25_top_k(asked, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), k)


@query("TOP2", _BM25 + "SELECT query_id, id, score, rank FROM sparse")
def top2(spark, d):
    return sparse(spark, d)


@query("JN9", _BM25 + "SELECT query_id, count(*) AS n, round(sum(score), 3) AS total FROM hit GROUP BY query_id")
def jn9(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    scored = S.bm25_scores(asked, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    # Whole millionths add up to the same total in any order; a sum of doubles does not, and rounds either way.
    millionths = F.sum(F.round(F.round("score", 6) * 1e6).cast("long"))
    return scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(millionths / 1e6, 3).alias("total"))


@query("HLP27", "SELECT doc_id, cast(len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS integer) AS n_words FROM documents")
def hlp27(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(words(F.col("text"))).alias("n_words"))


#: Two ranked lists of one query: by cosine with the query and with its variant, the vector read backwards.
_SECOND = _DENSE.replace(_QUERIES, "SELECT vec_id AS query_id, list_reverse(embedding) AS qvec FROM embeddings WHERE vec_id % 50 = 0")
_LISTS = f"SELECT query_id, 0 AS list_id, id, score, rank FROM ({_DENSE}) WHERE rank <= {K} UNION ALL SELECT query_id, 1, id, score, rank FROM ({_SECOND}) WHERE rank <= {K}"


def lists(spark, d):
    second = S.dense_top_k(queries_dense(spark, d).withColumn("qvec", F.reverse("qvec")), corpus_dense(spark, d), K)
    return dense(spark, d).withColumn("list_id", F.lit(0)).unionByName(second.withColumn("list_id", F.lit(1)))


@query("WIN1", f"SELECT query_id, id, rank FROM ({_DENSE}) WHERE rank <= {K}")
def win1(spark, d):
    return dense(spark, d).select("query_id", "id", "rank")


@query("AGG2", f"SELECT query_id, id, round(sum(1.0 / ({DEFAULTS.rrf_k} + rank)), 8) AS score FROM ({_LISTS}) GROUP BY query_id, id")
def agg2(spark, d):
    return S.reciprocal_rank_fusion(lists(spark, d), DEFAULTS.rrf_k).withColumn("score", F.round("score", 8))


_FUSED = f"SELECT query_id, id, round(sum(1.0 / ({DEFAULTS.rrf_k} + rank)), 8) AS score FROM ({_LISTS}) GROUP BY query_id, id"


@query("TOP3", f"SELECT * FROM (SELECT query_id, id, score, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS integer) AS rank FROM ({_FUSED})) WHERE rank <= {DEFAULTS.final_k}")
def top3(spark, d):
    return S.top(agg2(spark, d), ["query_id"], [F.desc("score"), F.asc("id")], DEFAULTS.final_k)


_BEST = f"SELECT query_id, id, max(score) AS score FROM ({_LISTS}) GROUP BY query_id, id"


@query("AGG3", _BEST)
def agg3(spark, d):
    return S.best_score(lists(spark, d))


@query("SRT1", f"SELECT query_id, id, score, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS integer) AS rank FROM ({_BEST})")
def srt1(spark, d):
    return S.top(agg3(spark, d), ["query_id"], [F.desc("score"), F.asc("id")], 2 * K)


@query("AGG4", f"SELECT query_id, round(avg(score), 6) AS mean_score, arg_min(score, rank) AS top_score FROM ({_DENSE}) WHERE rank <= {K} GROUP BY query_id")
def agg4(spark, d):
    return dense(spark, d).groupBy("query_id").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.min_by("score", "rank").alias("top_score"))


@query("TOP6", f"SELECT query_id, id, rank FROM ({_DENSE}) WHERE rank <= {DEFAULTS.rerank_k}")
def top6(spark, d):
    return dense(spark, d, DEFAULTS.rerank_k).select("query_id", "id", "rank")


_WORDS = "list_distinct(list_filter(string_split_regex(lower(coalesce({}, '')), '\\s+'), lambda w: w <> ''))"
_OVERLAP = f"round(len(list_intersect({_WORDS.format('dq.text')}, {_WORDS.format('dc.text')})) / greatest(len({_WORDS.format('dq.text')}), 1), 6)"
_RERANKED = f"SELECT h.query_id, h.id, {_OVERLAP} AS score FROM (SELECT * FROM ({_DENSE}) WHERE rank <= {K}) h JOIN documents dq ON dq.doc_id = h.query_id JOIN documents dc ON dc.doc_id = h.id"


def texts(spark, d, key, name):
    return table(spark, d, "documents").select(F.col("doc_id").alias(key), F.col("text").alias(name))


@query("TOP4", f"SELECT * FROM (SELECT query_id, id, score, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS integer) AS rank FROM ({_RERANKED})) WHERE rank <= {DEFAULTS.rerank_k}")
def top4(spark, d):
    """Dense hits reranked by a scorer that reads query and text, so that the order is not that of the cosine."""
    read = dense(spark, d).drop("rank").join(texts(spark, d, "query_id", "query_text"), "query_id").join(texts(spark, d, "id", "text"), "id")
    return S.rerank(read, S.word_overlap(F.col("query_text"), F.col("text")), DEFAULTS.rerank_k).select("query_id", "id", "score", "rank")


@query("FN10", "SELECT vec_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS s, round(least(greatest(embedding[2]::DOUBLE, 0), 1), 6) AS c FROM embeddings")
def fn10(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(sigmoid(e[0].cast("double")), 6).alias("s"), F.round(F.least(F.greatest(e[1].cast("double"), F.lit(0.0)), F.lit(1.0)), 6).alias("c"))


_EIGHT = f"SELECT d.query_id, d.id, d.score, d.rank, e.embedding::DOUBLE[] AS vec FROM ({_DENSE}) d JOIN embeddings e ON e.vec_id = d.id WHERE d.rank <= {DEFAULTS.rerank_k}"
#: A low threshold, so that the rule has something to remove in these vectors.
NEAR = 0.6


@query("CMP1", f"""WITH RECURSIVE c AS ({_EIGHT}), keep AS (
  SELECT query_id, 1 AS rank, [1] AS kept FROM c WHERE rank = 1
  UNION ALL
  SELECT k.query_id, c.rank, CASE WHEN (SELECT bool_or(list_cosine_similarity(o.vec, c.vec) >= {NEAR}) FROM c o WHERE o.query_id = c.query_id AND list_contains(k.kept, o.rank)) THEN k.kept ELSE list_append(k.kept, c.rank) END
  FROM keep k JOIN c ON c.query_id = k.query_id AND c.rank = k.rank + 1)
SELECT c.query_id, c.id, c.score, c.rank FROM c JOIN (SELECT query_id, arg_max(kept, rank) AS kept FROM keep GROUP BY query_id) k ON k.query_id = c.query_id AND list_contains(k.kept, c.rank)""")
def cmp1(spark, d):
    ranked = dense(spark, d, DEFAULTS.rerank_k).join(corpus_dense(spark, d).select("id", "vec"), "id")
    return S.near_distinct(ranked, NEAR)


#: Children are lines of documents that a query hits; parents of French documents are missing, Spanish lines stand alone.
_HITS = _PARENTS + """, child AS (
  SELECT p.doc_id, p.grp, u.ord, u.text, d.lang, round(1.0 / (1 + length(u.text)), 6) AS score FROM p JOIN u USING (doc_id, ord) JOIN documents d USING (doc_id)),
best AS (SELECT doc_id, grp, lang, max(score) AS score, arg_min(text, (-score, ord)) AS text, arg_min(ord, (-score, ord)) AS ord FROM child WHERE lang <> 'es' GROUP BY doc_id, grp, lang)
"""


@query("JN5", _HITS + """SELECT doc_id || '-c' || ord AS id, md5(text) AS digest, score, 'standalone' AS kind FROM child WHERE lang = 'es'
UNION ALL SELECT CASE WHEN b.lang = 'fr' THEN b.doc_id || '-c' || b.ord ELSE b.doc_id || '-p' || b.grp END, md5(CASE WHEN b.lang = 'fr' THEN b.text ELSE r.text END), b.score, CASE WHEN b.lang = 'fr' THEN 'fallback' ELSE 'parent' END
FROM best b JOIN parents r ON r.doc_id = b.doc_id AND r.chunk_no = b.grp""")
def jn5(spark, d):
    docs = table(spark, d, "documents")
    lang = docs.select("doc_id", "lang")
    doc = F.col("doc_id").cast("string")
    grouped = F.flatten(F.transform("groups", lambda g, i: F.transform(g, lambda t: F.struct(t.alias("text"), i.alias("grp")))))
    line = C.parent_lines(docs).select("doc_id", F.posexplode(grouped).alias("at", "x")).join(lang, "doc_id")
    hits = line.select(F.lit(0).alias("query_id"), F.concat(doc, F.lit("-c"), (F.col("at") + 1).cast("string")).alias("id"), F.when(F.col("lang") != "es", F.concat(doc, F.lit("-p"), F.col("x.grp").cast("string"))).alias("parent_id"), F.col("x.text").alias("text"), F.round(1.0 / (1 + F.length("x.text")), 6).alias("score"), F.col("at"))
    held = C.parents(docs).join(lang, "doc_id").where("lang not in ('fr', 'es')").select(F.concat(doc, F.lit("-p"), F.col("chunk_no").cast("string")).alias("id"), "text")
    # Ties go to the earlier line: for the expansion, ids start with the line's place.
    placed = hits.withColumn("id", F.concat(F.lpad(F.col("at").cast("string"), 9, "0"), F.lit("|"), "id")).drop("at")
    grown = S.expand_parents(placed, held)
    return grown.select(F.regexp_replace("id", r"^\d{9}\|", "").alias("id"), F.md5("text").alias("digest"), "score", "kind")


@query("JN6", _PARENTS + "SELECT doc_id, chunk_no, md5(text) AS digest FROM parents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jn6(spark, d):
    wanted = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return C.parents(table(spark, d, "documents")).join(wanted, "doc_id", "left_semi").select("doc_id", "chunk_no", F.md5("text").alias("digest"))


_HITTEXT = _BM25 + ", top3 AS (SELECT s.query_id, s.rank, s.score, d.source, d.lang, d.text FROM sparse s JOIN documents d ON d.doc_id = s.id WHERE rank <= 3)\n"
_CONTEXT = "string_agg('[' || rank || '] Source: ' || source || ' | Section: ' || lang || ' | Page: 0 | Category: ' || lang || ' | Score: ' || printf('%.3f', round_even(score, 3)) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)"


def context_rows(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang", "text")
    return sparse(spark, d, 3).join(docs, "id")


def context(rows):
    """Numbered context blocks of each query's chunks in rank order."""
    header = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Source: "), "source", F.lit(" | Section: "), "lang", F.lit(" | Page: 0 | Category: "), "lang", F.lit(" | Score: "), F.format_string("%.3f", F.bround("score", 3)), F.lit("\n"), "text")
    got = rows.withColumn("block", header).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return got.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n").alias("context"))


@query("PRJ1", _HITTEXT + f"SELECT query_id, md5({_CONTEXT}) AS digest FROM top3 GROUP BY query_id")
def prj1(spark, d):
    return context(context_rows(spark, d)).select("query_id", F.md5("context").alias("digest"))


@query("PRJ2", _HITTEXT + "SELECT query_id, count(*) AS n FROM top3 GROUP BY query_id")
def prj2(spark, d):
    return context_rows(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


#: Every second query is filtered by its label, one by a label that nothing has; the reranker fails for some.
_ONLY = "CASE WHEN vec_id % 450 = 0 AND vec_id > 0 THEN -1 WHEN vec_id % 100 = 50 THEN label END"
_RUN = f"""WITH RECURSIVE q AS (SELECT vec_id AS query_id, {_ONLY} AS wanted, unnest([embedding, list_reverse(embedding)])::DOUBLE[] AS qvec, unnest([0, 1]) AS variant FROM embeddings WHERE vec_id % 50 = 0),
hit AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, id) AS rank FROM (SELECT query_id, variant, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], qvec), 6) AS score FROM embeddings e, q WHERE wanted IS NULL OR wanted = e.label)),
cand AS (SELECT query_id, id, max(score) AS score FROM hit WHERE rank <= {DEFAULTS.final_k} GROUP BY query_id, id),
scored AS (SELECT h.query_id, h.id, CASE WHEN h.query_id % 350 = 0 THEN h.score ELSE {_OVERLAP} END AS score FROM cand h LEFT JOIN documents dq ON dq.doc_id = h.query_id LEFT JOIN documents dc ON dc.doc_id = h.id),
c AS (SELECT s.*, e.embedding::DOUBLE[] AS vec FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) s JOIN embeddings e ON e.vec_id = s.id WHERE rank <= {DEFAULTS.rerank_k}),
keep AS (
  SELECT query_id, 1 AS rank, [1] AS kept FROM c WHERE rank = 1
  UNION ALL
  SELECT k.query_id, c.rank, CASE WHEN (SELECT bool_or(list_cosine_similarity(o.vec, c.vec) >= {NEAR}) FROM c o WHERE o.query_id = c.query_id AND list_contains(k.kept, o.rank)) THEN k.kept ELSE list_append(k.kept, c.rank) END
  FROM keep k JOIN c ON c.query_id = k.query_id AND c.rank = k.rank + 1),
comp AS (SELECT c.* FROM c JOIN (SELECT query_id, arg_max(kept, rank) AS kept FROM keep GROUP BY query_id) k ON k.query_id = c.query_id AND list_contains(k.kept, c.rank)),
chunk AS (SELECT query_id, CASE WHEN (id // 4) % 7 = 3 THEN 'c' || id ELSE 'p' || (id // 4) END AS id, score, CASE WHEN (id // 4) % 7 = 3 THEN 'fallback' ELSE 'parent' END AS kind
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id // 4 ORDER BY score DESC, cast(id AS varchar)) AS n FROM comp) WHERE n = 1)
"""


def retrieval(spark, d):
    only = F.when((F.col("vec_id") % 450 == 0) & (F.col("vec_id") > 0), -1).when(F.col("vec_id") % 100 == 50, F.col("label"))
    base = table(spark, d, "embeddings").where("vec_id % 50 = 0")
    two = F.posexplode(F.array("embedding", F.reverse("embedding"))).alias("variant", "qvec")
    asked = base.select(F.col("vec_id").alias("query_id"), only.alias("only"), two).join(texts(spark, d, "query_id", "text"), "query_id", "left")
    asked = asked.withColumn("rerank_works", F.col("query_id") % 350 != 0)
    corpus = corpus_dense(spark, d).join(texts(spark, d, "id", "text"), "id", "left").withColumn("parent_id", F.floor(F.col("id") / 4))
    held = corpus.where("parent_id % 7 <> 3").groupBy("parent_id").agg(F.coalesce(F.min_by("text", "id"), F.lit("")).alias("text")).select(F.col("parent_id").cast("string").alias("id"), "text")
    return R.retrieve(asked, corpus, held, near=NEAR)


@query("ORC1", _RUN + """SELECT q.query_id, CASE WHEN expanded > 0 THEN 'answered' ELSE 'insufficient' END AS outcome, coalesce(candidates, 0) AS candidates, coalesce(reranked, 0) AS reranked, coalesce(compressed, 0) AS compressed, coalesce(expanded, 0) AS expanded, top_score
FROM (SELECT DISTINCT query_id FROM q) q LEFT JOIN (SELECT query_id, count(*) AS candidates FROM cand GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS reranked FROM c GROUP BY 1) USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS compressed FROM comp GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS expanded, max(score) AS top_score FROM chunk GROUP BY 1) USING (query_id)""")
def orc1(spark, d):
    """Rows that each stage of the retrieval run leaves, and whether there is evidence at all."""
    return retrieval(spark, d)[1]


@query("ORC1_CHUNKS", _RUN + "SELECT query_id, id, score, kind FROM chunk")
def orc1_chunks(spark, d):
    """The chunks that a retrieval run returns."""
    mark = F.when(F.col("kind") == "parent", "p").otherwise("c")
    return retrieval(spark, d)[0].select("query_id", F.concat(mark, "id").alias("id"), "score", "kind")


@query("TOP5", f"SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS integer) AS rank FROM ({_DENSE}) x JOIN embeddings e ON e.vec_id = x.id JOIN embeddings q ON q.vec_id = x.query_id WHERE e.label = q.label) WHERE rank <= {DEFAULTS.memory_top_k}")
def top5(spark, d):
    """Memories of the asking user only: the label stands for the user."""
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0 and label is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), F.col("label").alias("only"))
    return S.dense_top_k(asked, corpus_dense(spark, d), DEFAULTS.memory_top_k)


@query("FLT5", "SELECT label, count(*) AS n FROM embeddings WHERE label = 4 GROUP BY label")
def flt5(spark, d):
    return table(spark, d, "embeddings").where("label = 4").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("AGG1", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def agg1(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
