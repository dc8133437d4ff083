"""Queries on parsing and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.text import estimate_tokens, sentences
from ..operators import chunking as C
from .base import query, table

TOK = "greatest(1, cast(floor(length({}) / 4) AS integer))"
#: Lines with their order; blank ones left out.
LINES = "SELECT doc_id, ord, text FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS ord FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents))"


@query("CHK1", f"SELECT doc_id, {TOK.format('text')} AS tokens FROM documents")
def chk1(spark, d):
    return table(spark, d, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query("CHK4", f"SELECT doc_id, cast(ord AS integer) AS ord, text FROM ({LINES})")
def chk4(spark, d):
    return C.paragraphs(table(spark, d, "documents"))


#: Greedy packing as a recursion over each document's lines: used tokens and group number.
_PARENTS = f"""WITH RECURSIVE u AS (SELECT doc_id, ord, text, {TOK.format('text')} AS t FROM ({LINES})),
p AS (
  SELECT doc_id, ord, t AS used, 0 AS grp FROM u WHERE ord = 1
  UNION ALL
  SELECT u.doc_id, u.ord, CASE WHEN p.used + u.t > {DEFAULTS.parent_max_tokens} THEN u.t ELSE p.used + u.t END, CASE WHEN p.used + u.t > {DEFAULTS.parent_max_tokens} THEN p.grp + 1 ELSE p.grp END
  FROM p JOIN u ON u.doc_id = p.doc_id AND u.ord = p.ord + 1
), parents AS (SELECT doc_id, grp AS chunk_no, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text FROM p JOIN u USING (doc_id, ord) GROUP BY doc_id, grp)
"""


@query("CHK5", _PARENTS + f"SELECT doc_id, chunk_no, text, {TOK.format('text')} AS token_count FROM parents")
def chk5(spark, d):
    return C.parents(table(spark, d, "documents"))


_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9"])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '')"""


@query("CHK6", f"SELECT doc_id, cast(len(s) AS integer) AS n_sentences, md5(array_to_string(s, chr(31))) AS digest FROM (SELECT doc_id, CASE WHEN len({_SENTENCES}) > 0 THEN {_SENTENCES} ELSE [text] END AS s FROM documents)")
def chk6(spark, d):
    s = sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.md5(F.array_join(s, "\x1f")).alias("digest"))


@query("CHK7", None)
def chk7(spark, d):
    return C.children(C.parents(table(spark, d, "documents"))).select("doc_id", "parent_no", "child_no", F.md5("text").alias("digest"), "token_count")


@query("CHK3", None)
def chk3(spark, d):
    return C.structure_chunks(table(spark, d, "documents")).select("doc_id", "chunk_no", F.md5("text").alias("digest"), "token_count")


def gated(spark, d):
    """Parents and lines as chunks with the metadata of the gate."""
    docs, meta = table(spark, d, "documents"), ("source", "lang")
    parents = C.parents(docs, keep=meta).select("doc_id", *meta, F.col("chunk_no").alias("ord"), "text", "token_count", F.lit(True).alias("is_parent"))
    lines = C.paragraphs(docs, keep=meta).select("doc_id", *meta, "ord", "text", estimate_tokens(F.col("text")).alias("token_count"), F.lit(False).alias("is_parent"))
    meta = {"doc_title": F.col("source"), "source_url": F.col("source"), "doc_category": F.when(F.col("lang") == "es", "").otherwise(F.col("lang")), "section_path": F.col("source"), "chunk_type": F.lit("text"), "page_number": F.lit(0)}
    return parents.unionByName(lines).withColumns(meta)


_GATED = _PARENTS + f""", gated AS (
  SELECT c.doc_id, c.ord, c.text, c.tok, c.is_parent, CASE WHEN NOT c.is_parent AND c.tok < {DEFAULTS.chunk_min_tokens} THEN 'short' WHEN d.lang = 'es' THEN 'missing:doc_category' END AS reason
  FROM (SELECT doc_id, chunk_no AS ord, text, {TOK.format('text')} AS tok, true AS is_parent FROM parents UNION ALL SELECT doc_id, ord, text, t, false FROM u) c JOIN documents d USING (doc_id))
"""


@query("CHK10", _GATED + "SELECT coalesce(reason, 'ok') AS reason, is_parent, count(*) AS n FROM gated GROUP BY 1, 2")
def chk10(spark, d):
    return gated(spark, d).select(F.coalesce(C.reject_reason(), F.lit("ok")).alias("reason"), "is_parent").groupBy("reason", "is_parent").agg(F.count(F.lit(1)).alias("n"))


@query("CHK11", _GATED + "SELECT doc_id, cast(min(ord) AS integer) AS ord, is_parent FROM gated WHERE reason IS NULL GROUP BY doc_id, is_parent, md5(doc_id || ':' || text)")
def chk11(spark, d):
    kept = gated(spark, d).where(C.reject_reason().isNull())
    return C.first_of_equal_texts(kept, ["ord"]).select("doc_id", F.col("ord").cast("int").alias("ord"), "is_parent")


@query("CHK13", _GATED + "SELECT CASE WHEN is_parent THEN 'parent' ELSE 'line' END AS kind, count(*) AS n FROM gated WHERE reason IS NULL GROUP BY 1")
def chk13(spark, d):
    return gated(spark, d).where(C.reject_reason().isNull()).groupBy(F.when(F.col("is_parent"), "parent").otherwise("line").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("CHK14", _GATED + "SELECT doc_id, cast(ord AS integer) AS ord, cast(is_parent AS integer) AS is_parent, tok AS token_count FROM gated")
def chk14(spark, d):
    return gated(spark, d).select("doc_id", F.col("ord").cast("int").alias("ord"), F.col("is_parent").cast("int").alias("is_parent"), "token_count")


@query("CHK12", _GATED + "SELECT doc_id, count(*) AS n FROM gated GROUP BY doc_id")
def chk12(spark, d):
    return gated(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SET1", _GATED + "SELECT is_parent, cast(sum(tok) AS bigint) AS tokens FROM gated GROUP BY is_parent")
def set1(spark, d):
    return gated(spark, d).groupBy("is_parent").agg(F.sum("token_count").alias("tokens"))


@query("FN8", "SELECT doc_id, md5(text) AS m, sha256(text) AS s, sha256(doc_id || ':' || lang || ':' || source) AS chunk_id FROM documents")
def fn8(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s"), C.chunk_id("doc_id", "lang", "source").alias("chunk_id"))


@query("AGG11", "SELECT round(avg(t), 6) AS mean, round(quantile_cont(t, 0.5), 6) AS median, round(quantile_cont(t, 0.9), 6) AS p90, round(quantile_cont(t, 0.95), 6) AS p95, round(quantile_cont(t, 0.99), 6) AS p99, max(t) AS top FROM (SELECT " + TOK.format("text") + " AS t FROM documents)")
def agg11(spark, d):
    t = table(spark, d, "documents").select(estimate_tokens(F.col("text")).alias("t"))
    # One state of distinct lengths for all four percentiles.
    got = t.agg(F.avg("t").alias("mean"), F.percentile("t", F.array(*[F.lit(q) for q in (0.5, 0.9, 0.95, 0.99)])).alias("p"), F.max("t").alias("top"))
    return got.select(F.round("mean", 6).alias("mean"), *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("median", "p90", "p95", "p99"))], "top")
