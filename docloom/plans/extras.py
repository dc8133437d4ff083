"""Queries on model stand-ins, strategies in common schemas, and JSON lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import fresh_folder
from ..operators import chunking as C
from ..operators import models as M
from .answers import answers
from .base import query, table
from .chunks import _PARENTS, TOK


@query("SRC13", "SELECT event_id, event_type FROM events")
def src13(spark, d):
    """Rows encoded as JSON lines and read back with a schema."""
    lines = table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("line"))
    return lines.where("trim(line) <> ''").select(F.from_json("line", "event_id long, event_type string").alias("r")).select("r.*")


@query("HLP1", _PARENTS + "SELECT doc_id, 'parent' AS strategy, count(*) AS n FROM parents GROUP BY doc_id UNION ALL SELECT doc_id, 'line', count(*) FROM u GROUP BY doc_id")
def hlp1(spark, d):
    docs = table(spark, d, "documents")
    n = lambda rows, name: rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.lit(name).alias("strategy"), "n")
    return n(C.parents(docs), "parent").unionByName(n(C.paragraphs(docs), "line"))


@query("HLP2", _PARENTS + f"SELECT sha256(doc_id || ':parent:' || chunk_no) AS chunk_id, length(text) AS n_chars, {TOK.format('text')} AS token_count FROM parents")
def hlp2(spark, d):
    rows = C.parents(table(spark, d, "documents"))
    made = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("parent"), F.col("chunk_no").cast("string")), 256)
    return rows.select(made.alias("chunk_id"), F.length("text").cast("long").alias("n_chars"), "token_count")


_N_WORDS = "len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''))"


@query("MDL1", f"SELECT doc_id, md5(text) AS text_hash, 64 AS dimension, CASE WHEN {_N_WORDS} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm, CASE WHEN md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0) THEN 0 ELSE 1 END::BIGINT AS segment FROM documents")
def mdl1(spark, d):
    """Vectors of all documents by a cache that half of them filled before; a third run finds nothing to compute."""
    docs, folder = table(spark, d, "documents").select("doc_id", "text"), fresh_folder(spark, "vectors")
    M.embed_cached(docs.where("doc_id % 2 = 0"), folder, 0)
    M.embed_cached(docs, folder, 1)
    found = M.embed_cached(docs, folder, 2)
    return found.select("doc_id", "text_hash", F.size("vec").alias("dimension"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), "segment")


@query("MDL5")
def mdl5(spark, d):
    return answers(spark, d).select("answer_id", M.evidence(F.col("answer"), F.col("chunks")).alias("evidence"))
