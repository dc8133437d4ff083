"""Queries that write: chunk collections, the word index, ingestion in batches. Each writes into a new shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as T
from ..functions.session import fresh_folder
from ..functions.words import TOPIC_KEYWORDS
from ..operators import chunking as C
from ..operators import collections as K
from ..operators import html as H
from ..operators.word_index import WordIndex
from ..sources import files
from ..streaming import intake
from ..streaming.memory import remembered
from .base import SQL, query, table
from .chunks import _GATED, _PARENTS, gated
from .dialogue import _KINDS, TEXT
from .layout import _BARE
from .search import _BM25


def _chunks(spark, d) -> DataFrame:
    """Chunks that pass the gate, with ids that follow from document, kind and place."""
    rows = gated(spark, d).where(C.reject_reason().isNull())
    made = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.when(F.col("is_parent"), "parent").otherwise("line"), F.col("ord").cast("string")), 256)
    return rows.select(made.alias("chunk_id"), "doc_id", "text", "token_count", "is_parent", "ord")


#: Of every third place the text is changed by a second upsert.
_STORED = f"(SELECT sha256(doc_id || CASE WHEN is_parent THEN ':parent:' ELSE ':line:' END || ord) AS chunk_id, doc_id, CASE WHEN ord % 3 = 0 THEN upper(md5(text)) ELSE text END AS text, is_parent FROM gated WHERE reason IS NULL)"


def _upserted(spark, d) -> str:
    folder = fresh_folder(spark, "collections")
    rows = _chunks(spark, d)
    K.upsert(rows, folder, 0)
    K.upsert(rows.where("ord % 3 = 0").withColumn("text", F.upper(F.md5("text"))), folder, 1)
    return folder


def _stored(spark, folder: str) -> DataFrame:
    rows = [K.read(spark, folder, name, F.md5("text")).select("chunk_id", "doc_id", F.col("text").alias("digest"), F.lit(name).alias("name")) for name in K.NAMES]
    return rows[0].unionByName(rows[1])


_NAME = "CASE WHEN is_parent THEN 'parents' ELSE 'main' END"


@query("SNK4", _GATED + f"SELECT chunk_id, doc_id::VARCHAR AS doc_id, md5(text) AS digest, {_NAME} AS name FROM {_STORED}")
def snk4(spark, d):
    """Chunks upserted into their collections, a third of them twice, read back."""
    return _stored(spark, _upserted(spark, d))


@query("SNK5", _GATED + f"SELECT chunk_id, doc_id::VARCHAR AS doc_id, md5(text) AS digest, {_NAME} AS name FROM {_STORED} WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr') AND chunk_id NOT LIKE 'a%'")
def snk5(spark, d):
    """The same after a deletion by document and one by chunk."""
    folder = _upserted(spark, d)
    K.delete(table(spark, d, "documents").where("lang = 'fr'").select("doc_id"), folder, 2, "doc_id")
    K.delete(_chunks(spark, d).where("chunk_id LIKE 'a%'").select("chunk_id"), folder, 3)
    return _stored(spark, folder)


@query("SNK6", _GATED + f"SELECT {_NAME} AS name, count(*) AS n, true AS healthy FROM gated WHERE reason IS NULL AND ord % 2 = 0 GROUP BY 1")
def snk6(spark, d):
    """Both collections reset and filled anew, counted, beside a row written and read back for their health."""
    folder = _upserted(spark, d)
    K.reset(spark, folder)
    K.upsert(_chunks(spark, d).where("ord % 2 = 0"), folder, 0)
    return K.counts(spark, folder).where("n > 0").withColumn("healthy", F.lit(files.healthy(spark, folder)))


#: What is left after all changes; bad ids were replaced, Spanish ones removed.
_KEPT = "(SELECT doc_id, text FROM documents WHERE lang IS DISTINCT FROM 'es')"


@query("STR9", _BM25.replace("FROM documents", f"FROM {_KEPT} documents").replace("JOIN documents d", f"JOIN {_KEPT} d") + "SELECT query_id, id, score, rank FROM sparse")
def str9(spark, d):
    """Search in an index that took in two thirds of the documents, some with another text, then the rest and the right texts, then lost some."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    index = WordIndex(spark, fresh_folder(spark, "index"), "long")
    index.change(docs.where("id % 3 <> 0").select("id", F.when(F.col("id") % 5 == 0, F.reverse("text")).otherwise(F.col("text")).alias("text")), 0)
    index.change(docs.where("id % 3 = 0 OR id % 5 = 0").select("id", "text"), 1)
    index.change(docs.where("lang = 'es'").select("id", F.lit(None).cast("string").alias("text")), 2)
    return index.search(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), DEFAULTS.sparse_k)


_COUNTED = f"""SELECT d.doc_id::VARCHAR AS doc_id, 1 AS version, CASE WHEN p.n IS NULL THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN p.n IS NULL THEN 1 ELSE 0 END AS retry_count, coalesce(p.n, 0)::INTEGER AS parents, coalesce(m.n, 0)::INTEGER AS main
FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT text) AS n FROM parents GROUP BY doc_id) p ON p.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(DISTINCT text) AS n FROM u WHERE t >= {DEFAULTS.chunk_min_tokens} GROUP BY doc_id) m ON m.doc_id = d.doc_id"""


@query("STR5", _PARENTS + _COUNTED)
def str5(spark, d):
    """The registry after three batches, the second of them taken in again after the third."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", F.lit(None).cast("string").alias("stamp"))
    folder = fresh_folder(spark, "intake")
    for k in (0, 1, 2, 1):
        intake.take_in(docs.where(f"doc_id % 3 = {k}"), k, folder)
    return intake.registry(spark, folder).select("doc_id", "version", "status", "retry_count", "parents", "main")


@query("STR6", _PARENTS + "SELECT status, count(*) AS n FROM (" + _COUNTED + ") GROUP BY status")
def str6(spark, d):
    """Two polls of the documents' files by a stream with a checkpoint; the second finds nothing new."""
    folder = fresh_folder(spark, "polled")
    for _ in range(2):
        intake.intake(spark, f"{d}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return intake.registry(spark, f"{folder}/out").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("STR7_STREAM", f"SELECT * FROM ({SQL['STR7_MEMORY']}) m WHERE turn = (SELECT max(turn) FROM conversations c WHERE c.conv_id = m.conv_id AND trim({TEXT}) <> '')")
def str7_stream(spark, d):
    """Memories after the last turn, by a stream over the conversations' files."""
    folder, path = fresh_folder(spark, "memory"), f"{d}/conversations.parquet"
    turns = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(intake.as_pattern(path))
    said = turns.select("conv_id", "turn", "role", F.expr(TEXT).alias("text"))
    rows = remembered(said, TOPIC_KEYWORDS, T.entities(F.col("text")))
    rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("conv_id").agg(F.max_by(F.struct("turn", "turns", "active", "history", "found"), "turn").alias("m")).select("conv_id", "m.*")
    line = lambda x: F.concat(x["turn"].cast("string"), F.lit(" "), x["role"], F.lit(": "), x["text"])
    kind = lambda k: F.array_join(F.transform(F.filter("found", lambda x: x["kind"] == k), lambda x: x["value"]), ",").alias(k)
    return last.select("conv_id", "turn", F.array_join(F.transform("turns", line), "\n").alias("short_term"), "active", F.array_join("history", ",").alias("history"), *map(kind, _KINDS))


#: Of some pages nothing, plain text, nothing but nesting or no block.
_PAGE = "CASE page_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'title' || chr(10) || 'line two' WHEN 2 THEN repeat('<div>', 600) || '<p>found</p>' WHEN 3 THEN '<div>' || page_id || '</div>' ELSE html END"
_TAG = "len(regexp_extract_all(bare, '(?i)<{}\\b'))"


@query("PRS1_DISPATCH", f"""SELECT page_id, CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 9 = 1 THEN 'lines' WHEN page_id % 9 = 2 THEN 'patterns' ELSE 'reader' END AS parser,
 CASE WHEN page_id % 9 = 0 THEN 'empty' WHEN page_id % 9 = 2 THEN 'reader failed: too deep' WHEN page_id % 9 = 3 THEN 'no content' END AS error,
 CASE WHEN page_id % 9 > 3 THEN {_TAG.format('h1')} ELSE 0 END::BIGINT AS h1, CASE WHEN page_id % 9 > 3 THEN {_TAG.format('li')} ELSE 0 END::BIGINT AS li, CASE WHEN page_id % 9 > 3 THEN {_TAG.format('p')} WHEN page_id % 9 = 1 THEN 2 WHEN page_id % 9 = 2 THEN 1 ELSE 0 END::BIGINT AS p
FROM (SELECT page_id, {_BARE} AS bare FROM pages)""")
def prs1_dispatch(spark, d):
    """Which parser read each page, with what error, and its blocks by kind."""
    rows = H.parse(table(spark, d, "pages").select("page_id", F.expr(_PAGE).alias("html")))
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return rows.groupBy("page_id", "parser", "error").agg(n("h1"), n("li"), n("p"))
