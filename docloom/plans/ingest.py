"""Queries on sources, registry and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import fresh_folder
from ..functions.text import cache_name, title_of
from ..operators import registry as R
from ..sources.files import read_links
from .base import query, table

URL = "'https://docs.example/' || source || '/file_' || doc_id || '.pdf'"
STATUS = "CASE WHEN n_chars < 400 THEN 'pending' WHEN n_chars < 800 THEN 'failed' WHEN n_chars < 1000 THEN 'deleted' ELSE 'indexed' END"
#: The registry holds all documents but the German ones; the listing all but the Spanish, long ones changed.
REGISTRY = f"SELECT cast(doc_id AS string) AS doc_id, {URL} AS source_url, md5(text) AS content_hash, {STATUS} AS status, 1 AS version, source AS category, lang AS language, cast(n_chars AS bigint) AS stamp, 0 AS retry_count FROM documents WHERE lang <> 'de'"
LISTING = "SELECT cast(doc_id AS string) AS file_id, md5(CASE WHEN n_chars > 3000 THEN upper(text) ELSE text END) AS md5, cast(n_chars AS bigint) AS modified FROM documents WHERE lang <> 'es'"
#: Pages as a list of links: some of another type or none, some blank, some known to a registry.
_LINK = {"url": "CASE page_id % 7 WHEN 0 THEN ' ' || url || ' ' WHEN 1 THEN '  ' ELSE url END", "title": "' Page ' || page_id || ' '", "type": "CASE page_id % 5 WHEN 0 THEN 'html' WHEN 1 THEN NULL ELSE 'pdf' END"}
LINKS = f"(SELECT {', '.join(f'{x} AS {c}' for c, x in _LINK.items())} FROM pages)"
_STATUS = "CASE WHEN page_id % 2 = 0 THEN 'indexed' ELSE 'failed' END"
KNOWN = f"(SELECT page_id::VARCHAR AS doc_id, url AS source_url, {_STATUS} AS status FROM pages WHERE page_id % 3 = 0)"


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", *[F.expr(x).alias(c) for c, x in _LINK.items()])


def registry(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    n = F.col("n_chars")
    status = F.when(n < 400, "pending").when(n < 800, "failed").when(n < 1000, "deleted").otherwise("indexed")
    url = F.concat(F.lit("https://docs.example/"), "source", F.lit("/file_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return docs.where("lang <> 'de'").select(F.col("doc_id").cast("string").alias("doc_id"), url.alias("source_url"), F.md5("text").alias("content_hash"), status.alias("status"), F.lit(1).alias("version"), F.col("source").alias("category"), F.col("lang").alias("language"), n.cast("long").alias("stamp"), F.lit(0).alias("retry_count"))


def listing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lang <> 'es'")
    text = F.when(F.col("n_chars") > 3000, F.upper("text")).otherwise(F.col("text"))
    return docs.select(F.col("doc_id").cast("string").alias("file_id"), F.md5(text).alias("md5"), F.col("n_chars").cast("long").alias("modified"))


def _held(spark: SparkSession, d: str) -> DataFrame:
    return registry(spark, d).select(F.col("doc_id").alias("file_id"), F.col("content_hash").alias("md5"), F.col("stamp").alias("modified"), "status")


DUCK_REGISTRY = REGISTRY.replace("AS string", "AS varchar")
DUCK_LISTING = LISTING.replace("AS string", "AS varchar")


@query("SRC1", f"SELECT trim(url) AS url, title FROM {LINKS} WHERE coalesce(type, 'pdf') = 'pdf'")
def src1(spark, d):
    """Link lists of a hundred links each, written as JSON lines and read back."""
    lists = links(spark, d).groupBy(F.floor(F.col("page_id") / 100).alias("list")).agg(F.collect_list(F.struct(*_LINK)).alias("documents"))
    folder = fresh_folder(spark, "links")
    lists.select("documents").write.json(folder)
    return read_links(spark, folder, lines=True).select(F.trim("url").alias("url"), "title")


_DISCOVER = f"""SELECT l.url, l.title, CASE WHEN r.doc_id IS NULL THEN 'new' ELSE 'known' END AS state, r.doc_id AS known_id, coalesce(r.status, 'pending') AS status
FROM (SELECT trim(url) AS url, trim(title) AS title FROM {LINKS} WHERE coalesce(type, 'pdf') = 'pdf' AND trim(url) <> '') l
LEFT JOIN {KNOWN} r ON l.url = r.source_url"""


@query("SRC2", _DISCOVER)
def src2(spark, d):
    known = table(spark, d, "pages").where("page_id % 3 = 0").select(F.col("page_id").cast("string").alias("doc_id"), F.col("url").alias("source_url"), F.expr(_STATUS).alias("status"))
    return R.discover(links(spark, d), known)


@query("SRC5", "SELECT page_id, CASE WHEN lower(name) LIKE '%.pdf' THEN name ELSE name || '.pdf' END AS file_name FROM (SELECT page_id, CASE WHEN raw = '' THEN 'document' ELSE raw END AS name FROM (SELECT page_id, regexp_extract(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1) AS raw FROM pages))")
def src5(spark, d):
    return table(spark, d, "pages").select("page_id", cache_name(F.col("url")).alias("file_name"))


_CHANGES = f"""SELECT * FROM (SELECT coalesce(l.file_id, r.doc_id) AS file_id,
 CASE WHEN r.doc_id IS NULL THEN 'new' WHEN l.file_id IS NOT NULL AND (l.md5 <> r.content_hash OR l.modified > r.stamp) THEN 'updated' WHEN l.file_id IS NULL AND r.status = 'indexed' THEN 'deleted' END AS change
FROM ({DUCK_LISTING}) l FULL JOIN ({DUCK_REGISTRY}) r ON l.file_id = r.doc_id) WHERE change IS NOT NULL"""


@query("SRC7", _CHANGES)
def src7(spark, d):
    return R.detect_changes(listing(spark, d), _held(spark, d))


@query("JN2", f"SELECT change, count(*) AS n FROM ({_CHANGES}) GROUP BY change")
def jn2(spark, d):
    return src7(spark, d).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("JN1", f"SELECT l.file_id, r.status FROM ({DUCK_LISTING}) l LEFT JOIN ({DUCK_REGISTRY}) r ON l.file_id = r.doc_id")
def jn1(spark, d):
    return listing(spark, d).select("file_id").join(registry(spark, d).select(F.col("doc_id").alias("file_id"), "status"), "file_id", "left")


_GONE = f"SELECT doc_id FROM ({DUCK_REGISTRY}) r WHERE status = 'indexed' AND doc_id NOT IN (SELECT file_id FROM ({DUCK_LISTING}))"


@query("JN3", _GONE)
def jn3(spark, d):
    return registry(spark, d).where("status = 'indexed'").select("doc_id").join(listing(spark, d).select(F.col("file_id").alias("doc_id")), "doc_id", "left_anti")


@query("SET3", f"SELECT doc_id FROM ({DUCK_REGISTRY}) WHERE status = 'indexed' EXCEPT SELECT file_id FROM ({DUCK_LISTING})")
def set3(spark, d):
    return registry(spark, d).where("status = 'indexed'").select("doc_id").exceptAll(listing(spark, d).select("file_id"))


@query("SRC11", "SELECT vec_id, label FROM embeddings")
def src11(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label")


@query("SRC12", "SELECT conv_id, turn, role, text FROM conversations")
def src12(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


_NEW = f"SELECT doc_id, source_url, md5(content_hash) AS content_hash, 'pending' AS status, version + 1 AS version, 'moved' AS category, language, stamp + 1 AS stamp, retry_count FROM ({DUCK_REGISTRY}) WHERE language = 'fr' UNION ALL SELECT cast(doc_id AS varchar), 'https://docs.example/new/' || doc_id, md5(text), 'pending', 1, source, lang, n_chars, 0 FROM documents WHERE lang = 'de'"


def changes(spark, d):
    old = registry(spark, d).where("language = 'fr'").select("doc_id", "source_url", F.md5("content_hash").alias("content_hash"), F.lit("pending").alias("status"), (F.col("version") + 1).alias("version"), F.lit("moved").alias("category"), "language", (F.col("stamp") + 1).alias("stamp"), "retry_count")
    new = table(spark, d, "documents").where("lang = 'de'").select(F.col("doc_id").cast("string"), F.concat(F.lit("https://docs.example/new/"), F.col("doc_id").cast("string")), F.md5("text"), F.lit("pending"), F.lit(1), "source", "lang", F.col("n_chars").cast("long"), F.lit(0))
    return old.union(new)


_MERGED = f"""SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN o.content_hash ELSE n.content_hash END AS content_hash,
 CASE WHEN n.doc_id IS NULL THEN o.status ELSE n.status END AS status, CASE WHEN n.doc_id IS NULL THEN o.version ELSE n.version END AS version, coalesce(o.category, n.category) AS category
FROM ({DUCK_REGISTRY}) o FULL JOIN ({_NEW}) n ON o.doc_id = n.doc_id"""


@query("SNK1", _MERGED)
def snk1(spark, d):
    return R.merge(registry(spark, d), changes(spark, d), "doc_id", ["category"], "stamp").select("doc_id", "content_hash", "status", "version", "category")


@query("SNK2", "SELECT content_hash, count(*) AS n FROM (SELECT md5(text) AS content_hash FROM documents) GROUP BY 1 HAVING count(*) > 1")
def snk2(spark, d):
    return R.violations(table(spark, d, "documents").select(F.md5("text").alias("content_hash")), "content_hash")


@query("SNK3", f"SELECT doc_id, CASE WHEN language = 'es' THEN 'deleted' ELSE status END AS status, CASE WHEN status = 'failed' THEN retry_count + 1 ELSE retry_count END AS retry_count FROM ({DUCK_REGISTRY}) WHERE status <> 'deleted'")
def snk3(spark, d):
    return registry(spark, d).where("status <> 'deleted'").select("doc_id", F.when(F.col("language") == "es", "deleted").otherwise(F.col("status")).alias("status"), F.when(F.col("status") == "failed", F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count"))


@query("SNK7", "SELECT doc_id, text_hash IN (SELECT md5(text) FROM documents WHERE lang = 'en') AS cached FROM (SELECT doc_id, md5(text) AS text_hash FROM documents)")
def snk7(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    cache = docs.where("lang = 'en'").select(F.md5("text").alias("text_hash")).distinct().withColumn("hit", F.lit(True))
    return docs.withColumn("text_hash", F.md5("text")).join(cache, "text_hash", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("cached"))


@query("JN4", "SELECT count(*) AS to_compute FROM (SELECT DISTINCT md5(text) AS h FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en'))")
def jn4(spark, d):
    docs = table(spark, d, "documents").select("lang", "text")
    cache = docs.where("lang = 'en'").select(F.md5("text").alias("text_hash")).distinct()
    return R.cached(docs.select("text"), cache)[1].agg(F.count(F.lit(1)).alias("to_compute"))


@query("REG1", f"SELECT doc_id, source_url, status FROM ({DUCK_REGISTRY}) WHERE doc_id = '0' OR source_url LIKE '%/file_1.pdf'")
def reg1(spark, d):
    return registry(spark, d).where("doc_id = '0' OR source_url LIKE '%/file_1.pdf'").select("doc_id", "source_url", "status")


@query("REG2", "SELECT content_hash, min(doc_id) AS doc_id FROM (SELECT md5(text) AS content_hash, doc_id FROM documents) GROUP BY 1")
def reg2(spark, d):
    return table(spark, d, "documents").select(F.md5("text").alias("content_hash"), "doc_id").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))


@query("REG3", f"SELECT doc_id, status FROM ({DUCK_REGISTRY}) WHERE status IN ('indexed', 'failed')")
def reg3(spark, d):
    return registry(spark, d).where(F.col("status").isin("indexed", "failed")).select("doc_id", "status")


@query("REG4", f"SELECT status, count(*) AS n FROM ({DUCK_REGISTRY}) GROUP BY status")
def reg4(spark, d):
    return registry(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_PAIRED = f"SELECT r.doc_id, r.status, r.content_hash, l.md5 FROM ({DUCK_REGISTRY}) r JOIN ({DUCK_LISTING}) l ON r.doc_id = l.file_id"


def paired(spark, d):
    return registry(spark, d).join(listing(spark, d).select(F.col("file_id").alias("doc_id"), "md5"), "doc_id")


@query("REG5", f"SELECT doc_id, status IN ('pending', 'failed') OR content_hash <> md5 AS needs_reindex FROM ({_PAIRED})")
def reg5(spark, d):
    return paired(spark, d).select("doc_id", R.needs_reindex(F.col("md5")).alias("needs_reindex"))


@query("REG6", f"SELECT doc_id, md5 <> '' AND content_hash = md5 AND status = 'indexed' AS skip FROM ({_PAIRED})")
def reg6(spark, d):
    return paired(spark, d).select("doc_id", R.unchanged(F.col("md5")).alias("skip"))


@query("REG7", "SELECT doc_id, sha256(text) AS sha FROM documents")
def reg7(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("REG8", f"SELECT doc_id, CASE WHEN stamp > 200 THEN 'indexed' ELSE 'failed' END AS status, CASE WHEN stamp > 200 THEN cast(floor(stamp / 1200) AS bigint) + 1 ELSE 0 END AS chunk_count, CASE WHEN stamp > 200 THEN retry_count ELSE retry_count + 1 END AS retry_count FROM ({DUCK_REGISTRY})")
def reg8(spark, d):
    after = R.lifecycle(F.col("stamp") > 200, (F.floor(F.col("stamp") / 1200) + 1).cast("long"))
    return registry(spark, d).select("doc_id", *[c.alias(n) for n, c in after.items()])


_STATS = f"SELECT coalesce(c.change, 'unchanged') AS change, r.stamp > 200 AS ok, cast(floor(r.stamp / 1200) AS bigint) + 1 AS chunks FROM ({DUCK_REGISTRY}) r LEFT JOIN ({_CHANGES}) c ON r.doc_id = c.file_id"


@query("REG9", f"SELECT count(*) AS discovered, count(*) FILTER (change = 'new') AS \"new\", count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'unchanged') AS skipped, count(*) FILTER (NOT ok) AS failed, cast(sum(CASE WHEN ok THEN chunks ELSE 0 END) AS bigint) AS chunks FROM ({_STATS})")
def reg9(spark, d):
    rows = registry(spark, d).join(src7(spark, d).select(F.col("file_id").alias("doc_id"), "change"), "doc_id", "left")
    return R.run_stats(rows.select(F.coalesce("change", F.lit("unchanged")).alias("change"), (F.col("stamp") > 200).alias("ok"), (F.floor(F.col("stamp") / 1200) + 1).cast("long").alias("chunks")))


@query("FN19", f"SELECT doc_id, replace(replace(regexp_extract(source_url, '([^/]*)$', 1), '.pdf', ''), '_', ' ') AS title FROM ({DUCK_REGISTRY})")
def fn19(spark, d):
    return registry(spark, d).select("doc_id", title_of(F.regexp_extract("source_url", "([^/]*)$", 1)).alias("title"))


@query("HLP8", f"SELECT doc_id, coalesce(nullif(category, 'src0'), '') AS category FROM ({DUCK_REGISTRY})")
def hlp8(spark, d):
    return registry(spark, d).select("doc_id", F.coalesce(F.nullif("category", F.lit("src0")), F.lit("")).alias("category"))


@query("AGG13", f"SELECT count(*) FILTER (status = 'failed') AS errors, CASE WHEN count(*) FILTER (status = 'failed') = 0 THEN 'HEALTHY' WHEN count(*) FILTER (status = 'failed') < count(*) THEN 'DEGRADED' ELSE 'UNHEALTHY' END AS health FROM ({DUCK_REGISTRY})")
def agg13(spark, d):
    bad = F.count_if(F.col("status") == "failed")
    return registry(spark, d).agg(bad.alias("errors"), F.when(bad == 0, "HEALTHY").when(bad < F.count(F.lit(1)), "DEGRADED").otherwise("UNHEALTHY").alias("health"))
