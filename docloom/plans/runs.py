"""Queries on downloads, uploads, the full ingestion run, re-indexing and saved memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..operators import ingestion as I
from .base import query, table
from .chunks import _PARENTS
from .ingest import _CHANGES, DUCK_LISTING, DUCK_REGISTRY, listing, registry

#: Pages as download attempts: most answer at once, some late or never, some with errors or another kind of file.
_STATUS = "CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 11 = 1 AND attempt < 3 THEN NULL WHEN page_id % 11 = 2 THEN 404 WHEN page_id % 11 = 3 THEN 429 WHEN page_id % 11 = 4 THEN 500 ELSE 200 END"
_BODY = "CASE WHEN page_id % 11 = 5 THEN html ELSE '%PDF-1.7 ' || html END"


def responses(spark, d):
    pages = table(spark, d, "pages").withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(4))))
    body = F.expr(_BODY).cast("binary")
    return pages.select("url", F.col("page_id").alias("request"), "attempt", F.expr(_STATUS).alias("status"), body.alias("content"), (F.octet_length(body) + F.when(F.col("page_id") % 11 == 6, 1).otherwise(0)).alias("declared"))


_FETCHED = f"""WITH r AS (SELECT url, page_id, attempt, {_STATUS} AS status, {_BODY} AS content FROM pages, (SELECT unnest([1, 2, 3]) AS attempt)),
f AS (SELECT url, page_id, min(attempt) FILTER (status IS NOT NULL) AS first FROM r GROUP BY url, page_id)
SELECT f.url, CASE WHEN r.status IS NULL THEN 'timeout' WHEN r.status = 404 THEN 'not found' WHEN r.status = 429 THEN 'rate limited' WHEN r.status >= 400 THEN 'http error' WHEN NOT starts_with(content, '%PDF') THEN 'not a pdf' END AS error,
 CASE WHEN f.page_id % 11 = 6 THEN 'length differs' END AS warning, coalesce(first, 3) AS attempts, CASE WHEN r.status < 400 AND starts_with(content, '%PDF') THEN sha256(content) END AS content_hash
FROM f LEFT JOIN r ON r.url = f.url AND r.attempt = f.first"""


@query("SRC3", _FETCHED)
def src3(spark, d):
    """Downloads with retries; failures are rows with an error."""
    return I.fetched(responses(spark, d))


@query("SRC4", f"SELECT coalesce(error, 'ok') AS outcome, count(*) AS n FROM ({_FETCHED}) GROUP BY 1")
def src4(spark, d):
    """All downloads of a run at once, by outcome."""
    return I.fetched(responses(spark, d)).groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_FILES = "SELECT source AS folder, cast(doc_id AS {}) AS file_id, CASE WHEN lang = 'fr' THEN 'text/html' ELSE 'application/pdf' END AS mime, n_chars % 3 = 0 AS trashed, n_chars AS modified FROM {}"


@query("SRC6", f"SELECT folder, file_id, modified, cast(floor((row_number() OVER (PARTITION BY folder ORDER BY modified DESC, file_id) - 1) / 100) AS INTEGER) AS page FROM ({_FILES.format('varchar', 'documents')}) WHERE mime = 'application/pdf' AND NOT trashed")
def src6(spark, d):
    docs = table(spark, d, "documents")
    files = docs.select(F.col("source").alias("folder"), F.col("doc_id").cast("string").alias("file_id"), F.when(F.col("lang") == "fr", "text/html").otherwise("application/pdf").alias("mime"), (F.col("n_chars") % 3 == 0).alias("trashed"), F.col("n_chars").alias("modified"))
    return I.listed(files, 1000)


@query("SRC8", f"SELECT l.file_id, coalesce(r.version + 1, 1) AS version, 'downloading' AS status FROM ({DUCK_LISTING}) l JOIN ({_CHANGES}) c ON c.file_id = l.file_id LEFT JOIN ({DUCK_REGISTRY}) r ON r.doc_id = l.file_id")
def src8(spark, d):
    """Listed files that changed: the next version, and their status while they come in."""
    from ..operators import registry as R
    from .ingest import _held

    changed = R.detect_changes(listing(spark, d), _held(spark, d)).select("file_id")
    old = registry(spark, d).select(F.col("doc_id").alias("file_id"), "version")
    return listing(spark, d).join(changed, "file_id").join(old, "file_id", "left").select("file_id", F.coalesce(F.col("version") + 1, F.lit(1)).alias("version"), F.lit("downloading").alias("status"))


#: Pages in parts of a thousand bytes: of some the second or the last is lost, others come twice and overlap.
_LOST = "(page_id % 6 = 0 AND part = 1) OR (page_id % 6 = 2 AND part = n - 1 AND n > 1)"


@query("SRC8_PARTS", f"""WITH p AS (SELECT page_id, html, strlen(html) AS total, ceil(strlen(html) / 1000)::BIGINT AS n FROM pages WHERE strlen(html) > 0),
e AS (SELECT *, CASE WHEN page_id % 6 = 0 AND n > 2 THEN 'gap' WHEN (page_id % 6 = 0 AND n = 2) OR (page_id % 6 = 2 AND n > 1) THEN 'incomplete' END AS error FROM p)
SELECT page_id AS file_id, n - CASE WHEN error IS NULL THEN 0 ELSE 1 END AS n_parts, CASE WHEN error IS NULL THEN sha256(html) END AS digest, error FROM e""")
def src8_parts(spark, d):
    """Downloads put together from their parts."""
    pages = table(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("raw")).withColumn("total", F.octet_length("raw")).where("total > 0").withColumn("n", F.ceil(F.col("total") / 1000))
    parts = pages.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).where(f"NOT ({_LOST})")
    start = F.col("part") * 1000
    width = F.when(F.col("page_id") % 6 == 1, 1300).otherwise(1000)
    cut = parts.select(F.col("page_id").alias("file_id"), start.alias("start"), F.substring("raw", (start + 1).cast("int"), width).alias("content"), "total")
    return I.assembled(cut.unionByName(cut.where("file_id % 4 = 1"))).select("file_id", "n_parts", F.sha2("content", 256).alias("digest"), "error")


#: Documents as uploaded files, a fifth of them no PDF; the registry holds the English ones.
def uploaded(spark, d):
    docs = table(spark, d, "documents")
    head = F.when(F.col("n_chars") % 5 == 0, "").otherwise("%PDF-1.7 ")
    files = docs.select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.concat(head, "text").cast("binary").alias("content"))
    held = docs.where("lang = 'en'").select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2(F.concat(F.lit("%PDF-1.7 "), "text"), 256).alias("content_hash"), F.when(F.col("n_chars") < 1000, "failed").otherwise("indexed").alias("status"))
    return I.uploads(files, held)


_UPLOADS = """WITH f AS (SELECT 'in/' || doc_id || '.pdf' AS path, n_chars % 5 <> 0 AS pdf, sha256(CASE WHEN n_chars % 5 = 0 THEN '' ELSE '%PDF-1.7 ' END || text) AS content_hash FROM documents),
held AS (SELECT sha256('%PDF-1.7 ' || text) AS content_hash, min(cast(doc_id AS varchar)) AS known FROM documents WHERE lang = 'en' AND n_chars >= 1000 GROUP BY 1)
SELECT path, content_hash, CASE WHEN NOT pdf THEN 'failed' WHEN known IS NOT NULL OR row_number() OVER (PARTITION BY content_hash ORDER BY path) > 1 THEN 'skipped' ELSE 'new' END AS outcome,
 CASE WHEN pdf THEN coalesce(known, 'doc_' || substr(content_hash, 1, 12)) END AS doc_id FROM f LEFT JOIN held USING (content_hash)"""


@query("SRC9", _UPLOADS)
def src9(spark, d):
    return uploaded(spark, d)


@query("SRC10", f"SELECT count(*) FILTER (outcome = 'new') AS discovered, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed FROM ({_UPLOADS})")
def src10(spark, d):
    n = lambda c: F.count_if(F.col("outcome") == c)
    return uploaded(spark, d).agg(n("new").alias("discovered"), n("skipped").alias("skipped"), n("failed").alias("failed"))


#: Chunks of every document after gate and removal of repeats.
_COUNTS = _PARENTS + f""", counts AS (SELECT doc_id, sum(main) AS main, sum(parents) AS parents FROM (
  SELECT doc_id, count(DISTINCT text) AS main, 0 AS parents FROM u WHERE t >= {DEFAULTS.chunk_min_tokens} GROUP BY doc_id
  UNION ALL SELECT doc_id, 0, count(DISTINCT text) FROM parents GROUP BY doc_id) GROUP BY doc_id)
"""


@query("HLP25", _COUNTS + "SELECT doc_id, cast(main AS BIGINT) AS main, cast(parents AS BIGINT) AS parents FROM counts")
def hlp25(spark, d):
    return I.process(table(spark, d, "documents").select("doc_id", "text"))


def run(spark, d):
    """Every seventh download fails."""
    docs = table(spark, d, "documents")
    contents = docs.select(F.col("doc_id").cast("string").alias("file_id"), "text", F.when(F.col("n_chars") % 7 == 0, "timeout").alias("error"))
    return I.full_run(listing(spark, d), contents, registry(spark, d))


_RUN = _COUNTS + f""", ch AS ({_CHANGES}),
work AS (SELECT ch.file_id, ch.change, d.n_chars % 7 <> 0 AND c.doc_id IS NOT NULL AS ok, c.main + c.parents AS n, l.md5 FROM ch LEFT JOIN documents d ON cast(d.doc_id AS varchar) = ch.file_id LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN ({DUCK_LISTING}) l ON l.file_id = ch.file_id),
after AS (SELECT coalesce(r.doc_id, w.file_id) AS doc_id, w.change, w.change IN ('new', 'updated') AS touched, w.ok, w.n, w.md5, r.doc_id IS NOT NULL AS held, r.content_hash, r.status, r.version, r.retry_count
  FROM ({DUCK_REGISTRY}) r FULL JOIN work w ON w.file_id = r.doc_id),
done AS (SELECT doc_id, CASE WHEN touched THEN md5 ELSE content_hash END AS content_hash, CASE WHEN change = 'deleted' THEN 'deleted' WHEN touched AND ok THEN 'indexed' WHEN touched THEN 'failed' ELSE status END AS status,
  CASE WHEN NOT held THEN 1 WHEN touched THEN version + 1 ELSE version END AS version, coalesce(retry_count, 0) + CASE WHEN touched AND NOT ok THEN 1 ELSE 0 END AS retry_count, CASE WHEN touched THEN CASE WHEN ok THEN cast(n AS BIGINT) ELSE 0 END END AS chunk_count, change FROM after)
"""


@query("ORC4", _RUN + """SELECT count(*) FILTER (change IN ('new', 'updated')) AS discovered, count(*) FILTER (change = 'new') AS "new", count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'deleted') AS deleted,
 count(*) FILTER (change IS NULL AND status = 'indexed') AS skipped, count(*) FILTER (change IN ('new', 'updated') AND status = 'failed') AS failed, cast(sum(chunk_count) AS BIGINT) AS chunks FROM done""")
def orc4(spark, d):
    """Statistics of a full run: discover, parse, chunk, register."""
    return run(spark, d)[1]


@query("ORC4_REGISTRY", _RUN + "SELECT doc_id, status, version, retry_count, chunk_count FROM done")
def orc4_registry(spark, d):
    """The registry after the run; digests are left out, as the engines change case differently in the fixture."""
    return run(spark, d)[0].drop("content_hash")


_HELD_SOURCE = "CASE WHEN lang = 'fr' THEN 'upload' ELSE 'drive' END"


@query("REG10", _COUNTS + f"""SELECT cast(d.doc_id AS varchar) AS doc_id, CASE WHEN lang = 'de' THEN 'not found' WHEN n_chars % 4 = 0 AND lang = 'fr' THEN 'cannot fetch' WHEN n_chars % 4 = 0 THEN 'skipped' WHEN c.doc_id IS NULL THEN 'no content' ELSE 'updated' END AS outcome,
 CASE WHEN lang <> 'de' THEN CASE WHEN n_chars % 4 <> 0 AND c.doc_id IS NOT NULL THEN 2 ELSE 1 END END AS version, CASE WHEN lang <> 'de' AND n_chars % 4 <> 0 THEN cast(coalesce(main + parents, 0) AS BIGINT) ELSE 0 END AS chunks
FROM documents d LEFT JOIN counts c USING (doc_id) WHERE n_chars % 10 = 0""")
def reg10(spark, d):
    """Re-indexing on request: some ids are unknown, some files gone."""
    docs = table(spark, d, "documents").withColumn("doc_id", F.col("doc_id").cast("string"))
    held = docs.where("lang <> 'de'").select("doc_id", F.when(F.col("lang") == "fr", "upload").otherwise("drive").alias("source"), F.lit(1).alias("version"))
    return I.reindex(docs.where("n_chars % 10 = 0"), held, docs.where("n_chars % 4 <> 0").select("doc_id", "text"))


_LAST = "SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS summary FROM conversations GROUP BY conv_id"


@query("SNK8", f"SELECT 'mem_' || substr(sha256(user_id || ':' || session_id || ':' || summary), 1, 12) AS memory_id, user_id, session_id, summary FROM (SELECT CASE WHEN conv_id % 13 = 0 THEN '' ELSE 'u' || (conv_id % 7) END AS user_id, 's' || conv_id AS session_id, summary FROM ({_LAST})) WHERE user_id <> '' AND trim(coalesce(summary, '')) <> ''")
def snk8(spark, d):
    """Summaries of closed sessions to keep; sessions without a user or a user's message are rejected."""
    last = table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("summary"))
    user = F.when(F.col("conv_id") % 13 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")))
    return I.memories(last.select(user.alias("user_id"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), "summary"))


_COLUMNS = {"documents": ("doc_id", "text", "lang", "source", "n_chars"), "conversations": ("conv_id", "turn", "role", "text")}
_TYPED = " UNION ALL ".join(f"SELECT typeof({c}) AS dtype, count({c}) AS filled FROM {t} GROUP BY 1" for t, cs in _COLUMNS.items() for c in cs)


@query("AGG14", f"SELECT dtype, count(*) AS n, sum(filled)::BIGINT AS filled FROM ({_TYPED}) GROUP BY dtype")
def agg14(spark, d):
    """Columns of two tables by type, and their values that are not null."""
    name = lambda c: F.when(F.typeof(c) == "string", "VARCHAR").otherwise(F.upper(F.typeof(c)))
    each = [table(spark, d, t).agg(F.array(*[F.struct(F.max(name(c)).alias("dtype"), F.count(c).alias("filled")) for c in cs]).alias("x")) for t, cs in _COLUMNS.items()]
    rows = each[0].unionByName(each[1]).select(F.inline("x"))
    return rows.groupBy("dtype").agg(F.count(F.lit(1)).alias("n"), F.sum("filled").alias("filled"))
