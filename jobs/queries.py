"""The jobs as registered queries: each runs twice into a new folder, and its output is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import DEFAULTS
from docloom.functions.session import fresh_folder
from docloom.plans.chunks import _PARENTS

from . import export_training_set, ingest_documents


def job1_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest version of every document with its chunks, after a second run that finds nothing new."""
    where = fresh_folder(spark, "job1")
    config = {"input": f"{sf_dir}/documents.parquet", "output": f"{where}/out", "checkpoint": f"{where}/checkpoint"}
    ingest_documents.run(spark, config)
    ingest_documents.run(spark, config)
    return ingest_documents.state(spark, config["output"])


_TEXTS = f"""SELECT doc_id, 'parent' AS kind, text, min(chunk_no) AS first FROM parents GROUP BY doc_id, text
 UNION ALL SELECT doc_id, 'main', text, min(ord) FROM u WHERE t >= {DEFAULTS.chunk_min_tokens} GROUP BY doc_id, text"""
JOB1_SQL = _PARENTS + f"""SELECT d.doc_id::VARCHAR AS doc_id, 1 AS version, CASE WHEN p.doc_id IS NULL THEN 'failed' ELSE 'indexed' END AS status, sha256(coalesce(d.text, '')) AS content_hash,
 CASE WHEN p.doc_id IS NULL THEN 1 ELSE 0 END AS retry_count, c.kind, (row_number() OVER (PARTITION BY d.doc_id, c.kind ORDER BY c.first) - 1)::INTEGER * CASE WHEN c.kind IS NOT NULL THEN 1 END AS chunk_no,
 CASE WHEN c.kind IS NOT NULL THEN greatest(1, (length(c.text) // 4)::INTEGER) END AS token_count, md5(c.text) AS digest
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM parents) p ON p.doc_id = d.doc_id LEFT JOIN ({_TEXTS}) c ON c.doc_id = d.doc_id"""


def job2_export_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's example or reason, after a second run that replaces the first one's output."""
    where = fresh_folder(spark, "job2")
    config = {"input": f"{sf_dir}/conversations.parquet", "output": where}
    export_training_set.run(spark, config)
    export_training_set.run(spark, config)
    rows = export_training_set.read_examples(spark, where)
    return rows.select("conv_id", "n_turns", "tokens", "reason", "split", F.sha2("text", 256).alias("digest"))


_D = export_training_set.DEFAULTS
JOB2_SQL = f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, text FROM conversations WHERE conv_id IS NOT NULL AND trim(coalesce(text, '')) <> ''),
made AS (SELECT conv_id, count(*) AS n_turns, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn, role, text) AS text, bool_or(role = 'user') AS asks, bool_or(role = 'assistant') AS replies FROM said GROUP BY conv_id),
judged AS (SELECT *, greatest(1, length(text) // 4)::BIGINT AS tokens FROM made),
kept AS (SELECT *, CASE WHEN NOT asks THEN 'no user' WHEN NOT replies THEN 'no assistant' WHEN tokens > {_D['max_tokens']} THEN 'too long' END AS why FROM judged),
named AS (SELECT *, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY why IS NULL, text ORDER BY conv_id) > 1 THEN 'duplicate' END) AS reason FROM kept)
SELECT conv_id, n_turns, tokens, reason, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN ('0x' || md5('{_D['seed']}:' || conv_id)[1:8])::UBIGINT % 100 < {_D['validation_percent']} THEN 'validation' ELSE 'train' END AS split,
 CASE WHEN why IS NULL THEN sha256(text) END AS digest FROM named"""

QUERIES = {"job1_ingest_documents": job1_ingest_documents, "job2_export_training_set": job2_export_training_set}
SQL = {"job1_ingest_documents": JOB1_SQL, "job2_export_training_set": JOB2_SQL}
