"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; all but
the last return the columns of documents. An empty table stays empty. Columns beyond
those of documents are kept as they are, whatever their names; texts of any length are
whole. A row without an id is filtered by its text; only as a near-duplicate, where ids
decide which one stays, it always does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import toxicity
from docloom.llm._common import Workspace, table, unused
from docloom.llm.byte_bpe import byte_bpe
from docloom.llm.decontaminate import uncontaminated
from docloom.llm.near_dedup import near_duplicates
from docloom.llm.pii import redact


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the lexicon rejects go, null ids included; null and empty texts stay, repeated rows fare alike."""
    return toxicity.clean(spark, docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest doc_id.

    Null and blank texts and rows without an id stay; rows that repeat the kept id all stay.
    """
    name = unused(docs, "found_id")
    found = near_duplicates(spark, docs).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id") == F.col(name), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, null ids included; null and empty texts stay, repeated rows fare alike."""
    return uncontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans are replaced by their kind; n_chars follows. Null texts stay null, with n_chars null."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the decoded bytes; null and empty texts have none."""
    return byte_bpe(spark, docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("byte_bpe", tokenize),
]

#: Near-duplicate groups, EM and BPE merges are beyond SQL; tests/llm/test_pipeline.py runs a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    last = len(STAGES) - 1
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < last:
            docs = ws.save(docs, f"{k}_{name}")
    return docs
