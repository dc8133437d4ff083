"""Job: takes in the new files of a growing folder of documents, and only those.

    python -m jobs.ingest_documents --config jobs/ingest_documents.json [--input P] [--output P] [--checkpoint P]

Output, Parquet: ``registry`` (by segment) with a row for each change of a document, and
``chunks`` (by segment and kind) with the parents and lines of each version. A document
whose text is unchanged is skipped; a changed one gets the next version; one without
content fails and is tried again when it comes again. A run without new files writes
nothing; one that broke off is repeated from the batch it was in, with the same result.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.streaming.intake import collection, intake, registry

from .common import configured, session

log = logging.getLogger("jobs.ingest_documents")
DEFAULTS = {"files_per_batch": 256, "parent_max_tokens": 1200, "chunk_min_tokens": 100}


def run(spark: SparkSession, config: dict) -> list[dict[str, int]]:
    """Brings ``output`` up to date with ``input``; the counts of every batch of this run."""
    c = {**DEFAULTS, **config}
    log.info("reading new files of %s", c["input"])
    batches = intake(spark, c["input"], c["output"], c["checkpoint"], c["files_per_batch"], Settings(parent_max_tokens=c["parent_max_tokens"], chunk_min_tokens=c["chunk_min_tokens"]))
    log.info("%d batches, %d documents, %d chunks written to %s", len(batches), sum(b["documents"] for b in batches), sum(b["chunks"] for b in batches), c["output"])
    return batches


def state(spark: SparkSession, output: str) -> DataFrame:
    """Every document's latest version with its chunks; a document without any has one row."""
    docs, chunks = registry(spark, output), collection(spark, output)
    return docs.join(chunks.drop("segment", "version"), "doc_id", "left").select("doc_id", "version", "status", "content_hash", "retry_count", "kind", "chunk_no", "token_count", F.md5("text").alias("digest"))


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    config = configured(parser, "input", "output", "checkpoint")
    with session("ingest documents") as spark:
        run(spark, config)


if __name__ == "__main__":
    main()
