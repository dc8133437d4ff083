"""Sources and sinks: link lists, landed files, JSON lines, versioned tables, checkpoints."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_links(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents of JSON lists {documents: [{url, title, category, type}]}, one a file or, with ``lines``, one a line; a missing type is pdf."""
    tree = spark.read.schema("documents array<struct<url:string,title:string,category:string,type:string>>").option("multiLine", not lines).json(path)
    return tree.select(F.inline("documents")).where(F.coalesce("type", F.lit("pdf")) == "pdf")


def read_landed(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Landed files with digest and error: what is no PDF is an error row; files whose digest is known are left out."""
    files = spark.read.format("binaryFile").load(path)
    rows = files.select("path", "length", "content", F.sha2("content", 256).alias("content_hash"), F.when(F.substring("content", 1, 4) != F.lit(b"%PDF"), "not a pdf").alias("error"))
    return rows if known is None else rows.join(known.select("content_hash"), "content_hash", "left_anti")


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _versions(spark: SparkSession, folder: str) -> dict[int, str]:
    """Folder of each version, by the pointers that writers have placed."""
    where, fs = _file_system(spark, f"{folder}/versions")
    if not fs.exists(where):
        return {}
    found = (status.getPath().getName() for status in fs.listStatus(where))
    return {int(n): t for n, _, t in (name.partition("-") for name in found)}


def write_version(rows: DataFrame, folder: str) -> str:
    """Writes rows as the folder's next version and only then points to it, so readers never see half a table.

    A folder anywhere Hadoop reaches; of two writers of one version the second fails.
    """
    spark = rows.sparkSession
    version = max(_versions(spark, folder), default=0) + 1
    target = f"v{version}_{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{target}")
    lock, fs = _file_system(spark, f"{folder}/locks/{version}")
    # Creating a file that must not exist is the one step only one writer can do.
    fs.create(lock, False).close()
    pointer, _ = _file_system(spark, f"{folder}/versions/{version}-{target}")
    fs.create(pointer, False).close()
    return f"{folder}/{target}"


def read_version(spark: SparkSession, folder: str) -> DataFrame:
    versions = _versions(spark, folder)
    return spark.read.parquet(f"{folder}/{versions[max(versions)]}")


def reset(spark: SparkSession, folder: str) -> None:
    """Removes a collection with everything in it."""
    where, fs = _file_system(spark, folder)
    fs.delete(where, True)


def healthy(spark: SparkSession, folder: str) -> bool:
    """Whether a row can be written beside a collection, read back and dropped again."""
    probe = f"{folder}_health_{uuid.uuid4().hex}"
    try:
        spark.createDataFrame([("ping",)], "text string").write.parquet(probe)
        return [r.text for r in spark.read.parquet(probe).collect()] == ["ping"]
    except (Py4JJavaError, PySparkException):
        return False
    finally:
        reset(spark, probe)


def save_json(path: str, value: object) -> None:
    """Writes beside the file and replaces it in one step."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    part = f"{path}.part"
    Path(part).write_text(json.dumps(value))
    os.replace(part, path)


def load_json(path: str, default: object) -> object:
    """The file's value; default if it is missing or broken."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return default
