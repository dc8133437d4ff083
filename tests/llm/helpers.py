"""Small documents with every awkward case, and tables made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

DDL = "doc_id long, text string, lang string, source string, n_chars long, id long, a string, words string, score double, runs int, bucket int, place int, comp int, pii string"
WORDS = [f"w{i}" for i in range(4000)]
LONG = " ".join(WORDS)


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, None if doc_id == 3 else "s", None, 7, "x", "y", 0.5, 1, 2, 3, 4, "z")


#: Nulls, empty and blank texts, repeated rows, ties, a very long text, a null id.
AWKWARD = [
    row(1, "one two three four five six seven eight nine ten"), row(1, "one two three four five six seven eight nine ten"),
    row(2, None), row(3, ""), row(4, " \n\t "), row(5, "short"), row(6, LONG), row(7, LONG), row(8, LONG + " tail"), row(None, "text without id of a few words"), row(9, "ünïcode 😀 text " * 30, None), row(10, "no1se @ 1.2.3 + - ."),
]


def docs(spark, rows=None):
    return spark.createDataFrame(AWKWARD if rows is None else rows, DDL)


def plain(spark, pairs):
    return docs(spark, [row(i, t) for i, t in pairs])


def empty(spark):
    return docs(spark, [])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
