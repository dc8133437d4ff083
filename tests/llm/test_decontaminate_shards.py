"""A benchmark that needs several indexes, and what op1 leaves behind."""

import random

from pyspark.sql import functions as F

from docloom.llm import pii
from docloom.llm.decontaminate import decontaminate, with_matches

from .helpers import docs, row


def test_shards_find_what_one_index_finds(spark):
    rng = random.Random(8)
    said = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    items = [(i, f"Question: {said(20)} Answer: {said(8)}") for i in range(60)] + [(100, None), (101, "  "), (None, said(20))]
    items.append((102, items[5][1]))
    texts = [f"{said(80)} {items[i][1]} {said(80)} {items[(i * 7 + 1) % 60][1]}" for i in range(30)] + [said(200) for _ in range(10)] + [None, "", " "]
    rows = [row(i, t) for i, t in enumerate(texts)]
    rows += [row(3, texts[3]), row(None, texts[4])]
    table = docs(spark, rows).repartition(3).withColumn("_row", F.lit("r")).withColumn("found_next", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = sorted(map(repr, decontaminate(spark, table, bench).drop("best_score").collect()))
    shards = sorted(map(repr, decontaminate(spark, table, bench, 2500).drop("best_score").collect()))
    assert shards == plain and len(plain) == len(rows)
    best = {r.doc_id: r for r in decontaminate(spark, table, bench, 2500).where("doc_id is not null").collect()}
    assert all(best[i].n_items >= 2 and best[i].best_score > 0 for i in range(30)) and best[5].item_ids.count(102) == 1 and best[40].item_ids == [] and best[40].best_score == 0
    whole = with_matches(spark, table, bench, "found", 2500)
    assert whole.columns == [*table.columns, "found"] and {(r._row, r.found_next) for r in whole.collect()} == {("r", 1)}


def test_blank_items_beyond_one_index(spark):
    blank = spark.createDataFrame([(i, " " * 50) for i in range(20)], "item_id long, text string")
    assert [r.n_items for r in decontaminate(spark, docs(spark, [row(1, "a b c")]), blank, 100).collect()] == [0]


def test_candidates_can_be_kept_without_texts(spark):
    table = docs(spark, [row(1, "write a@b.co"), row(None, None), row(1, "James Smith")])
    slim = pii.find_pii(table, keep=["doc_id"])
    assert slim.columns == ["doc_id", "pii"]
    assert sorted(map(repr, slim.collect())) == sorted(map(repr, pii.find_pii(table).select("doc_id", "pii").collect()))
