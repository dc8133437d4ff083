import duckdb

from docloom.plans import catalog
from docloom.plans.dialogue import messages


def test_memory_after_each_turn(spark, data):
    got = catalog.queries()["STR7_MEMORY"](spark, data)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    want = con.execute(catalog.oracle_sql()["STR7_MEMORY"])
    assert got.columns == [d[0] for d in want.description]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall())
    blank = {(r.conv_id, r.turn) for r in messages(spark, data).where("trim(text) = ''").collect()}
    assert blank and not blank & {r[:2] for r in rows} and any(r[4] for r in rows) and any(r[2].count("\n") == 3 for r in rows)


def test_memory_as_a_stream_equals_the_batch(spark, data, tmp_path):
    from pyspark.sql import functions as F

    from docloom.functions import text as T
    from docloom.functions.words import TOPIC_KEYWORDS
    from docloom.operators import memory as M
    from docloom.plans.dialogue import _KINDS
    from docloom.streaming.memory import remembered

    rows, entities = messages(spark, data), T.entities(F.col("text"))
    want = {}
    for r in M.memory(rows, TOPIC_KEYWORDS, entities, _KINDS, 4).orderBy("turn").collect():
        want[r.conv_id] = (r.turn, [tuple(t) for t in r.short_term], r.active, r.history, sorted((k, v) for k in _KINDS for v in r[k]))

    def run():
        turns = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        stream = remembered(turns, TOPIC_KEYWORDS, entities, 4)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    for lo, hi in ((0, 2), (2, 3), (3, 99)):
        rows.where(f"turn >= {lo} and turn < {hi}").write.mode("append").parquet(str(tmp_path / "in"))
        out = run()
    got = {}
    for r in out.orderBy("turn").collect():
        assert not r.expired
        got[r.conv_id] = (r.turn, [tuple(t) for t in r.turns], r.active, r.history, sorted(map(tuple, r.found)))
    assert got == want
    # A turn that comes too late changes nothing.
    spark.createDataFrame([(next(iter(want)), 0, "user", "late upi")], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
    last = run().groupBy("conv_id").agg(F.max("turn").alias("turn"))
    assert {r.conv_id: r.turn for r in last.collect()} == {i: v[0] for i, v in want.items()}


def test_a_silent_conversation_expires(spark, tmp_path):
    import time

    from pyspark.sql import functions as F

    from docloom.functions import text as T
    from docloom.functions.words import TOPIC_KEYWORDS
    from docloom.streaming.memory import remembered

    schema = "conv_id long, turn long, role string, text string"

    add = lambda row: spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add((1, 0, "user", "upi transfer"))
    turns = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    rows = remembered(turns, TOPIC_KEYWORDS, T.entities(F.col("text")), 4, 0.02)
    query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()

    def wait(n):
        for _ in range(120):
            time.sleep(0.5)
            if (tmp_path / "out" / "_spark_metadata").exists():
                got = sorted((r.expired, [t.text for t in r.turns]) for r in spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).collect())
                if len(got) >= n:
                    return got
        raise TimeoutError

    try:
        assert wait(2) == [(False, ["upi transfer"]), (True, ["upi transfer"])]
        add((1, 0, "user", "anew"))
        assert (False, ["anew"]) in wait(3)
    finally:
        query.stop()
