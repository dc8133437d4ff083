import json

import pytest

from docloom.operators import ingestion
from docloom.sources import files
from docloom.streaming import events as E


def drain(spark, frame, mode, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def stream(spark, data):
    path = f"{data}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{data}/events*.parquet")


def test_windows_equal_batch(spark, data):
    batch = spark.read.parquet(f"{data}/events.parquet")
    got = {tuple(r) for r in drain(spark, E.tumbling_counts(stream(spark, data)), "complete", "tumbling")}
    assert got == {tuple(r) for r in E.tumbling_counts(batch).collect()}
    assert sum(r[2] for r in got) == batch.count()
    assert sum(r.n for r in drain(spark, E.sliding_counts(stream(spark, data)), "complete", "sliding")) == 4 * batch.count()


def test_sessions_and_distinct(spark, data):
    batch = spark.read.parquet(f"{data}/events.parquet")
    got = {tuple(r) for r in drain(spark, E.session_counts(stream(spark, data)), "complete", "sessions")}
    assert got == {tuple(r) for r in E.session_counts(batch).collect()}
    assert len(drain(spark, E.distinct_events(stream(spark, data)), "append", "distinct")) == batch.count()


def test_rate_limit_burst_then_refill(spark, tmp_path):
    rows = [("a", i, 0.0) for i in range(11)] + [("a", 11, 1.5), ("b", 0, 0.0)]
    spark.createDataFrame(rows, "key string, seq long, at double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, seq long, at double").parquet(str(tmp_path / "in"))
    got = {(r.key, r.seq): r.allowed for r in drain(spark, E.rate_limited(source), "append", "limited")}
    assert [got["a", i] for i in range(12)] == [True] * 10 + [False, True] and got["b", 0]


def test_ingest_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: E.ingest_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.7 a")
    run()
    (tmp_path / "in" / "b.txt").write_bytes(b"plain")
    run()
    run()
    assert sorted(r.is_pdf for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [False, True]


def test_sources(spark, tmp_path):
    (tmp_path / "links.json").write_text(json.dumps({"documents": [{"url": "u1", "title": "a"}, {"url": "u2", "type": "html"}, {"url": "u3", "type": "pdf"}]}))
    assert [r.url for r in files.read_links(spark, str(tmp_path / "links.json")).collect()] == ["u1", "u3"]
    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "a.pdf").write_bytes(b"%PDF a")
    (tmp_path / "land" / "b.pdf").write_bytes(b"html")
    landed = files.read_landed(spark, str(tmp_path / "land"))
    assert sorted(r.error or "" for r in landed.collect()) == ["", "not a pdf"]
    assert files.read_landed(spark, str(tmp_path / "land"), landed.where("error is null")).count() == 1
    frame = spark.createDataFrame([(1, "x")], "id long, t string")
    files.append_jsonl(frame, str(tmp_path / "log"))
    files.append_jsonl(frame, str(tmp_path / "log"))
    assert files.read_jsonl(spark, str(tmp_path / "log"), "id long, t string").count() == 2
    files.write_version(frame, str(tmp_path / "reg"))
    files.write_version(files.read_version(spark, str(tmp_path / "reg")).union(frame), str(tmp_path / "reg"))
    assert files.read_version(spark, str(tmp_path / "reg")).count() == 2
    (tmp_path / "bad.json").write_text("{")
    assert files.load_json(str(tmp_path / "bad.json"), []) == []


def test_versions_of_two_writers(spark, tmp_path):
    folder = str(tmp_path / "reg")
    frame = spark.createDataFrame([(1,)], "id long")
    files.write_version(frame, folder)
    (tmp_path / "reg" / "locks" / "2").write_text("")
    with pytest.raises(Exception):
        files.write_version(frame.union(frame), folder)
    assert files.read_version(spark, folder).count() == 1


def test_reset_and_health(spark, tmp_path):
    folder = str(tmp_path / "chunks")
    assert files.healthy(spark, folder) and [p.name for p in tmp_path.iterdir()] == []
    spark.range(3).write.parquet(folder)
    files.reset(spark, folder)
    assert not (tmp_path / "chunks").exists()
    assert not files.healthy(spark, "/proc/nowhere/chunks")


def test_memories_go_to_their_users(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "s1", "a"), ("u1", "s2", "b"), ("", "s3", "c"), ("u2", "s4", " "), (None, "s5", "d")], "user_id string, session_id string, summary string")
    ingestion.save_memories(rows, str(tmp_path / "m"))
    ingestion.save_memories(rows.where("session_id = 's1'"), str(tmp_path / "m"))
    got = spark.read.parquet(str(tmp_path / "m"))
    assert got.where("user_id = 'u1'").count() == 3 and got.count() == 3 and all(len(r.memory_id) == 16 for r in got.collect())


def test_full_run_on_awkward_tables(spark):
    listing = spark.createDataFrame([("1", "m1", 5), ("2", "m2", 5), ("3", "", 5), ("4", "m4", 1)], "file_id string, md5 string, modified long")
    contents = spark.createDataFrame([("1", "one line", None), ("2", None, None), ("4", " \n ", None)], "file_id string, text string, error string")
    held = spark.createDataFrame([("4", "old", "indexed", 1, 3, 0), ("9", "m9", "indexed", 1, 1, 2)], "doc_id string, content_hash string, status string, stamp long, version int, retry_count int")
    after, stats = ingestion.full_run(listing, contents, held)
    got = {r.doc_id: (r.status, r.version, r.retry_count, r.chunk_count) for r in after.collect()}
    assert got == {"1": ("indexed", 1, 0, 1), "2": ("failed", 1, 1, 0), "3": ("failed", 1, 1, 0), "4": ("failed", 4, 1, 0), "9": ("deleted", 1, 2, None)}
    assert tuple(stats.first()) == (4, 3, 1, 1, 0, 3, 1)
    empty = [t.limit(0) for t in (listing, contents, held)]
    assert ingestion.full_run(*empty)[0].collect() == [] and tuple(ingestion.full_run(*empty)[1].first()) == (0, 0, 0, 0, 0, 0, 0)
