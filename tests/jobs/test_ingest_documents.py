"""Incremental ingestion over a growing folder, broken runs and repeated batches."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.streaming import intake as I
from jobs import ingest_documents as J

PARA = "\n".join(f"Paragraph {i}. " + "word " * 120 for i in range(30))


def land(spark, folder, name, rows):
    """One more file of the growing folder, later than those before."""
    made = folder.parent / f"made-{name}"
    spark.createDataFrame(rows, I.SOURCE).coalesce(1).write.parquet(str(made))
    folder.mkdir(exist_ok=True)
    (part,) = made.glob("part-*.parquet")
    target = folder / f"{name}.parquet"
    part.rename(target)
    os.utime(target, (1_700_000_000 + len(list(folder.iterdir())), 1_700_000_000 + len(list(folder.iterdir()))))


def doc(i, text):
    return (i, text, "en", "s", None if text is None else len(text))


def config(tmp_path):
    return {"input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "ck")}


def versions(spark, c):
    return {r.doc_id: (r.version, r.status, r.retry_count, r.parents, r.main) for r in I.registry(spark, c["output"]).collect()}


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("part-*")}


def test_two_runs_over_growing_input(spark, tmp_path):
    c = config(tmp_path)
    land(spark, tmp_path / "in", "a", [doc(1, "one line"), doc(2, None), doc(3, PARA), doc(4, " \n "), doc(None, "without id")])
    first = J.run(spark, c)
    assert [(b["documents"], b["new"], b["failed"]) for b in first] == [(5, 5, 2)]
    unnamed = next(k for k in versions(spark, c) if k.startswith("doc_"))
    assert versions(spark, c) == {"1": (1, "indexed", 0, 1, 0), "2": (1, "failed", 1, 0, 0), "3": (1, "indexed", 0, 5, 30), "4": (1, "failed", 1, 0, 0), unnamed: (1, "indexed", 0, 1, 0)}
    before = files(tmp_path / "out")
    assert J.run(spark, c) == [] and files(tmp_path / "out") == before
    land(spark, tmp_path / "in", "b", [doc(1, "one line"), doc(2, "now with text"), doc(3, "changed\nshort"), doc(4, None), doc(5, "new"), doc(5, "new"), doc(None, "without id")])
    (second,) = J.run(spark, c)
    assert (second["documents"], second["new"], second["failed"]) == (4, 1, 1)
    assert versions(spark, c) == {"1": (1, "indexed", 0, 1, 0), "2": (2, "indexed", 1, 1, 0), "3": (2, "indexed", 0, 1, 0), "4": (2, "failed", 2, 0, 0), "5": (1, "indexed", 0, 1, 0), unnamed: (1, "indexed", 0, 1, 0)}
    assert {p: t for p, t in files(tmp_path / "out").items() if p in before} == before
    texts = {(r.doc_id, r.text) for r in I.collection(spark, c["output"], "parent").collect()}
    assert texts == {("1", "one line"), ("2", "now with text"), ("3", "changed\n\nshort"), ("5", "new"), (unnamed, "without id")}
    assert I.collection(spark, c["output"], "main").count() == 0


def test_of_several_rows_in_a_batch_the_latest_file_counts(spark, tmp_path):
    c = config(tmp_path)
    for name, text in (("a", "zzz"), ("b", "aaa"), ("c", "mmm")):
        land(spark, tmp_path / "in", name, [doc(1, text), doc(2, "b"), doc(2, "c")])
    assert [b["documents"] for b in J.run(spark, c)] == [2]
    assert {r.doc_id: r.text for r in I.collection(spark, c["output"]).collect()}["1"] == "mmm"


def test_three_batches_with_a_forced_replay_equal_one(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", F.lit(None).cast("string").alias("stamp"))
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    I.take_in(docs, 0, whole)
    for k in range(3):
        I.take_in(docs.where(f"doc_id % 3 = {k}"), k, parts)
    before = files(parts)
    I.take_in(docs.where("doc_id % 3 = 1"), 1, parts)
    assert {p: t for p, t in files(parts).items() if "segment=1" not in p} == {p: t for p, t in before.items() if "segment=1" not in p}
    for found in (lambda f: I.registry(spark, f).drop("segment"), lambda f: I.collection(spark, f).drop("segment")):
        key = lambda f: sorted(map(repr, found(f).collect()))  # noqa: E731, B023
        assert key(whole) == key(parts)


def test_a_run_that_breaks_off_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    c = {**config(tmp_path), "files_per_batch": 1}
    for name, n in (("a", 1), ("b", 2), ("c", 3)):
        land(spark, tmp_path / "in", name, [doc(n, f"text {n}"), doc(9, f"nine {n}")])
    write = I.write_segment

    def broken(rows, folder, segment, *parts):
        if segment == 1 and folder.endswith("registry"):
            raise OSError("lost")
        write(rows, folder, segment, *parts)

    monkeypatch.setattr(I, "write_segment", broken)
    with pytest.raises(Exception):
        J.run(spark, c)
    # Chunks of the broken batch are there, but no version names them.
    assert {r.doc_id for r in I.collection(spark, c["output"]).collect()} == {"1", "9"} and versions(spark, c)["9"][0] == 1
    monkeypatch.setattr(I, "write_segment", write)
    assert [b["batch"] for b in J.run(spark, c)] == [1, 2]
    assert {k: v[0] for k, v in versions(spark, c).items()} == {"1": 1, "2": 1, "3": 1, "9": 3}
    assert {(r.doc_id, r.text) for r in I.collection(spark, c["output"]).collect()} == {("1", "text 1"), ("2", "text 2"), ("3", "text 3"), ("9", "nine 3")}


def test_command_line(spark, tmp_path):
    c = config(tmp_path)
    land(spark, tmp_path / "in", "a", [doc(1, "one line")])
    (tmp_path / "c.json").write_text(json.dumps({**c, "output": "nowhere"}))
    root = Path(__file__).resolve().parents[2]
    env = os.environ | {"PYTHONPATH": str(root), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", "jobs.ingest_documents", "--config", str(tmp_path / "c.json"), "--output", c["output"]], cwd=root, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "1 batches, 1 documents, 1 chunks written to" in done.stderr
    assert versions(spark, c) == {"1": (1, "indexed", 0, 1, 0)}


def test_a_batch_is_computed_once(spark, tmp_path):
    """Also when it compares with segments of the registry that it then writes to."""
    seen = spark.sparkContext.accumulator(0)

    def passed(text):
        seen.add(1)
        return text

    counted = F.udf(passed, "string").asNondeterministic()
    rows = spark.createDataFrame([(i, f"line {i}\nother line of {i}", "en", "s", None) for i in range(30)], "doc_id long, text string, lang string, source string, stamp string")
    for k in range(2):
        before = seen.value
        done = I.take_in(rows.withColumn("text", F.concat(counted("text"), F.lit(f" in batch {k}"))), k, str(tmp_path / "out"))
        assert (done["documents"], done["new"], seen.value - before) == (30, 30 * (k == 0), 30)
