"""The fine-tuning export against a loop over conversations."""

import hashlib
import json

from jobs import export_training_set as J

TURNS = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 1, "assistant", "hello"), (1, 0, "user", "hi"), (1, 2, "user", "  "), (1, 3, None, "no role"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"),
    (4, 0, "user", "only asked"), (5, 0, "assistant", "only said"), (6, 0, "user", "x" * 3000), (6, 1, "assistant", "long"),
    (7, 0, "user", None), (8, 0, "user", "b"), (8, 0, "assistant", "a"), (8, 0, "user", "a"), (None, 0, "user", "lost"), (9, 0, "user", "ünï 😀\n\"q\""), (9, 1, "assistant", "{}"),
]


def by_hand(rows, max_tokens=384, percent=20, seed=42):
    groups, out, seen = {}, {}, set()
    for conv, turn, role, text in rows:
        if conv is not None and (text or "").strip(" "):
            groups.setdefault(conv, []).append((turn, role or "", text))
    for conv, turns in sorted(groups.items()):
        turns.sort()
        text = "\n".join(f"<|im_start|>{r}\n{t}<|im_end|>" for _, r, t in turns)
        roles, tokens = {r for _, r, _ in turns}, max(1, len(text) // 4)
        why = "no user" if "user" not in roles else "no assistant" if "assistant" not in roles else "too long" if tokens > max_tokens else "duplicate" if text in seen else None
        place = int(hashlib.md5(f"{seed}:{conv}".encode()).hexdigest()[:8], 16) % 100
        out[conv] = (len(turns), tokens, None if why in ("no user", "no assistant", "too long") else text, why, "rejected" if why else "validation" if place < percent else "train")
        if why is None:
            seen.add(text)
    return out


def found(spark, output):
    return {r.conv_id: (r.n_turns, r.tokens, r.text, r.reason, r.split) for r in J.read_examples(spark, output).collect()}


def test_awkward_conversations(spark, tmp_path):
    spark.createDataFrame(ROWS, TURNS).repartition(3).write.parquet(str(tmp_path / "in"))
    c = {"input": str(tmp_path / "in"), "output": str(tmp_path / "out")}
    J.run(spark, c)
    assert found(spark, c["output"]) == by_hand(ROWS)
    assert {by_hand(ROWS)[k][3] for k in by_hand(ROWS)} == {None, "no user", "no assistant", "too long", "duplicate"}


def test_reruns_and_growth(spark, data, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    c = {"input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "max_tokens": 200, "validation_percent": 50, "seed": 1}
    spark.createDataFrame(rows[: len(rows) // 2], TURNS).write.parquet(c["input"])
    counts = J.run(spark, c)
    half = found(spark, c["output"])
    assert counts == J.run(spark, c) and found(spark, c["output"]) == half == by_hand(rows[: len(rows) // 2], 200, 50, 1)
    spark.createDataFrame(rows[len(rows) // 2 :], TURNS).write.mode("append").parquet(c["input"])
    J.run(spark, c)
    assert found(spark, c["output"]) == by_hand(rows, 200, 50, 1)
    profile = spark.read.parquet(f"{c['output']}/profile").collect()
    assert sum(r.n for r in profile) == len(found(spark, c["output"]))
    # The files themselves are plain JSON lines in folders by split.
    lines = [json.loads(x) for p in (tmp_path / "out" / "examples" / "split=train").glob("*.json") for x in p.read_text().splitlines()]
    assert {x["conv_id"] for x in lines} == {k for k, v in found(spark, c["output"]).items() if v[4] == "train"}


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(str(tmp_path / "in"))
    c = {"input": str(tmp_path / "in"), "output": str(tmp_path / "out")}
    assert J.run(spark, c) == {}


def test_one_conversation_with_most_rows_is_not_gathered(spark, tmp_path):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(5000)] + ROWS
    frame = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: r.reason for r in J.examples(frame, 384, 20, 42).collect()}
    assert got[1] == "too long" and len(got) == 8
