"""Byte-level BPE, packing, chat formatting."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest

from docloom.llm import byte_bpe, chat_format, packing

from .helpers import AWKWARD, LONG, docs, empty, plain


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.vocabulary_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=byte_bpe.pattern(), mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, library):
    rng = random.Random(4)
    texts = ["", None, "hello   world\n\n\tx   y　z '", "don't 123abc_é ñ😀😀 \x85 q" + "a" * 300, " " * 50, "<|endoftext|>", "A" * 3000, "\x1c\x1d x", LONG]
    texts += ["".join(chr(rng.choice([32, 10, 39, 97, 101, 115, 116, 0xE9, 0x4E2D, 0x1F600, 48])) for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = {r.doc_id: r for r in byte_bpe.byte_bpe(spark, plain(spark, list(enumerate(texts))), with_ids=True).collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert list(rows[i].token_ids) == ids
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def own():
    return byte_bpe.Encoder(byte_bpe.vocabulary_path())


def test_bpe_of_long_words(own, library):
    rng = random.Random(6)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    words = [c * n for c in "a-=_.0 *#" for n in (65, 96, 129, 1000)] + [letters[:n] for n in (65, 300, 200_000)]
    words += ["-=" * 500, "中文" * 300, "thequickbrownfox" * 50, ("-" * 70 + "=" * 33) * 20, "-" * 37 + "_" * 900 + "#" * 900, "é" * 999]
    words += ["".join(rng.choice(["-", "=", "ab", "-" * 16, "_" * 7, "é", "x"]) for _ in range(rng.randrange(60, 400))) for _ in range(60)]
    for word in words:
        assert own.contract_long(word.encode()).tolist() == library._core_bpe.encode_single_piece(word.encode()), word[:40]


def test_bpe_of_long_texts(spark, library):
    """One text beyond every step's size, and many of 50 kB in one batch."""
    rng = random.Random(8)
    stock = [rng.choice(["the", "Haus", "été", "x1", "12345", "\n\n", "don't", "😀", "  "]) + str(rng.randrange(3000)) for _ in range(5000)]
    say = lambda n: " ".join(rng.choice(stock) for _ in range(n))
    texts = [say(700_000), "a" * 1_000_000, *[say(6_000) for _ in range(40)]]
    assert len(texts[0]) > 10 * byte_bpe.LONG_TEXT and len(texts[5]) < byte_bpe.LONG_TEXT
    for r in byte_bpe.byte_bpe(spark, plain(spark, list(enumerate(texts)))).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_decodes_in_steps(own):
    """Many documents and one of several steps share the decoder's memory."""
    ids = np.arange(50_000, dtype=np.int32)
    ids = np.concatenate([ids] * 60)
    bounds = np.array([0, 0, 10, 2_999_990, 3_000_000])
    want = [hashlib.sha256(b"".join(own.tokens[i] for i in ids[a:b].tolist())).hexdigest() for a, b in zip(bounds, bounds[1:])]
    assert own.decoded_sha256(ids, bounds) == want


def test_bpe_awkward(spark):
    assert byte_bpe.byte_bpe(spark, docs(spark)).count() == len(AWKWARD)
    assert byte_bpe.byte_bpe(spark, empty(spark)).collect() == []


def test_best_fit_decreasing_equals_a_scan():
    rng = random.Random(0)
    for _ in range(200):
        lengths = [rng.randint(1, 20) for _ in range(rng.randrange(40))]
        rows = packing.best_fit_decreasing(lengths, 20)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        rooms = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [k for k, room in enumerate(rooms) if room >= lengths[i]]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= lengths[i]
            else:
                rooms.append(20 - lengths[i])
        assert sorted(rooms) == sorted(20 - sum(lengths[i] for i in r) for r in rows)


def test_packing_query_returns_ids_and_positions(spark, data):
    for r in packing.op3_packing(spark, data).limit(20).collect():
        ids, positions = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.positions, "<i4")
        assert len(ids) == len(positions) == packing.ROW_TOKENS
        assert hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and hashlib.sha256(r.positions).hexdigest() == r.positions_sha256
        assert all(positions[a] == 0 and (np.diff(positions[a:b]) == 1).all() for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]))


def test_packing_is_lossless(spark, tmp_path):
    packed = packing.pack(spark, docs(spark), capacity=512)
    back = {}
    for r in packed.collect():
        ids, positions = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.positions, "<i4")
        assert len(ids) == 512 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == packing.PAD).all()
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (positions[a:b] == np.arange(b - a)).all()
            back.setdefault(doc, []).append((start, ids[a:b]))
    tokens = byte_bpe.read_ranks(byte_bpe.vocabulary_path())
    text = lambda doc: b"".join(tokens[i] for _, part in sorted(back[doc], key=lambda p: p[0]) for i in part).decode()
    assert text(6) == LONG and text(8) == LONG + " tail" and text(None) == "text without id of a few words"
    assert not {2, 3} & set(back) and len(back[1]) == 2
    packing.write_packed(packed, str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed")).count() == packed.select("bucket").distinct().count()
    assert packing.pack(spark, empty(spark)).collect() == []


def test_packing_parts_of_a_bucket():
    import pyarrow as pa

    texts = ["one two three " * n for n in (1, 9, 30, 2, 2, 9, 4, 0, 5)]
    work = packing._work(byte_bpe.vocabulary_path(), 16, True, held_tokens=64)
    words = [[w for g in byte_bpe.word_groups(t) for w in g] for t in texts]
    batch = pa.record_batch([pa.array([0] * 5 + [3] * 4), pa.array(list(range(9))), pa.array([1] * 9), pa.array(words, pa.list_(pa.string())), pa.array([None] * 9, pa.string())], names=["bucket", "doc_id", "copies", "words", "long"])
    rows = [r for b in work(iter([batch])) for r in b.to_pylist()]
    for bucket in (0, 3):
        assert [r["row"] for r in rows if r["bucket"] == bucket] == list(range(sum(r["bucket"] == bucket for r in rows)))
    segments = sorted((d, s, r["ids"][4 * a : 4 * b]) for r in rows for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]))
    tokens = byte_bpe.read_ranks(byte_bpe.vocabulary_path())
    for doc, text in enumerate(texts):
        assert b"".join(tokens[i] for d, _, part in segments if d == doc for i in np.frombuffer(part, "<i4")).decode() == text


def test_repeated_rows_share_no_bucket(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_DOCS", 50)
    monkeypatch.setattr(packing, "TOGETHER", 8)
    packed = packing.pack(spark, plain(spark, [(1, "same words here")] * 400), capacity=64)
    assert packed.select("bucket").distinct().count() > 4 and packed.selectExpr("sum(size(doc_ids))").first()[0] == 400


def test_packing_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_DOCS", 10)
    rows = [(i % 70, f"text {i % 70} " * (i % 9)) for i in range(200)] + [(None, "x")] * 130
    key = lambda frame: sorted(map(repr, packing.pack(spark, frame, capacity=32).collect()))
    one = plain(spark, rows)
    assert key(one.repartition(1)) == key(one.repartition(7, "text")) == key(plain(spark, rows[::-1]).repartition(3))


def test_words_are_split_as_the_library_does_at_every_code_point(spark, library):
    from docloom.llm.char_classes import every_character

    chars, step = every_character(), 2000
    texts = ["\n".join(f"X{c}'s {c}1" for c in chars[i : i + step]) for i in range(0, len(chars), step)]
    frame = plain(spark, list(enumerate(texts))).repartition(4)
    assert max(map(len, texts)) < byte_bpe.LONG_TEXT
    for r in byte_bpe.byte_bpe(spark, frame).collect():
        want = library.encode_ordinary(texts[r.doc_id])
        assert r.ids_sha256 == byte_bpe.ids_sha256(np.array(want))
    # The module that splits longer texts cuts the same words.
    for r in byte_bpe.split_words(frame, ["doc_id"]).select("doc_id", "words").collect():
        assert r.words == [w for group in byte_bpe.word_groups(texts[r.doc_id]) for w in group]


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int, source string, t int")


def test_chat_round_trip_of_control_strings(spark):
    rng = random.Random(7)
    bits = ["</s>", "<s>", "<^/s>", "[INST]", "[/INST]", "[^^INST]", "<<SYS>>", "<</SYS>>", "<", "[", "^", "/", "s>", "#1\n", "ok", " ", "\n", "é", "<s", "<<"]
    make = lambda n: "".join(rng.choice(bits) for _ in range(rng.randrange(n)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", make(3)]), make(9), 1, "x", 2) for c in range(120) for t in range(rng.randrange(1, 6))]
    got = {r.conv_id: r for r in chat_format.format_conversations(chats(spark, rows)).collect()}
    for c in {r[0] for r in rows}:
        assert got[c].round_trip
        own = [(r[2], r[3]) for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert [(t.role, t.text) for t in got[c].turns] == own
        # Every control string in the rendering is a mark of the template.
        marks = [m for role, _ in own for m in ("<s>", "<<SYS>>", "<</SYS>>", *(["[INST]", "[/INST]"] if role != "assistant" else []), "</s>")]
        assert re.findall(r"</?s>|\[/?INST\]|<</?SYS>>", got[c].formatted) == marks


def test_chat_awkward(spark):
    rows = [(1, 0, "user", None, 0, "", 0), (1, 1, None, "x", 0, "", 0), (1, 1, None, "x", 0, "", 0), (None, 0, "assistant", "y", 0, "", 0), (2, None, "assistant", "b", 0, "", 0), (2, 0, "assistant", "a" * 100_000, 0, "", 0)]
    got = {r.conv_id: r for r in chat_format.format_conversations(chats(spark, rows)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", ""), ("", "x"), ("", "x")]
    assert got[None].turns[0].text == "y" and got[2].turns[0].text == "b" and all(r.round_trip for r in got.values())
    assert chat_format.format_conversations(chats(spark, [])).collect() == []
