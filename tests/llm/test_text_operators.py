"""Toxicity, language identification, media, PII: fixtures with known answers and awkward rows."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import langid, media, pii, toxicity

from .helpers import AWKWARD, docs, empty, labels, plain, row


def words(rng, n, stock="lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split()):
    return " ".join(rng.choice(stock) for _ in range(n))


def test_toxicity_held_out_and_awkward(spark):
    rng = random.Random(1)
    pairs, marks = [], []
    for i in range(600):
        bad = i % 3 == 0
        text = words(rng, 40)
        if bad:
            text = f"{text} {rng.choice(['idiot', 'id1ot', 'іdіot', 'moron'])} {words(rng, 30)}"
        pairs.append((i, text))
        marks.append((i, 1, int(bad)))
    found = toxicity.toxicity(spark, plain(spark, pairs + [(1000, None), (1001, "")]), labels(spark, [*marks, (None, 1, 1), (5000, 1, None)])).collect()
    held = [r for r in found if r.held_out and r.doc_id < 600]
    assert held and sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    rows = toxicity.toxicity(spark, docs(spark), labels(spark, [])).collect()
    assert len(rows) == len(AWKWARD) and {r.predicted for r in rows} == {0}
    assert toxicity.toxicity(spark, empty(spark), labels(spark, marks)).collect() == []


def test_toxicity_exceptions_spare_a_hit():
    lexicon = toxicity.Lexicon({" idiot ": 3.0}, (" not idiot ",), (0, 0, 0))
    hits = lambda t: toxicity.hits(lexicon.matcher(), toxicity.fold(t))
    assert len(hits("you idiot you")) == 1 and hits("you not idiot you") == [] and len(hits("1D10T!")) == 1


def test_toxicity_hits_equal_plain_search():
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("ab  ") for _ in range(n))
    for _ in range(200):
        weights = {f" {say(rng.randrange(1, 4)).strip() or 'a'}{rng.choice(['', ' '])}": rng.choice([1.0, 2.0, 3.0]) for _ in range(4)}
        exceptions = tuple(f" {say(rng.randrange(2, 7)).strip() or 'b'} " for _ in range(3))
        exceptions = tuple(p for p in exceptions if p not in weights)
        text = f" {say(40)} "
        best = {}
        for entry, weight in weights.items():
            for at in range(len(text)):
                if text.startswith(entry, at) and (at not in best or (weight, -len(entry)) > (best[at][1], -best[at][0])):
                    best[at] = (len(entry), weight)
        spared = [(at, at + len(p)) for p in exceptions for at in range(len(text)) if text.startswith(p, at)]
        want = [(s, s + n, w) for s, (n, w) in sorted(best.items()) if not any(a <= s and s + n <= b + 1 for a, b in spared)]
        assert toxicity.hits(toxicity.Lexicon(weights, exceptions, (0, 0, 0)).matcher(), text) == want


def test_toxicity_many_hits_and_exceptions():
    """A million places where a comparison of all hits with all phrases would not end."""
    automaton = toxicity.Lexicon({" idiot ": 3.0}, (" not idiot ",), (0, 0, 0)).matcher()
    assert len(toxicity.hits(automaton, toxicity.fold("not idiot so idiot and " * 100_000))) == 100_000


def test_langid_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    model = langid.new_model(["a", "b", "c"], 5)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (1, 5, 0, 127, 128, 129, 500)]
    gate = lambda x: np.clip(x / 4 + 0.5, 0, 1)
    h = langid.HIDDEN

    def states(k, codes):
        state, out = np.zeros(h), []
        for code in codes:
            drive = model.inputs[k][:, code].astype(float)
            z, r = gate(drive[:h] + model.recurrent[k][:h] @ state), gate(drive[h : 2 * h] + model.recurrent[k][h : 2 * h] @ state)
            state = state + z * (np.tanh(drive[2 * h :] + model.recurrent[k][2 * h :] @ (r * state)) - state)
            out.append(state)
        return out

    want = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        for at in range(0, len(text), langid.SEGMENT):
            part = text[at : at + langid.SEGMENT]
            for f, b in zip(states(0, part), reversed(states(1, part[::-1]))):
                p = np.exp(model.output @ np.concatenate((f, b)) + model.bias)
                want[i] += p / p.sum()
        want[i] /= max(1, len(text))
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = langid.predict(model, data, np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    assert np.allclose(got, want, atol=1e-4)


def test_langid_gradients():
    rng = np.random.default_rng(0)
    model = langid.new_model(["a", "b"], 3)
    codes, target = rng.integers(0, 257, (6, 3)), np.array([0, 1, 1])
    _, grads = langid.loss_and_gradients(model, codes, target)
    for p, g in zip(model.parameters(), grads):
        i = tuple(rng.integers(0, s) for s in p.shape)
        if p.shape[-1] == 257:
            i = (i[0], codes[2, 0])
        old = p[i]
        p[i] = old + 1e-2
        up, _ = langid.loss_and_gradients(model, codes, target)
        p[i] = old - 1e-2
        down, _ = langid.loss_and_gradients(model, codes, target)
        p[i] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[i]), abs=2e-3)


def test_langid_accuracy_and_awkward(spark, data):
    known = spark.read.parquet(f"{data}/documents.parquet")
    got = langid.identify(spark, known, langid.learn(known)).join(known.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(got)
    table = docs(spark)
    rows = langid.identify(spark, table, langid.learn(table)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(AWKWARD) and by[2].lang_pred == by[3].lang_pred == by[4].lang_pred == "und" and by[2].score == 0
    assert by[6].lang_pred == "en" and 0 <= by[6].score <= 1
    assert langid.identify(spark, empty(spark), langid.learn(empty(spark))).collect() == []


def test_media_round_trip_and_awkward(spark, tmp_path):
    for n in (0, 1, 191, 192, 193, 192 * 8, 192 * 9 + 5, 50_000, 3_000_001):
        raw = bytes(i * 7 % 256 for i in range(n))
        for image, mark in (("ppm", b"P6"), ("bmp", b"BM")):
            size, stored, back, tile, feature = media.media_row(raw, image)
            assert back == media.pad(raw) and size == n and len(back) % 192 == 0 and back and len(feature) == 16
            assert np.load(io.BytesIO(tile)).shape == media.TILE and stored[:2] == mark
    gray = np.arange(40.0).reshape(5, 8)
    assert media.area_resize(gray, (1, 1))[0, 0] == pytest.approx(gray.mean())
    assert np.allclose(media.area_resize(gray, (5, 8)), gray)
    rows = media.media_columns(spark, docs(spark)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(AWKWARD) and by[2].payload_bytes == 192 and by[2].media_sha256 == by[3].media_sha256
    assert by[6].payload_sha256 == by[7].payload_sha256 == hashlib.sha256(media.pad(AWKWARD[6][1].encode())).hexdigest()
    for r in rows:
        assert media.decode(r.media).tobytes()[: r.n_bytes] == (next(t for i, t, *_ in AWKWARD if i == r.doc_id) or "").encode()
    assert media.media_columns(spark, empty(spark), "bmp").collect() == []
    assert {r.feature for r in media.media_columns(spark, docs(spark), "bmp").collect()} == {r.feature for r in rows}
    media.write_tiles(media.media_columns(spark, docs(spark)), str(tmp_path / "tiles"))
    for r in spark.read.parquet(str(tmp_path / "tiles")).collect():
        assert np.load(io.BytesIO(r.tiles_npy)).shape == (len(r.doc_ids), *media.TILE)


def test_media_features_equal_plain_loops():
    rng = random.Random(5)
    for height, width, shape in ((7, 11, (3, 4)), (8, 9, (8, 9)), (3, 64, (8, 9)), (40, 64, (8, 9))):
        gray = np.array([[rng.randrange(256) for _ in range(width)] for _ in range(height)], float)
        got = media.area_resize(gray, shape)
        for r in range(shape[0]):
            for c in range(shape[1]):
                top, bottom, left, right = r * height / shape[0], (r + 1) * height / shape[0], c * width / shape[1], (c + 1) * width / shape[1]
                total = 0.0
                for y in range(height):
                    for x in range(width):
                        total += gray[y, x] * max(0, min(y + 1, bottom) - max(y, top)) * max(0, min(x + 1, right) - max(x, left))
                assert got[r, c] == pytest.approx(total / ((bottom - top) * (right - left)), abs=1e-6)
    tile = np.array([[rng.randrange(256) for _ in range(9)] for _ in range(8)], np.uint8)
    bits = "".join("1" if tile[r, c + 1] > tile[r, c] else "0" for r in range(8) for c in range(8))
    assert media.difference_hash(tile) == f"{int(bits, 2):016x}"


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in KINDS for m in re.finditer(p, text or "") if ok(m.group())]


def test_pii_base_spans_equal_the_contract(spark):
    rng = random.Random(3)
    bits = ["a@b.co", "x_y@e.f_g@h.i", "é 1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (222) 333-4444", "+49 1", "007.0008.1.1", "word", "😀", "@", "+", ".", " ", "12", "a" * 300, "9" * 400, "call me at (555) 123-4567", "mail bob (at) site (dot) org", "James Smith"]
    pairs = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", "-", "."]) for _ in range(rng.randrange(12)))) for i in range(300)] + [(900, None), (901, "")]
    got = {r.doc_id: r.pii for r in pii.find_pii(plain(spark, pairs)).collect()}
    for i, text in pairs:
        own = [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in got[i] if s.base]
        assert own == base(text), text


def test_pii_awkward_and_redaction(spark):
    rows = pii.find_pii(docs(spark)).collect()
    assert len(rows) == len(AWKWARD) and all(isinstance(r.pii, list) for r in rows)
    assert pii.find_pii(empty(spark)).collect() == []
    table = docs(spark, [row(1, "😀 write a@b.co, or 1.2.3.4!"), row(2, None), row(3, "clean")])
    clean = {r.doc_id: r for r in pii.redact(table).collect()}
    assert clean[1].text == "😀 write [EMAIL], or [IP]!" and clean[2].text is None and clean[3].text == "clean"
    assert pii.redact(table).columns == table.columns and {r.pii for r in pii.redact(table).collect()} == {"z"}
    clash = table.withColumn("_pii_found", F.lit(1)).withColumn("_pii_spans", F.lit(2)).withColumn("_pii_email", F.lit(3))
    assert {(r._pii_found, r._pii_spans, r._pii_email, r.pii) for r in pii.redact(clash).collect()} == {(1, 2, 3, "z")}


def test_pii_of_many_matches(spark):
    """Places and redaction over several runs, in a text where a fold over all matches would copy 10^8 spans."""
    unit = "mail a@b.co or 1.2.3.4, 123-45-6789 "
    text = "é" + unit * 5_000
    found = pii.find_pii(plain(spark, [(1, text)])).first().pii
    own = [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in found if s.base]
    assert own == base(text) and len(own) == 10_000
    marks = pii.redact(plain(spark, [(1, text)])).first().text
    assert marks.count("[EMAIL]") == marks.count("[IP]") == 5_000 and marks.startswith("émail [EMAIL] or [IP], ") and not re.search("[0-9@]{2}", marks.replace("123-45-6789", ""))


def test_pii_names_by_title_or_list(spark):
    pairs = [(1, "we met Mr. Zyxel Quorn and Dr Vant."), (2, "so Anna Vant wrote"), (3, "Then Zyxel Quorn left")]
    table = plain(spark, pairs).select("doc_id", "text")
    got = {r.doc_id: [text[c.start : c.end] for c in r.c if pii.KINDS[c.kind] == "name"] for r in pii.candidates(table, "c").collect() for text in [r.text]}
    assert got == {1: ["Zyxel Quorn", "Vant"], 2: ["Anna Vant"], 3: []}


def test_pii_long_runs_stay_linear(spark):
    """Runs on which a restarting search would need 10^10 steps."""
    text = "a" * 200_000 + " " + "9" * 200_000 + " x@y.z " + "." * 100_000
    assert [(r.kind, r.start) for r in pii.find_pii(plain(spark, [(1, text)])).selectExpr("inline(pii)").collect()] == [(0, 400_002)]


def test_em_recovers_reliable_labelers():
    patterns = [((0, 1, 1, 1, 0, 0), 80), ((0, 1, 0, 1, 0, 0), 20), ((0, -1, 0, 0, -1, -1), 90), ((0, 1, 0, 0, -1, -1), 10)]
    post, rate = pii.reliabilities(patterns)
    assert post[patterns[0][0]] > 0.9 and post[patterns[2][0]] < 0.1
    assert rate[2, 1, 1] > rate[2, 0, 1]
