"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on segments that are drawn from the
whole texts of a bounded sample of labelled documents; at inference every byte of every
text gets a distribution over the languages from the states of both directions, and a
document's probability is their mean. Texts run through the network in segments of
``SEGMENT`` bytes, at whose borders both directions start anew, thousands of segments
abreast: a step is a few matrix operations whatever the length of a text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import short_batches, table, text_bytes

HIDDEN = 8
SEGMENT = 128
#: Segments that step through the network together, fewer with more than eight languages.
ABREAST = 8192
#: Labelled documents to learn from: about this many of each language, by a hash of doc_id.
TRAIN_DOCS = 150
#: Places in each of them, anywhere in its text, of two segments' length.
TRAIN_PLACES = 32
STEPS, BATCH, RATE = 260, 192, 0.02
UNKNOWN = "und"


@dataclass
class Model:
    """Per direction: input table (3H, 256), recurrent weights (3H, H); output weights (C, 2H) and bias."""

    langs: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    output: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, self.output, self.bias]


def new_model(langs: list[str], seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    return Model(langs, [draw(3 * HIDDEN, 257) for _ in range(2)], [draw(3 * HIDDEN, HIDDEN) for _ in range(2)], draw(len(langs), 2 * HIDDEN), np.zeros(len(langs), np.float32))


def _gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid, in place."""
    x *= np.float32(0.25)
    x += np.float32(0.5)
    return np.clip(x, 0, 1, out=x)


def _step(table, weights, codes, state):
    """One step of gated recurrence for all columns: update and reset gates, candidate, new state."""
    drive = table[:, codes]
    gates = _gate(drive[: 2 * HIDDEN] + weights[: 2 * HIDDEN] @ state)
    z, r = gates[:HIDDEN], gates[HIDDEN:]
    candidate = np.tanh(drive[2 * HIDDEN :] + weights[2 * HIDDEN :] @ (r * state))
    return z, r, candidate, state + z * (candidate - state)


def loss_and_gradients(model: Model, codes: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all positions (codes: time x columns, 256 is padding) and gradients of all parameters."""
    steps, width = codes.shape
    used = codes != 256
    runs = []
    for k in range(2):
        order = range(steps) if k == 0 else range(steps - 1, -1, -1)
        state, trace = np.zeros((HIDDEN, width), np.float32), [None] * steps
        for t in order:
            z, r, c, new = _step(model.inputs[k], model.recurrent[k], codes[t], state)
            new = np.where(used[t], new, state)
            trace[t] = (state, z, r, c, new)
            state = new
        runs.append((order, trace))
    hidden = np.stack([np.concatenate((runs[0][1][t][4], runs[1][1][t][4])) for t in range(steps)])
    logits = model.output @ hidden + model.bias[None, :, None]
    logits -= logits.max(axis=1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=1, keepdims=True)
    n = max(1, int(used.sum()))
    column = np.arange(width)
    loss = -float((np.log(prob[:, target, column] + 1e-9) * used).sum()) / n
    error = prob
    error[:, target, column] -= 1
    error *= used[:, None, :] / n
    d_output = np.tensordot(error, hidden, ((0, 2), (0, 2)))
    d_hidden = model.output.T @ error
    grads_in, grads_rec = [], []
    for k in range(2):
        order, trace = runs[k]
        weights = model.recurrent[k]
        drives, d_weights = np.zeros((3 * HIDDEN, steps, width), np.float32), np.zeros_like(weights)
        carry = np.zeros((HIDDEN, width), np.float32)
        for t in reversed(list(order)):
            state, z, r, c, _ = trace[t]
            live = used[t]
            grad = (d_hidden[t, k * HIDDEN : (k + 1) * HIDDEN] + carry) * live
            d_c = grad * z * (1 - c * c)
            d_z = grad * (c - state) * (np.float32(0.25) * ((z > 0) & (z < 1)))
            through = weights[2 * HIDDEN :].T @ d_c
            d_r = through * state * (np.float32(0.25) * ((r > 0) & (r < 1)))
            gates = np.concatenate((d_z, d_r))
            carry = (carry * ~live) + grad * (1 - z) + through * r + weights[: 2 * HIDDEN].T @ gates
            d_weights[: 2 * HIDDEN] += gates @ state.T
            d_weights[2 * HIDDEN :] += d_c @ (r * state).T
            drives[: 2 * HIDDEN, t], drives[2 * HIDDEN :, t] = gates, d_c
        # The gradient of a byte's column is the sum over the places that have the byte.
        grads_in.append(np.stack([np.bincount(codes.ravel(), weights=row.ravel(), minlength=257) for row in drives]).astype(model.inputs[k].dtype))
        grads_rec.append(d_weights)
    return loss, [*grads_in, *grads_rec, d_output, error.sum(axis=(0, 2))]


def train(texts: list[tuple[bytes, str]], steps: int = STEPS, seed: int = 11) -> Model:
    """Adam over random segments of the sample, languages drawn evenly."""
    langs = sorted({lang for _, lang in texts})
    model = new_model(langs, seed)
    rng = np.random.default_rng(seed)
    own = [[np.frombuffer(raw, np.uint8) for raw, lang in texts if lang == name and raw] or [np.array([32], np.uint8)] for name in langs]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    for step in range(1, steps + 1):
        target = rng.integers(0, len(langs), BATCH)
        codes = np.full((SEGMENT, BATCH), 256, np.int64)
        for b, lang in enumerate(target):
            raw = own[lang][rng.integers(len(own[lang]))]
            at = int(rng.integers(0, max(1, len(raw) - SEGMENT // 2)))
            part = raw[at : at + SEGMENT]
            codes[: len(part), b] = part
        _, grads = loss_and_gradients(model, codes, target)
        rate = RATE * min(1.0, 2.2 - 2 * step / steps)
        for p, g, (m, v) in zip(model.parameters(), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def predict(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean over each row's positions of the class probabilities: rows x classes; rows without bytes get zeros."""
    n_rows, classes = len(offsets) - 1, len(model.langs)
    size = np.diff(offsets)
    pieces = -(-size // SEGMENT)
    row = np.repeat(np.arange(n_rows), pieces)
    begin = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
    length = np.minimum(SEGMENT, offsets[row + 1] - begin)
    total = np.zeros((n_rows, classes))
    # Longest first, so that those still running at a step are the first columns.
    order = np.argsort(-length, kind="stable")
    columns = max(64, ABREAST * 8 // max(8, classes))
    for lo in range(0, len(order), columns):
        part = order[lo : lo + columns]
        top = int(length[part[0]])
        live = np.searchsorted(-length[part], -np.arange(top), side="left")
        at = np.minimum(begin[part][:, None] + np.arange(top), len(data) - 1)
        codes = np.ascontiguousarray(data[at].T)
        logits = np.zeros((top, classes, len(part)), np.float32)
        for k in range(2):
            weights = model.output[:, k * HIDDEN : (k + 1) * HIDDEN]
            state = np.zeros((HIDDEN, len(part)), np.float32)
            for t in range(top) if k == 0 else range(top - 1, -1, -1):
                m = live[t]
                state[:, :m] = _step(model.inputs[k], model.recurrent[k], codes[t, :m], state[:, :m])[3]
                logits[t, :, :m] += weights @ state[:, :m]
        logits += model.bias[:, None]
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        logits *= (np.arange(top)[:, None] < length[part])[:, None, :]
        np.add.at(total, row[part], logits.sum(axis=0).T)
    return total / np.maximum(size, 1)[:, None]


def _places(count: int):
    """Rows (doc_id, text, lang) -> lang and pieces of the text at ``count`` random places."""

    def work(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            langs, pieces = [], []
            for i, (doc, lang) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                raw = data[offsets[i] : offsets[i + 1]]
                rng = np.random.default_rng(zlib.crc32(str(doc).encode()))
                for at in sorted(set(rng.integers(0, max(1, len(raw) - SEGMENT), count).tolist())):
                    langs.append(lang)
                    pieces.append(raw[at : at + 2 * SEGMENT].tobytes())
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(pieces, pa.binary())], names=["lang", "piece"])

    return work


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, places: int = TRAIN_PLACES) -> Model | None:
    """A model from documents with text and language whose crc32(doc_id) mod 4 is not 2; None without any.

    train_docs bounds the labelled documents of each language, places the pieces of each
    that come to the driver: 8 kB of a document at most, drawn from its whole text.
    """
    short_batches(docs.sparkSession)
    own = F.col("doc_id").cast("string")
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and doc_id is not null").where(F.crc32(own) % 4 != 2)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("doc_id").alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, train_docs / n))).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64(own), F.lit(1 << 30)) < share * (1 << 30)).mapInArrow(_places(places), "lang string, piece binary")
    rows = sorted((r["lang"], bytes(r["piece"])) for r in sample.collect())
    return train([(piece, lang) for lang, piece in rows]) if rows else None


def identify(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    A null text, or one without a letter, is ``und`` with score 0, as is every text
    without a model. A null doc_id stays null and is not held out; repeated rows get
    equal results; an empty table gives an empty result. Of equally likely languages the
    first by name is predicted. Texts of any length are read whole, a bounded number of
    segments at a time; other columns are not read.
    """
    short_batches(spark, 1024)

    def work(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            lettered = batch.column(2).to_pylist()
            if model is None or not len(data):
                names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            else:
                prob = predict(model, data, offsets)
                best = prob.argmax(axis=1)
                names = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                scores = [min(1.0, float(p[b])) if ok else 0.0 for p, b, ok in zip(prob, best, lettered, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double").select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; nulls, empty and long texts as in ``identify``."""
    docs = table(spark, sf_dir, "documents")
    return identify(spark, docs, learn(docs))
