"""Quality classifier by gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage of every text
is encoded: shares of character-class pairs, and how far its words and word windows
repeat in the document. Only documents have labels; gated attention (Ilse, Tomczak and
Welling, 2018) learns how much each passage counts, and the score is that of the
weighted mean of the encoded passages.

The fit runs on a bounded sample (``SAMPLE_EACH`` documents of either label, of at most
``SAMPLE_BYTES``), the scoring on all texts. A text without words scores 0. Equal rows
score alike; null labels are left out; without documents of both labels every text with
a word scores the share of label 1. A column named ``score`` gives way to the new one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orderlake.llm.arrow_text import Words, first_mask, flat, per_row, slices, windows
from orderlake.llm.labelled import labelled_sample
from orderlake.llm.schema import added, without

PASSAGE_WORDS = 64
SAMPLE_EACH = 1500
SAMPLE_BYTES = 1 << 17
HIDDEN, GATE, EPOCHS, RATE, DECAY, SEED = 24, 12, 160, 0.02, 1e-3, 7

CLASSES = 14
LOWER, UPPER, DIGIT, SPACE, NEWLINE, STOP, COMMA, SHOUT, SYMBOL, MARKUP, QUOTE, DASH, FOREIGN, OTHER = range(CLASSES)
FEATURES = CLASSES * CLASSES + 8


def _classes() -> np.ndarray:
    """The class of a code point by its first byte; 255: a later byte, which counts as none."""
    out = np.full(256, OTHER, np.uint8)
    for chars, kind in (
        (b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"0123456789", DIGIT),
        (b" \t\x0b\x0c\r", SPACE), (b"\n", NEWLINE), (b".;:", STOP), (b",", COMMA), (b"!?", SHOUT),
        (b"#$%&*+=~^@", SYMBOL), (b"<>{}[]\\/|`", MARKUP), (b"'\"()", QUOTE), (b"-_", DASH),
    ):
        out[list(chars)] = kind
    out[0xC0:] = FOREIGN
    out[0x80:0xC0] = 255
    return out


_CLASS = _classes()


def encode_passages(texts: pa.Array, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a batch of texts, and each text's bounds among them."""
    data, at = flat(texts)
    words = Words(data, at)
    rows, n = len(at) - 1, len(words.start)
    n_passages = -(-words.count // size)
    bounds = np.concatenate([[0], np.cumsum(n_passages)])
    if not n:
        return np.zeros((0, FEATURES), np.float32), bounds
    within = np.arange(n) - words.first[:-1][words.row]
    passage = bounds[:-1][words.row] + within // size
    total = int(bounds[-1])
    head = np.flatnonzero(np.diff(passage, prepend=-1))
    word_bounds = np.append(head, n)
    # A passage takes the bytes from its first word to the next passage of its text, or to the text's end.
    begin = words.start[head]
    code = _CLASS[data]
    point = np.flatnonzero(code < 255)
    kind = code[point].astype(np.int32)
    width = CLASSES * CLASSES + 1
    pair = np.full(len(point), width - 1, np.int32)
    pair[:-1] = kind[:-1] * CLASSES + kind[1:]
    ends = np.searchsorted(point, at[1:])
    pair[ends[ends > 0] - 1] = width - 1  # a pair does not reach into the next text
    span = np.searchsorted(point, np.append(begin, len(data)))
    owner = np.repeat(np.arange(total, dtype=np.int32), np.diff(span))
    pair = pair[span[0] :]
    wordless = np.flatnonzero((words.count == 0) & (np.diff(at) > 0))
    for r in wordless:
        pair[max(0, np.searchsorted(point, at[r]) - span[0]) : max(0, ends[r] - span[0])] = width - 1
    if words.first[0] == 0 and len(begin):
        # Space before the first word of a text belongs to no passage.
        lead = np.searchsorted(point, at[:-1][words.count > 0]) - span[0]
        first = np.searchsorted(point, words.start[words.first[:-1][words.count > 0]]) - span[0]
        for x, y in zip(lead.tolist(), first.tolist()):
            if y > x >= 0:
                pair[x:y] = width - 1
    pairs = np.bincount(owner * width + pair if total * width < 2**31 else owner.astype(np.int64) * width + pair,
                        minlength=total * width).reshape(total, width)[:, :-1]
    inside = pairs.sum(axis=1)
    pairs = np.sqrt(pairs / np.maximum(inside, 1)[:, None])

    hashes = words.hashes()
    group, sizes = first_mask(words.row, hashes)
    again = sizes[group] - 1
    count = np.diff(word_bounds)
    triples, start = windows(hashes, words.row, 3)
    repeated = np.zeros(n + 3, bool)
    if len(triples):
        group3, sizes3 = first_mask(words.row[start], triples)
        twice = start[sizes3[group3] > 1]
        for k in range(3):
            repeated[twice + k] = True
    same = np.zeros(n, bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    length = words.end - words.start
    local, local_sizes = first_mask(passage, hashes)
    first_here = np.zeros(n, bool)
    first_here[np.unique(local, return_index=True)[1]] = True
    share = lambda x: per_row(x, word_bounds) / count
    extra = np.stack([
        share(again > 0), np.log1p(share(again)), share(repeated[:n]), share(same), share(first_here),
        share(length) / 10.0, np.sqrt(share(length * length)) / 10.0, np.log1p(count) / 5.0,
    ], axis=1)
    return np.concatenate([pairs, extra], axis=1).astype(np.float32), bounds


class Model(NamedTuple):
    """Weights of the encoder (W, c), the gated attention (V, U, w) and the score (o, b); scaling of features."""

    mean: np.ndarray
    scale: np.ndarray
    W: np.ndarray
    c: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    o: np.ndarray
    b: np.ndarray


def _by_bag(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, bounds[:-1], axis=0)


def _forward(p: dict, x: np.ndarray, bounds: np.ndarray):
    bag = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    h = np.tanh(x @ p["W"] + p["c"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * g) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, bounds[:-1])[bag])
    a = e / _by_bag(e, bounds)[bag]
    z = _by_bag(a[:, None] * h, bounds)
    score = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["b"], -30, 30)))
    return bag, h, t, g, a, z, score


def fit(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Weighted logistic loss by Adam over all bags at once; no bag is empty."""
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    x = np.clip((x - mean) / scale, -6, 6)
    p = {
        "W": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "c": np.zeros(HIDDEN),
        "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE),
        "o": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(u) for k, u in p.items()}
    weight = weight / weight.sum()
    for step in range(1, EPOCHS + 1):
        bag, h, t, g, a, z, score = _forward(p, x, bounds)
        d = (weight * (score - y)).astype(np.float32)
        dz = d[:, None] * p["o"]
        da = (h * dz[bag]).sum(axis=1)
        de = a * (da - _by_bag(a * da, bounds)[bag])
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        grad = {
            "W": x.T @ dh, "c": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg,
            "w": (t * g).T @ de, "o": z.T @ d, "b": d.sum(keepdims=True),
        }
        rate = RATE * 0.5 * (1 + np.cos(np.pi * step / EPOCHS))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
            p[k] -= rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8) + DECAY * p[k])
    return Model(mean, scale, **p)


def predict(model: Model, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The score of each bag; 0 for an empty one."""
    out = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        x = np.clip((x - model.mean) / model.scale, -6, 6)
        out[full] = _forward(model._asdict(), x, np.append(bounds[:-1][full], bounds[-1]))[-1]
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", each: int = SAMPLE_EACH) -> Model | float:
    """A model from a bounded sample of the labelled documents, or the share of label 1 if one label is missing."""
    rows, counts = labelled_sample(docs, labels, label, each, SAMPLE_BYTES)
    parts = [encode_passages(pa.array([r[1] for r in rows[i : i + 100]], pa.string())) for i in range(0, len(rows), 100)]
    x = np.concatenate([np.zeros((0, FEATURES), np.float32), *(p[0] for p in parts)])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(p[1]) for p in parts)]))])
    del parts
    full = np.flatnonzero(np.diff(bounds))
    y = np.array([r[2] for r in rows], np.float32)[full]
    if len(set(y.tolist())) < 2:
        return counts.get(1, 0) / max(1, sum(counts.values()))
    # Each label weighs as much as it does among all labelled documents.
    weight = np.array([counts[int(k)] / (y == k).sum() for k in y], np.float32)
    return fit(x, np.append(bounds[:-1][full], bounds[-1]), y, weight)


def score(docs: DataFrame, model: Model | float, keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` from 0 to 1; ``keep`` names the columns that pass through (all by default)."""
    docs = without(docs, ["score"])
    columns = docs.columns
    kept = columns if keep is None else keep
    schema = added(docs.select(kept), [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                x, bounds = encode_passages(batch.column(columns.index("text")))
                if isinstance(model, float):
                    found = np.where(np.diff(bounds) > 0, model, 0.0)
                else:
                    found = predict(model, x, bounds)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(columns.index(c)) for c in kept), pa.array(found, pa.float64())], names=schema.names
                )

    return docs.mapInArrow(run, schema)
