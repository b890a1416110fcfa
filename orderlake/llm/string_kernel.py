"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

Two strings are alike by the character subsequences of length 3 that they share, each
weighted by ``LAMBDA ** span`` (Lodhi et al., 2002; spans up to ``MAX_SPAN``), so an
insult keeps most of its weight when characters are put in, left out or repeated.
The normalised kernel against landmark strings gives Nyström features, on which a
linear SVM is fitted. It stays a weighted sum of kernel values, so for scoring its
weights are folded once into one weight for each subsequence, which gives the same
sums as the kernel itself.

Units are the words of a sentence, lower-cased, and runs of single letters put together
("i d i o t"). A sentence's value is its greatest unit's, a text's its greatest
sentence's, and a logistic curve makes it a score from 0 to 1. Only documents are
labelled, so the fit takes a toxic document's strongest sentence as its witness, and all
sentences of the others as harmless.

The fit runs on a bounded sample (``SAMPLE_EACH`` documents of either label, of at most
``SAMPLE_BYTES``), the scoring on all texts. Texts without a unit score as the weakest
unit does. Equal rows score alike; null labels are left out; without documents of both
labels every text scores the share of label 1. A column named ``score`` gives way to the
new one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orderlake.llm.arrow_text import Words, flat, slices
from orderlake.llm.labelled import labelled_sample
from orderlake.llm.schema import added, without

LAMBDA, MAX_SPAN = 0.6, 6
SAMPLE_EACH = 2000
SAMPLE_BYTES = 1 << 16
LANDMARKS = 96  # for each label
ROUNDS, C = 3, 4.0
FLOOR = -1.5  # values below it count as it
MIN_DOCS = 3
PART = 20_000  # strings whose subsequences are held at a time

LETTERS = 64


_START = 1  # stands before each string, so that its first letters are told from the same ones elsewhere


def _letters() -> np.ndarray:
    """A number below LETTERS for each byte; 0 for what only counts as a gap."""
    out = np.zeros(256, np.int64)
    for i, c in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
        out[c] = out[c - 32] = i + 1
    for i, c in enumerate(b"0123456789"):
        out[c] = 27 + i
    # Both bytes of a letter beyond ASCII take part; cases of one letter mostly meet by the fold.
    for b in range(0x80, 0xC0):
        out[b] = 37 + (b & 0x1F) % 20
    for b in range(0xC0, 256):
        out[b] = 57 + (b & 0x3F) % 6
    out[_START] = 63
    return out


_LETTER = _letters()
_OFFSETS = [(j, k) for k in range(2, MAX_SPAN) for j in range(1, k)]


class Units(NamedTuple):
    """Letters of many strings one after the other, and where each string begins."""

    letters: np.ndarray
    at: np.ndarray


def units(strings: list[bytes]) -> Units:
    mark = bytes([_START])
    at = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])]).astype(np.int64)
    return Units(_LETTER[np.frombuffer(b"".join(mark + s for s in strings), np.uint8)], at)


def subsequences(u: Units) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(string, subsequence, weight) of all occurrences, span by span."""
    n = len(u.letters)
    owner = np.repeat(np.arange(len(u.at) - 1), np.diff(u.at))
    for j, k in _OFFSETS:
        if n <= k:
            continue
        a, b, c = u.letters[: n - k], u.letters[j : n - k + j], u.letters[k:]
        ok = np.flatnonzero((a > 0) & (b > 0) & (c > 0) & (owner[: n - k] == owner[k:]))
        yield owner[ok], (a[ok] * LETTERS + b[ok]) * LETTERS + c[ok], LAMBDA ** (k + 1)


def feature_rows(u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse feature vectors of strings, each of length 1: (string, subsequence, value)."""
    parts = list(subsequences(u))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key = np.concatenate([o * LETTERS**3 + s for o, s, _ in parts])
    value = np.concatenate([np.full(len(o), w) for o, _, w in parts])
    key, which = np.unique(key, return_inverse=True)
    value = np.bincount(which, value)
    owner, sub = key // LETTERS**3, key % LETTERS**3
    norm = np.sqrt(np.bincount(owner, value**2, minlength=len(u.at) - 1))
    return owner, sub, value / norm[owner]


def kernel(strings: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """The normalised kernel of each string with each landmark."""
    owner, sub, value = feature_rows(units(strings))
    mark, mark_sub, mark_value = feature_rows(units(landmarks))
    out = np.zeros((len(strings), len(landmarks)))
    dense = np.zeros(LETTERS**3)
    for m in range(len(landmarks)):
        mine = mark == m
        dense[mark_sub[mine]] = mark_value[mine]
        out[:, m] = np.bincount(owner, value * dense[sub], minlength=len(strings))
        dense[mark_sub[mine]] = 0
    return out


def document_units(words: Words) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different strings of a batch of texts, and for each use of one: its string and its text."""
    hashes = words.hashes()
    _, example, which = np.unique(hashes, return_index=True, return_inverse=True)
    strings, string, row = words.take(example), which, words.row
    single = np.zeros(0, bool)
    if len(words.start):
        lead = np.concatenate([[0], np.cumsum(words.data & 0xC0 != 0x80)])
        single = (lead[words.end] - lead[words.start] == 1) & (_LETTER[words.data[words.start]] > 0)
    if single.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
        runs, owners = [], []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            for x in _same_row(words.row, a, b):
                if x[1] - x[0] >= 3:
                    span = slice(words.start[x[0]], words.end[x[1] - 1])
                    runs.append(words.data[span][words.solid[span]].tobytes())
                    owners.append(int(words.row[x[0]]))
        if runs:
            string = np.concatenate([string, len(strings) + np.arange(len(runs))])
            row = np.concatenate([row, owners])
            strings = strings + runs
    return strings, string, row


def _same_row(row: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
    cuts = [a, *(a + 1 + np.flatnonzero(np.diff(row[a:b]))).tolist(), b]
    return list(zip(cuts, cuts[1:]))


class Model(NamedTuple):
    """One weight for each subsequence, the SVM's offset, and the curve from value to score."""

    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def values(self, strings: list[bytes]) -> np.ndarray:
        """The SVM's value of each string, or FLOOR where it is below."""
        parts = [self._values(strings[i : i + PART]) for i in range(0, len(strings), PART)]
        return np.concatenate([np.zeros(0), *parts])

    def _values(self, strings: list[bytes]) -> np.ndarray:
        n = len(strings)
        out = np.full(n, FLOOR)
        u = units(strings)
        raw, least = np.zeros(n), np.zeros(n)
        for owner, sub, w in subsequences(u):
            raw += np.bincount(owner, self.weights[sub], minlength=n) * w
            least += np.bincount(owner, minlength=n) * (w * w)
        # The squares of single occurrences bound the norm from below, which settles most strings.
        some = least > 0
        bound = np.where(some, np.maximum(raw, 0) / np.sqrt(np.where(some, least, 1)), 0) + self.offset
        near = np.flatnonzero(some & ((bound > FLOOR) & (raw > 0) | (self.offset > FLOOR)))
        if len(near):
            owner, sub, value = feature_rows(units([strings[i] for i in near]))
            out[near] = np.maximum(FLOOR, np.bincount(owner, value * self.weights[sub], minlength=len(near)) + self.offset)
        return out

    def scores(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -40, 40)))


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(25):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active] * C
        step = np.linalg.solve(ridge + (xa * wa[:, None]).T @ xa, ridge @ w + (xa * wa[:, None]).T @ (xa @ w - y[active]))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from values to scores (Platt)."""
    z, w = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (weight * (p - y)) + 1e-3 * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def sample_units(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Different strings of the sample, and (text, string) for each text that holds one, in the order of texts."""
    number: dict[bytes, int] = {}
    rows, strings = [], []
    for i in range(0, len(texts), 100):
        some, string, row = document_units(Words(*flat(pa.array(texts[i : i + 100], pa.string()))))
        known = np.array([number.setdefault(s.lower(), len(number)) for s in some], np.int64)
        rows.append(row + i)
        strings.append(known[string] if len(string) else string)
    return list(number), np.unique(np.stack([np.concatenate(rows), np.concatenate(strings)]), axis=1)


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray) -> Model:
    """Landmarks, Nyström features and the SVM, from labelled texts."""
    strings, seen = sample_units(texts)
    toxic = y[seen[0]] == 1
    in_toxic = np.bincount(seen[1][toxic], minlength=len(strings))
    in_clean = np.bincount(seen[1][~toxic], minlength=len(strings))
    odds = np.log((in_toxic + 0.5) / (y.sum() + 1)) - np.log((in_clean + 0.5) / ((1 - y).sum() + 1))
    gain = odds * np.sqrt(in_toxic)
    known = np.array([len(s) >= 4 for s in strings])
    able = np.flatnonzero(known & (in_toxic >= MIN_DOCS) & (odds > 1))
    bad = able[np.argsort(-gain[able], kind="stable")][:LANDMARKS]
    usual = np.flatnonzero(known & (odds < 0.3))
    usual = usual[np.argsort(-in_clean[usual], kind="stable")][: 20 * LANDMARKS]
    good = usual[:: max(1, len(usual) // LANDMARKS)][:LANDMARKS]
    landmarks = list(dict.fromkeys(strings[i] for i in [*bad, *good]))

    # Nyström: features whose products are the kernel's values as far as the landmarks carry them.
    base = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh(base)
    good_ones = values > 1e-6 * values.max()
    root = vectors[:, good_ones] / np.sqrt(values[good_ones])

    # A few clean strings stand for all of them at first; later rounds add those that score highest.
    rng = np.random.default_rng(11)
    clean = np.flatnonzero(in_toxic + in_clean > 0)
    clean = clean[(in_clean[clean] > 0)]
    pool = rng.choice(clean, min(len(clean), 4000), replace=False)
    guess = np.where(able_mask(len(strings), able), gain, -1e9)
    hard = np.zeros(0, np.int64)
    first = np.searchsorted(seen[0], np.arange(len(texts) + 1))
    sick = [d for d in np.flatnonzero(y == 1) if first[d + 1] > first[d]]
    model = None
    for _ in range(ROUNDS):
        witness = []
        for d in sick:
            mine = seen[1][first[d] : first[d + 1]]
            top = mine[np.argmax(guess[mine])]
            if model is not None or guess[top] > 0:
                witness.append(top)
        if not witness:
            witness = list(bad[:1]) or [int(seen[1][0])]
        plus, times = np.unique(witness, return_counts=True)
        # A string that most toxic documents' witnesses are not, but clean texts hold, is no witness.
        fine = in_clean[plus] <= in_toxic[plus]
        if fine.any():
            plus, times = plus[fine], times[fine]
        minus = np.setdiff1d(np.concatenate([pool, hard]), plus)
        rows = np.concatenate([plus, minus])
        x = np.concatenate([
            kernel([strings[i] for i in rows[k : k + 2000]], landmarks) for k in range(0, len(rows), 2000)
        ]) @ root
        target = np.concatenate([np.ones(len(plus)), -np.ones(len(minus))])
        importance = np.concatenate([np.sqrt(times), 1 + 0.2 * np.log1p(in_clean[minus])])
        w, offset = _hinge(x, target, importance)
        alpha = root @ w
        mark, sub, value = feature_rows(units(landmarks))
        weights = np.bincount(sub, value * alpha[mark], minlength=LETTERS**3)
        model = Model(weights, offset, 1.0, 0.0)
        guess = model.values(strings)
        top_clean = clean[np.argsort(-guess[clean], kind="stable")][:3000]
        hard = top_clean[in_clean[top_clean] > in_toxic[top_clean]]
    best = np.full(len(texts), FLOOR)
    np.maximum.at(best, seen[0], guess[seen[1]])
    slope, shift = _logistic(best, y, weight)
    return model._replace(weights=model.weights.astype(np.float32), slope=slope, shift=shift)


def able_mask(n: int, some: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[some] = True
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", each: int = SAMPLE_EACH) -> Model | float:
    """A model from a bounded sample of the labelled documents, or the share of label 1 if one label is missing."""
    rows, counts = labelled_sample(docs, labels, label, each, SAMPLE_BYTES)
    y = np.array([r[2] for r in rows])
    if len(set(y.tolist())) < 2:
        return counts.get(1, 0) / max(1, sum(counts.values()))
    weight = np.array([counts[k] / (y == k).sum() for k in y.tolist()])
    return fit([r[1] for r in rows], y, weight)


def text_values(texts: pa.Array, model: Model) -> np.ndarray:
    """The greatest value of each text's units."""
    data, at = flat(texts)
    strings, string, row = document_units(Words(data, at))
    best = np.full(len(at) - 1, FLOOR)
    value = model.values(strings)
    high = np.flatnonzero(value[string] > FLOOR)
    np.maximum.at(best, row[high], value[string[high]])
    return best


def score(docs: DataFrame, model: Model | float, keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` from 0 to 1; ``keep`` names the columns that pass through (all by default)."""
    docs = without(docs, ["score"])
    columns = docs.columns
    kept = columns if keep is None else keep
    schema = added(docs.select(kept), [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(columns.index("text"))
                found = (
                    np.full(batch.num_rows, model)
                    if isinstance(model, float)
                    else model.scores(text_values(texts, model))
                )
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(columns.index(c)) for c in kept), pa.array(found, pa.float64())], names=schema.names
                )

    return docs.mapInArrow(run, schema)
