"""Quality rules from tokeniser fertility, with rejection bands for each language or script.

For each text: characters per token and the share of byte-fallback tokens under a
public sentencepiece vocabulary, the entropy of its tokens, and plain word and line
counts. Words are encoded one by one, so a text's figures are sums over its words.

The bands look at characters per token under three vocabularies: the sentencepiece one, a
word-level and a byte-level BPE. Words with a digit (keys, numbers, addresses) are left
out of these where they are few: they take many tokens, and a clean text that names one
would measure as junk.

A null or empty text has no words, entropy and shares of 0, and fails the base rule.
Rows may repeat; a column that has the name of an added one gives way to it.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orderlake.llm.arrow_text import _BASE, _BYTE, Words, first_mask, flat, mix, per_row, powers, slices, windows
from orderlake.llm.schema import added, without
from orderlake.llm.word_tokens import _byte_of_char as byte_of_char
from orderlake.llm.word_tokens import encoder


class Band(NamedTuple):
    """What a text may measure and still be kept."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_fallback_share: float
    min_entropy: float
    min_chars_per_word_token: float = 0.0
    min_chars_per_byte_token: float = 0.0


#: By ``lang`` first, then by script; "other" holds for the rest. The least characters per token of the four languages are
#: 2 % below the lowest clean text of SHORT words or more among the labelled ones of sf0.1; "mixed" has the least of each.
BANDS = {
    "en": Band(2.04, 5.0, 0.10, 5.0, 2.21, 2.06),
    "de": Band(2.09, 5.0, 0.10, 5.0, 2.03, 1.90),
    "fr": Band(1.83, 5.0, 0.10, 5.0, 1.84, 1.70),
    "es": Band(1.76, 5.0, 0.10, 5.0, 1.78, 1.60),
    "mixed": Band(1.76, 5.0, 0.10, 5.0, 1.78, 1.60),
    "latin": Band(1.55, 6.0, 0.10, 3.0),
    "greek": Band(0.6, 4.0, 0.50, 3.0),
    "cyrillic": Band(1.0, 5.0, 0.20, 3.0),
    "hebrew": Band(0.5, 3.0, 0.60, 3.0),
    "arabic": Band(0.5, 3.0, 0.60, 3.0),
    "cjk": Band(0.25, 2.5, 0.90, 3.0),
    "other": Band(0.2, 6.0, 0.95, 2.5),
}
MIN_WORDS = 50
WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
SHORT, SHORT_SHARE = 100, 0.94  # words; of the least characters per token, for texts with fewer, whose figures vary more
MAX_MIXED_SHARE = 0.005  # letters beyond ASCII in a text that says it is English; above, it holds other languages too
MAX_DIGIT_PERCENT = 10  # of a text's words; where more have a digit, they count
MAX_REPEAT_PERCENT = 50

# The symbols that count.
SYMBOLS = b"#*$%&|<>"

SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "cjk", "other")
_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("script", T.StringType()),
    T.StructField("n_pieces", T.LongType()),
    T.StructField("chars_per_token", T.DoubleType()),
    T.StructField("fallback_share", T.DoubleType()),
    T.StructField("token_entropy", T.DoubleType()),
]


def _script_of_lead_byte() -> np.ndarray:
    """The script that a code point's first UTF-8 byte points to, as 1 + its place in SCRIPTS; 0: no letter."""
    out = np.zeros(256, np.uint8)
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1] = 1
    for name, low, high in (
        ("latin", 0xC3, 0xCA), ("greek", 0xCD, 0xD0), ("cyrillic", 0xD0, 0xD5), ("hebrew", 0xD6, 0xD8),
        ("arabic", 0xD8, 0xDC), ("other", 0xDC, 0xE3), ("cjk", 0xE3, 0xEE), ("other", 0xF0, 0xF5),
    ):
        out[low:high] = 1 + SCRIPTS.index(name)
    return out


_SCRIPT = _script_of_lead_byte()
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


@lru_cache(maxsize=2)
def _model(vocabulary: str):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    fallback = np.array([model.IsByte(i) for i in range(model.GetPieceSize())])
    return model, fallback


@lru_cache(maxsize=1)
def _byte_model(vocabulary: str):
    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte = byte_of_char()
    ranks = {}
    for token, i in vocab.items():
        if all(c in byte for c in token):
            ranks[bytes(byte[c] for c in token)] = i
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _word_tokens(different: list[bytes]) -> np.ndarray:
    ids = encoder(WORD_VOCABULARY).encode_all([w.decode() for w in different])
    return np.fromiter((len(x) // 4 for x in ids), np.int64, len(different))


def _byte_tokens(different: list[bytes]) -> np.ndarray:
    encode = _byte_model(BYTE_VOCABULARY).encode_ordinary
    return np.fromiter((len(encode(" " + w.decode())) for w in different), np.int64, len(different))


def _has_digit(words: Words) -> np.ndarray:
    digits = np.concatenate([[0], np.cumsum((words.data >= 48) & (words.data < 58))])
    return digits[words.end] > digits[words.start]


def repeated_lines(words: Words) -> np.ndarray:
    """For each row, lines with a word that equal an earlier line of the row."""
    data, at = words.data, words.at
    rows = len(at) - 1
    if not len(words.start):
        return np.zeros(rows, np.int64)
    inside = data != 10
    start = np.unique(np.concatenate([at[:-1], np.flatnonzero(~inside) + 1]))
    start = start[start < len(data)]
    index = np.concatenate([[0], np.cumsum(inside)])
    head, length = index[start], np.diff(index[np.append(start, len(data))])
    full = length > 0
    start, head, length = start[full], head[full], length[full]
    within = np.arange(int(length.sum())) - np.repeat(head, length)
    key = np.add.reduceat(_BYTE[data[inside]] * powers(int(length.max()) + 1)[within], head)
    key = mix(key + length.astype(np.uint64) * _BASE)
    word = np.searchsorted(words.start, np.append(start, len(data)))
    worded = np.diff(word) > 0
    row, key = (np.searchsorted(at, start, side="right") - 1)[worded], key[worded]
    group, sizes = first_mask(row, key)
    # Hashes only say which lines may be equal; their bytes decide.
    maybe = np.flatnonzero(sizes[group] > 1)
    start, end = start[worded][maybe], (start + length)[worded][maybe]
    out, seen, raw = np.zeros(rows, np.int64), set(), data.tobytes()
    for r, a, b in zip(row[maybe].tolist(), start.tolist(), end.tolist()):
        line = (r, raw[a:b])
        out[r] += line in seen
        seen.add(line)
    return out


def repeated_words(words: Words, hashes: np.ndarray, size: int = 3) -> np.ndarray:
    """For each row, words that lie in a window of ``size`` words found twice or more in the row."""
    found, start = windows(hashes, words.row, size)
    covered = np.zeros(len(hashes) + size, bool)
    if len(found):
        row = words.row[start]
        group, sizes = first_mask(row, found)
        maybe = start[sizes[group] > 1]
        # Hashes only say which windows may be equal; their words decide.
        places = (maybe[:, None] + np.arange(size)).ravel()
        taken = iter(words.take(places))
        kept = list(zip(words.row[maybe].tolist(), zip(*[taken] * size)))
        counts = Counter(kept)
        twice = maybe[np.fromiter((counts[w] > 1 for w in kept), bool, len(kept))]
        for k in range(size):
            covered[twice + k] = True
    return per_row(covered[: len(hashes)], words.first)


def measure(texts: pa.Array, vocabulary: str) -> dict[str, np.ndarray]:
    """All figures of a batch of texts."""
    model, is_fallback = _model(vocabulary)
    data, at = flat(texts)
    words = Words(data, at)
    rows = len(at) - 1
    n_words = words.count
    solid_chars = words.solid & (data & 0xC0 != 0x80)
    out = {
        "n_words": n_words,
        "word_chars": per_row(solid_chars, at),
        "n_symbols": per_row(_IS_SYMBOL[data], at),
        "n_dup_lines": repeated_lines(words),
    }
    script = _SCRIPT[data]
    there = np.bincount(script, minlength=len(SCRIPTS) + 1) > 0
    none = np.zeros(rows, np.int64)
    by_script = np.stack([per_row(script == k, at) if there[k] else none for k in range(1, len(SCRIPTS) + 1)])
    out["script"] = np.where(by_script.sum(axis=0) > 0, by_script.argmax(axis=0), len(SCRIPTS) - 1)
    hashes = words.hashes()
    out["n_repeat_words"] = repeated_words(words, hashes)

    _, example, which = np.unique(hashes, return_index=True, return_inverse=True)
    different = words.take(example)
    pieces = model.encode(different, num_threads=1) if different else []
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    pool = np.fromiter(chain.from_iterable(pieces), np.int64, int(sizes.sum()))
    start = np.concatenate([[0], np.cumsum(sizes)])
    fallback = per_row(is_fallback[pool], start)
    n_pieces = per_row(sizes[which], words.first)
    out["n_pieces"] = n_pieces
    # What the bands look at.
    counted = ~_has_digit(words)
    counted |= (100 * per_row(~counted, words.first) > MAX_DIGIT_PERCENT * n_words)[words.row]
    chars = np.concatenate([[0], np.cumsum(solid_chars)])
    chars = per_row(np.where(counted, chars[words.end] - chars[words.start], 0), words.first)
    for name, count in (("piece", sizes), ("word", _word_tokens(different)), ("byte", _byte_tokens(different))):
        out[f"chars_per_{name}"] = chars / np.maximum(per_row(np.where(counted, count[which], 0), words.first), 1)
    code_points = per_row(data & 0xC0 != 0x80, at)
    out["wide_share"] = per_row(data >= 0xC0, at) / np.maximum(code_points, 1)
    safe = np.maximum(n_pieces, 1)
    out["chars_per_token"] = out["word_chars"] / safe
    out["fallback_share"] = per_row(fallback[which], words.first) / safe

    # Entropy of a row's tokens: log2(n) less the mean of log2(count).
    length = sizes[which]
    spread = np.repeat(start[:-1][which] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    key = np.sort(np.repeat(words.row, length) * len(is_fallback) + pool[spread])
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(edge, len(key)))
    surprise = np.bincount(key[edge] // len(is_fallback), weights=counts * np.log2(np.maximum(counts, 1)), minlength=rows)
    out["token_entropy"] = np.maximum(np.log2(safe) - surprise / safe, 0.0)
    return out


def _kept(m: dict[str, np.ndarray], langs: list[str | None], bands: dict[str, Band]) -> np.ndarray:
    rows = len(langs)
    mixed = (m["wide_share"] > MAX_MIXED_SHARE).tolist()
    langs = ["mixed" if lang == "en" and wide else lang for lang, wide in zip(langs, mixed)]
    limit = np.array(
        [bands.get(lang) or bands.get(SCRIPTS[s]) or bands["other"] for lang, s in zip(langs, m["script"].tolist())]
    ).reshape(rows, len(Band._fields))
    limit[m["n_words"] < SHORT] *= [SHORT_SHARE, 1, 1, 1, SHORT_SHARE, SHORT_SHARE]
    return (
        (m["chars_per_piece"] >= limit[:, 0])
        & (m["chars_per_piece"] <= limit[:, 1])
        & (m["fallback_share"] <= limit[:, 2])
        & (m["token_entropy"] >= limit[:, 3])
        & (m["chars_per_word"] >= limit[:, 4])
        & (m["chars_per_byte"] >= limit[:, 5])
    )


def fertility(
    docs: DataFrame,
    vocabulary: str = "piece_bpe_32k.model",
    bands: dict[str, Band] | None = None,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    keep: list[str] | None = None,
) -> DataFrame:
    """Measures every text and tells whether it is kept.

    ``base_failed``: under ``min_words`` words, or over ``max_repeat_percent`` of them in
    repeated three-word windows. ``kept``: not so, and within the band of its language or
    script. ``keep`` names the columns that pass through (all by default).
    """
    bands = {**BANDS, **(bands or {})}
    docs = without(docs, [f.name for f in _FIELDS])
    columns = docs.columns
    kept = columns if keep is None else keep
    schema = added(docs.select(kept), _FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                m = measure(batch.column(columns.index("text")), vocabulary)
                langs = batch.column(columns.index("lang")).to_pylist() if "lang" in columns else [None] * batch.num_rows
                m["base_failed"] = (m["n_words"] < min_words) | (
                    100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"]
                )
                m["kept"] = ~m["base_failed"] & _kept(m, langs, bands)
                m["script"] = [SCRIPTS[s] for s in m["script"].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(columns.index(c)) for c in kept), *(pa.array(m[f.name]) for f in _FIELDS)],
                    names=schema.names,
                )

    return docs.mapInArrow(run, schema)
