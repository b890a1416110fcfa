"""Exact token counts at every prefix of a text, by dynamic programming.

For a byte-level BPE the encoding of a prefix ends in exactly one token ``t`` for
which (last token of what stands before ``t``, ``t``) is a pair that BPE leaves
apart. So ``last`` and ``count`` at each byte follow from those at earlier bytes,
and no prefix is encoded again. Text falls into chunks that begin where white
space follows something else; the tokenizer never joins across such a place, so
a chunk's counts are found once and kept.

``prefix_counts`` stores, for each text, the change of the count at every code
point (one byte each, or four where one byte is too narrow). A null text counts
as empty, an empty text has 0 tokens and an empty table. Rows may repeat; other
columns pass through; one that has the name of an added column gives way to it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from orderlake.llm.arrow_text import _BASE, mix, powers, slices
from orderlake.llm.schema import added, without

CACHE_CHUNKS = 400_000
LONG_CHUNK = 64
CACHE_PAIRS = 1_000_000

# The characters with the property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = re.compile(f"[{WHITE}]").match
_CHUNKS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
# Chunks whose pieces this expression finds; the others ask the tokenizer.
_PLAIN = re.compile("[ \n]?[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PIECES = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\\s"
).findall


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_CONTRACTION = re.compile("'[A-Za-z]").match
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def _hash(token: bytes) -> int:
    value = 0
    for byte in token:
        value = (value * int(_BASE) + int(_VALUE[byte])) & 0xFFFFFFFFFFFFFFFF
    return value


class PrefixCounter:
    """Counts tokens at every prefix as ``tokenizers`` counts them for a byte-level BPE file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of_char()
        self.vocab = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.longest = max(map(len, self.vocab))
        self.encode = tiktoken.Encoding(
            "bpe", pat_str=r"\S+", mergeable_ranks=self.vocab, special_tokens={}
        )._core_bpe.encode_single_piece
        keys = np.array([_hash(token) for token in self.vocab], np.uint64)
        ids = np.array(list(self.vocab.values()), np.int64)
        by_key = np.argsort(keys)
        self.keys, self.numbers = keys[by_key], ids[by_key]
        self.token = {i: token for token, i in self.vocab.items()}
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.wide = False  # whether a chunk kept has changes that need four bytes
        self._split = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def _apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves these two neighbouring tokens as they are (a = -1: b alone)."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        left = self.token[a] if a >= 0 else b""
        known = self.encode(left + self.token[b]) == ([a, b] if a >= 0 else [b])
        self.pairs[a << 20 | b] = known
        return known

    def steps(self, pieces: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Changes of the token count at each code point of each piece, found byte by byte for all pieces at once.

        Returns the pieces' order, the changes of all pieces in that order, and where each piece's begin.
        """
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        sizes = np.array([len(pieces[i]) for i in order])
        n, width = len(order), int(sizes[0])
        bytes_ = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in order), np.uint8)
        value = _VALUE[bytes_.reshape(n, width).T]
        prefix = np.zeros((width + 1, n), np.uint64)
        for k in range(width):
            prefix[k + 1] = prefix[k] * _BASE + value[k]
        power = powers(width + 1)
        count = np.zeros((width + 1, n), np.int32)
        last = np.full((width + 1, n), -1, np.int64)
        begin = np.zeros((width + 1, n), np.int64)
        known = self.pairs.get
        for end in range(1, width + 1):
            rows = np.arange(np.searchsorted(-sizes, -end, side="right"))
            # One start alone is right, so the likely ones go first: the last token grown, a single byte.
            for start in (None, end - 1, *range(end - 2, max(0, end - self.longest) - 1, -1)):
                at = begin[end - 1, rows] if start is None else start
                key = prefix[end, rows] - prefix[at, rows] * power[end - at]
                slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[slot] == key)
                if not len(hit):
                    continue
                found, number = rows[hit], self.numbers[slot[hit]]
                if start is None:
                    at = at[hit]
                before = last[at, found]
                pairs = (before << 20 | number).tolist()
                fits = [known(x) for x in pairs]
                for i, fit in enumerate(fits):
                    if fit is None:
                        fits[i] = self._apart(int(before[i]), int(number[i]))
                fits = np.array(fits)
                found = found[fits]
                count[end, found] = count[at[fits] if start is None else at, found] + 1
                last[end, found] = number[fits]
                begin[end, found] = at[fits] if start is None else at
                rows = np.delete(rows, hit[fits])
                if not len(rows):
                    break
        raw = bytes_.reshape(n, width)
        ends = np.arange(width) < sizes[:, None]
        ends[:, :-1] &= raw[:, 1:] & 0xC0 != 0x80
        at = np.concatenate([[0], np.cumsum(ends.sum(axis=1))])
        flat = count[1:].T[ends]
        changes = flat.copy()
        changes[1:] -= flat[:-1]
        changes[at[1:-1]] = flat[at[1:-1]]
        return order, changes, at

    def _ends(self, text: str) -> list[str]:
        if _PLAIN(text):
            return _PIECES(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _code_points(self, piece: str) -> list[int]:
        """Token counts of all prefixes, at code points, of one piece."""
        if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
            # A contraction's own prefixes are split otherwise.
            return [sum(int(self.steps([p.encode()])[1].sum()) for p in self._ends(piece[:k])) for k in range(1, len(piece) + 1)]
        return np.cumsum(self.steps([piece.encode()])[1]).tolist()

    def _steps(self, chunk: str) -> list[int]:
        """Changes of the count over one chunk. A run of white space counts as one piece until something follows."""
        out, done, now, at = [], 0, 0, 0
        solid = next((i for i, c in enumerate(chunk) if not _WHITE(c)), len(chunk))
        if solid == 1 and chunk[0] in " \n\t\r":
            out, now = [1], 1
        elif solid:
            for count in self._code_points(chunk[:solid]):
                out.append(count - now)
                now = count
        for piece in self._ends(chunk):
            counts = self._code_points(piece)
            for count in counts[solid - at :] if solid > at else counts:
                out.append(done + count - now)
                now = done + count
            at += len(piece)
            done += counts[-1]
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Works out the changes over new chunks and keeps them."""
        plain = {c: _PIECES(c) for c in chunks if len(c) <= LONG_CHUNK and _PLAIN(c)}
        new = list(set(chain.from_iterable(plain.values())).difference(self.pieces))
        simple = [p for p in new if not _CONTRACTION(p)]
        if simple:
            order, changes, at = self.steps([p.encode() for p in simple])
            made = changes.astype(np.int8).tobytes()
            bounds = at.tolist()
            self.pieces.update((simple[i], made[bounds[k] : bounds[k + 1]]) for k, i in enumerate(order))
        for piece in new:
            if piece not in self.pieces:
                self.pieces[piece] = np.diff(self._code_points(piece), prepend=0).astype(np.int8).tobytes()
        for chunk in chunks:
            if chunk in plain:
                self.chunks[chunk] = b"".join([self.pieces[p] for p in plain[chunk]])
            else:
                steps = np.array(self._steps(chunk), np.int32)
                narrow = steps.astype(np.int8)
                fits = bool((narrow == steps).all())
                self.wide |= not fits
                self.chunks[chunk] = narrow.tobytes() if fits else steps

    def _ordinary(self, text: str) -> list:
        chunks = _CHUNKS(text)
        self._learn_new([chunks])
        return [self.chunks[c] for c in chunks]

    def _learn_new(self, texts: list[list[str]]) -> None:
        new = set().union(*texts).difference(self.chunks)
        if new and len(self.chunks) + len(new) > CACHE_CHUNKS:
            self.chunks.clear()
            self.pieces.clear()
            self.wide = False
            new = set().union(*texts)
        if new:
            self._learn(list(new))

    def tables(self, texts: list[str]) -> list[bytes]:
        """The change of the token count at each code point, for several texts."""
        chunks = [[] if self._split and self._split.search(t) else _CHUNKS(t) for t in texts]
        self._learn_new(chunks)
        known = self.chunks.__getitem__
        parts = [list(map(known, x)) for x in chunks]
        return [self._join(p or self._with_special(t)) for p, t in zip(parts, texts)]

    def table(self, text: str) -> bytes:
        return self.tables([text])[0]

    def _join(self, parts: list) -> bytes:
        if not self.wide or all(type(p) is bytes for p in parts):
            return b"".join(parts)
        return np.concatenate(
            [np.frombuffer(p, np.int8).astype(np.int32) if type(p) is bytes else p for p in parts]
        ).tobytes()

    def _with_special(self, text: str) -> list:
        """Special strings are one token each; their own prefixes are ordinary text."""
        parts, at = [], 0
        for m in self._split.finditer(text):
            before = text[at : m.start()]
            # Only the last chunk can change by what follows it.
            chunks = _CHUNKS(before)
            parts += self._ordinary(before)
            tail = "".join(chunks[-1:])
            base = sum(self._steps(tail)) if tail else 0
            now, steps = base, []
            for k in range(1, m.end() - m.start()):
                count = sum(sum(self._steps(c)) for c in _CHUNKS(tail + m.group()[:k]))
                steps.append(count - now)
                now = count
            steps.append(base + 1 - now)
            parts.append(np.array(steps, np.int8).tobytes())
            at = m.end()
        return parts + self._ordinary(text[at:])




@lru_cache(maxsize=2)
def _counter(vocabulary: str) -> PrefixCounter:
    """One counter, with what it has learnt, for all tasks of a Python worker."""
    return PrefixCounter(public_tokenizers.path(vocabulary))


def _changes(table: bytes, length: int) -> np.ndarray:
    return np.frombuffer(table, np.int8 if len(table) == length else np.int32)


def count_at(table: bytes, length: int, prefix: int | None = None) -> int:
    """Tokens of the first ``prefix`` code points of a text of ``length`` (all by default)."""
    return int(_changes(table, length)[:prefix].sum(dtype=np.int64))


def longest_prefix(table: bytes, length: int, budget: int) -> int:
    """The most code points that a text can keep within ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(_changes(table, length), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    budget: int = 1024,
    keep: list[str] | None = None,
    keep_table: bool = True,
) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens``, ``fit_chars`` (code points within ``budget``) and ``prefix_table``.

    ``vocabulary`` names a byte-level BPE file of the public tokenizers; ``keep`` the columns that pass
    through (all by default).
    """
    extra = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("fit_chars", T.LongType()),
        *([T.StructField("prefix_table", T.BinaryType())] if keep_table else []),
    ]
    docs = without(docs, [f.name for f in extra])
    columns = docs.columns
    kept = columns if keep is None else keep
    schema = added(docs.select(kept), extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for whole in batches:
            for batch in slices(whole):
                texts = [t or "" for t in batch.column(columns.index("text")).to_pylist()]
                rows = []
                for text, table in zip(texts, counter.tables(texts)):
                    steps = _changes(table, len(text))
                    total = int(steps.sum(dtype=np.int64))
                    fit = len(text) if total <= budget else longest_prefix(table, len(text), budget)
                    rows.append((len(text.encode()), total, fit, table))
                made = zip(*rows)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(extra)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(columns.index(c)) for c in kept), *(pa.array(list(v), k) for v, k in zip(made, kinds))],
                    names=schema.names,
                )

    return docs.mapInArrow(run, schema)
