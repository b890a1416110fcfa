"""Token ids of texts under the public word-level BPE, as the ``tokenizers`` library gives them.

White space only parts words for this tokenizer, so a text's ids are its words' ids
one after the other, and a word's ids are found once. Words of plain Latin letters go
through the same merges in a quicker library; the others ask ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from orderlake.llm.arrow_text import Words, flat

CACHE_BYTES = 64 << 20
ENTRY_BYTES = 180  # what a word and its ids take beside their own bytes
_END = "\x01"  # stands for the end of a piece; no plain word holds it
_ODD = re.compile("[^!-~À-ÖØ-öø-ÿ\n]").search
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of words and texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, byte, mark = spec["model"]["end_of_word_suffix"], _byte_of_char(), _END.encode()
        ranks, last = {mark: len(spec["model"]["vocab"])}, []
        for token, i in spec["model"]["vocab"].items():
            ends = token.endswith(suffix) and len(token) > len(suffix)
            body = bytes(byte[c] for c in (token[: -len(suffix)] if ends else token))
            if mark not in body:
                ranks[body + (mark if ends else b"")] = i
                last += [i] * ends
        special = spec["added_tokens"]
        self.vocabulary = 1 + max(max(spec["model"]["vocab"].values()), *(x["id"] for x in special))
        self._has_special = re.compile("|".join(re.escape(x["content"]) for x in special) or "(?!)").search
        self._is_last = np.zeros(len(spec["model"]["vocab"]) + 1, bool)
        self._is_last[last] = True
        self._merge = tiktoken.Encoding(
            "pieces", pat_str=f"[^{_END}\n]+{_END}", mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.words: dict[bytes, bytes] = {}
        self.held = 0

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words; plain ones go through the merges together, a word a line and a mark after each piece."""
        text = b"\n".join(words).decode()
        if _ODD(text) or self._has_special(text):
            other = {word.encode() for word in text.split("\n") if _ODD(word) or self._has_special(word)}
            for word in other:
                ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
                self.words[word] = np.array(ids, "<u4").tobytes()
            words = [word for word in words if word not in other]
            text = b"\n".join(words).decode()
            self.held += sum(len(word) + len(self.words[word]) + ENTRY_BYTES for word in other)
        if words:
            marked = _PIECES.sub("\\g<0>" + _END, text.lower())
            ids = np.array(self._merge(marked), "<u4")
            raw = np.frombuffer(marked.encode(), np.uint8)
            pieces = np.searchsorted(np.flatnonzero(raw == ord(_END)), np.append(np.flatnonzero(raw == 10), len(raw)))
            ends = (4 * (np.flatnonzero(self._is_last[ids]) + 1)[pieces - 1]).tolist()
            made = ids.tobytes()
            self.words.update(zip(words, map(made.__getitem__, map(slice, [0, *ends], ends))))
            self.held += len(text) + len(made) + ENTRY_BYTES * len(words)

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words."""
        if self.held > CACHE_BYTES:
            self.words.clear()
            self.held = 0
        new = [word for word in words if word not in self.words]
        if new:
            self._learn(new)
        return list(map(self.words.__getitem__, words))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin (one more entry than texts)."""
        words = Words(*flat(texts))
        length = words.end - words.start
        ends = np.concatenate([[0], np.cumsum(length)])
        solid = words.data[words.solid]
        made = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(length), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(solid)]
        ).dictionary_encode()
        # Each different word is looked up once, and its ids go wherever it stands.
        known = self._known(made.dictionary.to_pylist())
        which = made.indices.to_numpy()
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin = np.cumsum(size) - size
        count = size[which]
        total = np.concatenate([[0], np.cumsum(count)])
        place = np.repeat(begin[which] - total[:-1], count) + np.arange(int(total[-1]))
        return np.frombuffer(b"".join(known), "<u4")[place], total[words.first]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        ids, at = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> WordEncoder:
    """One encoder, with what it has learnt, for all tasks of a Python worker."""
    return WordEncoder(public_tokenizers.path(vocabulary))
