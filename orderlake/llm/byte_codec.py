"""Byte-level BPE with the tiktoken library and a rank file: texts to ids, ids to bytes.

The library splits a text by a pattern and merges the bytes of each match by rank. Its
pattern engine recurses over white space, so a run of a million spaces ends the process,
and a text of many megabytes would be one call. Long texts are therefore cut before, at
places no match of the pattern crosses, whatever stands around them: between anything
and white space after it, between a letter or digit and a sign after it (a small set of
characters whose class is the same in every Unicode version). A long run of white
space is one match, less its last character where more text follows; it goes to the
library as one piece.

A null text counts as empty, an empty text has no ids; null ids decode to no bytes, an
unknown id raises ``KeyError``. Rows may repeat, an empty table gives an empty result,
and a column that has the name of an added one gives way to it.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orderlake.llm.arrow_text import slices
from orderlake.llm.prefix_tokens import WHITE
from orderlake.llm.schema import added, without

SEGMENT = 1 << 16
SLICE_IDS = 1 << 18
LONG_RUN = 10_000

_RUN = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")
_SIGNS = "!-/:-@\\[-`{-~、。，"
_CUT = f"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[A-Za-z一-龥])(?=[0-9{_SIGNS}])|(?<=[0-9])(?=[A-Za-z{_SIGNS}])"
_NEXT_CUT = re.compile(_CUT)
_LAST_CUT = re.compile(f"(?s:.*)(?:{_CUT})")


def segments(text: str, limit: int = SEGMENT) -> Iterator[str]:
    """Parts of a text that are split by the pattern as within the whole; about ``limit`` characters where it has a cut."""
    at = 0
    while len(text) - at > limit:
        cut = _LAST_CUT.match(text, at + 1, at + limit) or _NEXT_CUT.search(text, at + limit)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


class Codec:
    """A rank file and the pattern that splits texts before its merges."""

    def __init__(self, ranks: str, pattern: str = public_tokenizers.PATTERN):
        with open(ranks, "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(
            os.path.basename(ranks), pat_str=pattern, mergeable_ranks=table, special_tokens={}
        )
        self.piece = self.encoding._core_bpe.encode_single_piece

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return self.encoding.encode_ordinary(text)
        ids, at = [], 0
        for run in _RUN.finditer(text):
            ids += self._parts(text[at : run.start()])
            # The last space goes with what follows it.
            at = run.end() - (run.end() < len(text))
            ids += self.piece(text[run.start() : at].encode())
        return ids + self._parts(text[at:])

    def _parts(self, text: str) -> list[int]:
        return [i for part in segments(text) for i in self.encoding.encode_ordinary(part)]

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes: ids cut in the middle of a character give the bytes they have."""
        return self.encoding.decode_bytes(ids)


@lru_cache(maxsize=4)
def _codec(ranks: str, pattern: str) -> Codec:
    """One codec for all tasks of a Python worker."""
    return Codec(ranks if os.path.isabs(ranks) else public_tokenizers.path(ranks), pattern)


def _mapped(df: DataFrame, column: str, field: T.StructField, make) -> DataFrame:
    """``df`` with one column more, which ``make`` works out from the values of ``column``."""
    df = without(df, [field.name])
    schema, place = added(df, [field]), df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (
                pa.RecordBatch.from_arrays([*part.columns, made], names=schema.names)
                for part, made in make(batch, place)
            )

    return df.mapInArrow(run, schema)


def encode_texts(df: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, column: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int): the tokens of ``column``. ``ranks`` is a path, or a name among the public tokenizers."""

    def make(batch, place):
        codec = _codec(ranks, pattern)
        for part in slices(batch, batch.schema.names[place]):
            rows = [codec.encode(text) if text else [] for text in part.column(place).to_pylist()]
            offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
            yield part, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return _mapped(df, column, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), make)


def decode_ids(df: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, column: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes that the ids of ``column`` stand for."""

    def make(batch, place):
        codec, lists = _codec(ranks, pattern), batch.column(place)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        absent = lists.is_null().to_numpy(zero_copy_only=False)
        start = 0
        while start < len(lists):
            # Rows of about SLICE_IDS at a time; a longer one is a part of its own.
            stop = max(start + 1, int(np.searchsorted(at, at[start] + SLICE_IDS, side="right")) - 1)
            made = [
                b"" if absent[i] else codec.decode(flat[at[i] : at[i + 1]].tolist()) for i in range(start, stop)
            ]
            yield batch.slice(start, stop - start), pa.array(made, pa.binary())
            start = stop

    return _mapped(df, column, T.StructField("decoded", T.BinaryType()), make)
