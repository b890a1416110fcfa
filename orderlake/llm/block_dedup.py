"""Exact substring removal over words, by fixed-block anchors.

Every document's text falls into reference blocks of ``window // 2`` words that do not
overlap; any window of ``window`` words holds a whole one. Blocks are indexed by hash and
probed with every rolling window of the same size, in any document. A hit is extended
over the neighbouring windows that occur in two documents or more to the maximal repeat;
the windows of ``window`` words inside are then compared by their own 64-bit hash with
those of all other documents, and a word goes if one of them starts in a document with
a smaller id too. The hash functions are drawn for each run (``arrow_text.Keys``). Hashes travel between chunks of documents and buckets of keys
(``exchange``); texts are dealt to chunks once and never meet each other.

A document that equals a smaller one word for word goes as a whole and is not compared.
Null and empty texts have no words. A null id counts as greater than all others; rows
with the same id count as one document and take nothing from each other. An empty table
gives an empty result. Other columns pass through; one that has the name of an added
column, or is named ``chunk``, gives way to it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orderlake.llm import exchange as ex
from orderlake.llm.arrow_text import Keys, Words, flat, keys_of, mix, new_seed, per_row, slices
from orderlake.llm.schema import added, without

WINDOW = 50
LAST = np.iinfo(np.int64).max

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("spans", _SPAN),
    T.StructField("kept_text", T.StringType()),
]


class Chunk:
    """Word hashes of a chunk's documents, in the order of their ids and texts."""

    def __init__(self, table: pa.Table, window: int, keys: Keys):
        order = pc.sort_indices(table.select(["doc_id", "text"]), [("doc_id", "ascending"), ("text", "ascending")])
        self.table = table = table.take(order).combine_chunks()
        self.ids = pc.fill_null(table["doc_id"].cast(pa.int64()), LAST).to_numpy()
        self.keys = keys
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in table.select(["text"]).to_batches():
            for part in slices(batch):
                words = Words(*flat(part.column(0)))
                hashes.append(words.hashes(keys))
                counts.append(words.count)
        self.hashes, self.count = np.concatenate(hashes), np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.row = np.repeat(np.arange(len(self.count), dtype=np.int32), self.count)
        self.long = np.flatnonzero(self.count >= window)

    def doc(self, word: np.ndarray) -> np.ndarray:
        """The ids of the documents that words belong to."""
        return self.ids[self.row[word]]

    def starts(self, size: int) -> np.ndarray:
        """Words at which ``size`` words of one document start; documents under the window have none."""
        n = len(self.row) - size + 1
        if n <= 0:
            return np.zeros(0, np.int32)
        ok = self.row[:n] == self.row[size - 1 :]
        short = np.ones(len(self.count), bool)
        short[self.long] = False
        return np.flatnonzero(ok & ~short[self.row[:n]]).astype(np.int32)

    def whole(self) -> np.ndarray:
        """A hash of all words of each document that has a window."""
        out = np.empty(len(self.long), np.uint64)
        for i, d in enumerate(self.long):
            a, b = self.first[d], self.first[d + 1]
            place = np.arange(1, b - a + 1, dtype=np.uint64)
            out[i] = mix(self.hashes[a:b] ^ mix(place)).sum(dtype=np.uint64)
        return mix(out + self.count[self.long].astype(np.uint64))


class Anchors:
    """The different rolling windows of a chunk: whether one is a reference block, and whether two documents hold it."""

    def __init__(self, chunk: Chunk, block: int, buckets: int):
        self.start = chunk.starts(block)
        code = ex.dealt(chunk.keys.rolling(chunk.hashes, block)[self.start], buckets)
        order = np.argsort(code, kind="stable").astype(np.int32)
        code = code[order]
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        edge = np.flatnonzero(new)
        self.code = code[edge]
        self.which = np.empty(len(code), np.int32)
        self.which[order] = np.cumsum(new, dtype=np.int32) - 1
        del code, new
        self.block = np.zeros(len(self.code), bool)
        first = chunk.first[:-1].astype(np.int32)
        self.block[self.which[(self.start - first[chunk.row[self.start]]) % block == 0]] = True
        self.several = np.zeros(0, bool)
        if len(edge):
            doc = chunk.doc(self.start[order])
            self.several = np.minimum.reduceat(doc, edge) < np.maximum.reduceat(doc, edge)


def _question(window: int, buckets: int, seed: bytes) -> Callable:
    def ask(table: pa.Table) -> list[tuple[int, int, bytes]]:
        chunk = Chunk(table, window, keys_of(seed))
        anchors = Anchors(chunk, window // 2, buckets)
        copies = ex.FirstDocs(chunk.whole(), chunk.ids[chunk.long], buckets).parts()
        parts = {b: (x, y) for b, x, y in ex.spans(anchors.code, buckets)}
        out, me = [], table["chunk"][0].as_py()
        for b in sorted({*copies, *parts}):
            x, y = parts.get(b, (0, 0))
            low = (anchors.code[x:y] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            out.append((me, b, ex.packed(
                ex.sorted_bytes(low), ex.bits(anchors.block[x:y]), ex.bits(anchors.several[x:y]),
                *copies.get(b, (b"", b"")),
            )))
        return out

    return ask


def _anchor_answers(payloads: list[bytes]) -> list[bytes]:
    """Bits: the window is in two documents or more; one of its uses is a reference block; a smaller copy exists."""
    parts = [ex.unpacked(p) for p in payloads]
    low = [ex.from_sorted_bytes(p[0]) for p in parts]
    sizes = [len(x) for x in low]
    block = np.concatenate([ex.from_bits(p[1], n) for p, n in zip(parts, sizes)])
    several = np.concatenate([ex.from_bits(p[2], n) for p, n in zip(parts, sizes)])
    _, which, counts = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
    many = (counts > 1) | (np.bincount(which, several, len(counts)) > 0)
    hit = many & (np.bincount(which, block, len(counts)) > 0)
    cut = np.cumsum(sizes)[:-1]
    copies = ex.smaller_elsewhere(
        [np.frombuffer(p[3], np.uint64) for p in parts], [np.frombuffer(p[4], np.int64) for p in parts]
    )
    return [
        ex.packed(ex.bits(m), ex.bits(h), ex.bits(c))
        for m, h, c in zip(np.split(many[which], cut), np.split(hit[which], cut), copies)
    ]


def _candidates(chunk: Chunk, answers: dict[int, bytes], window: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that start a window to compare, and documents (among the long ones) that equal a smaller one."""
    anchors = Anchors(chunk, window // 2, buckets)
    many, hit = np.zeros(len(anchors.code), bool), np.zeros(len(anchors.code), bool)
    got = {b: ex.unpacked(p) for b, p in answers.items()}
    for b, x, y in ex.spans(anchors.code, buckets):
        many[x:y], hit[x:y] = ex.from_bits(got[b][0], y - x), ex.from_bits(got[b][1], y - x)
    copies = ex.FirstDocs(chunk.whole(), chunk.ids[chunk.long], buckets)
    copied = copies.smaller({b: p[2] for b, p in got.items()}) | (copies.docs[copies.which] < chunk.ids[chunk.long])
    n = len(chunk.hashes)
    word_many, word_hit = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    word_many[anchors.start + 1] = many[anchors.which]
    word_hit[anchors.start + 1] = hit[anchors.which]
    width = window - window // 2 + 1  # blocks' worth of rolling windows inside a window
    start = chunk.starts(window)
    sum_many, sum_hit = np.cumsum(word_many, dtype=np.int32), np.cumsum(word_hit, dtype=np.int32)
    ok = (sum_many[start + width] - sum_many[start] == width) & (sum_hit[start + width] > sum_hit[start])
    skip = np.zeros(len(chunk.count), bool)
    skip[chunk.long[copied]] = True
    start = start[ok]
    return start[~skip[chunk.row[start]]], skip


def block_dedup(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = ex.CHUNK_BYTES) -> DataFrame:
    """Adds ``n_words, n_removed, spans`` (removed word ranges) and ``kept_text`` (kept words, joined by one space)."""
    if window < 2 or window % 2:
        raise ValueError("window is an even number of words")
    docs = without(docs, ["chunk", *(f.name for f in _FIELDS)])
    columns = docs.columns
    schema = added(docs, _FIELDS)
    buckets = ex.chunk_count(docs, chunk_bytes)
    chunked = ex.in_chunks(docs, buckets)
    small = chunked.select("doc_id", "text", "chunk")  # in this order, so that its shuffle can be used again
    seed = new_seed()

    def compare(table: pa.Table, answers: dict[int, bytes]) -> list[tuple[int, int, bytes]]:
        chunk, me = Chunk(table, window, keys_of(seed)), table["chunk"][0].as_py()
        start, skip = _candidates(chunk, answers, window, buckets)
        asked = ex.FirstDocs(chunk.keys.rolling(chunk.hashes, window)[start], chunk.doc(start), buckets)
        flags = np.zeros(len(chunk.hashes), bool)
        flags[start] = True
        out = [(me, b, ex.packed(*p)) for b, p in asked.parts().items()]
        return [*out, (me, ex.note_to_self(me), ex.packed(ex.bits(flags), ex.bits(skip)))]

    def first_documents(payloads: list[bytes]) -> list[bytes]:
        parts = [ex.unpacked(p) for p in payloads]
        found = ex.smaller_elsewhere(
            [np.frombuffer(p[0], np.uint64) for p in parts], [np.frombuffer(p[1], np.int64) for p in parts]
        )
        return [ex.bits(f) for f in found]

    def remove(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], f.type) for f in out_schema], schema=out_schema)
        chunk, me = Chunk(table, window, keys_of(seed)), table["chunk"][0].as_py()
        answers = ex.by_bucket(got)
        note = ex.unpacked(answers[ex.note_to_self(me)])
        start = np.flatnonzero(ex.from_bits(note[0], len(chunk.hashes)))
        skip = ex.from_bits(note[1], len(chunk.count))
        asked = ex.FirstDocs(chunk.keys.rolling(chunk.hashes, window)[start], chunk.doc(start), buckets)
        gone = asked.smaller(answers) | (asked.docs[asked.which] < chunk.doc(start))
        depth = np.zeros(len(chunk.hashes) + 1, np.int64)
        np.add.at(depth, start[gone], 1)
        np.add.at(depth, start[gone] + window, -1)
        covered = np.cumsum(depth)[:-1] > 0
        covered |= skip[chunk.row]
        return _removed(chunk, covered, columns, out_schema)

    out_schema = to_arrow_schema(schema)
    asked = ex.ask(small, _question(window, buckets, seed))
    first = ex.answer(asked, _anchor_answers)
    second = ex.answer(ex.ask_again(small, first, compare), first_documents)
    return chunked.groupBy("chunk").cogroup(second.groupBy("chunk")).applyInArrow(remove, schema)


def _removed(chunk: Chunk, covered: np.ndarray, columns: list[str], schema: pa.Schema) -> pa.Table:
    """The documents of a chunk without their covered words."""
    n_removed = per_row(covered, chunk.first)
    kept, spans = [], []
    for i, value in enumerate(chunk.table["text"]):
        words = (value.as_py() or "").encode().split()
        if not n_removed[i]:
            kept.append(b" ".join(words).decode())
            spans.append([])
            continue
        mine = covered[chunk.first[i] : chunk.first[i + 1]]
        kept.append(b" ".join([w for w, c in zip(words, mine.tolist()) if not c]).decode())
        turn = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
        spans.append([{"start": a, "end": b} for a, b in zip(turn[::2].tolist(), turn[1::2].tolist())])
    new = [chunk.count, n_removed, spans, kept]
    arrays = [chunk.table[c].cast(schema.field(c).type) for c in columns]
    return pa.table([*arrays, *(pa.array(v, schema.field(f.name).type) for v, f in zip(new, _FIELDS))], schema=schema)
