"""Exact substring removal over bytes by distributed suffix sorting with difference covers.

Suffixes only need to be told apart by their first ``window`` bytes, so the work is dealt
out by content. Every window of ``window`` bytes is given to the smallest hash among the
``window // 2 + 1``-byte strings in it: sampled positions that equal windows share, wherever
they stand. Neighbouring windows with the same sample form one segment.

1. Samples are sorted and named in buckets; a sample that only one document holds leads
   to no repeat and its segments are done. A sample whose segments may hold more than
   ``sort_bytes`` (a phrase of very many documents) is crowded: its segments are not kept
   together, but each of their windows goes by its own hash to a bucket, which tells
   whether a smaller document has it.
2. Whole segments are named in turn, and the document that holds each first. A segment
   that a smaller document holds too is a repeat from end to end.
3. What remains are segments that share a sample with another segment but differ from
   it. A bucket sorts all their suffixes by the difference cover algorithm
   (``suffix_array``) and compares adjacent prefixes; windows that agree go to the smallest
   document among theirs.

Chunks of documents and buckets of samples exchange messages (``exchange``); each
different segment of the last step is sent once. A document that equals a smaller one
byte for byte goes as a whole. The hash functions are drawn for each run (``arrow_text.Keys``).

Null and empty texts have no bytes. A null id counts as greater than all others; rows
with the same id count as one document and take nothing from each other. An empty table
gives an empty result. Other columns pass through; one that has the name of an added
column, or is named ``chunk``, gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orderlake.llm import exchange as ex
from orderlake.llm.arrow_text import Keys, flat, keys_of, mix, new_seed
from orderlake.llm.schema import added, without
from orderlake.llm.suffix_array import equal_prefixes, suffix_array

WINDOW = 50
LAST = np.iinfo(np.int64).max
PART = 1 << 20
SORT_BYTES = 4 << 20

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FIELDS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("spans", _SPAN),
    T.StructField("kept", T.BinaryType()),
]


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    step = 1
    while step * 2 <= size:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (size - step)], values[size - step :]) if size > step else values


class Chunk:
    """Segments of a chunk's documents, in the order of their ids and texts."""

    def __init__(self, table: pa.Table, window: int, keys: Keys):
        self.keys = keys
        order = pc.sort_indices(table.select(["doc_id", "text"]), [("doc_id", "ascending"), ("text", "ascending")])
        self.table = table = table.take(order).combine_chunks()
        self.ids = pc.fill_null(table["doc_id"].cast(pa.int64()), LAST).to_numpy()
        self.data, self.at = flat(table["text"].combine_chunks())
        self.window = window
        self.sizes = np.diff(self.at)
        self.long = np.flatnonzero(self.sizes >= window)
        made = [self._segments(a, b) for a, b in self._parts()]
        empty = np.zeros(0, np.int64)
        self.start = np.concatenate([m[0] for m in made]) if made else empty  # first window
        self.stop = np.concatenate([m[1] for m in made]) if made else empty  # after the last window
        self.sample = np.concatenate([m[2] for m in made]) if made else np.zeros(0, np.uint64)
        self.row = np.searchsorted(self.at, self.start, side="right") - 1
        self.doc = self.ids[self.row]

    def _parts(self) -> list[tuple[int, int]]:
        """Runs of documents with about PART bytes."""
        cuts = np.searchsorted(self.at, np.arange(PART, int(self.at[-1]) + PART, PART))
        edges = np.unique(np.concatenate([[0], self.at[np.minimum(cuts, len(self.at) - 1)], [self.at[-1]]]))
        return list(zip(edges[:-1].tolist(), edges[1:].tolist()))

    def _segments(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        window, size = self.window, self.window // 2 + 1
        if high - low < window:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        least = _sliding_min(self.keys.rolling(self.keys.byte[self.data[low:high]], size), window - size + 1)
        row = np.zeros(high - low, np.int32)
        heads = self.at[(self.at > low) & (self.at < high)] - low
        np.add.at(row, heads, 1)
        row = np.cumsum(row)
        ok = row[: len(least)] == row[window - 1 :]
        turn = np.ones(len(least) + 1, bool)
        turn[1:-1] = (least[1:] != least[:-1]) | (row[1 : len(least)] != row[: len(least) - 1]) | (ok[1:] != ok[:-1])
        edge = np.flatnonzero(turn)
        start, stop = edge[:-1], edge[1:]
        good = ok[start]
        return low + start[good], low + stop[good], least[start[good]]

    def whole(self) -> np.ndarray:
        return self.keys.ranges(self.data, self.at[:-1][self.long], self.at[1:][self.long])

    def contents(self, which: np.ndarray) -> np.ndarray:
        """Hashes of whole segments."""
        return self.keys.ranges(self.data, self.start[which], self.stop[which] + self.window - 1)

    def windows(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, hash, document) of all windows of segments, some documents at a time; the segments ascend."""
        for low, high in self._parts():
            a, b = np.searchsorted(self.start[which], [low, high])
            if a == b:
                continue
            some = which[a:b]
            size = self.stop[some] - self.start[some]
            place = np.repeat(self.start[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            value = self.keys.rolling(self.keys.byte[self.data[low:high]], self.window)[place - low]
            yield place, value, np.repeat(self.doc[some], size)


class Samples:
    """The different samples of a chunk, and whether two documents hold them."""

    def __init__(self, chunk: Chunk, buckets: int):
        code = ex.dealt(mix(chunk.sample), buckets)
        order = np.argsort(code, kind="stable")
        self.code, self.which = np.unique(code, return_inverse=True)
        edge = np.searchsorted(code[order], self.code)
        doc = chunk.doc[order]
        if len(edge):
            self.several = np.minimum.reduceat(doc, edge) < np.maximum.reduceat(doc, edge)
        else:
            self.several = np.zeros(0, bool)
        self.size = np.bincount(self.which, chunk.stop - chunk.start + chunk.window - 1, len(self.code)).astype(np.int64)


class Windows:
    """The different windows of a chunk's crowded segments, with their smallest documents."""

    def __init__(self, chunk: Chunk, which: np.ndarray, buckets: int):
        keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, value, doc in chunk.windows(which):
            order = np.lexsort((doc, value))
            value, doc = value[order], doc[order]
            head = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            keys.append(value[head])
            docs.append(doc[head])
        self.chunk, self.segments = chunk, which
        self.first = ex.FirstDocs(np.concatenate(keys), np.concatenate(docs), buckets)

    def repeats(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each window, in order: whether a smaller document has it too."""
        order = np.argsort(self.first.keys)
        keys, least = self.first.keys[order], self.first.docs[order]
        smaller = self.first.smaller_keys(answers)[order]
        out = [np.zeros(0, bool)]
        for _, value, doc in self.chunk.windows(self.segments):
            at = np.searchsorted(keys, value)
            out.append(smaller[at] | (least[at] < doc))
        return np.concatenate(out)


class Contents:
    """The different segments of a chunk that may repeat: content hash, sample code, smallest document."""

    def __init__(self, chunk: Chunk, which: np.ndarray, buckets: int):
        self.which = which
        content = chunk.contents(which)
        code = ex.dealt(mix(chunk.sample[which]), buckets)
        order = np.lexsort((chunk.doc[which], content, code))
        c, k = content[order], code[order]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (k[1:] != k[:-1])]) if len(c) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        self.content, self.code = c[head], k[head]
        self.example = which[order][head]  # a segment of the smallest document
        self.least = chunk.doc[self.example]
        self.of = np.empty(len(which), np.int64)
        self.of[order] = np.cumsum(new) - 1


def _first_question(window: int, buckets: int, seed: bytes, sort_bytes: int = SORT_BYTES):
    # Sizes below this in every chunk stay under half the bound together.
    least = max(1, sort_bytes // (2 * buckets))

    def ask(table: pa.Table) -> list[tuple[int, int, bytes]]:
        chunk, me = Chunk(table, window, keys_of(seed)), table["chunk"][0].as_py()
        samples = Samples(chunk, buckets)
        copies = ex.FirstDocs(chunk.whole(), chunk.ids[chunk.long], buckets).parts()
        parts = {b: (x, y) for b, x, y in ex.spans(samples.code, buckets)}
        out = []
        for b in sorted({*copies, *parts}):
            x, y = parts.get(b, (0, 0))
            low = (samples.code[x:y] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            large = np.flatnonzero(samples.size[x:y] >= least)
            out.append((me, b, ex.packed(
                ex.sorted_bytes(low), ex.bits(samples.several[x:y]), *copies.get(b, (b"", b"")),
                large.astype(np.uint32).tobytes(), samples.size[x:y][large].tobytes(),
            )))
        return out

    return ask


def _name_samples(sort_bytes: int = SORT_BYTES):
    def reply(payloads: list[bytes]) -> list[bytes]:
        """Bits: two documents or more hold the sample; a smaller copy of the document exists; the sample is crowded."""
        parts = [ex.unpacked(p) for p in payloads]
        low = [ex.from_sorted_bytes(p[0]) for p in parts]
        sizes = [len(x) for x in low]
        several = np.concatenate([ex.from_bits(p[1], n) for p, n in zip(parts, sizes)])
        _, which, counts = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
        many = ((counts > 1) | (np.bincount(which, several, len(counts)) > 0))[which]
        copies = ex.smaller_elsewhere(
            [np.frombuffer(p[2], np.uint64) for p in parts], [np.frombuffer(p[3], np.int64) for p in parts]
        )
        cut = np.cumsum(sizes)
        large = np.concatenate([np.frombuffer(p[4], np.uint32) + at for p, at in zip(parts, cut - sizes)]).astype(np.int64)
        total = np.bincount(which[large], np.concatenate([np.frombuffer(p[5], np.int64) for p in parts]), len(counts))
        crowded = (total >= sort_bytes / 2)[which]
        return [
            ex.packed(ex.bits(m), ex.bits(c), ex.bits(w))
            for m, c, w in zip(np.split(many, cut[:-1]), copies, np.split(crowded, cut[:-1]))
        ]

    return reply


def _second_question(window: int, buckets: int, seed: bytes):
    def ask(table: pa.Table, answers: dict[int, bytes]) -> list[tuple[int, int, bytes]]:
        chunk, me = Chunk(table, window, keys_of(seed)), table["chunk"][0].as_py()
        samples = Samples(chunk, buckets)
        got = {b: ex.unpacked(p) for b, p in answers.items()}
        many, crowded = np.zeros(len(samples.code), bool), np.zeros(len(samples.code), bool)
        for b, x, y in ex.spans(samples.code, buckets):
            many[x:y], crowded[x:y] = ex.from_bits(got[b][0], y - x), ex.from_bits(got[b][2], y - x)
        copies = ex.FirstDocs(chunk.whole(), chunk.ids[chunk.long], buckets)
        skip = np.zeros(len(chunk.sizes), bool)
        skip[chunk.long] = copies.smaller({b: p[1] for b, p in got.items()}) | (
            copies.docs[copies.which] < chunk.ids[chunk.long]
        )
        maybe = many[samples.which] & ~skip[chunk.row]
        apart = maybe & crowded[samples.which]
        maybe &= ~apart
        windows = Windows(chunk, np.flatnonzero(apart), buckets).first.parts()
        contents = Contents(chunk, np.flatnonzero(maybe), buckets)
        out = [(me, ex.note_to_self(me), ex.packed(ex.bits(maybe), ex.bits(skip), ex.bits(apart)))]
        parts = {b: (x, y) for b, x, y in ex.spans(contents.code, buckets)}
        for b in sorted({*windows, *parts}):
            x, y = parts.get(b, (0, 0))
            low = (contents.code[x:y] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            out.append((me, b, ex.packed(
                ex.sorted_bytes(low), contents.content[x:y].tobytes(), contents.least[x:y].astype(np.int64).tobytes(),
                *windows.get(b, (b"", b"")),
            )))
        return out

    return ask


def _name_contents(payloads: list[bytes]) -> list[bytes]:
    """Bits: a smaller document of another chunk holds the segment; its sample has different segments; a smaller
    document of another chunk holds the window."""
    parts = [ex.unpacked(p) for p in payloads]
    low = [ex.from_sorted_bytes(p[0]) for p in parts]
    content = [np.frombuffer(p[1], np.uint64) for p in parts]
    doc = [np.frombuffer(p[2], np.int64) for p in parts]
    smaller = ex.smaller_elsewhere(content, doc)
    windows = ex.smaller_elsewhere(
        [np.frombuffer(p[3], np.uint64) for p in parts], [np.frombuffer(p[4], np.int64) for p in parts]
    )
    every, key = np.concatenate(low), np.concatenate(content)
    order = np.lexsort((key, every))
    k, c = every[order], key[order]
    head = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
    other = np.concatenate([[True], (c[1:] != c[:-1]) | head[1:]])[: len(k)]
    group = np.cumsum(head) - 1
    differing = np.empty(len(every), bool)
    differing[order] = (np.bincount(group, other) > 1)[group]
    cut = np.cumsum([len(x) for x in low])[:-1]
    return [
        ex.packed(ex.bits(s), ex.bits(d), ex.bits(w)) for s, d, w in zip(smaller, np.split(differing, cut), windows)
    ]


def _third_question(window: int, buckets: int, seed: bytes):
    def ask(table: pa.Table, answers: dict[int, bytes]) -> list[tuple[int, int, bytes]]:
        chunk, me = Chunk(table, window, keys_of(seed)), table["chunk"][0].as_py()
        note = ex.unpacked(answers[ex.note_to_self(me)])
        maybe = ex.from_bits(note[0], len(chunk.start))
        contents = Contents(chunk, np.flatnonzero(maybe), buckets)
        smaller, differing = np.zeros(len(contents.code), bool), np.zeros(len(contents.code), bool)
        for b, x, y in ex.spans(contents.code, buckets):
            got = ex.unpacked(answers[b])
            smaller[x:y], differing[x:y] = ex.from_bits(got[0], y - x), ex.from_bits(got[1], y - x)
        send = differing & ~smaller
        repeat = np.zeros(len(chunk.start), bool)
        repeat[contents.which] = smaller[contents.of] | (contents.least[contents.of] < chunk.doc[contents.which])
        windows = Windows(chunk, np.flatnonzero(ex.from_bits(note[2], len(chunk.start))), buckets)
        gone = windows.repeats({b: ex.unpacked(p)[2] for b, p in answers.items() if b >= 0})
        out = [(me, ex.note_to_self(me), ex.packed(note[0], note[1], ex.bits(repeat), ex.bits(send), note[2], ex.bits(gone)))]
        data = chunk.data.tobytes()
        for b, x, y in ex.spans(contents.code, buckets):
            some = contents.example[x:y][send[x:y]]
            if len(some):
                start, end = chunk.start[some], chunk.stop[some] + window - 1
                text = b"".join([data[i:j] for i, j in zip(start.tolist(), end.tolist())])
                low = (contents.code[x:y][send[x:y]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                out.append((me, b, ex.packed(
                    text, (end - start).astype(np.int64).tobytes(), chunk.doc[some].tobytes(), ex.sorted_bytes(low)
                )))
        return out

    return ask


def sort_segments(data: np.ndarray, length: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """For each window of each segment, in order: whether a segment of a smaller document has it too."""
    n = len(length)
    head = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    total = int(length.sum()) + n
    # A separator of its own after each segment, above all bytes.
    symbols = np.zeros(total, np.int64)
    inside = np.ones(total, bool)
    inside[head + length] = False
    symbols[inside] = data.astype(np.int64) + 1
    symbols[~inside] = 257 + np.arange(n)
    owner = np.repeat(np.arange(n), length + 1)
    left = (head + length)[owner] - np.arange(total)
    order = suffix_array(symbols)
    order = order[left[order] >= window]
    raw = np.zeros(total, np.uint8)
    raw[inside] = data
    same = equal_prefixes(raw, order, window)
    group = np.cumsum(~same) - 1
    holder = doc[owner[order]]
    least = np.full(int(group[-1]) + 1 if len(group) else 0, LAST)
    np.minimum.at(least, group, holder)
    out = np.zeros(total, bool)
    out[order] = least[group] < holder
    return out[left >= window]


def _sort_bucket(window: int, sort_bytes: int):
    def reply(payloads: list[bytes]) -> list[bytes]:
        """Bits: for each window of each segment sent, whether a smaller document has it."""
        parts = [ex.unpacked(p) for p in payloads]
        length = np.concatenate([np.frombuffer(p[1], np.int64) for p in parts])
        doc = np.concatenate([np.frombuffer(p[2], np.int64) for p in parts])
        sample = np.concatenate([ex.from_sorted_bytes(p[3]) for p in parts])
        data = np.frombuffer(b"".join(p[0] for p in parts), np.uint8)
        head = np.concatenate([[0], np.cumsum(length)])
        windows = length - window + 1
        bit_head = np.concatenate([[0], np.cumsum(windows)])
        found = np.zeros(int(windows.sum()), bool)
        # Equal windows have equal samples, so samples are sorted some at a time.
        order = np.argsort(sample, kind="stable")
        size = np.cumsum(length[order])
        edge = np.flatnonzero(np.diff(sample[order], prepend=sample[order][0] + 1) != 0) if len(order) else np.zeros(0, np.int64)
        at = 0
        while at < len(order):
            base = size[at - 1] if at else 0
            stop = int(np.searchsorted(size, base + sort_bytes, side="right"))
            later = edge[edge > at]
            within = later[later <= max(stop, at + 1)]
            stop = int(within[-1]) if len(within) else (int(later[0]) if len(later) else len(order))
            some = order[at:stop] if len(later) else order[at:]
            take = np.concatenate([data[head[i] : head[i + 1]] for i in some])
            flags = sort_segments(take, length[some], doc[some], window)
            begin = np.concatenate([[0], np.cumsum(windows[some])])
            spread = np.repeat(bit_head[some] - begin[:-1], windows[some]) + np.arange(int(begin[-1]))
            found[spread] = flags
            at += len(some)
        cut = np.cumsum([int((np.frombuffer(p[1], np.int64) - window + 1).sum()) for p in parts])[:-1]
        return [ex.bits(f) for f in np.split(found, cut)]

    return reply


def suffix_dedup(
    docs: DataFrame, window: int = WINDOW, chunk_bytes: int = ex.CHUNK_BYTES, sort_bytes: int = SORT_BYTES
) -> DataFrame:
    """Adds ``n_bytes, n_removed, spans`` (removed byte ranges) and ``kept`` (the remaining bytes)."""
    if window < 8:
        raise ValueError("window is at least 8 bytes")
    docs = without(docs, ["chunk", *(f.name for f in _FIELDS)])
    columns = docs.columns
    schema = added(docs, _FIELDS)
    out_schema = to_arrow_schema(schema)
    buckets = ex.chunk_count(docs, chunk_bytes)
    chunked = ex.in_chunks(docs, buckets)
    small = chunked.select("doc_id", "text", "chunk")  # in this order, so that its shuffle can be used again
    seed = new_seed()

    def remove(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out_schema.empty_table()
        chunk, me = Chunk(table, window, keys_of(seed)), table["chunk"][0].as_py()
        answers = ex.by_bucket(got)
        note = ex.unpacked(answers[ex.note_to_self(me)])
        contents = Contents(chunk, np.flatnonzero(ex.from_bits(note[0], len(chunk.start))), buckets)
        skip, repeat = ex.from_bits(note[1], len(chunk.sizes)), ex.from_bits(note[2], len(chunk.start))
        send = ex.from_bits(note[3], len(contents.code))
        depth = np.zeros(len(chunk.data) + 1, np.int32)
        whole = np.flatnonzero(repeat)
        np.add.at(depth, chunk.start[whole], 1)
        np.add.at(depth, chunk.stop[whole] + window - 1, -1)
        # Windows found in the sort count for all segments of that content in its smallest document.
        flags, place = [], np.full(len(contents.code), -1)
        total = 0
        size = (chunk.stop - chunk.start)[contents.example] if len(contents.code) else np.zeros(0, np.int64)
        for b, x, y in ex.spans(contents.code, buckets):
            some = x + np.flatnonzero(send[x:y])
            if len(some):
                n = int(size[some].sum())
                flags.append(ex.from_bits(answers[b], n))
                place[some] = total + np.cumsum(size[some]) - size[some]
                total += n
        if flags:
            flags = np.concatenate(flags)
            mine = contents.which[(place[contents.of] >= 0) & ~repeat[contents.which]]
            where = place[contents.of][(place[contents.of] >= 0) & ~repeat[contents.which]]
            n = (chunk.stop - chunk.start)[mine]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            gone = flags[np.repeat(where, n) + step]
            start = (np.repeat(chunk.start[mine], n) + step)[gone]
            np.add.at(depth, start, 1)
            np.add.at(depth, start + window, -1)
        apart = np.flatnonzero(ex.from_bits(note[4], len(chunk.start)))
        if len(apart):
            size = (chunk.stop - chunk.start)[apart]
            gone = ex.from_bits(note[5], int(size.sum()))
            start = (np.repeat(chunk.start[apart] - (np.cumsum(size) - size), size) + np.arange(len(gone)))[gone]
            np.add.at(depth, start, 1)
            np.add.at(depth, start + window, -1)
        covered = np.cumsum(depth)[:-1] > 0
        for r in np.flatnonzero(skip):
            covered[chunk.at[r] : chunk.at[r + 1]] = True
        return _removed(chunk, covered, columns, out_schema)

    named = ex.answer(ex.ask(small, _first_question(window, buckets, seed, sort_bytes)), _name_samples(sort_bytes))
    named = ex.answer(ex.ask_again(small, named, _second_question(window, buckets, seed)), _name_contents)
    sorted_ = ex.answer(ex.ask_again(small, named, _third_question(window, buckets, seed)), _sort_bucket(window, sort_bytes))
    return chunked.groupBy("chunk").cogroup(sorted_.groupBy("chunk")).applyInArrow(remove, schema)


def _removed(chunk: Chunk, covered: np.ndarray, columns: list[str], schema: pa.Schema) -> pa.Table:
    """The documents of a chunk without their covered bytes."""
    n_removed, spans, kept = [], [], []
    for a, b in zip(chunk.at[:-1].tolist(), chunk.at[1:].tolist()):
        gone, data = covered[a:b], chunk.data[a:b]
        turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        n_removed.append(int((turn[1::2] - turn[::2]).sum()))
        spans.append([{"start": x, "end": y} for x, y in zip(turn[::2].tolist(), turn[1::2].tolist())])
        kept.append((data[~gone] if len(turn) else data).tobytes())
    new = [chunk.sizes, n_removed, spans, kept]
    arrays = [chunk.table[c].cast(schema.field(c).type) for c in columns]
    return pa.table([*arrays, *(pa.array(v, schema.field(f.name).type) for v, f in zip(new, _FIELDS))], schema=schema)
