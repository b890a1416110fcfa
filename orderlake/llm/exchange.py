"""Questions that chunks of documents put to buckets of keys, and the answers.

Documents are dealt to chunks by a hash of their id, keys to buckets by a hash of their
own. A chunk sends each bucket one message with its different keys; a bucket sees all
messages about its keys and sends each chunk one message back, mostly bits in the order
of the question. So a key that is everywhere costs one entry a chunk, whoever uses it,
and nothing but bits travels back. Messages are rows ``chunk, bucket, payload``.

Chunk and bucket counts follow the bytes of text. A message about a negative bucket is a
chunk's note to itself and comes back as it is.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGE = "chunk int, bucket int, payload binary"
CHUNK_BYTES = 10 << 20

_MESSAGES = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])


def chunk_count(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Chunks of about ``chunk_bytes``, larger where the messages would become too small."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = max(chunk_bytes, min(64 << 20, 128 * math.isqrt(total)))
    return max(1, -(-total // size))


def in_chunks(docs: DataFrame, chunks: int) -> DataFrame:
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    made = list(zip(*rows)) if rows else [[], [], []]
    return pa.table([pa.array(list(c), t) for c, t in zip(made, _MESSAGES.types)], schema=_MESSAGES)


def ask(docs: DataFrame, question: Callable[[pa.Table], list[tuple[int, int, bytes]]]) -> DataFrame:
    """Messages of every chunk, from its documents."""
    return docs.groupBy("chunk").applyInArrow(lambda t: messages(question(t)), MESSAGE)


def ask_again(
    docs: DataFrame, answers: DataFrame, question: Callable[[pa.Table, dict[int, bytes]], list[tuple[int, int, bytes]]]
) -> DataFrame:
    """Messages of every chunk, from its documents and the answers it got."""

    def run(t: pa.Table, a: pa.Table) -> pa.Table:
        return messages(question(t, by_bucket(a))) if t.num_rows else messages([])

    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, MESSAGE)


def answer(asked: DataFrame, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Each bucket's replies to the messages it got, in their order."""

    def run(t: pa.Table) -> pa.Table:
        if t["bucket"][0].as_py() < 0:
            return t.select(_MESSAGES.names)
        payload = pa.array(reply(t["payload"].to_pylist()), pa.binary())
        return pa.table([t["chunk"], t["bucket"], payload], schema=_MESSAGES)

    return asked.groupBy("bucket").applyInArrow(run, MESSAGE)


def by_bucket(answers: pa.Table) -> dict[int, bytes]:
    return dict(zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist()))


def note_to_self(chunk: int) -> int:
    return -1 - chunk


# Payloads: several arrays, one after the other.


def packed(*arrays: bytes) -> bytes:
    return struct.pack(f"<{len(arrays) + 1}Q", len(arrays), *map(len, arrays)) + b"".join(arrays)


def unpacked(payload: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<Q", payload)
    sizes = struct.unpack_from(f"<{n}Q", payload, 8)
    out, at = [], 8 * (n + 1)
    for size in sizes:
        out.append(payload[at : at + size])
        at += size
    return out


def sorted_bytes(values: np.ndarray) -> bytes:
    """Ascending 32-bit values as differences, byte by byte, which the shuffle's codec makes small."""
    gaps = np.diff(values, prepend=values.dtype.type(0)).astype("<u4")
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def from_sorted_bytes(data: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.uint32)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def from_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def dealt(keys: np.ndarray, buckets: int) -> np.ndarray:
    """64-bit keys as bucket (upper half) and 32 further bits, in one number that sorts by bucket."""
    bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
    return bucket << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)


def spans(codes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) in ascending ``dealt`` codes."""
    edges = np.searchsorted(codes, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)).tolist()
    return ((b, x, y) for b, (x, y) in enumerate(zip(edges, edges[1:])) if y > x)


class FirstDocs:
    """For each of a chunk's keys, the smallest id among its documents; asks whether other chunks have a smaller one."""

    def __init__(self, keys: np.ndarray, docs: np.ndarray, buckets: int):
        bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
        order = np.lexsort((docs, keys, bucket))
        k, b = keys[order], bucket[order]
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        self.keys, self.docs = k[new], docs[order][new]
        self.edges = np.searchsorted(b[new], np.arange(buckets + 1)).tolist()
        self.which = np.empty(len(keys), np.int64)
        self.which[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(k))))

    def parts(self) -> dict[int, tuple[bytes, bytes]]:
        return {
            b: (self.keys[x:y].tobytes(), self.docs[x:y].astype(np.int64).tobytes())
            for b, (x, y) in enumerate(zip(self.edges, self.edges[1:]))
            if y > x
        }

    def smaller(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each key as given: whether a document of another chunk has it and a smaller id than all here."""
        return self.smaller_keys(answers)[self.which]

    def smaller_keys(self, answers: dict[int, bytes]) -> np.ndarray:
        """The same for each of ``keys``."""
        out = np.zeros(len(self.keys), bool)
        for b, (x, y) in enumerate(zip(self.edges, self.edges[1:])):
            if y > x:
                out[x:y] = from_bits(answers[b], y - x)
        return out


def smaller_elsewhere(keys: list[np.ndarray], docs: list[np.ndarray]) -> list[np.ndarray]:
    """For each message's keys, whether another message has the key with a smaller document."""
    sizes = [len(k) for k in keys]
    every, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((doc, every))
    k = every[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
    least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(every), bool)
    out[order] = least < doc[order]
    return np.split(out, np.cumsum(sizes)[:-1])
