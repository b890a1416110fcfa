"""Packing by lexical retrieval: a seed document's window is filled with its BM25 neighbours.

Documents are spread over shards of about ``shard_docs`` rows. A shard holds an
inverted index with BM25 weights under corpus-wide statistics. The longest unused
document seeds a window; its strongest terms find neighbours, which go in by score
where they fit whole; a last one is cut to fill the window, and its rest stays in the
index for later windows. Where no neighbour is left, the longest unused document
goes on. Parts of 2,048 ids of longer documents are windows of their own first.

Cuts lie on multiples of ``GRAIN`` ids. The CRCs of prefixes on that grid are kept with
the term counts, so nothing is encoded again after the cuts are known.

A null or empty text is one token, the end id. Equal rows are packed each for itself;
a null ``doc_id`` is kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlake.llm import crc
from orderlake.llm.arrow_text import slices
from orderlake.llm.scratch import written
from orderlake.llm.word_tokens import encoder

WINDOW = 2048
GRAIN = 16
END_ID = 1
SHARD_DOCS = 4096
QUERY_TERMS = 16
K1, B = 1.2, 0.75
SLICE_BYTES = 2 << 20

_COUNTED = "doc_id {id}, n_tokens long, crcs binary, terms binary, tfs binary"
_PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """For each document: its number of ids, prefix CRCs on the grid, and its terms with their counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in (part for whole in batches for part in slices(whole, limit=SLICE_BYTES)):
            rows = []
            every, at = words.encode_column(batch.column(1))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                ids = every[a:b].tobytes() + end
                terms, tfs = np.unique(np.frombuffer(ids, "<u4"), return_counts=True)
                rows.append((
                    len(ids) // 4,
                    np.array(crc.prefixes(ids, 4 * GRAIN), np.uint32).tobytes(),
                    terms.astype(np.uint16).tobytes(),
                    np.minimum(tfs, 65535).astype(np.uint16).tobytes(),
                ))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))],
                names=["doc_id", "n_tokens", "crcs", "terms", "tfs"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, _COUNTED.format(id=kind))


def document_frequencies(encoded: DataFrame) -> np.ndarray:
    """Documents that hold each id; at most one row for each id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total[np.frombuffer(value.as_py(), np.uint16)] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    counts = encoded.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << 16, np.int64)
    for row in counts.collect():
        out[row["term"]] = row["n"]
    return out


class Shard:
    """The inverted index of one shard and what is still unused of its documents."""

    def __init__(self, sizes: np.ndarray, terms: list[np.ndarray], tfs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.left = sizes.copy()  # ids not yet packed; they are a document's last ones
        doc = np.repeat(np.arange(len(sizes)), [len(t) for t in terms])
        term = np.concatenate(terms)
        tf = np.concatenate(tfs)
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))).astype(np.float32)
        by_doc = np.lexsort((term, -weight, doc))
        first = np.searchsorted(doc, np.arange(len(sizes) + 1))
        self.query = [term[by_doc[a : min(b, a + QUERY_TERMS)]] for a, b in zip(first, first[1:])]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a query term with the seed, best first, equal ones by place."""
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.query[seed]]
        doc = np.concatenate([self.doc[s] for s in spans])
        score = np.bincount(doc, np.concatenate([self.weight[s] for s in spans]), minlength=len(self.left))
        found = np.flatnonzero((score > 0) & (self.left > 0))
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(sizes: np.ndarray, shard: Shard) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for all ids of all documents."""
    pieces, sequence = [], 0
    left = shard.left
    for d in np.flatnonzero(left >= WINDOW):
        for k in range(int(left[d]) // WINDOW):
            pieces.append((int(d), k * WINDOW, WINDOW, sequence, 0))
            sequence += 1
        left[d] %= WINDOW
    order = np.argsort(-left, kind="stable")
    next_seed = 0
    while True:
        while next_seed < len(order) and left[order[next_seed]] == 0:
            next_seed += 1
        if next_seed == len(order):
            return pieces
        seed, used = int(order[next_seed]), 0

        def take(d: int, n: int) -> None:
            nonlocal used
            pieces.append((d, int(sizes[d] - left[d]), n, sequence, used))
            left[d] -= n
            used += n

        take(seed, int(left[seed]))
        long = []
        if used + GRAIN <= WINDOW:
            found = shard.neighbours(seed)
            for d, n in zip(found.tolist(), left[found].tolist()):
                if n <= WINDOW - used:
                    take(d, n)
                    if used + GRAIN > WINDOW:
                        break
                else:
                    long.append(d)
        at = next_seed
        while used + GRAIN <= WINDOW:
            if long:
                d = long.pop(0)
            else:
                while at < len(order) and left[order[at]] == 0:
                    at += 1
                if at == len(order):
                    break
                d = int(order[at])
            room = WINDOW - used
            take(d, int(left[d]) if left[d] <= room else room - room % GRAIN)
        sequence += 1


def retrieval_packing(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = written(encoded_documents(docs, vocabulary), "encoded")
    total = encoded.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean")).first()
    rows, mean = total["n"], total["mean"] or 1.0
    df = document_frequencies(encoded)
    idf = np.log1p((rows - df + 0.5) / (df + 0.5)).astype(np.float32)
    shards = max(1, -(-rows // shard_docs))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        sizes = table["n_tokens"].to_numpy()
        terms = [np.frombuffer(x, np.uint16) for x in table["terms"].to_pylist()]
        tfs = [np.frombuffer(x, np.uint16).astype(np.float32) for x in table["tfs"].to_pylist()]
        made = np.array(pack_shard(sizes, Shard(sizes, terms, tfs, idf, mean)), np.int64)
        doc, start, length, sequence, offset = made.T
        grid = [np.frombuffer(x, np.uint32) for x in table["crcs"].to_pylist()]
        before = np.array([grid[d][s // GRAIN] for d, s in zip(doc, start)], np.uint32)
        through = np.array([grid[d][-(-e // GRAIN)] for d, e in zip(doc, start + length)], np.uint32)
        checks = crc.part(before, through, 4 * length)
        shard = table["shard"][0].as_py()
        return pa.table({
            "doc_id": table["doc_id"].take(pa.array(doc)),
            "start": start, "length": length, "ids_crc32": checks.astype(np.int64), "doc_tokens": sizes[doc],
            "sequence_id": sequence + (shard << 32), "offset": offset,
        })

    sharded = encoded.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    return sharded.groupBy("shard").applyInArrow(run, _PIECES.format(id=kind))
