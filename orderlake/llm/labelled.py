"""Bounded samples of labelled documents, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, each: int, max_bytes: int) -> tuple[list, dict]:
    """Texts with their 0/1 label: at most ``each`` documents of either label, of at most ``max_bytes``.

    Documents are taken in the order of a hash of their id. Returns (doc_id, text, label) rows and the
    number of labelled documents by label. Ids labelled twice count once, with the greater label.
    """
    marked = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    counts = {r["_label"]: r["count"] for r in marked.groupBy("_label").count().collect()}
    picked = None
    for value in (0, 1):
        some = marked.where(F.col("_label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        picked = some if picked is None else picked.unionByName(some)
    # 2 * each rows at most, so this side may always be broadcast.
    texts = (
        docs.select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")
        .where(F.octet_length("text") <= max_bytes)
        .groupBy("doc_id", "_label")
        .agg(F.min("text").alias("text"))
    )
    rows = sorted((r["doc_id"], r["text"], r["_label"]) for r in texts.collect())
    return rows, counts
