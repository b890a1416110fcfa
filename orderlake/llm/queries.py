"""The numbered operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlake.llm import mil, string_kernel
from orderlake.llm.block_dedup import block_dedup
from orderlake.llm.bottom_k import near_duplicates
from orderlake.llm.byte_codec import decode_ids, encode_texts
from orderlake.llm.curriculum import plan_columns
from orderlake.llm.fertility import fertility
from orderlake.llm.labelled import id_remainder
from orderlake.llm.merkle import fold, merkle_proofs, proof_text, row_hash
from orderlake.llm.prefix_tokens import prefix_counts
from orderlake.llm.prefix_trie import prefix_trie, turns_in_order, with_shared_heads
from orderlake.llm.retrieval_packing import retrieval_packing
from orderlake.llm.suffix_dedup import suffix_dedup
from orderlake.llm.vector_tiles import near_vectors


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


def op1_tokenizer_fertility(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select("doc_id", "text", "lang")
    measured = fertility(docs, "piece_bpe_32k.model", keep=["doc_id"])
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "chars_per_token", "fallback_share", "token_entropy",
    )


def op2_attention_mil_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _documents(spark, sf).select("doc_id", "text"), _labels(spark, sf)
    model = mil.train(docs, labels.where(id_remainder(F.col("doc_id"), 5) != 0), "quality")
    scored = mil.score(docs, model, keep=["doc_id"])
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_retrieval_packing(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval_packing(_documents(spark, sf).select("doc_id", "text"), "word_bpe_49k.json")


def op4_string_kernel_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _documents(spark, sf).select("doc_id", "text"), _labels(spark, sf)
    model = string_kernel.train(docs, labels.where(id_remainder(F.col("doc_id"), 3) != 1), "toxic")
    scored = string_kernel.score(docs, model, keep=["doc_id"])
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = suffix_dedup(_documents(spark, sf).select("doc_id", "text"), window=50)
    return cleaned.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_bottom_k_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf).select("doc_id", "text"), words=5, percent=75)


def op7_tiled_vector_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), threshold=0.95)


def op8_prefix_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select("doc_id", "text")
    counted = prefix_counts(docs, "byte_bpe_50k.json", budget=1024, keep=["doc_id"], keep_table=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "fit_chars")


def op9_curriculum_mixing(spark: SparkSession, sf: str) -> DataFrame:
    plan = plan_columns(_documents(spark, sf).select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "position")


def op10_block_anchor_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = block_dedup(_documents(spark, sf).select("doc_id", "text"), window=50)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the trie of conversations that begin like the first of their hundred."""
    turns = turns_in_order(spark.read.parquet(f"{sf}/conversations.parquet"))
    return prefix_trie(*with_shared_heads(turns))


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Proofs of all documents, checked against texts that were tampered with where 5 divides the id's CRC-32."""
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaves = _documents(spark, sf).select(
        "doc_id",
        "source",
        row_hash(*others, F.col("text")).alias("leaf"),
        F.when(id_remainder(F.col("doc_id"), 5) == 0, row_hash(*others, lower)).alias("claimed"),
    )
    proofs = merkle_proofs(leaves, group="source", order="doc_id")
    folded = proofs.withColumn("folded_root", fold(F.coalesce("claimed", "leaf"), F.col("steps")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("steps")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_byte_bpe_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of all texts under a rank file, and the bytes they decode to, as digests."""
    ranks = "byte_bpe_50k.tiktoken"
    ids = encode_texts(_documents(spark, sf).select("doc_id", "text"), ranks).select("doc_id", "ids")
    decoded = decode_ids(ids, ranks)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_tokenizer_fertility": op1_tokenizer_fertility,
    "op2_attention_mil_quality": op2_attention_mil_quality,
    "op3_retrieval_packing": op3_retrieval_packing,
    "op4_string_kernel_toxicity": op4_string_kernel_toxicity,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_bottom_k_near_dedup": op6_bottom_k_near_dedup,
    "op7_tiled_vector_dedup": op7_tiled_vector_dedup,
    "op8_prefix_token_counts": op8_prefix_token_counts,
    "op9_curriculum_mixing": op9_curriculum_mixing,
    "op10_block_anchor_dedup": op10_block_anchor_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_byte_bpe_codec": op13_byte_bpe_codec,
}
