"""The registered queries of this subpackage: each operator over its whole table, as digests."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from userbaseline.llm import (
    byte_bpe,
    chat_tree,
    decontamination,
    jaccard_join,
    line_dedup,
    merkle_manifest,
    pair_index_bpe,
    paragraph_dedup,
    quality_classifier,
    quality_rules,
    secret_frequency,
    token_alignment,
    warc_store,
)
from userbaseline.session import scratch_path

RANKS = "byte_bpe_multi_50k.tiktoken"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every paragraph and passage removed, with the one that stays in its place."""
    return paragraph_dedup.repeats(table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, folder, "documents"))
    return judged.drop("lang", "source", "n_lines")


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = quality_classifier.held_out(F.col("doc_id"))
    weights = quality_classifier.train(docs, table(spark, folder, "labels"), ~held_out)
    scored = quality_classifier.with_score(docs, weights)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item it holds."""
    found = decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("r1", "r2")


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return byte_bpe.encode_rows(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=False)


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents")).drop("n_copies")


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc_store.write(table(spark, folder, "pages"), path)
    return warc_store.parsed(warc_store.read(spark, path)).drop("record_bytes")


def op9_secret_frequency(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_frequency.secret_spans(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secret_frequency.spans_text(F.col("base")), 256).alias("base_sha256"),
        secret_frequency.spans_text(F.col("spans")).alias("spans"),
        "n_copied", "n_specific",
    )


#: a conversation whose texts look like control strings
PROBE = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op10_chat_tree(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    held = chat_tree.read_back(chat_tree.chat_trees(turns.unionByName(probe)))
    said = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    learnt = F.array_join("learnt", "")
    return held.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaf with its proof, and whether a text that was lower-cased for some ids still gives the root."""
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.translate("text", line_dedup.UPPER, line_dedup.FOLDED)
    picked = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(picked, changed).otherwise(F.col("text"))
    held = merkle_manifest.manifest(
        table(spark, folder, "documents"), {"found": merkle_manifest.leaf_hash(*values, text)}
    )
    folded = held.withColumn("folded_root", merkle_manifest.folded_root(F.col("found"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(merkle_manifest.proof(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_pair_index_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pair_index_bpe.encode_rows(docs, public_tokenizers.path(BYTE_BPE), with_ids=False)


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_alignment.alignment(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        op1_substring_dedup, op2_quality_rules, op3_quality_classifier, op4_decontamination, op5_byte_bpe,
        op6_jaccard_join, op7_line_dedup, op8_warc, op9_secret_frequency, op10_chat_tree,
        op11_merkle_manifest, op12_pair_index_bpe, op13_token_alignment,
    ]
    return {query.__name__: query for query in made}
