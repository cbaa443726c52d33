"""Documents to token ids: classify, drop shared lines, join near copies, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next
one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from userbaseline.llm import byte_bpe, decontamination, jaccard_join, line_dedup, quality_classifier
from userbaseline.llm.queries import RANKS, table
from userbaseline.session import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a score of at least 0.5."""
    held_out = quality_classifier.held_out(F.col("doc_id"))
    weights = quality_classifier.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality_classifier.with_score(docs, weights).filter("score >= 0.5").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents share; n_chars follows the text."""
    kept = line_dedup.drop_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents."""
    return jaccard_join.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and decoded bytes."""
    # small tables: the executors still hold what the earlier stages left in their heaps
    return byte_bpe.encode_rows(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, tables=0.25)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: the classifier's weights and the seeds' hits are not expressible in SQL; a brute-force test stands in
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
