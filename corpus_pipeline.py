"""A corpus pipeline: from raw documents to token ids, stage by stage.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents and decide which rows stay; the last returns what a trainer reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import chunks, decontaminate, language, pieces, simhash
from ledgerlark.llm.common import fold, is_written, read, scratch, shared_dir
from ledgerlark.llm.queries import piece_model


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a text or without a letter (``und``) go; others get the predicted language where they have none.

    If no row has a language to learn from, all documents with a letter stay as they are.
    """
    model = language.train(docs.where(fold("doc_id", 4) != 2))
    return language.told(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return chunks.distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays; documents without an id stay."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words lie in benchmark passages go; items without an id count too."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"), unnamed=True)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with their number and digests."""
    return pieces.encoded(docs, piece_model(), [c for c in ("doc_id", "lang", "source") if c in docs.columns])


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: Shingle fingerprints and piece merges can't be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The rows of the last stage. A stage's own intermediate tables go when it has been written.

    folder: where the stages' tables are kept, by number. A run that finds a stage's finished table there goes on
    from it, so that a run whose driver was lost can be resumed; without a folder a new one is taken.
    """
    at = (folder or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}").rstrip("/")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{at}/stage-{k}"
        if not is_written(spark, path):
            with scratch(spark):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
