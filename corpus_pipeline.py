"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of documents; the last adds the piece ids, having decoded them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import crf, decontaminate, neardup, pieces, pii
from quire.llm.common import free_name, shared_folder, table
from quire.llm.queries import held_out

#: A document is rejected when no language has so much of its letters; also when it has no letter at all.
LEAST_SCORE = 0.4
#: A document is rejected when benchmark passages make up more of its words than this.
MOST_HIT = 0.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages; the model learns from the labelled ones."""
    model = crf.fit(docs.where(~held_out()).select("text", "lang"))
    found = crf.identify(docs, model, name="found_language")
    return found.where((F.col("found_language.lang") != crf.UNKNOWN) & (F.col("found_language.score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id in each class of near duplicates."""
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_share=MOST_HIT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that disclose it, in the texts."""
    made = pii.sanitise(docs)
    return made.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else made


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the texts' piece ids and decodes them; a text that doesn't come back is an error."""
    decoded = free_name(docs, "decoded")
    coded = pieces.encode(docs, decoded=decoded)
    checked = F.when(F.col(decoded).eqNullSafe(F.col("text")), F.col("pieces")).otherwise(F.raise_error(F.lit("pieces don't decode to their text")))
    return coded.withColumn("pieces", checked).drop(decoded)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", sentencepiece),
]
#: SQL can't express the learned model, the signatures or the encoder; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, by way of tables in the shared folder."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
