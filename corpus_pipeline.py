"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, PII, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_engine.llm import byte_bpe, decontamination, near_duplicates, pii, toxicity
from listing_engine.llm.shared import shared_folder, table


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.filter("toxicity_score < 0.5").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of near-duplicates."""
    return near_duplicates.deduplicated(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_people(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data and the length of the new text."""
    done = pii.pseudonymize(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether the ids decode to the text's bytes."""
    done = byte_bpe.encoded(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return done.select("doc_id", "ids", "n_tokens", (F.col("decoded") == F.col("text").cast("binary")).alias("round_trip"))


STAGES = [
    ("toxicity", keep_harmless),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("pii", hide_people),
    ("byte_bpe", encode),
]

#: The fitted classifier and the byte-pair merges have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each returns is written to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
