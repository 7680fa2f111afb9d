"""From documents to a training mix: five stages, each written as a table and read again.

Languages that are not recognised go; one document of each group of near-duplicates stays; documents that hold
benchmark passages go; personal data and what discloses it are blanked out; sources are mixed to target weights, with
one row per repetition. All but the last return the columns of `documents`, extra columns included. Rows with NULLs,
empty or repeated rows and empty tables are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from usagelens.llm import decontaminate, langid, mixing, pii, simhash
from usagelens.llm.common import save, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a known language; what is empty, without letters or far from all languages goes."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of fingerprints within 3 bits; 3-word shingles."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with finds and disclosing terms replaced in their texts."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row per repetition, with mix_repetition and mix_words."""
    return mixing.repeat_documents(docs)


STAGES = [
    ("identify_language", identify_language),
    ("drop_near_duplicates", drop_near_duplicates),
    ("drop_contaminated", drop_contaminated),
    ("sanitise_personal_data", sanitise_personal_data),
    ("mix_sources", mix_sources),
]

# Trained centroids and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
