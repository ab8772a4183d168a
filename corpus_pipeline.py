"""A corpus pipeline over `documents`, in stages that each use one operator of graphloom.llm.

Each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the docs of the next one.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import line_dedup, mixing, packing, quality, simhash
from graphloom.storage import StageTables

# Documents whose score is below this are rejected.
LEAST_QUALITY = 0.3
# Texts of at least this Jaccard similarity of five-word shingles are near copies.
NEAR_COPY = 0.8


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line classifier, trained on `labels`, rejects."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, name="_gl_score").where(F.col("_gl_score") >= LEAST_QUALITY).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs; a document goes if none of its lines is left.

    n_chars is counted again where lines are deleted.
    """
    cleaned = line_dedup.remove_repeated_lines(docs).where("removed_lines < n_lines")
    length = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", length).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near copies: SimHash classes, joined where texts are similar."""
    return simhash.keep_first(docs, similarity=NEAR_COPY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the target weights of the sources ask for."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

# Fingerprints, the trained model and token ids have no SQL; tests hold the rows of small inputs
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared stage folder and reread."""
    stage = StageTables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs, _ = stage.put(docs, f"stage-{number}")
    return docs
