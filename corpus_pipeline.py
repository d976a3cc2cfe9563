"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and
line dedup one more, BEFORE, which near-dedup takes away again. No stage reads the documents table: it may be gone once
the first one has written its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import lines, minhash, mixing, pieces, quality
from tallyforge.llm.common import deleted, scratch, work_dir, written

#: The text of a document as it was, where line dedup has cut something from it; else null.
BEFORE = "text_before"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy passes."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; emptied documents go."""
    return lines.clean(docs)


def line_dedup_with_before(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """line_dedup as a stage: BEFORE hands on what near-dedup has to compare."""
    return lines.clean(docs, before=BEFORE)


def near_dedup_by_before(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class.

    Documents are compared by their texts here and by those that BEFORE has: line dedup has cut from later copies what
    they share with the first one, and what is left of them resembles nothing. Without that column only the texts here count.
    """
    if BEFORE not in docs.columns:
        return minhash.representatives(docs)
    before = docs.where(F.col(BEFORE).isNotNull()).select("doc_id", F.col(BEFORE).alias("text"))
    return minhash.representatives(docs.drop(BEFORE), before=before)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """near_dedup_by_before for callers that have the documents table and docs without BEFORE; no stage of the pipeline.

    Without a folder of tables only the texts of docs count.
    """
    return minhash.representatives(docs, before=spark.read.parquet(f"{sf_dir}/documents.parquet") if sf_dir else None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token-prefixes of the leaves that the target weights take."""
    return mixing.mix(docs, mixing.PIPELINE)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document."""
    return pieces.encoded(docs, pieces.model_path(spark))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_with_before),
    ("MinHash near-dedup", near_dedup_by_before),
    ("mixing sources", mix_sources),
    ("SentencePiece sampling", encode_pieces),
]

#: BagMinHash and the sampled segmentations have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each is written as Parquet and read again, and what only led to it is deleted."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), folder, f"stage-{k}")
        deleted(spark, f"{folder}/stage-{k - 1}")
    return docs
