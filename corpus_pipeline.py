"""A corpus pipeline over the operators of ``skygrid.llm``.

Five stages, each on all that its predecessor kept: quality classifier,
SimHash near copies, benchmark decontamination, personal data, packing.
Every stage but the last returns the columns of ``documents``; rows keep nulls
in other columns, and an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrid.llm import decontamination, packing, pii, quality, simhash
from skygrid.llm.common import discard, free_name, materialise, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.3) go.

    Null and empty texts are scored as empty ones; repeated rows and rows without
    doc_id are scored each; columns of any name pass through.
    """
    model, score = quality.train(docs, table(spark, sf_dir, "labels")), free_name(docs, "score")
    return quality.scores(docs, model, score).where(F.col(score) >= 0.3).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash over five-word
    shingles, links verified at a similarity of 0.8.

    The one of the smallest doc_id; of repeated rows one stays, texts without
    words, null ones too, are one group, and rows without doc_id all stay.
    """
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; without items all rows stay.
    """
    mark = free_name(docs, "contaminated")
    flagged = decontamination.flag_contaminated(docs, table(spark, sf_dir, "benchmark"), mark)
    return flagged.where(~F.col(mark)).drop(mark)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to marks; every document stays.

    ``n_chars`` follows the new text, null for a null one.
    """
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a null text is an empty one."""
    return packing.pack(docs).pieces.drop("part", "rank")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", pii_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            out = materialise(stage(spark, docs, sf_dir), outer=True)
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
