"""A training corpus from ``documents``: stages run in order, each on what the stage before kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
``run`` writes every stage as Parquet to the shared folder and reads it back as the next one's input, so a
lost executor costs at most one stage. All stages but the last return the columns of ``documents``; a stage
that changes texts also corrects ``n_chars``.

Defined results: NULL, empty and short texts fail the quality rules and go there; a stage that is called alone passes them
on as its operator defines (NULL stays NULL, no hits, no entities, no tokens). Rows with a NULL id stay, each of them,
in the near-duplicate stage. Repeated rows count as copies. Extra columns are kept until the last stage, whose results
replace columns of the same name. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, near_dedup, piece_codec, quality_rules, surrogates
from quarry.llm.common import materialise, prepare, table
from quarry.llm.queries import PIECE_BPE, SURROGATE_KEY

#: Near duplicates share this percentage of their five-word shingles.
SHINGLE, PERCENT = 5, 80


def _recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default rule policy keeps."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return near_dedup.keep_one(docs, SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without ten-word windows of ``benchmark``; documents that mostly consist of them go."""
    return _recount(decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data and secrets."""
    return _recount(surrogates.replace_entities(docs, SURROGATE_KEY))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids and the check that these decode to the text."""
    prepare(spark)
    return piece_codec.encode(docs, PIECE_BPE)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("sentencepiece", tokens)]

#: SQL cannot express surrogates and encodings; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
