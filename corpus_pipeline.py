"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Language ID drops documents without a recognisable language; the n-gram Jaccard join keeps one
document of each near-duplicate group; decontamination drops documents that hold a benchmark
passage; personal data is masked in the text; the last stage returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm.pipeline import decontaminated, language, near_duplicates, tokens, without_personal_data
from corpuslens.llm.shared import Scratch, read_table

STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", without_personal_data),
    ("sentencepiece", tokens),
]

#: Connected components, trained language models and token ids have no SQL form; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
