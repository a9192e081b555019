"""The stages of the corpus pipeline: DataFrames of documents in and out.

Every stage but the last returns the columns it was given.  Rows are told apart by a 64-bit hash
of doc_id and text, so what a stage decides of one row never touches another text under the same
doc_id.  Defined results, for all stages: an empty table gives an empty one; columns beyond those
of documents stay as they are, and so do their nulls; names that begin with two underscores are
the stages' own.  Texts are read whole, of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, pii, sentencepiece_codec
from .ngram_join import jaccard_components
from .shared import read_table, small_batches

PRED, SCORE, KEY, COPIES = "__lang_pred", "__lang_score", "__key", "__copies"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with KEY, which rows share only if they have both doc_id and text in common."""
    return docs.withColumn(KEY, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined, null and letterless texts; fills in a missing lang.

    Rows that repeat a doc_id are judged by their own text each.  Without a labelled row nothing
    can be learned, so nothing is kept.
    """
    small_batches(spark)
    found = langid.identify(docs, langid.fit(docs), lang_pred=PRED, score=SCORE)
    return found.where(F.col(PRED) != "und").withColumn("lang", F.coalesce("lang", PRED)).drop(PRED, SCORE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of shingle similarity 0.8 or more.

    Rows that repeat a doc_id with another text are documents of their own; of rows that repeat
    both, the smallest one stays.  Two texts of one doc_id that link: the smaller key stays.  A null
    doc_id is never linked; null and wordless texts are linked with nothing.
    """
    small_batches(spark)
    rows = keyed(docs).where("doc_id is not null")
    groups = jaccard_components(rows.select(F.col(KEY).alias("doc_id"), "text"), width=5, percent=80)
    groups = groups.groupBy(F.col("doc_id").alias(KEY)).agg(F.min("component_id").alias("__component"), F.count("*").alias(COPIES))
    members = groups.join(rows.select(KEY, F.col("doc_id").alias("__id")), KEY)
    first = members.groupBy("__component").agg(F.min(F.struct("__id", KEY, COPIES)).alias("m"))
    kept = rows.join(first.select(f"m.{KEY}", f"m.{COPIES}"), KEY)
    once = kept.where(F.col(COPIES) == 1).select(*docs.columns)
    again = kept.where(F.col(COPIES) > 1).groupBy(KEY).agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return once.unionByName(again).unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which any window of a benchmark item occurs; each row by its own text.

    Null texts hold no window; without benchmark items nothing goes.
    """
    rows = keyed(docs)
    found = decontaminate.contamination(rows.select(F.col(KEY).alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"), width=10)
    bad = found.where("contaminated").select(F.col("doc_id").alias(KEY)).distinct()
    return rows.join(bad, KEY, "left_anti").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data, plain and disguised; n_chars follows the text.  A null text stays null."""
    small_batches(spark)
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of every row that is left; a null or empty text has no ids."""
    small_batches(spark)
    return sentencepiece_codec.encoded(docs, sentencepiece_codec.default_model()).withColumn("n_tokens", F.size("ids"))
