"""Streams: latest progress and status per article, and files as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.articles import latest, percent_of


def progress_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(schemas.PROGRESS).json(folder)


def latest_progress(progress: DataFrame) -> DataFrame:
    """(article_id, ...): the row with the largest seq per article; state is one row per article."""
    others = [c for c in progress.columns if c != "article_id"]
    rows = progress.groupBy("article_id").agg(F.max_by(F.struct(*others), "seq").alias("r")).select("article_id", "r.*")
    return rows.withColumn("percent", percent_of("percent", "stage"))


def run_to_table(latest: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's changed articles replace `path`'s version of the batch: exactly once by batch id.

    The folder is a log, which newest() reads as a table.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return latest.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str) -> DataFrame:
    """One row per article of what run_to_table has written: that of the last batch."""
    return latest(spark.read.parquet(path), ["article_id"], "batch").drop("batch")


def landed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text): whole text files as they land in a folder."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.txt").load(folder)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def running_maximum(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, running_max) so far; one row of state per key."""
    return values.groupBy(key).agg(F.max(value).alias("running_max"))
