"""The article catalogue and its read surface, over append-only tables.

Records and progress are logs; a state is the latest row per article, by max_by.  Nothing is
rewritten in place.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import col
from .title import display_title

ALLOWED = (".txt", ".pdf")
# The percent of a stage that reports none.
STAGE_PERCENT = {"queued": 10, "processing": 30, "ner": 60, "tsne": 85, "completed": 100, "failed": 100}
TRANSITIONS = {
    None: ("uploaded",),
    "uploaded": ("processing", "failed"),
    "processing": ("processing", "processed", "failed"),
    "processed": ("processing",),
    "failed": ("processing",),
}


def now() -> str:
    return datetime.now(UTC).isoformat()


def new_id() -> str:
    return f"{datetime.now(UTC):%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"


def record(original_name: str, root: str) -> dict:
    """A new article's record; raises on a missing name or a suffix that is not allowed."""
    name = original_name.replace("\\", "/").rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if not name or suffix not in ALLOWED:
        raise ValueError(f"not an article file: {original_name!r}")
    key = new_id()
    at, when = f"{root}/article_id={key}", now()
    out = {k: f"{at}/{k}" for k in schemas.OUTPUTS.names}
    return {"id": key, "original_name": name, "uploaded_at": when, "updated_at": when, "status": "uploaded", "source_path": f"{at}/source/{name}", "outputs": out}


def records_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([{**dict.fromkeys(schemas.ARTICLE.names), **r} for r in rows], schemas.ARTICLE)


def latest(log: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """The last row per key of an append-only log; a row without an order value is the oldest."""
    others = [c for c in log.columns if c not in keys]
    # a struct is never null, whatever its fields
    return log.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(col(order))).alias("r")).select(*keys, "r.*")


def latest_records(records: DataFrame) -> DataFrame:
    """Each article's record as it stands: by its last update, else its upload."""
    return latest(records, ["id"], F.coalesce("updated_at", "uploaded_at"))


def listed(records: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Processed articles that have points, newest upload first; a missing time is the oldest."""
    kept = records.where("status = 'processed'")
    if points is not None:
        kept = kept.join(points.select(F.col("article_id").alias("id")).distinct(), "id", "left_semi")
    return kept.orderBy(F.coalesce("uploaded_at", F.lit("")).desc())


def percent_of(percent: str | Column, stage: str | Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STAGE_PERCENT.items() for x in kv])
    return F.coalesce(col(percent), F.try_element_at(table, F.coalesce(col(stage), F.lit("processing"))), F.lit(50))


def allowed_step(before: str | Column, after: str | Column) -> Column:
    """Whether the state machine has this step; a null state is before the upload."""
    out = F.lit(False)
    for state, nexts in TRANSITIONS.items():
        out = out | (col(before).eqNullSafe(F.lit(state)) & col(after).isin(*nexts))
    return out


def progress_row(article_id: str, seq: int, stage: str, percent: int, processed: int = 0, total: int = 0, eta: int | None = None, entities: int | None = None) -> tuple:
    return (article_id, seq, stage, percent, processed, total, eta, entities)


def output_kind(path: str | Column) -> Column:
    """Which point file a result's name leads to."""
    return F.when(F.contains(F.lower(col(path)), F.lit("article")), "article").otherwise("texts")


def stepped(spark: SparkSession, article: dict, status: str, **changes) -> dict:
    """The record after a step of the state machine; an error for a step that it does not have."""
    if status not in TRANSITIONS[article["status"]]:
        raise ValueError(f"no step from {article['status']} to {status}")
    return {**article, **changes, "status": status, "updated_at": now()}


class Library:
    """Reads of one library folder: records, progress, points, entities, cleaned texts, as Parquet.

    points, ner, embeddings and cleaned are partitioned by article_id, so a read of one article
    prunes.  records and progress are append-only logs.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def append(self, name: str, rows: DataFrame, by_article: bool = True) -> None:
        writer = rows.write.mode("append")
        (writer.partitionBy("article_id") if by_article else writer).parquet(f"{self.root}/{name}")

    def keep_record(self, article: dict) -> dict:
        self.append("records", records_frame(self.spark, [article]), by_article=False)
        return article

    def keep_progress(self, article_id: str, seq: int, stage: str, percent: int, **counts) -> None:
        rows = [progress_row(article_id, seq, stage, percent, **counts)]
        self.append("progress", self.spark.createDataFrame(rows, schemas.PROGRESS), by_article=False)

    def ingest(self, path: str) -> dict:
        """Stores the file under a new article, appends its record and queued progress; returns the record."""
        article = self.keep_record(record(path, self.root))
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        source, to = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, article["source_path"]))
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, to.getFileSystem(conf), to, False, conf)
        self.keep_progress(article["id"], 0, "queued", 0)
        return article

    def process(self, article: dict, tagger, embed=None) -> dict:
        """Cleans, tags and projects an ingested article and appends its outputs, step by step.

        Progress goes from loading by 5 and the texts' share up to 75 to tsne and completed; a
        failure is a step of its own, with its message, and is raised again.  tagger: as
        entities_of has it.  embed: entity rows to rows with `embedding`; without it no points.
        """
        from ..plans.pipeline import entities_of
        from ..sources import readers
        from .project import points, projected

        key, began = article["id"], now()
        article = self.keep_record(stepped(self.spark, article, "processing", stage="queued"))
        try:
            self.keep_progress(key, 1, "loading", 5)
            pdf = article["source_path"].lower().endswith(".pdf")
            docs = (readers.read_pdfs if pdf else readers.read_texts)(self.spark, article["source_path"]).withColumn("doc_id", F.lit(0).cast("long"))
            mine = F.lit(key).alias("article_id")
            if self.missing("cleaned", key):
                from .clean import clean_pdf

                # a text file is kept as it came
                self.append("cleaned", (clean_pdf(docs) if pdf else docs).select("text", mine))
            texts = readers.article_texts(self.of("cleaned", key).select(F.lit(0).cast("long").alias("doc_id"), "text"))
            total = texts.count()
            article = self.keep_record(stepped(self.spark, article, "processing", stage="ner"))
            rows, results = entities_of(texts, tagger)
            found = results.join(texts, ["doc_id", "text_index"], "right").select("text_index", "text", "entities", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), mine)
            self.append("ner", found)
            n = self.of("ner", key).agg(F.sum("n_entities")).first()[0]
            self.keep_progress(key, 2, "ner", 75, processed=total, total=total, entities=int(n))
            if embed is not None and n:
                self.append("embeddings", embed(rows).select("id", "embedding", "label", "entity", "text_index", "sentence_id", "sentence_text", mine))
                article = self.keep_record(stepped(self.spark, article, "processing", stage="tsne"))
                self.keep_progress(key, 3, "tsne", 85, processed=total, total=total, entities=int(n))
                self.append("points", points(projected(self.of("embeddings", key), "embedding", "article_id", "id")).withColumn("article_id", F.lit(key)))
            self.keep_progress(key, 4, "completed", 100, processed=total, total=total, eta=0, entities=int(n))
            return self.keep_record(stepped(self.spark, article, "processed", stage="completed", processed_at=now()))
        except Exception as e:
            self.keep_progress(key, 5, "failed", 100)
            self.keep_record(stepped(self.spark, article, "failed", stage="failed", error=f"{began}: {e}"[:2000]))
            raise

    def missing(self, name: str, article_id: str) -> bool:
        try:
            self.of(name, article_id)
        except KeyError:
            return True
        return False

    def example_points(self) -> DataFrame:
        """Points to show before any upload: those of the first article listed; KeyError without one."""
        first = self.list_articles().select("id").first()
        if first is None:
            raise KeyError("no article has points")
        return self.points(first["id"])

    def point(self, article_id: str, point_id: int) -> DataFrame:
        """One point, from chart to text."""
        return self.points(article_id).where(F.col("id") == point_id)

    def list_articles(self) -> DataFrame:
        return listed(latest_records(self.table("records")), self.table("points"))

    def of(self, name: str, article_id: str) -> DataFrame:
        """One article's rows of a table; KeyError where there are none, or no such table yet."""
        try:
            found = self.table(name).where(F.col("article_id") == article_id)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raise KeyError(f"no {name} of any article") from None
        if found.isEmpty():
            raise KeyError(f"no {name} of article {article_id}")
        return found

    def points(self, article_id: str) -> DataFrame:
        """Points; projected anew from the embeddings where they are missing.

        They replace the article's partition, so that two readers at once leave one set of points.
        """
        try:
            return self.of("points", article_id).orderBy("id")
        except KeyError:
            from .project import pca_points, points

            rows = points(pca_points(self.of("embeddings", article_id), "embedding")).withColumn("article_id", F.lit(article_id))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("article_id").parquet(f"{self.root}/points")
            return self.of("points", article_id).orderBy("id")

    def ner(self, article_id: str) -> DataFrame:
        return self.of("ner", article_id).orderBy("text_index")

    def cleaned_text(self, article_id: str) -> DataFrame:
        return self.of("cleaned", article_id)

    def meta(self, article_id: str) -> DataFrame:
        """(record, progress, title)."""
        mine = latest_records(self.table("records")).where(F.col("id") == article_id)
        done = latest(self.table("progress"), ["article_id"], "seq").withColumn("percent", percent_of("percent", "stage"))
        text = self.table("cleaned").select(F.col("article_id").alias("id"), display_title("text").alias("title"))
        done = done.select(F.col("article_id").alias("id"), F.struct(*[c for c in done.columns if c != "article_id"]).alias("progress"))
        fields = F.struct(*mine.columns).alias("article")
        return mine.select("id", fields).join(done, "id", "left").join(text, "id", "left").drop("id")
