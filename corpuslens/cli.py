"""Command line: python -m corpuslens clean | run | project."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import functions as F

from .operators.articles import progress_row
from .operators.entities import hashed_vectors
from .operators.project import pca_points, points, projected
from .plans.pipeline import article_paragraphs, entities_of
from .session import session
from .sources import readers, sinks


def _documents(spark, path: str):
    frame = readers.read_pdfs(spark, path) if path.lower().endswith(".pdf") else readers.read_texts(spark, path)
    return frame.withColumn("doc_id", F.xxhash64("path"))


def clean(args: argparse.Namespace) -> int:
    spark = session()
    rows = article_paragraphs(_documents(spark, args.article))
    sinks.write_text_files(sinks.joined_paragraphs(rows), args.output)
    if args.save_processed:
        sinks.write_cleaned(sinks.joined_paragraphs(rows), args.save_processed)
    return 0


def run(args: argparse.Namespace) -> int:
    spark = session()
    with open(args.terms, encoding="utf-8") as f:
        terms = json.load(f)
    if args.article:
        texts = readers.article_texts(_documents(spark, args.article).select("doc_id", "text"))
    else:
        texts = readers.texts_frame(spark, args.text or None)
    n, began, steps = texts.count(), time.time(), []

    def progress(stage: str, percent: int, done: int = 0, found: int | None = None) -> None:
        """The steps so far, the last one with the time that is left at this pace."""
        if args.progress_file:
            eta = int((time.time() - began) * (100 - percent) / percent) if percent else None
            steps.append(progress_row(args.output, len(steps), stage, percent, done, n, eta, found))
            sinks.write_document(spark.createDataFrame(steps, readers.schemas.PROGRESS), args.progress_file)

    progress("queued", 0)
    progress("loading", 5)
    rows, results = entities_of(texts, terms)
    results = texts.join(results, ["doc_id", "text_index"], "left").orderBy("doc_id", "text_index")
    results = results.select("text", F.coalesce("entities", F.array().cast(results.schema["entities"].dataType)).alias("entities"))
    sinks.write_document(results, args.output)
    found = rows.count()
    progress("ner", 75, n, found)
    if args.entities:
        rows.write.mode("overwrite").parquet(args.entities)
    if args.embeddings or args.tsne_output:
        vectors = hashed_vectors(rows.withColumn("article", F.lit(0)))
        if args.embeddings:
            sinks.write_embeddings(vectors.select(*readers.schemas.EMBEDDED.names), args.embeddings)
        if args.tsne_output:
            progress("tsne", 85, n, found)
            sinks.write_document(points(projected(vectors, "embedding", "article", "id")).orderBy("id"), args.tsne_output)
    progress("completed", 100, n, found)
    return 0


def project(args: argparse.Namespace) -> int:
    spark = session()
    rows = readers.read_embeddings(spark, args.embeddings)
    if args.method == "tsne":
        rows = projected(rows.withColumn("article", F.lit(0)), "embedding", "article", "id")
    else:
        rows = pca_points(rows, "embedding")
    sinks.write_document(points(rows).orderBy("id"), args.output)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpuslens")
    commands = parser.add_subparsers(required=True)
    p = commands.add_parser("clean", help="clean an article and write its paragraphs")
    p.add_argument("article")
    p.add_argument("--output", required=True)
    p.add_argument("--save-processed")
    p.set_defaults(do=clean)
    p = commands.add_parser("run", help="tag the entities of texts")
    p.add_argument("--article")
    p.add_argument("--text", action="append")
    p.add_argument("--terms", required=True, help="a JSON object: term to label")
    p.add_argument("--output", required=True)
    p.add_argument("--entities")
    p.add_argument("--embeddings", help="Parquet of entity vectors")
    p.add_argument("--tsne-output", help="JSON document of points")
    p.add_argument("--progress-file")
    p.set_defaults(do=run)
    p = commands.add_parser("project", help="project embeddings to points")
    p.add_argument("--embeddings", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--method", choices=("pca", "tsne"), default="pca")
    p.set_defaults(do=project)
    args = parser.parse_args(argv)
    return args.do(args)


if __name__ == "__main__":
    sys.exit(main())
