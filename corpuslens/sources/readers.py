"""Sources: text and PDF files, literal texts, result and point JSON, NPZ files."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.normalize import file_suffix
from ..functions.text import strip
from ..operators.segment import article_parts, exploded

# The texts that are analysed where none is given.
DEFAULT_TEXTS = [
    "The Transformer architecture has revolutionized natural language processing. BERT and GPT are state-of-the-art models using attention mechanisms. ImageNet dataset contains millions of labeled images for computer vision tasks. The BLEU and ROUGE metrics are commonly used to evaluate machine translation systems.",
    "Deep learning techniques like Convolutional Neural Networks and Recurrent Neural Networks have achieved impressive results. The ResNet architecture won the ImageNet competition. Transfer learning with models like BERT provides excellent accuracy. Common applications include sentiment analysis and named entity recognition.",
    "The Vision Transformer model applies attention mechanisms to image processing. YOLO is a popular object detection model. The CIFAR-10 dataset is widely used for benchmarking. Accuracy and F1-score are standard evaluation metrics in machine learning research.",
    "Large Language Models such as GPT-3 and PaLM have demonstrated remarkable capabilities. The Transformer-XL architecture improves upon standard Transformers. Word2Vec embeddings were pioneering in NLP technology. The SQuAD dataset revolutionized question answering evaluation.",
]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, source_type): one row per whole .txt file."""
    files = spark.read.option("pathGlobFilter", "*.[tT][xX][tT]").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"), F.lit("txt").alias("source_type"))


def pdf_pages(content: bytes) -> tuple[list[str], str | None]:
    """The pages' texts and the title of the metadata, by whichever PDF library is installed."""
    try:
        from pypdf import PdfReader
    except ImportError:
        try:
            from PyPDF2 import PdfReader
        except ImportError:
            import pdfplumber

            with pdfplumber.open(io.BytesIO(content)) as pdf:
                meta = pdf.metadata or {}
                return [p.extract_text() or "" for p in pdf.pages], (meta.get("Title") or "").strip() or None
    reader = PdfReader(io.BytesIO(content))
    title = getattr(reader.metadata, "title", None) if reader.metadata else None
    return [p.extract_text() or "" for p in reader.pages], (title or "").strip() or None


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, title_hint, first_page, pages, source_type): one row per .pdf file; needs a PDF library.

    Pages with text have their spacing fixed and are joined by blank lines; first_page is the very
    first one as it is, which may be empty.
    """
    from ..functions.normalize import fix_spacing

    def run(batches):
        for pdf in batches:
            rows = [(p, *pdf_pages(bytes(c))) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame({"path": [r[0] for r in rows], "page_texts": [[x for x in r[1] if x] for r in rows], "first_page": [next(iter(r[1]), None) for r in rows], "title_hint": [r[2] for r in rows], "pages": [len(r[1]) for r in rows]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", "content").mapInPandas(run, "path string, page_texts array<string>, first_page string, title_hint string, pages int")
    text = F.array_join(F.transform("page_texts", fix_spacing), "\n\n")
    return rows.select("path", text.alias("text"), "title_hint", "first_page", "pages", F.lit("pdf").alias("source_type"))


def source_type(path: str):
    """txt or pdf by the suffix, null for other files."""
    suffix = file_suffix(path)
    return F.when(suffix == ".pdf", "pdf").when(suffix == ".txt", "txt")


def texts_frame(spark: SparkSession, texts: list[str] | None = None) -> DataFrame:
    """(doc_id, text_index, text) of literal texts."""
    rows = [(0, i, t) for i, t in enumerate(DEFAULT_TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, "doc_id long, text_index int, text string")


def article_texts(files: DataFrame) -> DataFrame:
    """(doc_id, text_index, text): a TITLE: line and the blank-line parts of each file (doc_id, text)."""
    return exploded(files.where(strip("text") != ""), article_parts("text"))


def read_ner_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.NER_RESULT).json(path, multiLine=True)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.POINT).json(path, multiLine=True)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ARTICLE).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="metadata.json")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMBEDDED).parquet(path)


def import_npz(spark: SparkSession, path: str) -> DataFrame:
    """Embedding rows of .npz files; each file is one article's and is read by one task."""
    import numpy as np

    def run(batches):
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                z = np.load(io.BytesIO(bytes(c)), allow_pickle=False)
                n = len(z["embeddings"])
                yield pd.DataFrame(
                    {
                        "path": [p] * n, "id": range(n), "embedding": list(z["embeddings"].astype("float32")), "label": z["labels"].astype(str), "entity": z["texts"].astype(str),
                        "text_index": z["text_index"].astype("int32"), "sentence_id": z["sentence_ids"].astype("int32"), "sentence_text": z["sentence_texts"].astype(str),
                    }
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(
        run, "path string, id long, embedding array<float>, label string, entity string, text_index int, sentence_id int, sentence_text string"
    )
