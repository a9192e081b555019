"""Sinks: JSON, Parquet and text, partitioned by article where there is one."""

from __future__ import annotations

import json
import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _writer(df: DataFrame, mode: str):
    w = df.write.mode(mode)
    return w.partitionBy("article_id") if "article_id" in df.columns else w


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; characters outside ASCII stay as they are."""
    _writer(df, mode).json(path)


def write_document(df: DataFrame, path: str) -> None:
    """One indented JSON array, as viewers read it: for the rows of one article, which the driver streams in order."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    out, mark = to.getFileSystem(conf).create(to, True), "["
    try:
        for row in df.toLocalIterator():
            text = json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2, default=str)
            out.write(bytearray((mark + "\n" + textwrap.indent(text, "  ")).encode()))
            mark = ","
        out.write(bytearray(b"[]" if mark == "[" else b"\n]"))
    finally:
        out.close()


def write_embeddings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _writer(df, mode).parquet(path)


def joined_paragraphs(rows: DataFrame) -> DataFrame:
    """(doc_id, text): a document's paragraphs in order, each followed by a blank line."""
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("text_index", "text"))).alias("p"))
    return lists.select("doc_id", F.array_join(F.transform("p", lambda x: F.concat(x["text"], F.lit("\n\n"))), "").alias("text"))


def write_cleaned(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Cleaned texts as rows (doc_id, text); a text of many lines stays one row."""
    _writer(docs.select(*[c for c in ("doc_id", "article_id", "text") if c in docs.columns]), mode).parquet(path)


def write_text_files(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Plain text, one folder per doc_id."""
    docs.select("doc_id", F.col("text").alias("value")).write.mode(mode).partitionBy("doc_id").text(path)
