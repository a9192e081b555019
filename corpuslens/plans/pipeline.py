"""Whole analyses: articles to chunks, entities, vectors, points and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import clean
from ..operators.entities import GazetteerTagger, Tagger, entity_rows, tagged, text_results, windowed_hits, with_ids
from ..operators.frequency import entity_frequency, sized
from ..operators.segment import exploded, paragraphs, word_windows


def article_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_index, text): cleaned documents (doc_id, text, source_type, ...) in paragraphs."""
    done = clean(docs)
    pdf = exploded(done.where("source_type = 'pdf'"), paragraphs("text", pdf=True))
    txt = exploded(done.where("source_type is null or source_type <> 'pdf'"), paragraphs("text"))
    return pdf.unionByName(txt)


def entities_of(texts: DataFrame, tagger: Tagger | dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(entity rows with ids, results per text) of texts (doc_id, text_index, text)."""
    tagger = GazetteerTagger(tagger) if isinstance(tagger, dict) else tagger
    keys = ["doc_id", "text_index"]
    chunks = tagged(word_windows(texts, keep=tuple(keys)), tagger)
    rows = with_ids(entity_rows(chunks, [*keys, "chunk_index"]), ["doc_id"], ["text_index", "chunk_index", "entity_index"])
    return rows.withColumnRenamed("chunk", "sentence_text").withColumn("sentence_id", F.col("text_index")), text_results(chunks, keys)


def term_frequencies(docs: DataFrame, terms: dict[str, str]) -> DataFrame:
    """(key, entity, frequency, label, size): the terms of all documents' word windows, expressions only."""
    hits = windowed_hits(docs, terms)
    return sized(entity_frequency(hits, order=F.struct("doc_id", "chunk_index", "word", "part"), centroid=False))
