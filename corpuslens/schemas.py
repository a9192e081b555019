"""The tables' schemas."""

from __future__ import annotations

from pyspark.sql import types as T

ENTITY = T.StructType().add("entity_group", "string").add("score", "double").add("word", "string").add("start", "integer").add("end", "integer")
NER_RESULT = T.StructType().add("text", "string").add("entities", T.ArrayType(ENTITY))
POINT = (
    T.StructType().add("id", "integer").add("x", "double").add("y", "double").add("label", "string").add("entity", "string")
    .add("text_index", "integer").add("sentence_id", "integer").add("sentence_text", "string")
)
EMBEDDED = (
    T.StructType().add("id", "long").add("embedding", T.ArrayType(T.FloatType())).add("label", "string").add("entity", "string")
    .add("text_index", "integer").add("sentence_id", "integer").add("sentence_text", "string")
)
OUTPUTS = T.StructType().add("ner_results", "string").add("embeddings", "string").add("tsne_data", "string").add("cleaned_text", "string")
ARTICLE = (
    T.StructType().add("id", "string").add("original_name", "string").add("uploaded_at", "string").add("status", "string")
    .add("source_path", "string").add("outputs", OUTPUTS).add("processed_at", "string").add("updated_at", "string")
    .add("stage", "string").add("error", "string")
)
PROGRESS = (
    T.StructType().add("article_id", "string").add("seq", "long").add("stage", "string").add("percent", "integer").add("processed", "integer")
    .add("total", "integer").add("eta_seconds", "integer").add("entities_extracted", "integer")
)

# The tag set by id, and each class's colour.
TAGS = (
    "B-APPLICATION", "B-ARCHITECTURE", "B-DATASET", "B-METRIC", "B-MODEL", "B-TECHNIQUE", "B-TECHNOLOGY",
    "I-APPLICATION", "I-ARCHITECTURE", "I-DATASET", "I-METRIC", "I-MODEL", "I-TECHNIQUE", "I-TECHNOLOGY", "O",
)
COLOURS = {
    "APPLICATION": "#d63384",
    "ARCHITECTURE": "#6f42c1",
    "DATASET": "#fd7e14",
    "TECHNOLOGY": "#20c997",
    "MODEL": "#0d6efd",
    "METRIC": "#198754",
    "TECHNIQUE": "#ffc107",
}
DEFAULT_COLOUR = "#666"
