"""Entity tagging and alignment: taggers, tag islands, containment join, pooling, flat rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import bound, col


class Tagger(Protocol):
    """Chunks in, entities out: one list of (label, score, word, start, end) per chunk."""

    def __call__(self, chunks: list[str]) -> list[list[tuple[str, float, str, int, int]]]: ...


class GazetteerTagger:
    """A deterministic stand-in for a trained tagger: longest matching term, any case, whole words."""

    def __init__(self, terms: dict[str, str]):
        self.labels = {t.lower(): label for t, label in terms.items()}
        longest_first = sorted(self.labels, key=lambda t: (-len(t), t))
        self.pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, longest_first)) + r")(?!\w)", re.I) if terms else None

    def __call__(self, chunks: list[str]) -> list[list[tuple[str, float, str, int, int]]]:
        if self.pattern is None:
            return [[] for _ in chunks]
        return [[(self.labels[m[0].lower()], 1.0, m[0].lower(), m.start(), m.end()) for m in self.pattern.finditer(c or "")] for c in chunks]


class LoadedTagger:
    """A tagger that each worker makes once, by make(): a model is loaded there, on the worker's device, and never pickled."""

    made: dict[str, Tagger] = {}

    def __init__(self, make: Callable[[], Tagger]):
        self.make, self.name = make, uuid.uuid4().hex

    def __call__(self, chunks: list[str]) -> list[list[tuple[str, float, str, int, int]]]:
        if self.name not in LoadedTagger.made:
            LoadedTagger.made[self.name] = self.make()
        return LoadedTagger.made[self.name](chunks)


def hashed_vectors(rows: DataFrame, size: int = 64, entity: str = "entity") -> DataFrame:
    """rows with `embedding`: the mean of fixed pseudo-random vectors of the entity's words; a stand-in for a model's states."""
    words = F.filter(F.split(F.lower(entity), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    value = lambda w, d: F.xxhash64(w, d).cast("double") / 2.0**63
    mean = lambda ws, d: F.aggregate(ws, F.lit(0.0), lambda a, w: a + value(w, d)) / F.greatest(F.size(ws), F.lit(1))
    return rows.withColumn("embedding", bound(words, lambda ws: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: mean(ws, d).cast("float"))))


def tagged(chunks: DataFrame, tagger: Tagger, chunk: str = "chunk") -> DataFrame:
    """chunks and `entities`; the tagger sees Arrow batches of whole chunks."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("entities", T.ArrayType(schemas.ENTITY))])
    names = schemas.ENTITY.names

    def run(batches):
        for pdf in batches:
            found = tagger(pdf[chunk].tolist())
            yield pdf.assign(entities=pd.Series([[dict(zip(names, e, strict=True)) for e in es] for es in found], index=pdf.index, dtype=object))

    return chunks.mapInPandas(run, schema)


def windowed_hits(texts: DataFrame, terms: dict[str, str], size: int = 320, overlap: int = 25, pattern: str = "[A-Za-z]+", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., chunk_index, word, part, entity, label): the terms among the tokens of word windows.

    The windows are those of word_windows, but none is made: each word is cut into tokens once, and
    a hit counts in every window that has its word.  The terms are literals of the plan, so their
    number is the caller's to bound.
    """
    step = size - overlap
    w = F.split(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+")
    texts = texts.select(*keep, w.alias("__w"))
    blank = (F.get("__w", F.lit(0)) == "").cast("int")
    n = F.size("__w") - blank - F.when((F.size("__w") > 1) & (F.element_at("__w", -1) == ""), 1).otherwise(0)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    words = texts.select(*keep, last.alias("last"), blank.alias("blank"), F.posexplode("__w").alias("at", "word_text"))
    words = words.select(*keep, "last", (F.col("at") - F.col("blank")).alias("word"), F.posexplode(F.regexp_extract_all("word_text", F.lit(pattern), F.lit(0))).alias("part", "entity"))
    hits = words.where(F.lower("entity").isin(list(terms)))
    label = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv])
    first = F.greatest(F.lit(0), F.ceil((F.col("word") - (size - 1)) / F.lit(step))).cast("int")
    chunks = F.explode(F.sequence(first, F.least("last", F.floor(F.col("word") / step).cast("int"))))
    return hits.select(*keep, chunks.alias("chunk_index"), "word", "part", "entity", F.element_at(label, F.lower("entity")).alias("label"))


def tag_islands(tokens: DataFrame, keys: list[str], order: str = "k") -> DataFrame:
    """(keys, entity_group, score, start, end): runs of one class's tags, a B- tag begins anew, O goes.

    tokens: (keys, order, tag, score, start, end).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    cls = F.regexp_replace("tag", "^[BI]-", "")
    new = (F.lag(cls).over(w).isNull()) | (F.lag(cls).over(w) != cls) | F.startswith("tag", F.lit("B-"))
    tokens = tokens.select("*", cls.alias("cls"), new.cast("int").alias("new")).withColumn("island", F.sum("new").over(w))
    return (
        tokens.where("tag <> 'O'")
        .groupBy(*keys, "island")
        .agg(F.first("cls").alias("entity_group"), F.avg("score").alias("score"), F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("island")
    )


def tag_name(c: str):
    """A tag id's name; null outside the tag set."""
    return F.get(F.array(*map(F.lit, schemas.TAGS)), col(c))


def contained_tokens(entities: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Entities with each token that lies within: s >= start and e <= end and e > s, on equal keys."""
    inside = (F.col("s") >= F.col("start")) & (F.col("e") <= F.col("end")) & (F.col("e") > F.col("s"))
    return entities.join(tokens, keys).where(inside)


def mean_pooled(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, embedding): the mean of the vectors, dimension by dimension."""
    dims = rows.select(*keys, F.posexplode(vector).alias("dim", "v")).groupBy(*keys, "dim").agg(F.avg("v").alias("v"))
    cells = dims.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("cells"))
    return cells.select(*keys, F.transform("cells", lambda x: x["v"].cast("float")).alias("embedding"))


def surface(chunk: str, start: str = "start", end: str = "end"):
    return F.substring(F.col(chunk), (F.col(start) + 1).cast("int"), (F.col(end) - F.col(start)).cast("int"))


def entity_rows(tagged_chunks: DataFrame, keys: list[str], chunk: str = "chunk") -> DataFrame:
    """One row per entity: (keys, entity_index, label, entity, score, start, end, chunk)."""
    rows = tagged_chunks.select(*keys, chunk, F.posexplode("entities").alias("entity_index", "e"))
    rows = rows.select(*keys, "entity_index", F.col("e.entity_group").alias("label"), F.col("e.score").alias("score"), F.col("e.start").alias("start"), F.col("e.end").alias("end"), chunk)
    return rows.withColumn("entity", surface(chunk))


def with_ids(rows: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """`id`, from 0 in emission order within each article."""
    return rows.withColumn("id", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1)


def text_results(tagged_chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entities, n_entities): all chunks' entities of a text, in chunk order."""
    lists = tagged_chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "entities"))).alias("c"))
    return lists.select(*keys, F.flatten(F.transform("c", lambda x: x["entities"])).alias("entities")).withColumn("n_entities", F.size("entities"))
