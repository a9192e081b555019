"""Aggregates over points: entity frequencies, dominant labels, series, paragraph counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.normalize import entity_key
from ..functions.text import col, found, strip
from .project import bubble_size


def dominant_label(df: DataFrame, keys: list[str], label: str, order: str | Column) -> DataFrame:
    """(keys, label): the most frequent label, of equally frequent ones the first seen.

    Two partial aggregates, on (keys, label), then on keys.
    """
    per = df.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(col(order)).alias("o"))
    return per.groupBy(*keys).agg(F.min_by(label, F.struct(F.negative("n"), "o")).alias(label))


def entity_frequency(points: DataFrame, order: str | Column = "id", centroid: bool = True, fallback: str = "TECHNIQUE") -> DataFrame:
    """(key, entity, frequency, label[, cx, cy]) per normalised entity; blank entities are skipped.

    entity is the form seen first, trimmed; label the dominant one.  One shuffle on (key, label) carries
    partial sums, one on key the few that are left.
    """
    rows = points.withColumn("key", entity_key("entity")).where("key <> ''").withColumns({"entity": strip("entity"), "__o": col(order)})
    sums = [F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"s{c}") for c in ("x", "y")] if centroid else []
    per = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.min("__o").alias("o"), F.min_by("entity", "__o").alias("entity"), *sums)
    total = F.sum("n")
    means = [(F.sum(f"s{c}") / total).alias(f"c{c}") for c in ("x", "y")] if centroid else []
    return per.groupBy("key").agg(
        F.min_by("entity", "o").alias("entity"), total.alias("frequency"), F.coalesce(F.min_by("label", F.struct(F.negative("n"), "o")), F.lit(fallback)).alias("label"), *means
    )


def occurrences(points: DataFrame, order: str = "id") -> DataFrame:
    """(key, occurrences): all of a key's points, in input order."""
    rows = points.withColumn("key", entity_key("entity")).where("key <> ''")
    return rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in points.columns if c != order]))).alias("occurrences"))


def sized(frequencies: DataFrame, global_max: int | None = None) -> DataFrame:
    """`size` of each bubble against the article's largest frequency, or a global one (30 if not above 1)."""
    if global_max is not None:
        return frequencies.withColumn("size", bubble_size("frequency", F.lit(global_max if global_max > 1 else 30)))
    top = frequencies.agg(F.max("frequency").alias("__top"))
    return frequencies.crossJoin(F.broadcast(top)).withColumn("size", bubble_size("frequency", "__top")).drop("__top")


def label_series(points: DataFrame, order: str, *columns: str) -> DataFrame:
    """(label, points): each label's points in order."""
    return points.groupBy("label").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("points"))


def max_frequency(points: DataFrame) -> DataFrame:
    """(max_frequency): of the most frequent entity, 1 at least."""
    per = points.withColumn("key", entity_key("entity")).where("key <> ''").groupBy("key").count()
    return per.agg(F.coalesce(F.max("count"), F.lit(1)).alias("max_frequency"))


def paragraphs_with_entities(points: DataFrame) -> DataFrame:
    """(paragraphs): distinct sentences with an entity, title lines apart."""
    fine = points.where(~F.coalesce(found("sentence_text", r"^\s*TITLE:", "i"), F.lit(False)))
    return fine.agg(F.countDistinct("sentence_id").alias("paragraphs"))


def totals(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("entities"), F.countDistinct("sentence_id").alias("paragraphs"))


def by_sentence(points: DataFrame, order: str = "id") -> DataFrame:
    """(sentence_id, sentence_text, first, entities): entities in encounter order, the first text wins."""
    return points.groupBy("sentence_id").agg(
        F.min_by("sentence_text", order).alias("sentence_text"), F.min(order).alias("first"), F.array_sort(F.collect_list(F.struct(order, "label", "entity"))).alias("entities")
    )


def last_by_id(points: DataFrame, order: str) -> DataFrame:
    """One row per id: the last in order."""
    others = [c for c in points.columns if c != "id"]
    return points.groupBy("id").agg(F.max_by(F.struct(*others), order).alias("r")).select("id", "r.*")


def expanded(points: DataFrame, key: str) -> DataFrame:
    """The points of one key, with the key's dominant label."""
    own = points.where(entity_key("entity") == key)
    label = entity_frequency(own, centroid=False).select(F.col("label").alias("__label"))
    return own.crossJoin(F.broadcast(label)).withColumn("label", F.col("__label")).drop("__label")


def with_colours(df: DataFrame, label: str = "label") -> DataFrame:
    """`colour` by label, a default for others; the table of colours is a literal map."""
    colours = F.create_map(*[F.lit(x) for kv in schemas.COLOURS.items() for x in kv])
    return df.withColumn("colour", F.coalesce(F.try_element_at(colours, F.upper(label)), F.lit(schemas.DEFAULT_COLOUR)))


def recoloured(df: DataFrame, ids: list[int], colour: str) -> DataFrame:
    return df.withColumn("colour", F.when(F.col("id").isin(ids), F.lit(colour)).otherwise(F.col("colour")))
