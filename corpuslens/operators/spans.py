"""Spans: occurrences of terms, greedy disjoint assignment, highlighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import escape_html
from ..functions.text import col

RANGE = "array<struct<start:int,end:int,id:int,label:string,entity:string>>"


def occurrences_of(text: str | Column, term: str | Column) -> Column:
    """Starts of all non-overlapping occurrences, case-sensitive; none of an empty term."""
    text, term = col(text), col(term)
    n = F.length(term)
    # pieces between occurrences: each start is what came before it
    pieces = F.split(text, F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    lengths = F.slice(F.transform(pieces, F.length), 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    starts = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, k: F.struct((a["at"] + k + n).alias("at"), F.concat(a["out"], F.array(a["at"] + k)).alias("out")),
        lambda a: a["out"],
    )
    return F.when((n > 0) & text.isNotNull(), starts).otherwise(F.array().cast("array<int>"))


def assigned_spans(text: str | Column, entities: str | Column) -> Column:
    """Disjoint ranges by start: each entity, in order, takes its first occurrence that is still free.

    entities: array<struct<id, label, entity>>.
    """
    text = col(text)

    def step(taken, e):
        n = F.length(e["entity"])
        free = F.filter(occurrences_of(text, e["entity"]), lambda s: ~F.exists(taken, lambda r: (s < r["end"]) & (s + n > r["start"])))
        at = F.get(free, F.lit(0))
        new = F.struct(
            at.alias("start"), (at + n).alias("end"), e["id"].cast("int").alias("id"), e["label"].alias("label"), e["entity"].alias("entity")
        )
        return F.when(at.isNull(), taken).otherwise(F.concat(taken, F.array(new).cast(RANGE)))

    return F.array_sort(F.aggregate(col(entities), F.array().cast(RANGE), step))


def highlighted(text: str | Column, ranges: str | Column) -> Column:
    """HTML of the text with a span element per range; a range that begins before the last one's end is skipped."""
    text = col(text)
    part = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))

    def step(a, r):
        tag = F.concat(
            F.lit('<span class="entity '), F.lower(F.coalesce(r["label"], F.lit(""))), F.lit('" data-id="'), r["id"].cast("string"), F.lit('">'),
            escape_html(part(r["start"], r["end"])), F.lit("</span>"),
        )
        return F.when(r["start"] < a["at"], a).otherwise(
            F.struct(r["end"].alias("at"), F.concat(a["html"], escape_html(part(a["at"], r["start"])), tag).alias("html"))
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("html"))
    return F.aggregate(col(ranges), start, step, lambda a: F.concat(a["html"], escape_html(part(a["at"], F.length(text)))))


def marked_sentences(sentences: DataFrame) -> DataFrame:
    """(sentence_id, sentence_text, ranges, html) of by_sentence() rows."""
    ranges = sentences.withColumn("ranges", assigned_spans("sentence_text", "entities"))
    return ranges.select("sentence_id", "sentence_text", "ranges", highlighted("sentence_text", "ranges").alias("html"))
