"""Benchmark decontamination with a distributed positional inverted index.

1. `windows`: every benchmark item gives its windows of consecutive words; equal windows of
   several items are one window with several items.
2. The corpus frequency of the benchmark's terms picks each window's rarest term, its anchor.
3. `positional_index` stores the postings of the anchor terms: document, position, and the words
   around it, which are the offset-adjusted lists of the window's other terms at that place.  It
   also stores one row per document with its length.
4. `phrase_matches` intersects: windows meet the postings of their anchor, and a match is an
   occurrence where every other term stands at its offset.
5. `near_contamination` asks for a share of the window's distinct terms, in any order, instead.  Of
   n distinct terms with c needed, any match holds one of any n - c + 1; the rarest of them are the
   window's anchors (terms that no document has are counted in, and have no postings), and
   `proximity_matches` counts the window's terms within reach of each.

DataFrame functions only.  Sets of terms are broadcast while they have at most `small` rows, and
joined by a shuffle beyond that.

Words: A-Z lower-cased, then runs of characters other than [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F].
Defined results: null or wordless documents have no words and no hit; null or wordless items have
no window; a null item_id is not listed.  An item of fewer words than the width is one window.
Rows that repeat a doc_id are judged by their own text each.  Empty tables give no rows or no hits;
other columns are not read.  A text of any length is one row; each of its postings holds as many words
around it as a window has.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def is_few(df: DataFrame, small: int) -> bool:
    return df.limit(small + 1).count() <= small


def at_most(df: DataFrame, small: int) -> DataFrame:
    """A broadcast hint, only where the rows are counted and few."""
    return F.broadcast(df) if is_few(df, small) else df


def windows(items: DataFrame, width: int) -> DataFrame:
    """(window, terms, item_ids): distinct windows."""
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - (width - 1)))
    cut = items.select("item_id", words("text").alias("w")).where(n > 0)
    cut = cut.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), width).alias("terms"))
    return cut.groupBy("terms").agg(F.collect_set("item_id").alias("item_ids")).withColumn("window", F.array_join("terms", " "))


def term_counts(cut: DataFrame, docs: DataFrame, small: int) -> DataFrame:
    """(term, times): how often the documents have each term of the windows."""
    vocabulary = cut.select(F.explode("terms").alias("term")).distinct()
    seen = docs.select(F.explode(words("text")).alias("term")).join(at_most(vocabulary, small), "term", "left_semi")
    return seen.groupBy("term").agg(F.count("*").alias("times"))


def enough(share: float) -> Column:
    """How many distinct terms of a window make that share."""
    return F.ceil(F.round(share * F.size(F.array_distinct("terms")), 9)).cast("int")


def rare_anchors(cut: DataFrame, docs: DataFrame, share: float, small: int) -> DataFrame:
    """Windows with `anchor`, a row for each of as many rarest terms as any near match must hold one of."""
    each = cut.select("window", F.explode(F.array_distinct("terms")).alias("term")).join(term_counts(cut, docs, small), "term", "left")
    sets = each.groupBy("window").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "term"))).alias("by_times"))
    anchors = cut.join(sets, "window").select("window", "terms", "item_ids", F.explode(F.slice("by_times", F.lit(1), F.size("by_times") - enough(share) + 1)).alias("a"))
    return anchors.where("a.times > 0").select("window", "terms", "item_ids", F.col("a.term").alias("anchor"))


def anchored(cut: DataFrame, docs: DataFrame, small: int) -> DataFrame:
    """Windows with `anchor`, their rarest term in the documents, and its `offset`."""
    each = cut.select("window", F.posexplode("terms").alias("offset", "term")).join(term_counts(cut, docs, small), "term", "left")
    rarest = each.groupBy("window").agg(
        F.min_by(F.struct("term", "offset"), F.struct(F.coalesce("times", F.lit(0)), "offset")).alias("r"), F.min(F.coalesce("times", F.lit(0))).alias("times")
    )
    # a term that no document has rules its window out
    return cut.join(rarest.where("times > 0"), "window").select(
        "window", "terms", "item_ids", F.col("r.term").alias("anchor"), F.col("r.offset").alias("offset")
    )


def positional_index(docs: DataFrame, terms: DataFrame, reach: int, small: int) -> DataFrame:
    """(doc_id, text_hash, n_words, term, pos, first, around); term is null in a document's own row.

    around holds the words from position `first` up to `reach` words after pos.  Where the terms are
    too many to broadcast, single words are shuffled to them, and the places come back by document,
    so that no word carries its text along.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words("text").alias("w"))
    n = F.size("w")
    own = F.struct(n.alias("pos"), F.lit(None).cast("string").alias("term"))
    if is_few(terms, small):
        tokens = base.select("doc_id", "text_hash", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "term"))
        found = tokens.join(F.broadcast(terms.select("term", F.lit(True).alias("wanted"))), "term", "left").where((F.col("pos") == n) | F.col("wanted"))
    else:
        tokens = base.select("doc_id", "text_hash", F.posexplode("w").alias("pos", "term")).join(terms, "term", "left_semi")
        places = tokens.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_set(F.struct("pos", "term")).alias("places"))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
        each = F.concat(F.coalesce("places", F.array().cast("array<struct<pos:int,term:string>>")), F.array(own))
        found = base.join(places, same, "left").select("doc_id", "text_hash", "w", F.inline(each))
    first = F.greatest(F.lit(0), F.col("pos") - reach)
    inside = F.col("pos") < n
    return found.select(
        "doc_id",
        "text_hash",
        n.alias("n_words"),
        F.when(inside, F.col("term")).alias("term"),
        "pos",
        first.alias("first"),
        F.when(inside, F.slice("w", first + 1, F.col("pos") + reach + 1 - first)).alias("around"),
    )


def phrase_matches(index: DataFrame, cut: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, length, item_ids), one row per exact occurrence of a window."""
    start = F.col("pos") - F.col("offset")
    at = F.slice("around", F.greatest(F.lit(1), start - F.col("first") + 1), F.size("terms"))
    return index.join(cut, (F.col("term") == F.col("anchor")) & (start >= 0) & (at == F.col("terms"))).select(
        "doc_id", "text_hash", start.alias("start"), F.size("terms").alias("length"), "item_ids"
    )


def proximity_matches(index: DataFrame, cut: DataFrame, share: float) -> DataFrame:
    """(doc_id, text_hash, pos, window, near): places with at least that share of a window's distinct terms around its anchor."""
    near = F.size(F.array_intersect("around", "terms"))
    return index.join(cut, (F.col("term") == F.col("anchor")) & (near >= enough(share))).select(
        "doc_id", "text_hash", "pos", "window", near.alias("near")
    )


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, small: int = 200_000) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids) per row of docs."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    cut = scratch.save(anchored(windows(items, width), docs, small), "windows")
    terms = cut.select(F.col("anchor").alias("term")).distinct()
    index = scratch.save(positional_index(docs, terms, width - 1, small), "index")
    hits = phrase_matches(index.where("term is not null"), cut)
    hits = hits.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("ids")
    )
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["length"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(a["end"], x["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    hits = hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), union.alias("n_hit"), F.array_sort(F.transform("ids", lambda x: x.cast("string"))).alias("ids"))
    rows = index.where("term is null").select("doc_id", "text_hash", "n_words")
    none = F.array().cast("array<string>")
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("ids", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("ids", none).alias("item_ids"),
    )


def near_contamination(docs: DataFrame, items: DataFrame, width: int = 10, share: float = 0.8, small: int = 200_000) -> DataFrame:
    """(doc_id, n_words, n_near, n_near_items, near_item_ids) per row of docs.

    n_near counts the windows of which some stretch of up to `width` words has at least that share
    of the distinct terms (and those with as many within `width` - 1 words around an anchor).
    """
    scratch = Scratch(docs.sparkSession, "decontaminate-near")
    cut = scratch.save(rare_anchors(windows(items, width), docs, share, small), "windows")
    index = scratch.save(positional_index(docs, cut.select(F.col("anchor").alias("term")).distinct(), width - 1, small), "index")
    hits = proximity_matches(index.where("term is not null"), cut, share).select("doc_id", "text_hash", "window").distinct()
    hits = hits.join(at_most(cut.select("window", "item_ids").dropDuplicates(["window"]), small), "window")
    hits = hits.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
        F.count("*").alias("n_near"), F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("item_ids"))), lambda x: x.cast("string"))).alias("ids")
    )
    rows = index.where("term is null").select("doc_id", "text_hash", "n_words")
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_near_items"),
        F.coalesce("ids", F.array().cast("array<string>")).alias("near_item_ids"),
    )
