"""I-Match fingerprints over several randomised lexicon subsets, and their use on edited texts.

The lexicon holds the terms whose document frequency lies between two shares of all documents, an
inverse-document-frequency band.  At most mean distinct terms / lower share terms can reach the
lower share, so the lexicon's size is bounded whatever the corpus.  Each of `subsets` random
subsets keeps every lexicon term with the same chance, 1 in 2^halvings, drawn anew for each, so
that subsets overlap.  A text's terms in one subset, distinct and sorted, are hashed; the
fingerprint is the list of these hashes.  Two fingerprints are as alike as the share of subsets,
among those that either uses, that agree.

Documents are dealt to range buckets of doc_id once, each with a copy of the next bucket's first
document; "the next document", the terms and the fingerprints are all made inside the buckets, so
texts are shuffled once.  Terms meet the lexicon once, each with one mask of its subsets, and come
back as one sorted array per document, from which all subsets are hashed inside the row.
DataFrame functions only.

Defined results: null text is empty.  A text without lexicon terms has one hash, of the whole
text; an empty text has none and is like nothing.  Documents follow by doc_id, then text; null
doc_ids come first.  The last is followed by the first, a single document by itself.  Rows that
repeat a doc_id are documents of their own.  An empty table gives an empty result; other columns
are not read.  A text may be of any length; its distinct terms are held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

NOT_TERM = r"[^\p{L}\p{N}]+"


def terms(text: str | Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), NOT_TERM), ""))


def lexicon(docs: DataFrame, low: float, high: float, halvings: int) -> DataFrame:
    """(term, mask): terms that at least `low` (and two) and at most `high` of the documents have, in some subset.

    Bit k of the mask says whether subset k keeps the term: the bits that `halvings` hashes share.
    """
    n = docs.count()
    counts = docs.select(F.explode(terms("text")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    mask = F.xxhash64(F.lit(0), "term")
    for k in range(1, halvings):
        mask = mask.bitwiseAND(F.xxhash64(F.lit(k), "term"))
    return counts.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n))).select("term", mask.alias("mask")).where("mask <> 0")


def bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """docs with `bucket`, ascending with doc_id and of about equal sizes."""
    shares = [i / buckets for i in range(1, buckets)]
    bounds = docs.select(F.percentile_approx("doc_id", shares, 10 * buckets).alias("b")).first()["b"] if shares else None
    bounds = sorted(set(bounds or []))
    if not bounds:
        return docs.withColumn("bucket", F.lit(0))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    held = F.array(*map(F.lit, bounds))
    # a binary search: how many bounds are at most doc_id
    at = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when(F.get(held, a + s - 1) <= F.col("doc_id"), a + s).otherwise(a)
    )
    return docs.withColumn("bucket", at)


def with_next(docs: DataFrame, buckets: int, scratch: Scratch) -> DataFrame:
    """(bucket, rn, ghost, doc_id, text, next): ghost rows are the copies that end each bucket."""
    docs = bucketed(docs, buckets)
    least = docs.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"))
    order = sorted(r["bucket"] for r in least.select("bucket").collect())  # at most `buckets` rows
    spark = docs.sparkSession
    before = spark.createDataFrame([(b, order[i - 1]) for i, b in enumerate(order)], "bucket int, before int")
    first = F.when(F.col("nulls") > 0, F.col("doc_id").isNull()).otherwise(F.col("doc_id") == F.col("least"))
    heads = docs.join(F.broadcast(least), "bucket").where(first).groupBy("bucket").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    heads = scratch.save(heads, "heads").join(F.broadcast(before), "bucket").select("doc_id", "text", F.col("before").alias("bucket"), F.lit(True).alias("ghost"))
    rows = docs.select("doc_id", "text", "bucket", F.lit(False).alias("ghost")).unionByName(heads)
    here = Window.partitionBy("bucket").orderBy("ghost", "doc_id", "text")
    return rows.select("bucket", F.row_number().over(here).alias("rn"), "ghost", "doc_id", "text", F.lead("text").over(here).alias("next"))


def edited(text: Column, following: Column) -> Column:
    """text with its last half (code points, rounded down) replaced by the start of `following`."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def alike(a: str, b: str) -> Column:
    """Of two fingerprint arrays: agreeing subsets over subsets that either uses; 0 without any."""
    used = lambda c: F.transform(c, lambda x: F.shiftright(x, 32))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(used(F.col(a)), used(F.col(b))))), F.lit(0.0))


def shown(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def hashes(kept: Column, subsets: int) -> Column:
    """The subset << 32 | hash of each subset that keeps any of the terms; kept: sorted array of struct<term, mask>.

    Terms are first parted by the byte of the mask, so that each bit is asked of few of them.
    """
    under = lambda terms, shift, ones: F.filter(terms, lambda x: F.call_function("shiftrightunsigned", x["mask"], shift).bitwiseAND(F.lit(ones)) != 0)
    eight = F.sequence(F.lit(0), F.lit(7))
    by_bit = lambda terms, byte: F.transform(eight, lambda bit: under(terms, byte * 8 + bit, 1))
    by_byte = F.transform(F.sequence(F.lit(0), F.lit((subsets - 1) // 8)), lambda byte: under(kept, byte * 8, 255))
    each = F.slice(F.flatten(F.transform(by_byte, by_bit)), 1, subsets)
    return F.array_compact(F.transform(each, lambda own, k: slot(k, F.xxhash64(own), F.size(own) > 0)))


def slot(subset: Column, h: Column, used: Column) -> Column:
    return F.when(used, F.shiftleft(subset.cast("long"), 32).bitwiseOR(h.bitwiseAND(F.lit(0xFFFFFFFF))))


def edit_fingerprints(
    docs: DataFrame, low: float = 0.002, high: float = 0.2, subsets: int = 64, halvings: int = 5, buckets: int | None = None, small: int = 500_000
) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of docs (doc_id, text)."""
    if not 1 <= subsets <= 64:
        raise ValueError("one to 64 subsets")
    spark = docs.sparkSession
    scratch = Scratch(spark, "imatch")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    band = scratch.save(lexicon(docs, low, high, halvings), "lexicon")
    if band.count() <= small:
        band = F.broadcast(band)
    rows = with_next(docs, buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), scratch)
    rows = rows.withColumn("new", F.when(~F.col("ghost"), edited(F.col("text"), F.col("next"))).otherwise(""))
    whole = lambda c: slot(F.lit(subsets), F.xxhash64(c), F.length(c) > 0)
    of = lambda c, which: F.transform(terms(c), lambda t: F.struct(F.lit(which).alias("which"), t.alias("term")))
    rows = rows.select(
        "bucket",
        "rn",
        F.struct(
            "doc_id", "ghost", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("new").cast("binary"), 256).alias("sha"),
            whole("text").alias("w0"), whole("new").alias("w1"),
        ).alias("meta"),
        F.concat(F.array(F.struct(F.lit(2).alias("which"), F.lit(None).cast("string").alias("term"))), of("text", 0), of("new", 1)).alias("each"),
    )
    # the meta of a row goes with its first entry only
    rows = rows.select("bucket", "rn", "meta", F.inline("each")).withColumn("meta", F.when(F.col("which") == 2, F.col("meta")))
    rows = rows.join(band, "term", "left").where("mask is not null or which = 2")
    kept = lambda which: F.array_sort(F.collect_list(F.when(F.col("which") == which, F.struct("term", "mask")))).alias(f"t{which}")
    per = rows.groupBy("bucket", "rn").agg(F.first("meta", True).alias("meta"), kept(0), kept(1))
    full = lambda t, w: F.when(F.size(t) > 0, hashes(F.col(t), subsets)).otherwise(F.array_compact(F.array(F.col(f"meta.{w}"))))
    per = per.select("bucket", "rn", "meta", full("t0", "w0").alias("f0"), full("t1", "w1").alias("f1"))
    per = per.withColumn("f2", F.lead("f0").over(Window.partitionBy("bucket").orderBy("rn")))
    return per.where(~F.col("meta.ghost")).select(
        "meta.doc_id",
        "meta.n_chars",
        F.col("meta.sha").alias("edited_sha256"),
        shown("f0").alias("fingerprint"),
        shown("f1").alias("edited_fingerprint"),
        alike("f0", "f1").alias("near_edited"),
        alike("f0", "f2").alias("near_next"),
    )
