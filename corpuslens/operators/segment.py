"""Segmentation: paragraphs, packed sentences, samples, overlapping word windows, title blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, digits, found, letters, strip, sub


def has_letter(c: Column) -> Column:
    return found(c, r"\p{L}")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def pack_sentences(c: str | Column, min_length: int = 30, max_length: int = 450, repeat_stop: bool = True) -> Column:
    """Sentences packed greedily into chunks of at most max_length, unless one is longer itself.

    Every sentence is followed by ". ", also where it ends in a stop already, unless repeat_stop is
    off.  Chunks of at most min_length, or without a letter, go.
    """
    end = lambda s: F.concat(s, F.lit(". ")) if repeat_stop else F.concat(s, F.when(found(s, r"[.!?]$"), F.lit(" ")).otherwise(F.lit(". ")))
    kept = lambda cur: F.when((F.length(cur) > min_length) & has_letter(cur), F.array(strip(cur))).otherwise(F.array().cast("array<string>"))

    def step(a, s):
        longer = F.concat(a["cur"], end(s))
        fits = F.length(longer) <= max_length
        # a sentence that is too long by itself still starts a chunk
        return F.struct(F.when(fits, longer).otherwise(end(s)).alias("cur"), F.when(fits, a["out"]).otherwise(F.concat(a["out"], kept(a["cur"]))).alias("out"))

    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(sentences(col(c)), start, step, lambda a: F.concat(a["out"], kept(a["cur"])))


def fixed_width(c: str | Column, width: int, min_length: int = 0) -> Column:
    c = col(c)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(c), F.lit(1)) - 1) / width).cast("int")), lambda i: strip(F.substring(c, i * width + 1, F.lit(width))))
    return F.filter(pieces, lambda s: (F.length(s) > min_length) & has_letter(s))


def sampled(array: str | Column, cap: int) -> Column:
    """Every step-th element, at most cap of them, where there are more than cap."""
    array = col(array)
    step = F.greatest(F.floor(F.size(array) / cap), F.lit(1))
    return F.when(F.size(array) > cap, F.slice(F.filter(array, lambda x, i: i % step == 0), 1, cap)).otherwise(array)


def paragraphs(c: str | Column, pdf: bool = False, min_length: int | None = None, max_length: int | None = None, cap: int | None = None) -> Column:
    """The array of a cleaned text's paragraphs; the defaults of the lengths depend on the source."""
    low, high, cap = min_length or (20 if pdf else 30), max_length or (700 if pdf else 450), cap or (120 if pdf else 40)
    c = col(c)
    parts = F.transform(F.split(c, "\n\n"), strip)
    if pdf:
        parts = F.filter(parts, lambda p: ~found(p, r"\.{4,}\s*\d+\s*$") & ~found(p, r"^\s*\d+(\.\d+)*\s+.*\s+\d+\s*$"))

    def pieces(p):
        n = F.greatest(F.length(p), F.lit(1))
        alpha, digit = letters(p) / n, digits(p) / n
        fine = has_letter(p) & ((alpha > 0.1) & (digit < 0.6) if pdf else (alpha > 0.2) & (digit < 0.4))
        single = (F.size(sentences(p)) == 1) & (F.length(F.get(sentences(p), F.lit(0))) > high)
        return (
            F.when((F.length(p) > high) & single, fixed_width(p, high, low))
            .when(F.length(p) > high, pack_sentences(p, low, high))
            .when((F.length(p) > low) & fine, F.array(p))
            .otherwise(F.array().cast("array<string>"))
        )

    out = F.flatten(F.transform(parts, pieces))
    if not pdf:
        return out
    by_line = F.filter(F.transform(F.split(c, "\n"), strip), lambda s: (F.length(s) > low) & has_letter(s))
    # bound once: whichever list it is, it is sampled
    return F.get(F.transform(F.array(out), lambda o: sampled(F.when(F.size(o) < 5, by_line).otherwise(o), cap)), F.lit(0))


def exploded(df: DataFrame, array: Column, index: str = "text_index", value: str = "text") -> DataFrame:
    return df.select("doc_id", F.posexplode(array).alias(index, value))


def word_windows(df: DataFrame, text: str = "text", size: int = 320, overlap: int = 25, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., chunk_index, chunk): windows of `size` words that share `overlap`.

    A text of up to `size` words is one chunk as it is; without words there is none.
    """
    step = size - overlap
    df = df.withColumn("__w", F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    n = F.size("__w")
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    df = df.where(n > 0).withColumn("__k", F.explode(F.sequence(F.lit(0), last)))
    cut = F.array_join(F.slice("__w", F.col("__k") * step + 1, size), " ")
    return df.select(*keep, F.col("__k").alias("chunk_index"), F.when(n <= size, F.col(text)).otherwise(cut).alias("chunk"))


def blank_line_parts(c: str | Column) -> Column:
    return F.filter(F.transform(F.split(col(c), r"(?U)\n\s*\n"), strip), lambda p: p != "")


def article_parts(c: str | Column, within: int = 30) -> Column:
    """A TITLE: line of the first lines as part 0, the rest split at blank lines; without parts, the text."""
    c = col(c)
    rows = F.split(c, "\r\n|\r|\n")
    is_title = lambda s: found(s, r"^\s*TITLE:\s*.+$", "i")
    at = F.array_position(F.transform(F.slice(rows, 1, within), is_title), True).cast("int")
    body = F.array_join(F.filter(rows, lambda s, i: i + 1 != at), "\n")
    parts = F.when(at > 0, F.concat(F.array(strip(F.get(rows, at - 1))), blank_line_parts(strip(body)))).otherwise(blank_line_parts(c))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def body_paragraphs(c: str | Column) -> Column:
    """Paragraphs for reading: a TITLE: line goes, and with it a paragraph that has nothing else."""
    parts = F.filter(F.transform(F.split(strip(c), r"(?U)\r?\n\s*\r?\n"), strip), lambda p: p != "")
    rest = F.transform(parts, lambda p: F.when(found(p, r"^TITLE:", "i"), strip(sub(p, r"^TITLE:\s*[^\r\n]*\s*", "", "i"))).otherwise(p))
    return F.filter(rest, lambda p: p != "")
