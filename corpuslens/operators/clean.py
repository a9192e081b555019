"""The cleaning profiles: compositions of the removal operators, with counters.

Input (doc_id, text, source_type, title_hint, first_page); the last two may be missing.  Each step
is a column of its own, so no expression is repeated in the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import normalize_extracted, normalize_title, remove_extra_whitespace
from . import removal as R
from .title import document_title, first_page_title, is_bad_title

COUNTERS = ("removed_references", "removed_citations", "removed_figures_tables", "removed_special_sections", "removed_urls")


def _steps(df: DataFrame, *steps) -> DataFrame:
    for step in steps:
        df = df.withColumn("text", step(F.col("text")))
    return df


def _started(df: DataFrame) -> DataFrame:
    df = df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("chars_before", F.length("text"))
    return df.withColumns({c: F.lit(0) for c in COUNTERS})


def _references(df: DataFrame, min_position: float, counted: bool) -> DataFrame:
    df = df.withColumn("__cut", R.remove_references("text", min_position))
    if counted:
        df = df.withColumn("removed_references", F.col("removed_references") + (F.col("__cut") != F.col("text")).cast("int"))
    return df.withColumn("text", F.col("__cut")).drop("__cut")


def clean_txt(df: DataFrame, preserve_blank_lines: bool = False) -> DataFrame:
    df = _references(_started(df), 0.6, True)
    df = R.count_then_remove(df, "text", "removed_special_sections", R.SPECIAL_SECTIONS, "im")
    df = R.count_then_remove(df, "text", "removed_figures_tables", R.FIGURES, "i")
    df = R.count_then_remove(df, "text", "removed_citations", R.CITATIONS, "")
    df = R.count_then_remove(df, "text", "removed_urls", R.URLS, "", count_first=True)
    df = _steps(df, lambda c: remove_extra_whitespace(c, preserve_blank_lines))
    return df.withColumn("chars_after", F.length("text"))


def clean_pdf(df: DataFrame, preserve_blank_lines: bool = False) -> DataFrame:
    for name in ("title_hint", "first_page"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    df = _started(df)
    better = lambda new: F.when(is_bad_title("title"), new).otherwise(F.col("title"))
    df = df.withColumn("title", first_page_title("first_page"))
    df = df.withColumn("title", better(normalize_title("title_hint")))
    df = df.withColumn("title", better(normalize_title(document_title("text"))))
    df = _steps(df, normalize_extracted, R.remove_inline_noise, R.remove_headers_footers, R.remove_boilerplate, R.remove_toc_lines, R.remove_noisy_lines)
    df = df.withColumn("title", better(normalize_title(document_title("text"))))
    df = R.remove_repeated_lines(df)
    df = _steps(df, R.remove_table_blocks, R.remove_dense_table_lines, R.remove_garbled_lines, lambda c: R.strip_front_matter(c, "title"))
    df = _references(_references(df, 0.6, True), 0.0, True)
    df = R.count_then_remove(df, "text", "removed_urls", R.URLS, "", count_first=True)
    df = _steps(df, lambda c: remove_extra_whitespace(c, preserve_blank_lines), lambda c: remove_extra_whitespace(c, preserve_blank_lines))
    return df.withColumn("chars_after", F.length("text"))


def clean(df: DataFrame) -> DataFrame:
    """Each document by its source_type; `pdf`, else txt."""
    pdf = clean_pdf(df.where("source_type = 'pdf'"))
    txt = clean_txt(df.where("source_type is null or source_type <> 'pdf'"))
    return pdf.unionByName(txt, allowMissingColumns=True)


def report(cleaned: DataFrame) -> DataFrame:
    """(doc_id, chars_before, chars_after, chars_removed, percent_removed, counters)."""
    gone = F.col("chars_before") - F.col("chars_after")
    return cleaned.select("doc_id", "chars_before", "chars_after", gone.alias("chars_removed"), (100 * gone / F.greatest(F.lit(1), "chars_before")).alias("percent_removed"), *COUNTERS)
