"""Removal operators.  Each is a Column -> Column function over a document's text; none shuffles.

Counters: `counted(text)` twins give what a removal deletes, on the text as it stands before each
of its patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, bound, chars, chars_of, col, count, digits, found, head, keep_lines, letters, lines, lowered, lstrip, ratio, rstrip, strip, sub, tail, where

START = r"(?:^|\n)"
REFERENCES = r"(?:\n|^)(References|Bibliography|Works Cited)\b"


def remove_references(c: str | Column, min_position: float = 0.6) -> Column:
    """Cuts at the first heading, if it starts at min_position of the text or later; 0 for anywhere."""
    c = col(c)
    at = where(c, REFERENCES, "i")
    return F.when(at >= F.floor(F.length(c) * min_position), rstrip(head(c, at.cast("int")))).otherwise(c)


# The patterns of each removal, in order.
CITATIONS = (r"\([A-Z][a-z]+\s*(?:et\s+al\.?)?,?\s*\d{4}\)", r"\([A-Z][a-z]+\s+\d{4}\)")
FIGURES = (
    r"(?:Fig(?:ure)?|Table|Eq\.?|Equation)\s*\.?\s*\d+[\s\S]*?(?:\.|$)",
    r"(?:See|shown in|as shown in)\s+(?:Fig|Figure|Table)\s*\.?\s*\d+",
    r"Figure \d+.*?\n",
    r"Table \d+.*?\n",
)
SPECIAL_SECTIONS = (
    r"(?:Abstract|Acknowledgments?|Funding|Conflicts? of Interest|Author Contributions|Data Availability)[\s\S]*?(?=\n(?:[A-Z][a-z]+|[A-Z]{2,})|$)",
    r"(?:^|\n)Appendix[\s\S]*?(?=\n(?:[A-Z][a-z]+|$)|$)",
)
URLS = (r"https?://[^\s]+", r"www\.[^\s]+")
INLINE_NOISE = (
    r"ARTICLE INFO.*$",
    r"Article history:.*$",
    r"©\s*\d{4}.*?All rights are reserved.*?(?=(Introduction|$))",
    r"\*+\s*Corresponding authors?\..*$",
    r"E-?mail addresses?:.*$",
    r"David\s+Y\..*?Zhang\s+et\s+al\..*?/+\s*Lab\s+Invest\s*\d+\s*\(\d{4}\)\s*\d+\s*\d+\s*\d+",
    r"\bTo\s+David\s+Y\..*?Zhang\s+et\s+al\..*?/+\s*Lab\s+Invest\s*\d+\s*\(\d{4}\)\s*\d+\s*\d+\s*\d+",
)
HEADERS_FOOTERS = (
    r"(?:^|\n)Page\s+\d+\s*(?:of\s+\d+)?",
    r"(?:^|\n)\d+\s*/\s*\d+\s*$",
    r"(?:^|\n)Vol\.?\s*\d+.*",
    r"(?:^|\n)ISSN\s*\d{4}-\d{3}[\dxX]",
    r"(?:^|\n)doi:\s*\S+",
)
BOILERPLATE = (
    r"(?:^|\n)Contents lists available at.*",
    r"(?:^|\n)journal homepage:.*",
    r"(?:^|\n)A\s+R\s+T\s+I\s+C\s+L\s+E\s+I\s+N\s+F\s+O.*",
    r"(?:^|\n)Keywords?:.*",
    r"(?:^|\n)Received\s+.*",
    r"(?:^|\n)Accepted\s+.*",
    r"(?:^|\n)Available\s+online.*",
)
NOISY_LINES = (
    r"^Decision Analytics Journal.*$",
    r"^Contents$",
    r"^School of .*University.*$",
    r"^A\s+R\s+T\s+I\s+C\s+L\s+E\s+I\s+N\s+F\s+O.*$",
    r"^Keywords?:.*$",
    r"^\*Corresponding author.*$",
    r"^E-?mail address:.*$",
    r"^Published by Elsevier.*$",
    r"^This is an open access article.*$",
    r"^Data availability.*$",
    r"^.*@.*$",
    r"^\d{4}-\d{4}.*$",
    r"^ARTICLE INFO.*$",
    r"^Article history:.*$",
    r"^Revised\s+\d+.*$",
    r"^Accepted\s+\d+.*$",
    r"^Available online.*$",
    r"^Lab Invest\s+\d+.*$",
    r"^David Y\.\. Zhang et al\..*$",
)
REPEATABLE = r"(lab invest|et al\.|^\d+$|^\d+\s+\d+\s+\d+|^page\s+\d+)"
FIGURE_BLOCKS = (r"(?:^|\n)(Figure|Fig\.|Table)\s*\d+.*(?:\n.+){0,3}", r"(?:^|\n)(Fig\.|Figure|Table)\s*\d+:\s*.*(?:\n.+){0,3}")
CAPTIONS = (
    r"(?:^|\n)Equation\s*\d+.*(?:\n.+){0,3}",
    r"(?:^|\n)Eq\.?\s*\(?\d+\)?[:\s].*(?:\n.+){0,2}",
    r"(?:^|\n)Table\s*\d+[:\s].*(?:\n.+){0,3}",
    r"(?:^|\n)Figure\s*\d+[:\s].*(?:\n.+){0,3}",
    r"(?:^|\n)Fig\.?\s*\d+[:\s].*(?:\n.+){0,3}",
)
LICENCES = (
    r"(?:\n|^)(Acknowledgments?|Acknowledgement|Funding|Conflicts? of Interest)[\s\S]*?(?=\n[A-Z][A-Za-z ]{2,}\n|$)",
    r"(?:\n|^)Appendix[\s\S]*?(?=\n[A-Z][A-Za-z ]{2,}\n|$)",
    r"(?:\n|^)(Copyright|©)\s*[^\n]*",
    r"(?:\n|^)All rights reserved\.*",
    r"(?:\n|^)This is an open access article.*",
    r"(?:\n|^)Creative Commons.*",
)


# One of these words is in the lower-cased text wherever the pattern matches; none is a quicker test than the pattern.
NEEDLES = {
    **{p: ("(",) for p in CITATIONS},
    FIGURES[0]: ("fig", "table", "eq"),
    FIGURES[1]: ("fig", "table"),
    FIGURES[2]: ("figure ",),
    FIGURES[3]: ("table ",),
    SPECIAL_SECTIONS[0]: ("abstract", "acknowledgment", "funding", "conflict", "author contributions", "data availability"),
    SPECIAL_SECTIONS[1]: ("appendix",),
    URLS[0]: ("http",),
    URLS[1]: ("www.",),
    **dict(zip(INLINE_NOISE, (("article info",), ("article history:",), ("©",), ("*",), ("mail address",), ("david",), ("david",)), strict=True)),
    **dict(zip(HEADERS_FOOTERS, (("page",), ("/",), ("vol",), ("issn",), ("doi:",)), strict=True)),
    **dict(zip(BOILERPLATE, (("contents lists",), ("journal homepage",), ("a",), ("keyword",), ("received",), ("accepted",), ("available",)), strict=True)),
}


def _subs(c: str | Column, patterns: tuple[str, ...], to: str, flags: str) -> Column:
    c = col(c)
    for p in patterns:
        c = bound(c, _where_needed(p, to, flags)) if p in NEEDLES else sub(c, p, to, flags)
    return c


def _where_needed(pattern: str, to: str, flags: str) -> Callable[[Column], Column]:
    return lambda t: F.when(any_of(lowered(t), NEEDLES[pattern]), sub(t, pattern, to, flags)).otherwise(t)


def remove_citations(c: str | Column) -> Column:
    return _subs(c, CITATIONS, "", "")


def remove_figures_tables(c: str | Column) -> Column:
    return _subs(c, FIGURES, "", "i")


def remove_special_sections(c: str | Column) -> Column:
    """From each keyword to the end of its line."""
    return _subs(c, SPECIAL_SECTIONS, "", "im")


def remove_urls(c: str | Column) -> Column:
    return _subs(c, URLS, "", "")


def remove_inline_noise(c: str | Column) -> Column:
    return _subs(c, INLINE_NOISE, " ", "im")


def remove_headers_footers(c: str | Column) -> Column:
    return _subs(c, HEADERS_FOOTERS, "\n", "i")


def remove_boilerplate(c: str | Column) -> Column:
    return _subs(c, BOILERPLATE, "\n", "i")


def remove_figure_blocks(c: str | Column) -> Column:
    """Caption lines and up to three lines after them.  Not in the default profiles."""
    return _subs(c, FIGURE_BLOCKS, "\n", "i")


def remove_captions(c: str | Column) -> Column:
    """Equation and caption blocks.  Not in the default profiles."""
    return _subs(c, CAPTIONS, "\n", "i")


def remove_licences(c: str | Column) -> Column:
    """Acknowledgements, appendices, copyright and licence lines.  Not in the default profiles."""
    return _subs(c, LICENCES, "\n", "i")


def count_then_remove(df: DataFrame, text: str, counter: str, patterns: tuple[str, ...], flags: str, count_first: bool = False) -> DataFrame:
    """Adds `counter`, removes the patterns from `text`.

    Each count is of the text that the patterns before have left, or with count_first of the text
    before any removal.  A pattern is tried only where one of its needles is, and its matches are
    replaced only where there are any; every step is a column of its own, so none is repeated.
    """
    df = df.withColumn(counter, F.lit(0)).withColumn("__before", F.col(text))
    for p in patterns:
        counted = "__before" if count_first else text
        df = df.withColumn("__n", F.when(any_of(lowered(counted), NEEDLES[p]), count(counted, p, flags)).otherwise(F.lit(0)))
        df = df.withColumn(text, F.when(F.lit(True) if count_first and p != patterns[0] else F.col("__n") > 0, sub(text, p, "", flags)).otherwise(F.col(text)))
        df = df.withColumn(counter, F.col(counter) + F.col("__n"))
    return df.drop("__n", "__before")


def remove_noisy_lines(c: str | Column) -> Column:
    return keep_lines(c, lambda line, s: (s == "") | ~found(s, "|".join(NOISY_LINES), "i"))


def remove_toc_lines(c: str | Column) -> Column:
    leaders, section, number = r"\.{4,}\s*\d+\s*$", r"^\s*\d+(\.\d+)*\s+.*$", r"\s+\d+\s*$"
    return keep_lines(c, lambda line, s: ~(found(line, leaders) | (found(line, section) & found(line, number))))


# What tables are full of, and phrases of their lines.
SYMBOLS = r"/\|%_=+[]()<>:;,*"
MARKERS = ("/C2", "FDA approval", "Scanner system", "Summary of ")


def is_dense_table_line(s: Column) -> Column:
    n = F.greatest(F.length(s), F.lit(1))
    markers = any_of(s, MARKERS)
    upper = bound(letters(s), lambda alpha: ratio(chars(s, r"\p{IsUppercase}"), alpha))
    return markers | ((n > 60) & (digits(s) / n > 0.15) & (chars_of(s, SYMBOLS) / n > 0.08) & (upper > 0.45))


def remove_dense_table_lines(c: str | Column) -> Column:
    return keep_lines(c, lambda line, s: (s == "") | ~is_dense_table_line(s))


def is_garbled_line(s: Column) -> Column:
    n = F.length(s)
    rare = (chars_of(s, "ÂÃÅÆÍ¿€‰") / n > 0.08) | (chars(s, r"[^\x00-\x7F]") / n > 0.25)
    mojibake = (n >= 20) & (F.octet_length(s) > n) & rare

    def by_case(m: Column) -> Column:
        lower = ratio(m["lower"], m["alpha"], 1.0)
        ciphered = (m["alpha"] >= 25) & (lower < 0.18) & (ratio(chars(s, "[aeiouAEIOU]"), m["alpha"], 1.0) < 0.22)
        return ciphered | ((lower < 0.45) & (count(s, r"\b[A-Z0-9]{6,}\b") >= 2))

    # 25 letters or the 20 characters of an encoded line make a line of 20 at least
    return (n >= 20) & (mojibake | bound(F.struct(letters(s).alias("alpha"), chars(s, r"[\p{L}&&\p{IsLowercase}]").alias("lower")), by_case))


def remove_garbled_lines(c: str | Column) -> Column:
    return keep_lines(c, lambda line, s: (s == "") | ~is_garbled_line(s))


def remove_repeated_lines(df: DataFrame, text: str = "text", least: int = 3, longest: int = 120) -> DataFrame:
    """Drops short header- or footer-like lines that a document repeats; other lines stay.

    Within a row: a sorted copy of the stripped lines gives the repeated ones, no shuffle.
    """
    own = F.filter(F.transform(lines(text), strip), lambda s: (s != "") & (F.length(s) <= longest) & found(s, REPEATABLE, "i"))
    df = df.withColumn("__own", F.array_sort(own))
    # in sorted order, a line that occurs `least` times equals the one `least - 1` places before it
    many = F.filter("__own", lambda s, i: s == F.get("__own", i - (least - 1)))
    df = df.withColumn("__many", F.array_distinct(many))
    return df.withColumn(text, keep_lines(text, lambda line, s: ~F.array_contains("__many", s))).drop("__own", "__many")


def is_table_start(s: Column) -> Column:
    return found(s, r"\bTable\s+\d+\b", "i")


def is_table_break(s: Column) -> Column:
    """Blank, a section heading, or plainly narrative."""
    heading = found(s, r"^(Introduction|Methods?|Results?|Discussion|Conclusion|References)\b", "i")
    narrative = (count(s, "[A-Za-z]{2,}") >= 14) & F.endswith(s, F.lit(".")) & (letters(s) > 60)
    return (s == "") | heading | (narrative & (chars_of(s, SYMBOLS) / F.greatest(F.length(s), F.lit(1)) < 0.07))


def remove_table_blocks(c: str | Column) -> Column:
    """From a line that names a table to the next break line; a long prefix of the first line stays.

    Two flags per line; then one pass over the flags alone gives what each line is: 0 outside, 1 the
    first line of a block, 2 inside.  A block opens at a start and closes at a break; a break that
    is a start opens again.
    """
    prefix = lambda s: strip(head(s, where(s, r"\bTable\s+\d+\b", "i").cast("int")))
    spaces = lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit("")))
    flag = lambda line: bound(strip(line), lambda s: F.when(is_table_start(s), 1).otherwise(0) + F.when(is_table_break(s), 2).otherwise(0))

    def kept(rows: Column) -> Column:
        return bound(F.transform(rows, flag), lambda flags: F.when(F.exists(flags, lambda f: f % 2 == 1), F.array_join(cut(rows, flags), "\n")).otherwise(F.array_join(rows, "\n")))

    def cut(rows: Column, flags: Column) -> Column:
        # the state before a line is that of the last line with a flag; a start inside a block is no start
        states = F.aggregate(
            flags,
            F.struct(F.lit(False).alias("inside"), F.lit("").alias("states")),
            lambda a, f: bound(
                a["inside"] & (f < 2),
                lambda inside: F.struct((inside | (f % 2 == 1)).alias("inside"), F.concat(a["states"], F.when(inside, "2").when(f % 2 == 1, "1").otherwise("0")).alias("states")),
            ),
            lambda a: a["states"],
        )
        state = lambda of, i: F.substring(of, i + 1, F.lit(1))
        line = lambda of, x, i: F.when(state(of, i) == "0", x).when(
            state(of, i) == "1", bound(prefix(strip(x)), lambda p: F.when((F.length(p) >= 50) & (spaces(p) >= 8), p))
        )
        return bound(states, lambda of: F.array_compact(F.transform(rows, lambda x, i: line(of, x, i))))

    return bound(lines(c), kept)


def strip_front_matter(c: str | Column, title: str | Column) -> Column:
    """The body from an early Introduction, else from Abstract, with the title line before it."""
    c, title = col(c), col(title)
    intro, abstract = where(c, r"(?:^|\n)\s*Introduction\b", "i"), where(c, r"(?:^|\n)\s*Abstract\b", "i")
    body = F.when(intro < F.floor(F.length(c) * 0.55), lstrip(tail(c, intro))).when(abstract.isNotNull(), lstrip(tail(c, abstract))).otherwise(c)
    return F.when(F.length(title) > 0, F.concat(F.lit("TITLE: "), title, F.lit("\n\n"), body)).otherwise(body)
