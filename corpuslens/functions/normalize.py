"""Text normalisation: pure Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, col, found, strip, sub, trim_of

# Fixed values, in the order of replacement: wrongly decoded characters of extracted text.
MOJIBAKE = [
    ("Â©", "©"), ("Ã—", "x"), ("Ã¾", " "), ("â€œ", '"'), ("â€\x9d", '"'), ("â€™", "'"), ("â€˜", "'"), ("â€“", "-"),
    ("â€”", "-"), ("â€¦", "..."), ("Â±", "+/-"), ("Â¼", "1/4"), ("Â½", "1/2"), ("Â¾", "3/4"), ("Â·", " "), ("Â", ""),
]


def fix_mojibake(c: str | Column) -> Column:
    c = col(c)
    for bad, good in MOJIBAKE:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def fix_characters(c: str | Column) -> Column:
    """Ligatures, hyphens and dashes, bullets, no-break spaces; soft hyphens go."""
    c = F.replace(F.replace(F.replace(col(c), F.lit("­"), F.lit("")), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return F.translate(c, "‐‑–—•· ", "----   ")


def join_hyphens(c: str | Column) -> Column:
    return sub(c, r"-\n(\w)", "$1")


def join_lines(c: str | Column) -> Column:
    """A line end between two letters is a space."""
    return sub(c, r"([a-záéíóúñ])\n([a-záéíóúñ])", "$1 $2", "i")


def split_camel_case(c: str | Column) -> Column:
    return sub(c, "([a-z])([A-Z])", "$1 $2")


def fix_spacing(c: str | Column) -> Column:
    """All of the above, a space after full stops, and single spaces and blank lines."""
    c = join_lines(join_hyphens(fix_characters(fix_mojibake(c))))
    c = split_camel_case(sub(c, r"\.([A-Z])", ". $1"))
    return strip(sub(sub(sub(c, " +", " "), r"\t+", " "), r"\n\n+", "\n\n"))


def normalize_extracted(c: str | Column) -> Column:
    """Control characters, rules of symbols and runs of blanks become one space."""
    c = F.replace(col(c), F.lit("Â"), F.lit(""))
    for pattern in (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", r"[_\-]{4,}", "={3,}", r"[ \t]{2,}"):
        c = sub(c, pattern, " ")
    return c


def remove_extra_whitespace(c: str | Column, preserve_blank_lines: bool = False) -> Column:
    """At most one blank line and single blanks; then leading blanks of lines go, and with them
    every blank line, unless preserve_blank_lines is set."""
    c = sub(sub(c, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    if preserve_blank_lines:
        return sub(c, r"(^|\n)[ \t]+", "$1")
    return F.regexp_replace(c, r"(?dU)(?:^|\n)[\s\x1c-\x1f]+", "\n")


SPACED_ABSTRACT = r"\bA\W*B\W*S\W*T\W*R\W*A\W*C\W*T\b"


def normalize_title(c: str | Column) -> Column:
    c = strip(sub(strip(c), r"^(Review Article|Original Article|Research Article)\s*", "", "i"))
    c = strip(sub(c, SPACED_ABSTRACT + r"[\s\S]*$", "", "i"))
    c = strip(sub(c, r"\bAbstract\b[\s\S]*$", "", "i"))
    c = strip(sub(c, r"^Fig\.{0,2}\s*\d+\.{0,2}\s*", "", "i"))
    return bound(trim_of(sub(c, r"\s{2,}", " "), " -:\t"), lambda t: F.nullif(t, F.lit("")))


def sanitize_title(c: str | Column) -> Column:
    c = strip(F.coalesce(col(c), F.lit("")))
    c = strip(sub(c, SPACED_ABSTRACT + r"[\s\S]*$", "", "i"))
    c = strip(sub(c, r"\bAbstract\b[\s\S]*$", "", "i"))
    return strip(sub(c, r"\s{2,}", " "))


def entity_key(c: str | Column) -> Column:
    return F.lower(sub(strip(c), r"\s+", " "))


def escape_html(c: str | Column) -> Column:
    c = col(c)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def eta_text(seconds: str | Column) -> Column:
    s = F.round(col(seconds)).cast("long")
    rest = F.concat((s % 60).cast("string"), F.lit("s"))
    return F.when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), rest)).otherwise(rest)


def is_log_noise(c: str | Column) -> Column:
    """Blank lines and progress lines of the tagger's error output."""
    c = strip(c)
    return (c == "") | F.startswith(c, F.lit("Loading weights")) | F.startswith(c, F.lit("Procesando:"))


def file_name(c: str | Column) -> Column:
    return F.element_at(F.split(col(c), r"[/\\]"), -1)


def file_suffix(c: str | Column) -> Column:
    return F.lower(F.regexp_extract(file_name(c), r"(\.[^.]+)$", 1))


def is_spaced_abstract(c: str | Column) -> Column:
    return found(c, SPACED_ABSTRACT, "i")
