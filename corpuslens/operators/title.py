"""Title extraction, as flags per line and array functions over them: no shuffle, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.normalize import is_spaced_abstract, normalize_title, sanitize_title
from ..functions.text import any_of, bound, col, count, found, full_lines, letters, lines, strip, sub, trim_of

# The word lists of the heuristics.
IGNORED_STARTS = ("article info", "keywords", "abstract", "contents", "received", "accepted", "available online")
BLOCKED = (
    "journal homepage", "contents lists available", "sciencedirect", "doi", "www.", "http://", "https://", "article history",
    "department of", "school of", "university", "laboratory", "issn", "lab invest",
)
NOT_AUTHORS = ("department of", "school of", "university", "institute", "laboratory")
AFFILIATION = (*NOT_AUTHORS, "hospital", "faculty of", "college of")
JOURNAL_HEADER = ("journal homepage", "contents lists available", "sciencedirect")
BAD_TITLE = (
    "abstract", "keywords", "article info", "article history", "journal homepage", "contents lists available", "sciencedirect", "doi", "www.",
)


def words_in(s: Column) -> Column:
    return count(s, r"\S+")


def names_any(s: Column, tokens: tuple[str, ...], starts: tuple[str, ...] = ()) -> Column:
    """Whether the lower-cased s has one of the tokens, or begins with one of `starts`; lower-cased once."""

    def tests(low):
        out = any_of(low, tokens)
        for p in starts:
            out = out | F.startswith(low, F.lit(p))
        return out

    return bound(F.lower(s), tests)


def is_boilerplate(s: Column) -> Column:
    return names_any(s, BLOCKED, IGNORED_STARTS)


def is_title_like(s: Column) -> Column:
    commas = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
    # the length comes first: long lines need none of the other tests
    return (
        F.length(s).between(20, 220)
        & ~is_boilerplate(s)
        & ~names_any(F.concat(F.lit(" "), s, F.lit(" ")), (" abstract ",))
        & ~is_spaced_abstract(s)
        & ~names_any(s, (" keyword", "fig."))
        & ~F.endswith(s, F.lit(":"))
        & (commas < 2)
        & (letters(s) >= 12)
        & (words_in(s) >= 4)
    )


def is_author_like(s: Column, marks: tuple[str, ...] = (",", "*", "∗"), et_al: bool = True) -> Column:
    """Two name-like chunks and a sign of a list of names."""
    marked = any_of(s, marks) | (names_any(s, (" et al",)) if et_al else F.lit(False))
    return marked & ~names_any(s, NOT_AUTHORS) & (count(s, r"\b[A-Z][a-z]+(?:\s+[A-Z]\.)?") >= 2)


def _at(array: Column, i: Column | int) -> Column:
    return F.coalesce(F.get(array, F.lit(i) if isinstance(i, int) else i), F.lit(False))


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def title_before_authors(row: Column, start: Column | int, stop: Column) -> Column:
    """The first title-like line in [start, stop) that an author line follows, maybe after one more title line."""
    text, title, author = row["line"], row["title"], row["author"]
    start = F.lit(start) if isinstance(start, int) else start
    places = F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<int>"))
    long = lambda i: _at(title, i + 1) & _at(author, i + 2)
    hits = F.filter(places, lambda i: _at(title, i) & (_at(author, i + 1) | long(i)))
    i = _first(hits)
    return F.when(_at(author, i + 1), F.get(text, i)).when(i.isNotNull(), F.concat(F.get(text, i), F.lit(" "), F.get(text, i + 1)))


def block_before_authors(row: Column) -> Column:
    """Up to four lines right before the first author line of the first ninety."""
    text, author = row["line"], row["author"]

    def up_to(a):
        ends = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.when((a - k < 0) | _at(row["stop"], (a - k).cast("int")), k - 1))
        n = F.coalesce(F.array_min(F.filter(ends, lambda k: k.isNotNull())), F.lit(4))
        return bound(n, lambda n: F.when((a > 0) & (n > 0), F.slice(text, (a - n + 1).cast("int"), n)))

    block = bound(F.array_position(F.slice(author, 1, 90), True) - 1, up_to)
    kind = r"^(review|original|research)\s+article$"
    block = bound(block, lambda b: F.when(found(_first(b), kind, "i"), F.slice(b, 2, 4)).otherwise(b))
    return bound(F.array_join(block, " "), lambda t: F.nullif(t, F.lit("")))


def document_title(c: str | Column) -> Column:
    """The likeliest title in a document's first lines, or null."""
    all_lines = full_lines(c)
    head = F.slice(all_lines, 1, 140)
    flags = lambda head: F.struct(
        head.alias("line"),
        F.transform(head, is_title_like).alias("title"),
        F.transform(head, lambda s: is_author_like(s) & ~is_boilerplate(s)).alias("author"),
        F.transform(head, lambda s: names_any(s, (*BLOCKED, *AFFILIATION, "keyword", "abstract"), IGNORED_STARTS)).alias("stop"),
        F.transform(head, lambda s: names_any(s, JOURNAL_HEADER)).alias("header"),
        F.transform(head, words_in).alias("words"),
    )

    def pick(row: Column) -> Column:
        n = F.size(row["line"])
        header = F.nullif(F.array_position(row["header"], True), F.lit(0)).cast("int") - 1
        few = F.filter(F.sequence(F.lit(0), F.lit(24)), lambda i: _at(row["title"], i) & (F.get(row["words"], i) <= 25))
        return F.coalesce(
            F.when(header.isNotNull(), title_before_authors(row, header + 1, F.least(n, header + 25))),
            block_before_authors(row),
            title_before_authors(row, 0, n),
            F.get(row["line"], _first(few)),
        )

    # one-element arrays bind the lines once for all flags, and the flags once for all strategies
    title = _first(F.transform(F.transform(F.array(head), flags), pick))
    title = sub(title, r"^(Review Article|Original Article|Research Article)\s*", "", "i")
    title = strip(sub(title, r"\bA\s*B\s*S\s*T\s*R\s*A\s*C\s*T\b[\s\S]*$", "", "i"))
    title = strip(sub(title, r"\bAbstract\b[\s\S]*$", "", "i"))
    title = strip(sub(title, r"\s+[A-Z][a-z]+\s+[A-Z]\.\.?$", ""))
    title = trim_of(sub(title, r"\s{2,}", " "), " -:\t")
    return bound(title, lambda t: F.when(F.length(t) >= 12, t))


def first_page_title(c: str | Column) -> Column:
    """The lines between a journal's header and the authors on a first page, or null."""
    all_lines = full_lines(c)
    author = lambda s: is_author_like(s, et_al=False)
    header = lambda s: names_any(s, JOURNAL_HEADER) | F.endswith(F.lower(s), F.lit("journal"))
    row = lambda x: F.struct(x.alias("line"), F.transform(F.slice(x, 1, 35), header).alias("header"))

    def pick(row: Column) -> Column:
        anchor = F.array_max(F.filter(F.transform(row["header"], lambda h, i: F.when(h, i)), lambda i: i.isNotNull()))
        after = F.slice(row["line"], anchor + 2, 29)
        a = F.array_position(F.transform(after, author), True)
        own = F.filter(F.slice(after, 1, (a - 1).cast("int")), lambda s: (F.length(s) >= 8) & ~names_any(s, (*JOURNAL_HEADER, "abstract", "keyword")))
        return F.when((a > 1) & (F.size(own) > 0), F.array_join(F.slice(own, 1, 3), " "))

    return normalize_title(_first(F.transform(F.transform(F.array(all_lines), row), pick)))


def is_bad_title(c: str | Column) -> Column:
    c = F.coalesce(col(c), F.lit(""))
    return (c == "") | any_of(F.lower(c), (*BAD_TITLE, "fig.")) | is_spaced_abstract(c) | (F.length(c) > 220)


def display_title(c: str | Column) -> Column:
    """A TITLE: line of the first 30, else the first fitting line of 60."""
    stripped = F.transform(lines(c), strip)
    marked = F.filter(F.slice(stripped, 1, 30), lambda s: found(s, r"^TITLE:\s*(.+)$", "i"))
    named = F.nullif(strip(sub(_first(marked), r"^TITLE:\s*", "", "i")), F.lit(""))
    fits = lambda s: (
        F.length(s).between(15, 220)
        & ~found(F.lower(s), "^(abstract|keywords|introduction)")
        & ~any_of(F.lower(s), ("journal homepage", "contents lists available"))
    )
    return F.coalesce(named, _first(F.filter(F.slice(stripped, 1, 60), fits)))


def panel_title(external: str | Column, sentences: str | Column) -> Column:
    """A given title, sanitised, else that of the first sentence that begins with TITLE:."""
    marked = _first(F.filter(col(sentences), lambda s: found(s, r"^\s*TITLE:", "i")))
    return F.coalesce(F.nullif(sanitize_title(external), F.lit("")), F.nullif(sanitize_title(sub(marked, r"^\s*TITLE:\s*", "", "i")), F.lit("")))
