"""Column helpers: regular expressions with Unicode classes, stripping, lines, character counts.

`rx` fixes the flags that make Java's engine read a pattern the usual way: `.` stops at \\n only,
`$` is the end or before a last \\n, and \\d, \\w, \\s and \\b are Unicode ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c: Column, f) -> Column:
    """f of c, where f names its argument more than once: c is evaluated once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def rx(pattern: str, flags: str = "") -> str:
    """flags: i (any case, Unicode), m (^ and $ at each line)."""
    return f"(?dU{flags.replace('i', 'iu')}){pattern}"


def sub(c: str | Column, pattern: str, to: str = "", flags: str = "") -> Column:
    return F.regexp_replace(col(c), rx(pattern, flags), to)


def found(c: str | Column, pattern: str, flags: str = "") -> Column:
    return col(c).rlike(rx(pattern, flags))


def count(c: str | Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(col(c), F.lit(rx(pattern, flags)))


def where(c: str | Column, pattern: str, flags: str = "") -> Column:
    """0-based start of the first match, null without one."""
    at = F.regexp_instr(col(c), F.lit(rx(pattern, flags)))
    return F.when(at > 0, at - 1)


# What counts as blank at the ends of a text or line, the Unicode white space and \x1c to \x1f.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: str | Column) -> Column:
    return F.trim(col(c), F.lit(BLANKS))


def lstrip(c: str | Column) -> Column:
    return F.ltrim(col(c), F.lit(BLANKS))


def rstrip(c: str | Column) -> Column:
    return F.rtrim(col(c), F.lit(BLANKS))


def trim_of(c: str | Column, chars: str) -> Column:
    return F.trim(col(c), F.lit(chars))


def lines(c: str | Column) -> Column:
    """Lines without their ends; no empty line after the last end."""
    return bound(F.split(col(c), LINE_END), lambda parts: F.slice(parts, 1, F.size(parts) - (F.element_at(parts, -1) == "").cast("int")))


def full_lines(c: str | Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def keep_lines(c: str | Column, keep) -> Column:
    """The text of the lines for which keep(line, stripped line) holds."""
    return F.array_join(F.filter(lines(c), lambda x: bound(strip(x), lambda s: keep(x, s))), "\n")


def head(c: Column, n: int | Column) -> Column:
    """The first n characters."""
    return F.substring(c, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def tail(c: Column, start: Column) -> Column:
    """From 0-based start on."""
    return F.substring(c, (start + 1).cast("int"), F.length(c))


def any_of(c: Column, tokens: tuple[str, ...]) -> Column:
    """Whether one of the literal tokens is in c."""
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(c, F.lit(t))
    return out


def chars(c: str | Column, one: str) -> Column:
    """How many characters are in the class `one`, such as [a-z]: what its runs leave is shorter by them."""
    return F.length(col(c)) - F.length(F.regexp_replace(col(c), f"(?U)(?:{one})++", ""))


def letters(c: str | Column) -> Column:
    return chars(c, r"\p{L}")


def digits(c: str | Column) -> Column:
    return chars(c, r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]")


def chars_of(c: str | Column, listed: str) -> Column:
    """How many characters are among the listed ones."""
    return F.length(col(c)) - F.length(F.translate(col(c), listed, ""))


# The characters that match an ASCII letter in any case without being one, and these letters.
FOLDED = ("İıſK", "iisk")


def lowered(c: str | Column) -> Column:
    """A text that holds a lower-case ASCII word wherever the text matches the word in any case."""
    return F.lower(F.translate(col(c), *FOLDED))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(default))
