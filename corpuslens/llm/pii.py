"""Personal data with offsets, in plain sight or disguised.

Plain detectors run on the source text.  Then transducers rewrite the text: homoglyphs to ASCII,
invisible characters away, spelled digits to digits, bracketed or spelled at / dot / plus to their
signs.  Each keeps, per character of its output, the source span it came from, so that what the
same detectors find in the rewritten text maps back to the source.  Such a span is added unless it
lies in a plain span of its kind; so an address whose tail alone is in plain sight is found whole.
Every rule is tried on every text.  Not covered: digits spelled in other languages than the four
below, numbers spelled as tens or hundreds, and letters spelled by name.

Defined results: null or empty text has no span.  Offsets are code points, the end exclusive.  Each
row is judged by its own text, whatever its doc_id, and repeated rows give repeated results.  An
empty table gives an empty result; columns but doc_id and text are not read.  Texts of any length
take time in proportion to it.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lean, parts

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits: the run's first digit would have matched too
IP, IP_CORE = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}"), re.compile(r"\.[0-9]+\.[0-9]+\.[0-9]")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, in one pass: the local part is the run before an @."""
    out, low = [], 0
    at = text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            seg = text[low:at]
            n = len(seg) - len(seg.rstrip(LOCAL))
            if n:
                out.append((at - n, m.end()))
                low = m.end()
                at = text.find("@", low)
                continue
        low = at + 1
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_ip(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in match.split("."))


def is_card(match: str) -> bool:
    digits = NOT_DIGIT.sub("", match)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_phone(match: str) -> bool:
    return 9 <= len(NOT_DIGIT.sub("", match)) <= 15


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    for kind, pattern, ok in (("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone)):
        if kind == "phone" and "+" not in text or kind == "ip" and not IP_CORE.search(text):
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if ok(m[0])]
    return out


# Letters of other scripts that look like ASCII letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "ı": "i", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
}


def homoglyphs() -> dict[int, str]:
    """The look-alikes, and every character whose compatibility form is one ASCII letter, digit or sign."""
    table = {ord(k): v for k, v in LOOKALIKES.items()}
    for block in (range(0x2070, 0x209D), range(0x2460, 0x24FF), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800), range(0x1F100, 0x1F150)):
        for c in block:
            plain = unicodedata.normalize("NFKC", chr(c)).strip("()")
            if len(plain) == 1 and " " < plain < "\x7f":
                table[c] = plain
    for c in range(0x660, 0x1E000):
        if unicodedata.category(chr(c)) == "Nd":
            table[c] = str(unicodedata.digit(chr(c)))
    return table


HOMOGLYPHS = homoglyphs()
# characters that match an ASCII letter in any case without being one
ODD_CASE = re.compile("[İıſK]")
LOOKALIKE = frozenset(map(chr, HOMOGLYPHS))
INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]+")
# Names of the digits in English, French, German and Spanish.
DIGITS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
NAME = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
GAP = r"(?:[ \t]+|[ \t]*[,-][ \t]*)"
# digits are spelled where at least three names follow one another, or where digits and names are mixed
SPELLED = re.compile(rf"\b{NAME}(?:{GAP}{NAME}){{2,}}\b", re.I)
ONE_NAME = re.compile(NAME, re.I)
# the blanks before a bracket are tried from their first one only, so that long blanks take linear time
AT = re.compile(r"(?:(?<![ \t])[ \t]+)?[\[({<][ \t]*(?:at|@|arroba|chez)[ \t]*[\])}>][ \t]*", re.I)
DOT = re.compile(r"(?:(?<![ \t])[ \t]+)?[\[({<][ \t]*(?:dot|\.|punto|point|punkt)[ \t]*[\])}>][ \t]*", re.I)
# Last labels that a spoken address may end in.
ENDINGS = "com|org|net|edu|gov|info|biz|io|co|ai|dev|app|uk|us|eu|de|fr|es|it|nl|ch|at|be|pt|br|mx|ca|au|jp|cn|in|ru"
# a spoken dot needs an ending within a few words, or digits on both sides
SPOKEN_DOT = re.compile(
    r"(?<=[A-Za-z0-9])[ \t]+(?:dot|punto|punkt)[ \t]+(?=(?:[A-Za-z0-9-]+(?:[ \t]+(?:dot|punto|punkt|at|arroba)[ \t]+|[.@])){0,6}(?:%s)\b)"
    r"|(?<=[0-9])[ \t]+(?:dot|punto|punkt)[ \t]+(?=[0-9])" % ENDINGS,
    re.I,
)
SPOKEN_AT = re.compile(r"(?<=[A-Za-z0-9])[ \t]+(?:at|arroba)[ \t]+(?=[A-Za-z0-9-]+\.[A-Za-z])", re.I)
SPOKEN_PLUS = re.compile(r"\bplus[ \t]+(?=[0-9])", re.I)
# each rule with a part of it that is found faster
SIGNS = (
    (AT, re.compile(r"[\[({<][ \t]*(?:at|@|arroba|chez)[ \t]*[\])}>]", re.I), "@"),
    (DOT, re.compile(r"[\[({<][ \t]*(?:dot|\.|punto|point|punkt)[ \t]*[\])}>]", re.I), "."),
    (SPOKEN_DOT, re.compile(r"[ \t](?:dot|punto|punkt)[ \t]", re.I), "."),
    (SPOKEN_AT, re.compile(r"[ \t](?:at|arroba)[ \t]", re.I), "@"),
    (SPOKEN_PLUS, re.compile(r"plus[ \t]+[0-9]", re.I), "+"),
)


BRACKETED_DOT = r"[ \t]*[\[({<][ \t]*(?:dot|\.|punto|point|punkt)[ \t]*[\])}>][ \t]*"
JOINT = rf"(?:{BRACKETED_DOT}|[ \t]+(?:dot|punto|punkt)[ \t]+|\.|{GAP})"
# names and digit groups, with gaps or dots between them
MIXED = re.compile(rf"(?<!\w)(?:{NAME}|[0-9]++)(?!\w)(?:{JOINT}(?:{NAME}|[0-9]++)(?!\w))*+", re.I)
TOKEN = re.compile(rf"(?<!\w)(?:({NAME})|[0-9]+)(?!\w)", re.I)
GAP_ONLY = re.compile(GAP)
ANY_NAME = re.compile(rf"\b{NAME}\b")  # in lower-cased text
PLUS_BEFORE = re.compile(r"(?:\+|\bplus[ \t])[ \t(]*\Z", re.I)


FOLDED = str.maketrans("İıſK", "iisk")


def digit_of(name: str) -> str:
    return str(DIGITS[name.translate(FOLDED).lower()])


def lines_with_names(text: str) -> list[tuple[int, int]]:
    """The lines with a digit's name; no run goes on over a line's end."""
    low, out, at = text.translate(FOLDED).lower() if ODD_CASE.search(text) else text.lower(), [], 0
    if len(low) != len(text):
        return [(0, len(text))]
    while m := ANY_NAME.search(low, at):
        start, at = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        out.append((start, at if at >= 0 else len(text)))
        if at < 0:
            break
    return out


def mixed_edits(text: str, lines: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, new) that write the names in runs of names, digits and dots as digits.

    A name alone counts only after a plus.  Gaps go where a name is beside them; dots and the gaps
    between digit groups stay.
    """
    edits = []
    for run in (m for line in lines for m in MIXED.finditer(text, *line)):
        tokens = list(TOKEN.finditer(text, *run.span()))
        if not any(m[1] for m in tokens):
            continue
        if len(tokens) == 1 and not PLUS_BEFORE.search(text, max(0, run.start() - 8), run.start()):
            continue
        before = None
        for m in tokens:
            if before and (before[1] or m[1]) and GAP_ONLY.fullmatch(text, before.end(), m.start()):
                edits.append((before.end(), m.start(), ""))
            if m[1]:
                edits.append((*m.span(), digit_of(m[0])))
            before = m
    return edits


class Rewritten:
    """A text with the source span of each of its characters; the spans are listed from the first edit on."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def edit(self, edits: list[tuple[int, int, str]]) -> bool:
        """Replaces text[s:e] by `new`, in order; each new character stands for the whole of it."""
        if not edits:
            return False
        out, start, end, at = [], [], [], 0
        for s, e, new in edits:
            out += [self.text[at:s], new]
            start += self.start[at:s]
            start += [self.start[s]] * len(new)
            end += self.end[at:s]
            end += [self.end[e - 1]] * len(new)
            at = e
        start += self.start[at:]
        end += self.end[at:]
        self.text, self.start, self.end = "".join(out) + self.text[at:], start, end
        return True

    def sub(self, pattern: re.Pattern, to) -> bool:
        """Replaces matches by to(match)."""
        return self.edit([(*m.span(), to(m)) for m in pattern.finditer(self.text)])

    def copy(self) -> Rewritten:
        new = Rewritten("")
        new.text, new.start, new.end = self.text, self.start, self.end
        return new

    def digits(self, lines: list[tuple[int, int]]) -> bool:
        """Spelled digits of these lines; each digit keeps the span of its own name."""
        edits = []
        for run in (m for line in lines for m in SPELLED.finditer(self.text, *line)):
            at = run.start()
            for m in ONE_NAME.finditer(self.text, run.start(), run.end()):
                edits += [(at, m.start(), "")] * (m.start() > at) + [(*m.span(), digit_of(m[0]))]
                at = m.end()
        return self.edit(edits)

    def signs(self) -> None:
        for pattern, core, sign in SIGNS:
            if core.search(self.text):
                self.sub(pattern, lambda m: sign)


WORD = re.compile(r"\w+")
# Words of which one is in any text that a rule could rewrite, unless a bracket or an odd character is.
SIGN_WORDS = {"at", "arroba", "chez", "dot", "punto", "point", "punkt", "plus"}
BRACKET = re.compile(r"[\[({<]")


def disguised_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows, in the source's offsets."""
    odd = not text.isascii()
    clear = text.translate(HOMOGLYPHS) if odd and not LOOKALIKE.isdisjoint(text) else text
    hidden = odd and INVISIBLE.search(clear)
    # each name and sign word is a whole word, so the set of words says which rules can match
    words = set(WORD.findall(clear.lower()))
    unsure = hidden or odd and ODD_CASE.search(clear)
    names = unsure or not words.isdisjoint(DIGITS)
    signs = unsure or not words.isdisjoint(SIGN_WORDS) or BRACKET.search(clear)
    # where no rule has a match in this text, none gets one from another rule
    if not (clear is not text or hidden or names or signs):
        return []
    base = Rewritten(clear)
    if hidden:
        base.sub(INVISIBLE, lambda m: "")
    lines = lines_with_names(base.text) if names else []
    # two readings: runs of names only, and runs of names, digits and dots, which may take in a number beside them
    found = []
    for kind_of_run in ("names", "mixed"):
        new = base.copy()
        if kind_of_run == "names":
            new.digits(lines)
        elif not new.edit(mixed_edits(new.text, lines)):
            break
        if signs:
            new.signs()
        if new.text != text:
            found += [(k, new.start[s], new.end[e - 1]) for k, s, e in plain_spans(new.text)]
    return longer_or_new(found, plain, len(text))


def longer_or_new(found: list[tuple[str, int, int]], plain: list[tuple[str, int, int]], size: int) -> list[tuple[str, int, int]]:
    """Those of `found` that lie in no plain span of their kind; of found ones that overlap the longest, then first."""
    starts, ends = {k: [] for k in KINDS}, {k: [] for k in KINDS}
    for kind, s, e in plain:
        starts[kind].append(s)
        ends[kind].append(e)
    taken = {k: bytearray(size) for k in {x[0] for x in found}}
    out = []
    for kind, s, e in sorted(found, key=lambda x: (x[1] - x[2], x[1])):
        i = bisect.bisect_right(starts[kind], s) - 1
        if i >= 0 and e <= ends[kind][i] or 1 in taken[kind][s:e]:
            continue
        taken[kind][s:e] = b"\1" * (e - s)
        out.append((kind, s, e))
    return out


def spans_of(text: str | None) -> tuple[list, list]:
    """(plain spans, all spans), each by kind as listed, then start."""
    if not text:
        return [], []
    plain = plain_spans(text)
    found = sorted(plain + disguised_spans(text, plain), key=lambda x: (KINDS.index(x[0]), x[1]))
    return plain, found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) per row; counts are of plain spans."""

    def run(batches):
        for b in batches:
            rows = [spans_of(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    *(pa.array([sum(s[0] == k for s in plain) for plain, _ in rows], pa.int64()) for k in KINDS),
                    pa.array([hashlib.sha256(joined(plain).encode()).hexdigest() for plain, _ in rows], pa.string()),
                    pa.array([joined(found) for _, found in rows], pa.string()),
                    pa.array([len(found) - len(plain) for plain, found in rows], pa.int64()),
                ],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS)])
    schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long")
    return docs.mapInArrow(lean(run), schema)


def redact(text: str | None) -> str | None:
    """The text with every span, plain or disguised, replaced by <KIND>; of overlapping spans the first, then longest."""
    if not text:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans_of(text)[1], key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
            at = e
        elif e > at:
            at = e
    return "".join(out) + text[at:] if at else text


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, with personal data in `text` replaced; all other columns as they are."""

    def run(batches):
        for b in parts(batches, text):
            at = b.schema.get_field_index(text)
            yield b.set_column(at, b.schema.field(at), pa.array([redact(t.as_py()) for t in b.column(at)], pa.string()))

    return docs.mapInArrow(lean(run), docs.schema)
