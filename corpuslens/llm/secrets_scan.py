"""Secret scan: plain patterns, and a randomness test battery on every unbroken run of characters.

Runs are parted at '='.  Each part gets an encoding (letters, hex, base32, base64 or mixed) from
the characters it uses, and three tests against a random string of that encoding: chi-squared
uniformity over the alphabet (in groups that keep the expected counts up), runs of the alphabet's
halves, and serial correlation of neighbouring characters.  The three p-values make one score by
Fisher's method.  A part that is not random as a whole is tested between its slashes, too.  What
is longer than LONGEST is tested in consecutive windows, and random neighbours make one span.

False discoveries are controlled by length: a first pass over all documents gathers, per length
band, the scores of ordinary letters, a table of fixed size; a candidate's p-value is the share of
ordinary strings of its band that look as random.  Parts of letters in one case are tested in an
alphabet of letters, and have bands and ordinary strings of their own.  Benjamini-Hochberg over
the histogram of all candidates' p-values then gives each band its threshold, and a second pass
adds the spans.

Defined results: null or empty text has no span.  Offsets are code points, the end exclusive; an
`assign` span is the whole match, with its key.  Candidates that overlap a plain span are dropped.
Each row is judged by its own text, and repeated rows give repeated results; in the histograms every
row counts.  Of equal scores all or none pass.  An empty table gives an empty result; columns but
doc_id and text are not read.  Texts of any length take time in proportion to it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART, SEGMENT = re.compile(r"[A-Za-z0-9+/_-]{16,}"), re.compile(r"[A-Za-z0-9+_-]{16,}")
LONGEST, BANDS, BINS = 512, 12, 200


KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed.

    What is long enough for a hex or access span lies in a long run of characters.
    """
    out, low = [], text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for run in RUN.finditer(text) for m in HEX.finditer(text, *run.span()) if m.end() - m.start() >= 16]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


# Encodings from narrow to wide: name, alphabet.
ENCODINGS = (
    ("digits", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("letters", "abcdefghijklmnopqrstuvwxyz"),
    ("LETTERS", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
# Letters by their frequency in English, the most frequent first: a group of neighbours in this
# order is far from uniform in any text, and capitals, digits and signs stay apart from letters.
USUAL = "etaoinshrdlucmfwypvbgkjqxz"
RANK = {c: i for i, c in enumerate(USUAL + USUAL.upper() + "0123456789+/-_")}
SETS = [(name, frozenset(a), {c: i for i, c in enumerate(sorted(a, key=RANK.__getitem__))}) for name, a in ENCODINGS]


def encoding_of(run: str) -> tuple[str, dict[str, int]] | None:
    """The narrowest encoding whose alphabet has every character, padding aside."""
    used = set(run.rstrip("="))
    for name, letters, at in SETS:
        if used <= letters:
            return name, at
    return None


def upper_tail(chi2: float, k: int) -> float:
    """P(X >= chi2) of a chi-squared variable with k degrees of freedom, by the cube-root normal form."""
    if chi2 <= 0:
        return 1.0
    z = ((chi2 / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(run: str) -> float:
    """Fisher's combined p-value of the three tests: near 0 for text, uniform for random strings."""
    found = encoding_of(run)
    if found is None:
        return 0.0
    _, at = found
    x = [at[c] for c in run.rstrip("=")]
    n, size = len(x), len(at)
    if n < 8:
        return 0.0
    groups = max(2, min(size, n // 4))
    edge = [i * groups // size for i in range(size)]
    expected, counts = [0] * groups, [0] * groups
    for g in edge:
        expected[g] += n / size
    for c in x:
        counts[edge[c]] += 1
    p1 = upper_tail(sum((o - e) ** 2 / e for o, e in zip(counts, expected, strict=True)), groups - 1)
    half = [c * 2 >= size for c in x]
    a = sum(half)
    b = n - a
    if not a or not b:
        return 0.0
    runs = 1 + sum(p != q for p, q in zip(half, half[1:]))
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p2 = two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    m = sum(x) / n
    den = sum((c - m) ** 2 for c in x)
    p3 = two_sided(sum((p - m) * (q - m) for p, q in zip(x, x[1:])) / den * math.sqrt(n)) if den else 0.0
    # Fisher: -2 ln of the product is chi-squared with 6 degrees of freedom
    half_stat = -sum(math.log(max(p, 1e-100)) for p in (p1, p2, p3))
    return math.exp(-half_stat) * (1 + half_stat + half_stat * half_stat / 2)


# log(erfc) on a fine grid; beyond its end the value counts as 1e-100
GRID = np.linspace(-12.0, 15.0, 27_001)
LOG_ERFC = np.log([max(math.erfc(x), 1e-100) for x in GRID])


def log_erfc(x: np.ndarray) -> np.ndarray:
    return np.interp(x, GRID, LOG_ERFC)


def batteries(x: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """randomness() of each row of codes, all rows of one length, per alphabet size; all codes are below each size."""
    m, n = x.shape
    codes = int(x.max(initial=0)) + 1
    counts = np.bincount((np.arange(m)[:, None] * codes + x).ravel(), minlength=m * codes).reshape(m, codes).astype(np.float64)
    value = np.arange(codes)
    total, squares = counts @ value, counts @ (value * value)
    average = total / n
    v = x.astype(np.float32)  # sums of products of codes are whole numbers that it holds
    products = np.einsum("ij,ij->i", v[:, :-1], v[:, 1:]).astype(np.float64)
    den = squares - n * average**2
    lag = products - average * (2 * total - x[:, 0] - x[:, -1]) + (n - 1) * average**2
    flat = den > 1e-9
    p3 = np.where(flat, log_erfc(np.abs(lag) / np.where(flat, den, 1) * math.sqrt(n / 2)), LEAST)
    out = []
    for size in sizes:
        groups = max(2, min(size, n // 4))
        edge = np.arange(size) * groups // size
        expected = np.bincount(edge, minlength=groups) * n / size
        chi2 = (counts @ np.eye(groups)[edge[:codes]]) ** 2 @ (1 / expected) - n
        a = counts[:, value * 2 >= size].sum(axis=1)
        mean = 2 * a * (n - a) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        half = x * 2 >= size
        runs = 1 + np.count_nonzero(half[:, 1:] != half[:, :-1], axis=1)
        k = groups - 1
        z = (np.cbrt(np.maximum(chi2, 0) / k) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
        p1 = np.where(chi2 > 1e-9, log_erfc(z / math.sqrt(2)) - math.log(2), 0.0)
        p2 = np.where(var > 0, log_erfc(np.abs(runs - mean) / np.sqrt(np.where(var > 0, var, 1) * 2)), LEAST)
        half_stat = -sum(np.maximum(p, LEAST) for p in (p1, p2, p3))
        out.append(np.where((a > 0) & (a < n), np.exp(-half_stat) * (1 + half_stat + half_stat * half_stat / 2), 0.0))
    return out


LEAST = math.log(1e-100)


def randomness_rows(x: np.ndarray, size: int) -> np.ndarray:
    return batteries(x, (size,))[0]


def is_ordinary(run: str) -> bool:
    """Letters only, in one case but for the first: what the null distribution is made of."""
    return run.isalpha() and (run.islower() or run.isupper() or run[1:].islower())


def windows(s: int, e: int) -> list[tuple[int, int]]:
    """s to e in consecutive windows of at most LONGEST characters, as equal as can be."""
    k = -(-(e - s) // LONGEST)
    return [(s + (e - s) * i // k, s + (e - s) * (i + 1) // k) for i in range(k)]


def parts(text: str) -> Iterator[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """Candidates (start, end), by part of a run between '=': the part's windows, and those of what lies between its slashes."""
    for run in RUN.finditer(text):
        for part in PART.finditer(text, *run.span()):
            inner = [m.span() for m in SEGMENT.finditer(text, *part.span())] if "/" in part[0] else []
            yield windows(*part.span()), [w for x in inner if x != part.span() for w in windows(*x)]


def band_of(n: int) -> int:
    """Length bands: 16-19, 20-23, 24-27, 28-31, then by doubling halves."""
    return min(BANDS - 1, (n - 16) // 4 if n < 32 else 4 + int(2 * math.log2(n / 32)))


def row_of(run: str) -> int:
    """The run's row of the histograms: its length band, past the others' for letters in one case."""
    return band_of(len(run)) + BANDS * (run.isalpha() and (run.islower() or run.isupper()))


def bin_of(p: float) -> int:
    """Bins of log10(p), from 1e-20 up."""
    return min(BINS - 1, max(0, int((math.log10(max(p, 1e-20)) + 20) * BINS / 20)))


def bins_of(p: np.ndarray) -> np.ndarray:
    return np.clip((np.log10(np.maximum(p, 1e-20)) + 20) * BINS / 20, 0, BINS - 1).astype(np.int64)


# the code of each ASCII letter, whatever its case, in the alphabet `lower`; -1 for other bytes
LETTER = np.full(256, -1)
LETTER[97:123] = LETTER[65:91] = [USUAL.index(chr(c)) for c in range(97, 123)]
LENGTHS = (18, 22, 26, 30, 36, 52, 76, 108, 152, 216, 304, 432)  # of ordinary strings, per band


def add_ordinary(null: np.ndarray, texts: list[np.ndarray]) -> None:
    """Adds the scores of the texts' letters to the null of every band, no stretch across two texts."""
    for k, n in enumerate(LENGTHS):
        cut = [x[: len(x) // n * n] for x in texts if len(x) >= n]
        rows = np.concatenate(cut).reshape(-1, n) if cut else np.empty((0, n), np.int64)
        step = max(1, (1 << 16) // n)  # rows that stay in a processor's cache
        for at in range(0, len(rows), step):
            for row, p in zip((k, BANDS + k), batteries(rows[at : at + step], (36, 26)), strict=True):
                null[row] += np.bincount(bins_of(p), minlength=BINS)


def histograms(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ordinary, candidates): counts per length band and score bin, over all documents.

    Ordinary strings are all letters of a text, lower-cased and cut into stretches of each band's
    length, so that every length has its own null and every document adds its whole text to each.
    Runs of mixed characters stay out, lest the secrets themselves be the null.
    """

    def run(batches):
        null, seen = np.zeros((2 * BANDS, BINS), np.int64), np.zeros((2 * BANDS, BINS), np.int64)
        held, size = [], 0
        for b in batches:
            for t in b.column("text"):
                text = t.as_py()
                if not text:
                    continue
                ordinary = RUN.sub(lambda m: m[0] if is_ordinary(m[0]) else " ", text)
                codes = LETTER[np.frombuffer(ordinary.encode(), np.uint8)]
                held.append(codes[codes >= 0])
                size += len(held[-1])
                if size > 1 << 18:
                    add_ordinary(null, held)
                    held, size = [], 0
                for part in parts(text):
                    for s, e in part[0] + part[1]:
                        seen[row_of(text[s:e]), bin_of(randomness(text[s:e]))] += 1
        add_ordinary(null, held)
        for name, table in (("null", null), ("seen", seen)):
            at = np.argwhere(table)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at)), pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.array(table[at[:, 0], at[:, 1]])],
                    names=["what", "band", "bin", "n"],
                )

    rows = docs.select("text").mapInArrow(run, "what string, band int, bin int, n long").groupBy("what", "band", "bin").agg(F.sum("n").alias("n"))
    out = {"null": np.zeros((2 * BANDS, BINS), np.int64), "seen": np.zeros((2 * BANDS, BINS), np.int64)}
    for r in rows.collect():
        out[r["what"]][r["band"], r["bin"]] = r["n"]
    return out["null"], out["seen"]


def thresholds(null: np.ndarray, seen: np.ndarray, rate: float) -> np.ndarray:
    """Per band the lowest score bin that counts as random, at that false discovery rate; BINS for none.

    p(bin) is the share of ordinary strings at or above the bin, never below 1 / (1 + how many
    there are): a band with few ordinary strings can't discover much.
    """
    tail = (null[:, ::-1].cumsum(1)[:, ::-1] + 1) / (null.sum(1, keepdims=True) + 1)
    tests = seen.sum()
    order = np.sort(np.unique(tail[seen > 0])) if tests else []
    cut = 0.0
    for p in order:
        if p <= rate * seen[tail <= p].sum() / tests:
            cut = p
    # no band looks random below the level at which a truly random string is seldom rejected
    floor = bin_of(1e-4)
    out = np.full(len(null), BINS)
    for k in range(len(null)):
        ok = np.flatnonzero(tail[k] <= cut)
        if len(ok):
            out[k] = max(floor, ok[0])
    return out


def random_spans(text: str, plain: list[tuple[int, int, str]], cut: np.ndarray) -> list[tuple[int, int, str]]:
    out, taken = [], bytearray(len(text))
    for a, b, _ in plain:
        taken[a:b] = b"\1" * (b - a)
    for outer, inner in parts(text):
        found = []
        for tried in (outer, inner):
            new = [(s, e) for s, e in tried if taken.find(1, s, e) < 0 and bin_of(randomness(text[s:e])) >= cut[row_of(text[s:e])]]
            for s, e in new:
                taken[s:e] = b"\1" * (e - s)
            found += new
        for s, e in sorted(found):
            if out and out[-1][1] == s:
                s = out.pop()[0]
            out.append((s, e, "random"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) per row of docs (doc_id, text)."""
    cut = thresholds(*histograms(docs), rate)
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"]])
    for k in KINDS:
        schema.add(f"n_{k}", "long")
    schema.add("base_sha256", "string").add("spans", "string").add("n_random", "long")
    order = (*KINDS, "random")

    def run(batches):
        for b in batches:
            plain, more = [], []
            for t in b.column("text"):
                text = t.as_py() or ""
                plain.append(plain_spans(text))
                more.append(random_spans(text, plain[-1], cut))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    *(pa.array([sum(s[2] == k for s in p) for p in plain], pa.int64()) for k in KINDS),
                    pa.array([hashlib.sha256(joined(p).encode()).hexdigest() for p in plain], pa.string()),
                    pa.array([joined(sorted(p + m, key=lambda x: (x[0], order.index(x[2])))) for p, m in zip(plain, more, strict=True)], pa.string()),
                    pa.array([len(m) for m in more], pa.int64()),
                ],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)
