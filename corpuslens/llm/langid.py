"""Language identification, word first: known words count by per-language log frequency; a word
that was never seen falls back to its character n-grams, from the longest order down, and takes
the first order of which any n-gram is known.

The model is fitted on a sample of labelled rows: those with the smallest hashes of doc_id, as
long as there are at most `max_docs` of them with at most `max_chars` characters; so its size is
bounded whatever the corpus.  Every word and n-gram of the sample counts.  Prediction reads the
text only.

Defined results: null text or text without a letter -> `und`, score 0.  Nothing to learn from ->
`und` for all.  Ties go to the language that sorts first.  Very long texts count as whole texts.
Rows that repeat a doc_id are in the sample together or not at all, each is predicted by its own
text; a null doc_id is never sampled.  An empty table gives an empty result.  Other columns stay
as they are; those named like a new one are replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lean, parts

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)


def letters(text: str | None) -> list[str]:
    """Lower-cased words that have a letter."""
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(c.isalpha() for c in w)] if text else []


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(max(0, len(padded) - n + 1))]


class LanguageModel:
    """languages, and the rows of words and of n-grams in a matrix of log probabilities, one column per language."""

    def __init__(self, languages: list[str], words: dict[str, int], ngrams: dict[str, int], rows: np.ndarray):
        self.languages, self.words, self.ngrams, self.rows = languages, words, ngrams, rows

    @classmethod
    def from_counts(cls, langs: list[str], is_word: list[bool], entries: list[str], counts: list[int]) -> LanguageModel:
        """Columns of equal length: a language, whether the entry is a word, the entry, its count."""
        languages = sorted(set(langs))
        column = {x: i for i, x in enumerate(languages)}
        at: dict[bool, dict[str, int]] = {True: {}, False: {}}
        kinds: list[int] = []  # per row: 0 for words, else the n-gram's order
        place = np.empty(len(counts), np.int64)
        for i, (word, entry) in enumerate(zip(is_word, entries, strict=True)):
            row = at[word].get(entry)
            if row is None:
                row = at[word][entry] = len(kinds)
                kinds.append(0 if word else len(entry))
            place[i] = row
        rows = np.zeros((len(kinds), len(languages)))
        np.add.at(rows, (place, [column[x] for x in langs]), counts)
        kind = np.array(kinds, np.int64)
        for k in np.unique(kind):
            own = kind == k
            rows[own] = np.log((rows[own] + 0.1) / (rows[own].sum(axis=0) + 0.1 * own.sum()))
        return cls(languages, at[True], at[False], rows - rows.mean(axis=1, keepdims=True) if languages else rows)

    def word(self, word: str) -> np.ndarray:
        at = self.words.get(word)
        if at is not None:
            return self.rows[at]
        for n in ORDERS:
            known = [g for g in map(self.ngrams.get, grams(word, n)) if g is not None]
            if known:
                return self.rows[known].mean(axis=0)
        return np.zeros(len(self.languages))

    def scorer(self, most: int = 200_000):
        """text -> (language, score); remembers the rows of recent words."""
        at: dict[str, int] = {}
        rows = np.zeros((1024, max(1, len(self.languages))))

        def score(text: str | None) -> tuple[str, float]:
            nonlocal rows
            words = letters(text)
            if not words or not self.languages:
                return "und", 0.0
            if len(at) > most:
                at.clear()
            ids = []
            for w in words:
                i = at.get(w)
                if i is None:
                    i = at[w] = len(at)
                    if i >= len(rows):
                        rows = np.concatenate([rows, np.zeros_like(rows)])
                    rows[i] = self.word(w)
                ids.append(i)
            total = rows[ids].sum(axis=0) / np.sqrt(len(ids))
            best = int(total.argmax())
            return self.languages[best], float(1 / np.exp(total - total[best]).sum())

        return score


def sampled(docs: DataFrame, max_docs: int, max_chars: int) -> DataFrame:
    """(text, lang) of the labelled rows with the smallest hashes of doc_id, within the bounds; no task gathers them.

    First the number of labelled rows gives a share of the hashes that holds about twice the sample;
    of those, the hashes that fit are picked one by one.
    """
    labelled = docs.where("doc_id is not null and lang is not null").select(F.xxhash64("doc_id").alias("h"), "text", "lang")
    n = labelled.count()
    below = -(2**63) + int(2**64 * min(1.0, 2 * max_docs / max(n, 1))) - 1
    near = labelled.where(F.col("h") <= below)
    sizes = near.groupBy("h").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    docs_left, chars_left, last, passed = max_docs, max_chars, -(2**63), []
    for r in sorted(sizes.collect()):  # about 2 * max_docs rows
        if r["n"] <= docs_left and r["chars"] <= chars_left:
            docs_left, chars_left, last = docs_left - r["n"], chars_left - r["chars"], r["h"]
        else:
            passed.append(r["h"])
    near = near.where(F.col("h") <= last)
    passed = [h for h in passed if h < last]
    if passed:
        passed = docs.sparkSession.createDataFrame([(h,) for h in passed], "h long")
        near = near.join(F.broadcast(passed), "h", "left_anti")
    return near.where("text is not null").select("text", "lang")


def fit(docs: DataFrame, max_docs: int = 4000, max_chars: int = 50_000_000) -> LanguageModel:
    """docs: (doc_id, text, lang), training rows only; see the module's text for the bounds."""

    def count(batches):
        found: Counter = Counter()
        for b in parts(batches):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                for w, k in Counter(letters(text)).items():
                    found[lang, True, w] += k
                    for n in ORDERS:
                        for g in grams(w, n):
                            found[lang, False, g] += k
        if found:
            lang, is_word, entry = zip(*found, strict=True)
            n = list(found.values())
            for i in range(0, len(lang), 50_000):
                j = i + 50_000
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang[i:j]), pa.array(is_word[i:j]), pa.array(entry[i:j]), pa.array(n[i:j])], names=["lang", "is_word", "entry", "n"]
                )

    counts = sampled(docs, max_docs, max_chars).mapInArrow(lean(count), "lang string, is_word boolean, entry string, n long")
    counts = counts.groupBy("lang", "is_word", "entry").agg(F.sum("n").alias("n"))
    return LanguageModel.from_counts(*(c.to_pylist() for c in counts.toArrow().columns))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns; columns of these names are replaced."""
    docs = docs.drop(lang_pred, score)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = shared.value.scorer()
        for b in parts(batches, text):
            found = [of(t.as_py()) for t in b.column(text)]
            langs, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, lang_pred, score])

    return docs.mapInArrow(lean(run), schema)


def language_predictions(docs: DataFrame, modulus: int = 4, out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from documents whose crc32 remainder is not `out`."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == out, F.lit(False))
    model = fit(docs.where(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).drop("text")
