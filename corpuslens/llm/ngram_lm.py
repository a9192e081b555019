"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept in sorted hash arrays.

1. `vocabulary`: tasks count word hashes and deal sorted runs to shards by the hash's top bits;
   each shard merges its runs and writes one sorted array of hashes and one of counts.  A word's id
   is its rank.
2. `bigrams`: tasks count (id, id) codes and deal sorted runs to shards by the first id; each shard
   merges, writes the sorted codes with counts, and per first id the number of tokens and of types
   seen once, twice, more often.  It deals the number of its first ids per second id on; the second
   shards write the continuation counts.
3. `scores`: workers memory-map the arrays and look up whole batches by binary search.

Files are written in one piece under their final names, so a repeated task changes nothing.  Runs
are compressed sorted differences.  All counts are over all training rows.

Tokens: A-Z lower-cased, runs of [^\\x20\\x09-\\x0D], then one end per text.  Defined results: a
null or empty text is its end alone.  A null doc_id is a training row.  With no training token
every word is unknown; the model is then uniform over one unknown word.  Rows that repeat a doc_id
count and are scored each by its own text.  An empty table gives an empty result.  Other columns
are kept by scored(), but for those named like a new one.  Texts of any length are scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, WordHashes, words_of, write_array

END = b" end"  # no word has a space
RUN = 4_000_000


def packed(x: np.ndarray) -> bytes:
    """Sorted 64-bit values, or counts, by byte planes of their differences."""
    d = np.diff(x, prepend=np.uint64(0))
    return zlib.compress(d.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    d = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
    return np.cumsum(d, dtype=np.uint64)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, np.empty(0, np.int64)
    return np.unique(keys, return_counts=True)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts per distinct key."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    if not len(k):
        return k, c
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


RUN_SCHEMA = "shard int, keys binary, counts binary"


def runs_of(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row per shard; within a shard the keys are sorted."""
    order = np.lexsort((keys, shard))
    shard, keys, counts = shard[order], keys[order], counts[order]
    cuts = np.flatnonzero(np.diff(shard)) + 1
    parts = [(s[0], packed(k), zlib.compress(c.astype("<i8").tobytes(), 1)) for s, k, c in zip(*(np.split(x, cuts) for x in (shard, keys, counts)), strict=True) if len(s)]
    s, k, c = zip(*parts, strict=True) if parts else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=["shard", "keys", "counts"])


def read_runs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return merged(
        [unpacked(x.as_buffer()) for x in table.column("keys")],
        [np.frombuffer(zlib.decompress(x.as_buffer()), "<i8") for x in table.column("counts")],
    )


def mapped(path: str) -> np.ndarray:
    try:
        return np.load(path, mmap_mode="r")
    except ValueError:  # an empty array can't be mapped
        return np.load(path)


def vocabulary(docs: DataFrame, folder: str, shards: int) -> list[tuple[int, int]]:
    """Writes the shards of (hash, count); returns (size, tokens) of each."""
    bits = shards.bit_length() - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, end = WordHashes(), np.array([WordHashes()[END]], np.uint64)
        held, n = [], 0
        for b in batches:
            for text in b.column("text"):
                held += [hashes.array(words_of(text.as_py())), end]
                n += len(held[-2]) + 1
                if n > RUN:
                    keys, counts = counted(np.concatenate(held))
                    yield runs_of((keys >> np.uint64(64 - bits)).astype(np.int32), keys, counts)
                    held, n = [], 0
        if held:
            keys, counts = counted(np.concatenate(held))
            yield runs_of((keys >> np.uint64(64 - bits)).astype(np.int32), keys, counts)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys, counts = read_runs(table)
        write_array(f"{folder}/word-{shard}.npy", keys)
        write_array(f"{folder}/times-{shard}.npy", counts.astype(np.uint64))
        return pa.table({"shard": pa.array([shard], pa.int32()), "size": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    made = docs.select("text").mapInArrow(count, RUN_SCHEMA).groupBy("shard").applyInArrow(merge, "shard int, size long, tokens long")
    out = [(0, 0)] * shards
    for r in made.collect():
        out[r["shard"]] = (r["size"], r["tokens"])
    return out


class Vocabulary:
    """Word -> id, -1 for unknown ones; memory-mapped."""

    def __init__(self, folder: str, sizes: list[int], most: int = 300_000):
        self.folder, self.sizes = folder, sizes
        self.bits = len(sizes).bit_length() - 1
        self.base = np.cumsum([0, *sizes])
        self.hashes: dict[int, np.ndarray] = {}
        self.cache: dict[bytes, int] = {}
        self.most = most

    def __len__(self) -> int:
        return int(self.base[-1])

    def ids(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        if len(cache) > self.most:
            cache.clear()
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if new:
            hashes = WordHashes(len(new) + 1).array(new)
            shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
            found = np.full(len(new), -1, np.int64)
            for s in np.unique(shard):
                if not self.sizes[s]:
                    continue
                if s not in self.hashes:
                    self.hashes[s] = mapped(f"{self.folder}/word-{s}.npy")
                own = np.flatnonzero(shard == s)
                at = np.searchsorted(self.hashes[s], hashes[own])
                at[at == self.sizes[s]] = 0
                ok = self.hashes[s][at] == hashes[own]
                found[own[ok]] = self.base[s] + at[ok]
            cache.update(zip(new, found.tolist(), strict=True))
        return np.fromiter(map(cache.__getitem__, words), np.int64, len(words))

    def times(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.base, ids, "right") - 1
        for s in np.unique(shard[ids >= 0]):
            own = np.flatnonzero((shard == s) & (ids >= 0))
            out[own] = mapped(f"{self.folder}/times-{s}.npy")[ids[own] - self.base[s]]
        return out


def token_ids(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all tokens of the texts, one after the other, and how many each text has."""
    words, sizes = [], []
    for t in texts:
        own = words_of(t)
        words += own
        words.append(END)
        sizes.append(len(own) + 1)
    return vocabulary.ids(words), np.array(sizes)


def contexts(ids: np.ndarray, sizes: np.ndarray, begin: int) -> np.ndarray:
    """The id before each token; `begin` before a text's first."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = begin
    return out


def bigrams(docs: DataFrame, folder: str, sizes: list[int], scratch: Scratch) -> dict[str, list[int]]:
    """Writes codes, counts, context and continuation arrays; returns counts of counts 1 to 4 and of types."""
    shards, begin = len(sizes), sum(sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(folder, sizes)
        held, n = [], 0
        for b in batches:
            texts = b.column("text")
            for at in range(0, b.num_rows, 1000):
                ids, lengths = token_ids(texts.slice(at, 1000).to_pylist(), words)
                held.append(contexts(ids, lengths, begin).astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64))
                n += len(ids)
                if n > RUN:
                    keys, counts = counted(np.concatenate(held))
                    yield runs_of(((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int32), keys, counts)
                    held, n = [], 0
        if held:
            keys, counts = counted(np.concatenate(held))
            yield runs_of(((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int32), keys, counts)

    def of_counts(c: np.ndarray) -> bytes:
        return np.bincount(np.minimum(c, 5), minlength=6)[1:].astype("<i8").tobytes()

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        codes, counts = read_runs(table)
        write_array(f"{folder}/code-{shard}.npy", codes)
        write_array(f"{folder}/count-{shard}.npy", np.minimum(counts, 255).astype(np.uint8))
        many = np.flatnonzero(counts >= 255)
        write_array(f"{folder}/many-{shard}.npy", np.stack([many, counts[many]]).astype(np.uint64))
        local = ((codes >> np.uint64(32)) // np.uint64(shards)).astype(np.int64)
        n = begin // shards + 1
        context = [np.bincount(local, counts, n)] + [np.bincount(local[m], minlength=n) for m in (counts == 1, counts == 2, counts > 2)]
        write_array(f"{folder}/context-{shard}.npy", np.stack(context).astype(np.uint64))
        second, before = counted(codes & np.uint64(0xFFFFFFFF))
        out = runs_of((second % np.uint64(shards)).astype(np.int32), second, before)
        # the row of shard -1 carries this shard's counts of counts
        return pa.Table.from_batches([out, pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([of_counts(counts)], pa.binary()), pa.nulls(1, pa.binary())], names=out.schema.names)])

    def continuation(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        second, before = read_runs(table)
        dense = np.zeros(begin // shards + 1, np.uint64)
        dense[(second // np.uint64(shards)).astype(np.int64)] = before
        write_array(f"{folder}/before-{shard}.npy", dense)
        return pa.table({"n": pa.array([of_counts(before)], pa.binary())})

    merged_rows = docs.select("text").mapInArrow(count, RUN_SCHEMA).groupBy("shard").applyInArrow(merge, RUN_SCHEMA)
    merged_rows = scratch.save(merged_rows, "continuations")
    total = lambda blobs: np.sum([np.frombuffer(x, "<i8") for x in blobs] or [np.zeros(5, np.int64)], axis=0).tolist()
    of_codes = total(r["keys"] for r in merged_rows.where("shard = -1").select("keys").collect())
    before = merged_rows.where("shard >= 0").groupBy("shard").applyInArrow(continuation, "n binary")
    return {"codes": of_codes, "before": total(r["n"] for r in before.collect())}


def discounts(n: list[int]) -> np.ndarray:
    """D1, D2, D3+ of counts of counts, kept within 0 and the count; 0.5, 1, 1.5 where they can't be estimated."""
    n1, n2, n3, n4 = n[:4]
    if not n1 or not n2 or not n3:
        return np.array([0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0.05] * 3, [1, 2, 3])


class Model:
    """Probabilities from the memory-mapped arrays."""

    def __init__(self, folder: str, sizes: list[int], tokens: int, counts: dict[str, list[int]]):
        self.folder, self.shards, self.tokens, self.begin = folder, len(sizes), tokens, sum(sizes)
        self.words = Vocabulary(folder, sizes)
        self.d2, self.d1 = discounts(counts["codes"]), discounts(counts["before"])
        types = counts["before"]
        self.types = sum(counts["codes"])  # of bigrams
        n1, n2, n3 = types[0], types[1], sum(types[2:])
        self.rest = float(self.d1 @ [n1, n2, n3]) / self.types if self.types else 1.0
        self.files: dict[tuple[str, int], np.ndarray] = {}

    def file(self, name: str, shard: int) -> np.ndarray:
        if (name, shard) not in self.files:
            import os

            path = f"{self.folder}/{name}-{shard}.npy"
            self.files[name, shard] = mapped(path) if os.path.exists(path) else np.empty(0, np.uint64)
        return self.files[name, shard]

    def by_shard(self, keys: np.ndarray):
        shard = keys % self.shards
        order = np.argsort(shard, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(own):
                yield int(shard[own[0]]), own

    def discount(self, counts: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.concatenate([[0.0], d])[np.minimum(counts, 3).astype(np.int64)]

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        """Continuation probability, interpolated with the uniform one over the words and one unknown."""
        before = np.zeros(len(ids), np.int64)
        known = np.flatnonzero(ids >= 0)
        for s, own in self.by_shard(ids[known]):
            table = self.file("before", s)
            if len(table):
                before[known[own]] = table[ids[known][own] // self.shards]
        p = (before - self.discount(before, self.d1)) / max(self.types, 1)
        return p + self.rest / (self.begin + 1)

    def bigram(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """P(second | first) per distinct pair."""
        low = self.unigram(second)
        out = low.copy()
        known = np.flatnonzero(first >= 0)
        for s, own in self.by_shard(first[known]):
            own = known[own]
            codes, context = self.file("code", s), self.file("context", s)
            if not len(codes):
                continue
            total, n1, n2, n3 = (context[i][first[own] // self.shards].astype(np.float64) for i in range(4))
            key = first[own].astype(np.uint64) << np.uint64(32) | np.maximum(second[own], 0).astype(np.uint64)
            at = np.searchsorted(codes, key)
            at[at == len(codes)] = 0
            hit = (codes[at] == key) & (second[own] >= 0)
            c = np.where(hit, self.file("count", s)[at], 0).astype(np.int64)
            many, counts = self.file("many", s)
            big = np.flatnonzero(c == 255)
            if len(big):
                c[big] = counts[np.searchsorted(many, at[big])]
            seen = total > 0
            gamma = (self.d2[0] * n1 + self.d2[1] * n2 + self.d2[2] * n3) / np.maximum(total, 1)
            p = (c - self.discount(c, self.d2)) / np.maximum(total, 1) + gamma * low[own]
            out[own] = np.where(seen, p, low[own])
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, base score, score (both log10)."""
        ids, sizes = token_ids(texts, self.words)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        distinct, back = np.unique(ids, return_inverse=True)
        times = self.words.times(distinct)
        base = np.log10((times + 0.1) / (self.tokens + 0.1 * (self.begin + 1)))[back]
        first = contexts(ids, sizes, self.begin)
        code, back2 = np.unique((first + 1).astype(np.uint64) << np.uint64(32) | (ids + 1).astype(np.uint64), return_inverse=True)
        p = self.bigram((code >> np.uint64(32)).astype(np.int64) - 1, (code & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1)
        full = np.log10(p)[back2]
        return sizes, np.add.reduceat((times > 0).astype(np.int64)[back], starts), np.add.reduceat(base, starts), np.add.reduceat(full, starts)


def train(docs: DataFrame, shards: int | None = None) -> dict:
    """Counts over all rows of docs (text) and writes the arrays; returns what Model needs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-lm")
    folder = scratch.local("model")
    wanted = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 1 << max(4, (wanted - 1).bit_length())
    made = vocabulary(docs, folder, shards)
    sizes = [n for n, _ in made]
    if sum(sizes) >= 2**32 - 2:
        raise ValueError("more words than a 32-bit id has room for")
    return {"folder": folder, "sizes": sizes, "tokens": sum(t for _, t in made), "counts": bigrams(docs, folder, sizes, scratch)}


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """docs' columns but text, with n_tokens, n_known, train_tokens, base_score, score and perplexity per token."""
    new = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double", "perplexity": "double"}
    kept = [f for f in docs.schema.fields if f.name != "text" and f.name not in new]
    schema = T.StructType(list(kept))
    for name, kind in new.items():
        schema.add(name, kind)

    def run(batches):
        m = Model(**model)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n, known, base, full = m.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), pa.array(n), pa.array(known), pa.array(np.full(len(n), m.tokens)), pa.array(base), pa.array(full), pa.array(10.0 ** (-full / n))],
                    names=schema.names,
                )

    return docs.mapInArrow(run, schema)


def document_scores(docs: DataFrame, modulus: int = 10, out: int = 0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity); learns from the rows not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == out, F.lit(False))
    model = train(docs.where(~held).select("text"))
    return scored(docs.select("doc_id", held.alias("held_out"), "text"), model)
