"""N-gram Jaccard self-join by multiple-global-order prefix filtering.

Every document is the set of its distinct word shingles.  Two documents link when
100 * intersection >= percent * union.  Two sets that link share a token among the first
n - ceil(percent/100 * n) + 1 tokens of either under *every* global token order.  So each order
k gives a filter, and only pairs that pass the filters of all orders reach verification.

1. `scan`: each document's shingle hashes give its class (documents with equal sets are one
   class, so copies are never paired) and a count sketch of fixed width, which puts every token
   in a band: band 0 for tokens as frequent as any, higher bands for tokens that stand out.
2. The orders begin with the tokens of band 0 in a fixed share of hash space, the region: rare
   ones first, by the exact number of classes that hold them, ties by hash_k.  The other tokens
   follow by (band, hash_k).  So what many documents share seldom reaches a prefix.
3. `shared_tokens` counts the region: one shuffle by token, in which tokens of one class alone
   end.  `prefixes` gathers what is left by class: a class knows how many tokens were its own, so
   its prefix under each order, and posts the shared ones among them.
4. `lists` streams the postings of each order by token.  Members of a list are paired with one
   pivot of about their size only, the one with the fewest tokens that it alone has; so there are
   never more pairs than postings.  Pairs found under
   all orders are verified, and links give components.
5. Lists that still hold several components are the rest: their members, unit by unit (what lists
   connect if it is small, else one list), are dealt to blocks, and for each pair of blocks that
   may hold a link across components the common tokens of the prefixes are counted exactly by a
   matrix product, per order.  A pair stays if in every order count + longest suffix reaches the
   overlap needed: the filters of all orders are intersected here, before any pair is emitted.
   Pairs inside one component are skipped.  The others are verified like the first.

Defined results: null text, no words -> empty set, linked with nothing, component is the
document itself.  Fewer words than the width -> the whole sequence is the one shingle.  A null
doc_id is never linked and keeps a null component.  Rows that repeat a doc_id are one document.
An empty table gives an empty result; columns but doc_id and text are not read, whatever their
names.  A text may be of any length: its set is held by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch, WordHashes, heavy_above, join_to_one, lean, mixed, words_of

SKETCH_BITS, SKETCH_PARTS, BANDS = 20, 16, 15
SIZE_BITS = 31  # of a class's second number; the rest are bits of its hash
HELD_PAIRS = 500_000
TO_INT = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    a = hashes.array(words)
    n = max(1, len(a) - width + 1)
    out = np.full(n, min(len(a), width), np.uint64)
    for i in range(min(len(a), width)):
        out = mixed(out * TO_INT ^ a[i : i + n], i)
    return np.unique(out)


def class_of(tokens: np.ndarray) -> tuple[int, int]:
    """(cls, m): 96 bits of a hash of the set, and its size in the low SIZE_BITS bits of m."""
    h = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63), (h >> 96) << SIZE_BITS | len(tokens)


def size_of(m: str = "m"):
    return F.col(m).bitwiseAND(F.lit((1 << SIZE_BITS) - 1))


def prefix_size(n, percent: int):
    """How many first tokens of n must be looked at; works on arrays too."""
    return n - -(-percent * n // 100) + 1


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def scan(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, cls, m) of the documents, and rows (part, salt, counts) of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, salt = WordHashes(), np.zeros(1 << SKETCH_BITS, np.int64), 0
        none = lambda n: (pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()))
        names = ["doc_id", "cls", "m", "part", "salt", "counts"]
        for b in batches:
            cls, sizes, gathered = [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py(), width, hashes)
                salt, m = class_of(s)
                cls.append(salt)
                sizes.append(m)
                gathered.append(s >> np.uint64(64 - SKETCH_BITS))
                if len(gathered) >= 512:
                    np.add.at(counts, *_tally(gathered))
                    gathered = []
            if gathered:
                np.add.at(counts, *_tally(gathered))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(cls, pa.int64()), pa.array(sizes, pa.int64()), *none(len(cls))],
                names=names,
            )
        if counts.any():
            parts = np.split(counts, SKETCH_PARTS)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SKETCH_PARTS, pa.int64())] * 3
                + [
                    pa.array(range(SKETCH_PARTS), pa.int32()),
                    pa.array([salt % 64] * SKETCH_PARTS, pa.int32()),
                    pa.array([zlib.compress(p.astype("<i8").tobytes(), 1) for p in parts], pa.binary()),
                ],
                names=names,
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, cls long, m long, part int, salt int, counts binary")


def _tally(gathered: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(gathered), return_counts=True)


def sketch_bands(scanned: DataFrame) -> np.ndarray:
    """The band of each sketch cell: 2^SKETCH_BITS bytes, whatever the input's size."""

    def add(key: tuple, pdf):
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int64)
        for blob in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(blob), "<i8")
        pdf = pdf.head(1).copy()
        pdf["counts"] = [zlib.compress(total.astype("<i8").tobytes(), 1)]
        return pdf

    rows = scanned.where("counts is not null").select("part", "salt", "counts")
    rows = rows.groupBy("part", "salt").applyInPandas(add, rows.schema)
    rows = rows.groupBy("part").applyInPandas(add, rows.schema)
    counts = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.int64)
    for r in rows.collect():
        counts[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    counts = counts.ravel()
    mean = counts.mean()
    usual = 6 * np.sqrt(mean) + 8
    excess = (counts - mean) / usual
    return np.where(excess > 1, 1 + np.clip(np.log2(np.maximum(excess, 1)), 0, BANDS - 1), 0).astype(np.uint8)


POSTING = ("key", "salt", "cls", "m", "a")


def postings(docs: DataFrame, bands, width: int, percent: int, orders: int, share: float) -> DataFrame:
    """(key, salt, cls, m, a): a token of a class, which has a tokens in the region.

    All tokens of the region are posted, with zeros in the low three bits of the key.  A class whose
    prefix is longer than that posts the rest of its prefix under each order k, with 4 + k there.
    Lists of tokens that stand out are dealt to parts (salt 1 and on), the more the longer they are.
    Copies that one task sees give one posting.
    """
    region = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, band_of = WordHashes(), bands.value
        seen: set[tuple[int, int]] = set()

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=list(POSTING))

        for b in batches:
            rows, held = [], 0
            for text in b.column("text"):
                s = shingles(text.as_py(), width, hashes)
                c, m = class_of(s)
                if not len(s) or (c, m) in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add((c, m))
                band = band_of[s >> np.uint64(64 - SKETCH_BITS)]
                inside = (band == 0) & (mixed(s, 7) <= region)
                a, p = int(inside.sum()), prefix_size(len(s), percent)
                posted = [(mixed(s[inside], 31) & ~np.uint64(7), np.zeros(a, np.int32))]
                if a < p:
                    rest, of = s[~inside], band[~inside].astype(np.uint64)
                    for k in range(orders):
                        first = np.argpartition((of << np.uint64(59)) | (mixed(rest, k + 11) >> np.uint64(5)), p - a - 1)[: p - a]
                        key = (mixed(rest[first], 32 + k) & ~np.uint64(7)) | np.uint64(4 + k)
                        part = mixed(key ^ np.uint64(c & 0xFFFFFFFFFFFFFFFF), 3) & ((np.uint64(1) << of[first]) - np.uint64(1))
                        posted.append((key, np.where(of[first] > 0, 1 + part, 0).astype(np.int32)))
                for key, salt in posted:
                    rows.append((key.view(np.int64), salt, *(np.full(len(key), x, np.int64) for x in (c, m)), np.full(len(key), a, np.int32)))
                    held += len(key)
                if held > 100_000:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    return docs.select("text").mapInArrow(lean(run), "key long, salt int, cls long, m long, a int")


def by_list(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[np.ndarray]:
    """Whole lists, several at a time: sorted rows as arrays, one row per column, without repeats.

    Lists are equal in their first two columns.  A list is held whole: tokens that stand out are
    dealt to parts, so it is no longer than what the sketch takes for usual.
    """
    held: list[np.ndarray] = []
    for rb in batches:
        x = np.stack([rb.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(columns)])
        if not x.shape[1]:
            continue
        # the last list of this batch may go on in the next
        tail = int(np.flatnonzero((x[0] == x[0, -1]) & (x[1] == x[1, -1]))[0])
        if tail or (held and (held[0][0, 0] != x[0, 0] or held[0][1, 0] != x[1, 0])):
            yield without_repeats(np.concatenate([*held, x[:, :tail]], axis=1))
            held = []
        held.append(x[:, tail:])
    if held:
        yield without_repeats(np.concatenate(held, axis=1))


def without_repeats(x: np.ndarray) -> np.ndarray:
    keep = np.ones(x.shape[1], bool)
    keep[1:] = (x[:, 1:] != x[:, :-1]).any(axis=0)
    return x[:, keep]


def list_numbers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, sizes): the number of each row's list, and the size of each list."""
    new = np.ones(x.shape[1], bool)
    new[1:] = (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])
    which = np.cumsum(new) - 1
    return which, np.bincount(which)


def shared_tokens(posted: DataFrame) -> DataFrame:
    """(cls, m, a, key, salt, df): the postings of tokens that several classes may share; df counts the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in by_list(batches, 5):
            which, sizes = list_numbers(x)
            df = sizes[which]
            keep = (df > 1) | (x[1] > 0)
            key, salt, cls, m, a = x[:, keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls), pa.array(m), pa.array(a.astype(np.int32)), pa.array(key), pa.array(salt.astype(np.int32)), pa.array(df[keep].astype(np.int32))],
                names=["cls", "m", "a", "key", "salt", "df"],
            )

    ordered = posted.repartition("key", "salt").sortWithinPartitions("key", "salt", "cls", "m")
    return ordered.mapInArrow(lean(run), "cls long, m long, a int, key long, salt int, df int")


def prefixes(shared: DataFrame, reps: DataFrame, percent: int, orders: int) -> DataFrame:
    """(key, salt, about, own, id, n): the shared tokens in the prefixes of each order k, which the low two bits of the key tell.

    id is the class's representative, about its size class, own the number of region tokens that no
    other class has: few for the copy that is nearest to what all copies share.
    """
    sets = shared.groupBy("cls", "m").agg(F.max("a").alias("a"), F.collect_list(F.struct("key", "salt", "df")).alias("tokens"))
    sets = sets.join(reps.select("cls", "m", F.col("rep").alias("id")), ["cls", "m"]).select("id", size_of().alias("n"), "a", "tokens")
    step = -2 * np.log(percent / 100) if percent < 100 else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                yield posted(b.slice(at, 500))

    def posted(b: pa.RecordBatch) -> pa.RecordBatch:
        lengths = pc.list_value_length(b.column("tokens")).to_numpy(zero_copy_only=False)
        key, salt, df = (x.to_numpy(zero_copy_only=False) for x in b.column("tokens").flatten().flatten())
        n, a, ids = (b.column(c).to_numpy() for c in ("n", "a", "id"))
        row = np.repeat(np.arange(b.num_rows), lengths)
        tail = key & 4 > 0
        out = [(key[tail], salt[tail], row[tail])]
        # of the tokens in the region, those of one class alone come first
        own = a - np.bincount(row[~tail], minlength=b.num_rows)
        room = np.where(a < prefix_size(n, percent), a, prefix_size(n, percent)) - own
        key, df, row = key[~tail], df[~tail], row[~tail]
        for k in range(orders):
            order = np.lexsort((mixed(key.view(np.uint64), 50 + k), df, row))
            starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))[:-1]])
            kept = order[np.arange(len(row)) - starts[row[order]] < room[row[order]]]
            out.append((key[kept] | k, np.zeros(len(kept), np.int32), row[kept]))
        key, salt, row = (np.concatenate(x) for x in zip(*out, strict=True))
        about = np.floor(np.log(n) / step).astype(np.int32)
        columns = (key, salt, about[row], own.astype(np.int32)[row], ids[row], n[row])
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "salt", "about", "own", "id", "n"])

    return sets.mapInArrow(lean(run), "key long, salt int, about int, own int, id long, n long")


def lists(posted: DataFrame, percent: int) -> DataFrame:
    """Rows (key, salt, about, own, id, n) are members of lists; rows (k, u, v) pair each member with the pivot of its list and size class,
    and the pivot of one size class with that of the next.
    """
    names = ["key", "salt", "about", "own", "id", "n", "k", "u", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []

        def distinct(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal pairs
            if sum(x.shape[1] for x in pairs) < least:
                return
            k, u, v = np.unique(np.concatenate(pairs, axis=1), axis=1)
            pairs, none = [], pa.nulls(len(k), pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 6 + [pa.array(k.astype(np.int32)), pa.array(u), pa.array(v)], names=names)

        for x in by_list(batches, 6):
            which, sizes = list_numbers(x)
            x = x[:, (sizes[which] > 1) | (x[1] > 0)]
            if not x.shape[1]:
                continue
            key, _, about, _, ids, n = x
            none = pa.nulls(len(key), pa.int64())
            yield pa.RecordBatch.from_arrays([*map(pa.array, x), pa.nulls(len(key), pa.int32()), none, none], names=names)
            which, _ = list_numbers(x)
            first = np.ones(len(key), bool)
            first[1:] = (which[1:] != which[:-1]) | (about[1:] != about[:-1])
            heads = np.flatnonzero(first)
            head = heads[np.cumsum(first) - 1]
            head[heads[1:]] = np.where(which[heads[1:]] == which[heads[:-1]], heads[:-1], heads[1:])
            ok = (ids != ids[head]) & (100 * np.minimum(n, n[head]) >= percent * np.maximum(n, n[head]))
            p, q = ids[ok], ids[head][ok]
            pairs.append(np.stack([key[ok] & 3, np.minimum(p, q), np.maximum(p, q)]))
            yield from distinct(HELD_PAIRS)
        if pairs:
            yield from distinct(1)

    ordered = posted.repartition("key", "salt").sortWithinPartitions("key", "salt", "about", "own", "id")
    return ordered.mapInArrow(lean(run), "key long, salt long, about long, own long, id long, n long, k int, u long, v long")


def pivot_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(k, u, v): each member of a list that is dealt to parts with the pivot of all parts."""
    hot = members.where("salt > 0")
    pivots = hot.groupBy("key", "about").agg(F.min(F.struct("own", "id", "n")).alias("p"), F.max("salt").alias("parts"))
    pivots = pivots.select("key", "about", "p", F.explode(F.sequence(F.lit(1).cast("long"), "parts")).alias("salt"))
    near = 100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")
    pairs = hot.join(pivots, ["key", "salt", "about"]).where((F.col("id") != F.col("p.id")) & near)
    return pairs.select(F.col("key").bitwiseAND(3).cast("int").alias("k"), F.least("id", "p.id").alias("u"), F.greatest("id", "p.id").alias("v")).distinct()


def bloom_of(ids: DataFrame, bits: int = 24) -> np.ndarray:
    """A bitmap of 2^bits bits over a column of ids, made and merged on the executors."""

    def run(batches):
        words = np.zeros(1 << (bits - 6), np.uint64)
        for b in batches:
            for at in _bloom_at(b.column(0).to_numpy(), bits):
                np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], names=["at", "word"])

    out = np.zeros(1 << (bits - 6), np.int64)
    for r in ids.mapInArrow(lean(run), "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toLocalIterator():
        out[r["at"]] = r["word"]
    return out.view(np.uint64)


def _bloom_at(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mixed(ids.astype(np.int64).view(np.uint64), seed) >> np.uint64(64 - bits) for seed in (3, 4)]


def sets_of(docs: DataFrame, bloom, width: int, bits: int = 24) -> DataFrame:
    """(id, tokens) of the documents whose id may be in the filter; the join that follows is exact."""

    def run(batches):
        hashes, words = WordHashes(), bloom.value
        for b in batches:
            b = b.filter(pc.is_valid(b.column("doc_id")))
            ids = b.column("doc_id").cast(pa.int64()).to_numpy()
            ok = np.ones(len(ids), bool)
            for at in _bloom_at(ids, bits):
                ok &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            for at in np.array_split(np.flatnonzero(ok), max(1, ok.sum() // 500)):
                sets = [shingles(b.column("text")[int(i)].as_py(), width, hashes).tobytes() for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(sets, pa.binary())], names=["id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "id long, tokens binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs (u, v) whose sets really link."""

    def run(batches):
        for b in batches:
            us, vs = [], []
            for u, v, x, y in zip(*(b.column(c) for c in ("u", "v", "x", "y")), strict=True):
                x, y = (np.frombuffer(t.as_buffer(), np.uint64) for t in (x, y))
                both = overlap(x, y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    us.append(u.as_py())
                    vs.append(v.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    left = sets.select(F.col("id").alias("u"), F.col("tokens").alias("x"))
    right = sets.select(F.col("id").alias("v"), F.col("tokens").alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(lean(run), "u long, v long")


def across(tagged: DataFrame, percent: int, orders: int) -> DataFrame:
    """(u, v) of the pairs of different components that one pair of blocks of a unit leaves.

    tagged: (by_key, unit, about, i, kind, j, id, n, label, keys), where keys are all shared tokens
    of the member's prefixes, so that they decide the filters of all orders.  Where units are
    lists, a pair is emitted by its smallest common key only.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, one = np.unique(table.column("id").to_numpy(), return_index=True)
        n, labels = table.column("n").to_numpy()[one], table.column("label").to_numpy()[one]
        lists = [np.sort(table.column("keys")[int(i)].values.to_numpy()) for i in one]
        flat = np.concatenate(lists)
        values, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        # what one member alone has is common to no pair
        shared = times[at] > 1
        at, owner = at[shared], owner[shared]
        kind = np.where(times > 1, values & 3, -1)
        small, large = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
        need = -(-percent * (n[:, None] + n[None, :]) // (100 + percent))
        least = np.maximum(1, need - (-(-percent * large // 100) - 1))
        left = (labels[:, None] != labels[None, :]) & (100 * small >= percent * large)
        for k in range(orders):
            own = np.flatnonzero(kind == k)
            column = np.full(len(values), -1)
            column[own] = np.arange(len(own))
            column = column[at]
            both = np.zeros(left.shape, np.float32)
            for lo in range(0, len(own), 4096):
                hit = (column >= lo) & (column < lo + 4096)
                strip = np.zeros((len(lists), min(4096, len(own) - lo)), np.float32)
                strip[owner[hit], column[hit] - lo] = 1
                both += strip @ strip.T
            left &= both >= least
        by_key, here, us, vs = key[0].as_py(), key[1].as_py(), [], []
        for a, b in zip(*np.nonzero(np.triu(left)), strict=True):
            x, y = lists[a], lists[b]
            if not by_key or min(v for v in np.intersect1d(x, y, assume_unique=True) if v & 3 == 0) == here:
                us.append(int(ids[a]))
                vs.append(int(ids[b]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return tagged.groupBy("by_key", "unit", "about", "i", "kind", "j").applyInArrow(run, "u long, v long")


def rest_pairs(members: DataFrame, labels: DataFrame, scratch: Scratch, percent: int, orders: int, block: int) -> DataFrame | None:
    """(u, v): candidate pairs across the components that lists still join, or None.

    members: (key, salt, id, n).  Lists that are dealt to parts stay so in the joins.
    """
    # a pair that links is in one size class or in two neighbouring ones: each member is in its own and the next
    about = F.floor(F.log("n") / (-F.log(F.lit(min(percent, 99) / 100)))).cast("int")
    own = members.where("key & 3 = 0").join(labels.select(F.col("node").alias("id"), "label"), "id", "left")
    own = own.select("key", "salt", F.explode(F.array(about, about + 1)).alias("about"), "id", "n", F.coalesce("label", "id").alias("label"))
    own = scratch.save(own, "own")
    mixed_lists = own.groupBy("key", "about").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.min("id").alias("head"), F.max("salt").alias("parts"))
    mixed_lists = mixed_lists.where("l <> m").select("key", "about", "head", F.explode(F.sequence(F.lit(0), "parts")).alias("salt"))
    still = scratch.save(own.join(mixed_lists, ["key", "salt", "about"]).drop("salt"), "still")
    if still.isEmpty():
        return None
    # members that lists connect are one unit, whose pairs are looked at once, if those are fewer than the pairs of its lists; else each list is one
    units = connected_components(still.select(F.col("id").alias("u"), F.col("head").alias("v")).distinct(), scratch, "units")
    units = units.withColumnsRenamed({"node": "id", "label": "unit"})
    heads = still.groupBy("key", "about", "head").count().groupBy("head").agg(F.sum(F.col("count") * F.col("count")).alias("squares"))
    squares = heads.join(units, F.col("head") == F.col("id")).groupBy("unit").agg(F.sum("squares").alias("squares"))
    few = units.groupBy("unit").agg(F.count("*").alias("size")).join(squares, "unit")
    few = few.where((F.col("size") <= 2 * block) | (F.col("size") * F.col("size") <= F.col("squares"))).select("unit")
    units = units.join(few, "unit").select("id", "unit")
    still = still.join(units, "id", "left").select(
        F.col("unit").isNull().alias("by_key"), F.coalesce("unit", "key").alias("unit"), F.when(F.col("unit").isNull(), F.col("about")).otherwise(0).alias("about"), "id", "n", "label"
    )
    still = scratch.save(still.distinct(), "open")
    unit = ["by_key", "unit", "about"]
    per = still.groupBy(*unit, "label").count()
    lists = per.groupBy(*unit).agg(F.max_by("label", F.struct("count", F.negative("label"))).alias("main"), F.max("count").alias("many"), F.sum("count").alias("all"))
    still = still.join(lists.where("all > many"), unit).withColumns(
        {
            "minors": F.ceil((F.col("all") - F.col("many")) / block).cast("int"),
            "majors": F.ceil(F.col("many") / block).cast("int"),
            "minor": F.col("label") != F.col("main"),
        }
    )
    still = still.withColumn("mine", F.pmod(F.xxhash64("id"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int"))
    blocks = F.expr(
        """if(minor,
              concat(transform(sequence(0, minors - 1), x -> struct(least(x, mine) as i, 0 as kind, greatest(x, mine) as j)),
                     transform(sequence(0, majors - 1), x -> struct(mine as i, 1 as kind, x as j))),
              transform(sequence(0, minors - 1), x -> struct(x as i, 1 as kind, mine as j)))"""
    )
    keys = members.join(still.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.collect_set("key").alias("keys"))
    tagged = still.join(keys, "id").select(*unit, F.inline(blocks), "id", "n", "label", "keys")
    return across(tagged, percent, orders).distinct()


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, orders: int = 2, share: float = 0.3, block: int = 256) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies) per row of docs (doc_id, text): see the module's text.

    n_copies is the number of rows with an equal set.  Other columns of docs are not read.
    """
    if not 1 <= orders <= 4:
        raise ValueError("one to four orders")
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    scanned = scratch.save(scan(docs, width), "scan")
    bands = spark.sparkContext.broadcast(sketch_bands(scanned))
    rows = scanned.where("counts is null").select("doc_id", "cls", "m", size_of().alias("n"))
    sized = rows.where("n > 0 and doc_id is not null")
    reps = sized.groupBy("cls", "m").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
    posted = postings(docs.where("doc_id is not null"), bands, width, percent, orders, share)
    shared = scratch.save(shared_tokens(posted), "shared")
    found = scratch.save(lists(prefixes(shared, reps, percent, orders), percent), "found")
    scratch.drop("shared")
    members = found.where("k is null").select("key", "salt", "about", "own", "id", "n")
    pairs = found.where("k is not null").select("k", "u", "v").unionByName(pivot_pairs(members, percent)).groupBy("u", "v").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("under"))
    pairs = scratch.save(pairs.where(F.col("under") == (1 << orders) - 1).select("u", "v"), "pairs")

    def links_of(pairs: DataFrame) -> DataFrame:
        bloom = spark.sparkContext.broadcast(bloom_of(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()))
        return verified(pairs, sets_of(docs, bloom, width), percent).distinct()

    links = scratch.save(links_of(pairs), "links")
    labels = connected_components(links, scratch, "first")
    rest = rest_pairs(members.select("key", "salt", "id", "n"), labels, scratch, percent, orders, block)
    if rest is not None:
        links = scratch.save(links.unionByName(links_of(scratch.save(rest, "rest"))), "all-links")
        labels = connected_components(links, scratch, "all")
    named = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    # a class of very many copies is sent to the rows, not the rows to it
    out = join_to_one(rows, named, ["cls", "m"], "n_copies", heavy_above(rows.count()))
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(linked, F.col("label")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
    )
