"""What several operators share: tables, the shared scratch folder, word hashes, the memory of Python workers."""

from __future__ import annotations

import ctypes
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only in one local process, as in tests.

    On a cluster a folder of our own would be another one on every machine, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/corpuslens-checkpoints"


def heavy_above(rows: int, keys: int = 5000, least: int = 100_000) -> int:
    """A count of rows that fewer than `keys` keys of a table of that many rows can exceed, and that is much for one task."""
    return max(least, rows // keys)


def join_to_one(many: DataFrame, one: DataFrame, on: list[str], count: str, heavy: int) -> DataFrame:
    """many, left-joined to its row of `one` (one row per key, none null); `count` is how many rows of many the key has.

    Keys above `heavy` are broadcast, so that no task gets all rows of one; heavy_above() bounds their number.
    """
    few = F.broadcast(one.where(F.col(count) > heavy))
    rest = many.join(few.select(*on), on, "left_anti")
    return many.join(few, on).unionByName(rest.join(one.where(F.col(count) <= heavy), on, "left"))


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation.

    A table is dropped as soon as nothing reads it any more; what a returned DataFrame still
    reads stays until the folder itself is cleaned.
    """

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{operator}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def local(self, name: str) -> str:
        """A path that workers can memory-map; the shared folder must be a mounted one for that."""
        at = self.path(name)
        if "://" in at and not at.startswith("file://"):
            raise ValueError(f"memory-mapped tables need a mounted shared folder, not {at}")
        at = at.removeprefix("file://")
        os.makedirs(at, exist_ok=True)
        return at


def write_array(path: str, array: np.ndarray) -> None:
    """Atomic: a task that runs twice, or beside its copy, leaves one whole file."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as out:
        np.save(out, array)
    os.replace(part, path)


def words_of(text: str | None) -> list[bytes]:
    """Words of the class [^\\x20\\x09-\\x0D]+, with A-Z lower-cased and all else kept.

    bytes.lower and bytes.split touch ASCII only, which is what the class asks for.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """Word -> 64-bit hash; forgets all at a size, so that a long task keeps its memory."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The one object that this process keeps from task to task.
_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """The object of this key, made once per worker as long as its tasks ask for no other; see lean()."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
        give_back()
    return _KEPT[key]


def forget() -> None:
    if _KEPT:
        _KEPT.clear()
        give_back()


def give_back() -> None:
    """Returns freed memory to the machine; Arrow's pool and the C library hold on to it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library only
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, in a worker that other operators use before and after it.

    Spark reuses Python workers, so what a task leaves there is in the executor's memory during all
    later stages: freed memory is given back at a task's end, and what kept() has of another
    operator goes at its start.  keeps: run calls kept() itself.
    """

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def parts(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in slices of at most so many bytes of text, or one row that has more.

    What a task makes of a slice at once is bounded by it; Spark's batches are bounded by rows only.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From here on Spark hands Python workers of this session at most so many rows at once.

    A batch lies in the JVM's memory outside its heap and in the worker's, by default 10,000 rows of
    any length.  Spark reads the setting when a plan runs, so it stays; a smaller one is left alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def in_training(doc_id, modulus: int, out: int) -> bool:
    """Whether crc32 of the id's decimal text leaves another remainder than `out`."""
    import zlib

    return zlib.crc32(str(doc_id).encode()) % modulus != out
