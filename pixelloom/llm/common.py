"""Shared helpers: scratch tables in the cluster's shared folder, ASCII case folding, word hashing."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Gives the C library's free memory back to the system, where that library can.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Lower-cases A-Z only; every other byte stays (so UTF-8 sequences stay whole).
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. A local one stands in only where driver and executors
    are one machine (tests)."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "pixelloom-scratch")


class Scratch:
    """Intermediate tables written to the shared folder, so that lost executors never cost a recomputation of more
    than one step. drop() removes those that no later step reads."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep(self, *names: str) -> None:
        """Drops all other tables."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        for status in root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root):
            if (other := status.getPath().getName()) not in names:
                self.drop(other)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tidy(run: Callable) -> Callable:
    """A batch function that gives memory back when its task ends: worker processes live on in other stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Batches of at most `rows` rows go to Python workers, where the session has not chosen a number of its own: batches of
    whole texts are held several times over, by the JVM and by the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def looked_up(rows: DataFrame, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """The rows whose key few has, with few's columns (left_semi: without, left_anti: the other rows); few is of whole numbers, its key
    unique. few goes to the tasks as sorted arrays, a few bytes a row: a join's broadcast table takes the driver over a hundred,
    several times over."""
    known = (few if how == "inner" else few.select(on)).toArrow().sort_by(on)
    values = [c for c in few.columns if c != on] if how == "inner" else []
    sent = rows.sparkSession.sparkContext.broadcast([known.column(c).to_numpy() for c in (on, *values)])
    del known
    release()
    at, names = rows.columns.index(on), [*rows.columns, *values]
    types = [pa.int32() if few.schema[c].dataType.typeName() == "integer" else pa.int64() for c in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *columns = sent.value
        for batch in batches:
            own = batch.column(at)
            place = np.searchsorted(keys, own.fill_null(0).to_numpy())
            hit = np.append(keys, 0)[place] == own.fill_null(0).to_numpy()
            hit &= (place < len(keys)) & own.is_valid().to_numpy(zero_copy_only=False)
            left = batch.filter(pa.array(~hit if how == "left_anti" else hit)).columns
            yield pa.RecordBatch.from_arrays([*left, *(pa.array(c[place[hit]], t) for c, t in zip(columns, types, strict=True))], names)

    return rows.mapInArrow(tidy(run), StructType([*rows.schema.fields, *(few.schema[c] for c in values)]))


def cut_count(counted: DataFrame, column: str, most: int) -> int:
    """The least count such that at most about `most` rows have it or more, from the counts' logarithmic histogram: a
    few hundred rows, whatever the table's size."""
    bins = counted.groupBy(F.floor(8 * F.log2(column)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low")).collect()
    cut, left = 2**62, most
    for r in sorted(bins, key=lambda r: -r["bin"]):
        if r["n"] > left:
            break
        cut, left = r["low"], left - r["n"]
    return cut


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FOLD = np.frombuffer(ASCII_LOWER, np.uint8)
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: One 64-bit value for each byte value: the polynomial hash of a word is the sum of value * base ** position.
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class HashedWords:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of many texts at once, from Arrow's buffers; A-Z are lower-cased
    where fold is set."""

    def __init__(self, block: int = 1_000_000, fold: bool = True):
        self.block, self.values = block, _VALUES[_FOLD] if fold else _VALUES
        self.up = self.down = np.empty(0, np.uint64)

    def blocks(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, bytes of it and the texts after it, where each ends), about `block` bytes each."""
        texts = texts.cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + self.block, side="right")) - 1)
            j = min(j, len(texts))
            yield i, data[bounds[i] : bounds[j]], bounds[i + 1 : j + 1] - bounds[i]
            i = j

    def words(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of each word."""
        return self.placed(raw, ends)[:2]

    def placed(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash and text number of each word, its first byte and the one after its last."""
        if len(self.up) < len(raw):
            self.up, self.down = _powers(_BASE, len(raw)), _powers(pow(_BASE, -1, 2**64), len(raw))
        black = ~_WHITE[raw]
        first, last = black.copy(), black.copy()
        first[1:] &= ~black[:-1]
        last[:-1] &= ~black[1:]
        cuts = np.unique(ends[(ends > 0) & (ends < len(raw))])
        first[cuts] = black[cuts]
        last[cuts - 1] = black[cuts - 1]
        i, j = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.values[raw] * self.up[: len(raw)], dtype=np.uint64)])
        return mix((sums[j] - sums[i]) * self.down[i] + (j - i).astype(np.uint64)), np.searchsorted(ends, i, side="right"), i, j


class Generations:
    """What `make` gives for keys, remembered in two generations of up to `most`: keys in use move to the younger, the
    older is forgotten when the younger is full."""

    def __init__(self, make, most: int = 150_000):
        self.make, self.most, self.young, self.old = make, most, {}, {}

    def ensure(self, keys: set) -> dict:
        """A dict of exactly these keys: small, so that the lookups that follow stay in the processor's caches."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        found = dict(zip(keys, map(self.young.get, keys), strict=True))
        new = []
        for k in [k for k, v in found.items() if v is None]:
            v = self.old.get(k)
            if v is None:
                new.append(k)
            else:
                found[k] = self.young[k] = v
        if new:
            made = dict(zip(new, self.make(new), strict=True))
            self.young.update(made)
            found.update(made)
        return found
