"""What the document operators share: columns of documents, bounded slices of Arrow batches, ordered ranges."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Text that is worked on at once in a task, in bytes; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20
NO_ID = -(1 << 63)
#: Most bits of a bitmap that sifts keys, whatever their number: 16 MB.
BITS = 1 << 27
#: Tables that a worker process keeps from one task to the next of the operator that made them.
LOADED: dict = {}
_BIT = (128 >> np.arange(8)).astype(np.uint8)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id and text only; a null text is an empty one."""
    importable(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies at the same place as on the driver.

    Clusters that have no copy of it get one in the usual way, by ``--py-files``.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{paths}".rstrip(":")


def text_key(text: str | Column) -> Column:
    """Tells rows with the same id and different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def release() -> None:
    """Drop the tables of this process. A function of the module, as the closure that is sent to a worker has globals of its own."""
    if LOADED:
        LOADED.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Return to the system what Arrow's pool and, where glibc is the C library, the allocator hold but don't use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable:
    """``run`` in a worker that gives back, when its task ends, the memory of the batches that it has worked on.

    Spark takes worker processes in turn, also for the next operator of a pipeline, and keeps more of them than have a task; those that
    wait would hold on to it.
    Unless ``run`` keeps tables in ``LOADED``, those of an earlier operator are dropped first.
    """
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        try:
            yield from run(batches)
        finally:
            give_back()
    return bounded


def mapped(rows: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, by: str = "text",
           limit: int = SLICE_BYTES, keeps: bool = False) -> DataFrame:
    """``work`` on slices of at most ``limit`` bytes of column ``by``; ``keeps`` as in :func:`released`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, by, limit):
            out = work(part)
            if out is not None:
                yield out
    return rows.mapInArrow(released(run, keeps), schema)


def slices(batches: Iterator[pa.RecordBatch], by: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(by)
        sizes = pc.binary_length(column) if pa.types.is_string(column.type) or pa.types.is_binary(column.type) \
            else pc.multiply(pc.list_value_length(column), 4)
        ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def flat(column: pa.Array) -> pa.Array:
    """The same values in an array without an offset."""
    return pa.concat_arrays([column]) if column.offset else column


def words_of(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between white space: code of each word, the different words, and where each text's words begin."""
    lists = pc.utf8_split_whitespace(flat(column))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.flatten().dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary, offsets


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, whose values lie between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A well spread permutation of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bitmap(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """Which of ``bits`` remainders occur among the keys (column lsh): at most bits / 63 numbers come to the driver."""
    bit = F.pmod("lsh", F.lit(bits))
    words = (keys.select(F.floor(bit / 63).cast("long").alias("word"), F.pmod(bit, F.lit(63)).cast("int").alias("bit"))
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).toArrow())
    number, mask = (words.column(c).to_numpy() for c in ("word", "mask"))
    out = np.zeros(bits // 8 + 8, np.uint8)
    for i in range(63):
        at = number[(mask >> i) & 1 == 1] * 63 + i
        np.bitwise_or.at(out, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    return out


def passing(keys: np.ndarray, sift: np.ndarray, count: int = BITS) -> np.ndarray:
    """Which keys may be among those of a bitmap of ``count`` bits: all that are, and some others."""
    bits = keys & (count - 1) if count & (count - 1) == 0 else keys % count
    return sift[bits >> 3] & _BIT[bits & 7] != 0


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_ranges(docs: DataFrame, count: int) -> DataFrame:
    """Adds ``key`` (doc_id, the smallest number if null) and ``place``, the number of its range of keys.

    The bounds are quantiles of the ids, so that ranges hold about as many rows each; rows of one key share a range.
    """
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(NO_ID)))
    share = [i / count for i in range(1, count)]
    bounds = np.unique(np.array(docs.select(F.col("key").cast("double")).approxQuantile("key", share, 0.2 / count)
                                if share else [], dtype=np.float64))

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(dtype=np.float64), side="right").astype(np.int32))

    return docs.withColumn("place", place("key"))
