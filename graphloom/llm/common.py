"""Helpers that several training-data operators share.

Arrow string columns are tokenised in whole batches with numpy: a batch's byte
buffer is lower-cased through a table, word edges are found by comparing
neighbouring bytes, and every word gets a 64-bit hash from eight-byte loads.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; bounds a worker's memory.
SLICE_BYTES = 8 << 20
#: Bits of a table that sift() broadcasts, at most: 8 MB, in rows of PAGE_BITS.
SIEVE_BITS, PAGE_BITS = 1 << 26, 1 << 15

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of this machine only where none is set and all work is done here."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(sc, "_graphloom_dir", None):
        sc._graphloom_dir = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return sc._graphloom_dir


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def release(*staged: DataFrame) -> None:
    """Remove what stage() wrote."""
    for df in staged:
        drop(df.sparkSession, df._staged)
    tidy(staged[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more, as it does on the driver's collections only."""
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, path: str) -> None:
    """Remove a staged folder, if the session still lives."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM has gone, and the folder is the cluster's to clean
        pass


def unused(df: DataFrame, *names: str) -> list[str]:
    """A name like each of names that df has no column of; Spark doesn't tell cases apart."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sift(df: DataFrame, on: list[str], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose columns on, of whole numbers, may be a row of keys, and those whose surely aren't.

    A join on the first part alone then needs no shuffle of the second.  Keys are
    known by one bit each, 16 bits a key and SIEVE_BITS in all: with very many keys
    more rows, at last all, come in the first part, and what is joined stays exact.
    A null is no key.  keys is read twice, so it should be a staged table.
    """
    (page, bits), names = unused(df, "page", "bits"), list(on)
    size = max(PAGE_BITS, min(SIEVE_BITS, 1 << (16 * keys.count()).bit_length()))
    spot = F.pmod(F.xxhash64(*(F.col(c).cast("long") for c in names)), F.lit(size))
    place = spot % PAGE_BITS
    table = keys.select(F.floor(spot / PAGE_BITS).alias(page), place.alias(bits)).repartition(page).groupBy(page).agg(F.bitmap_construct_agg(bits).alias(bits))
    octet = F.conv(F.hex(F.substring(F.col(bits), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    marked = df.withColumn(page, F.floor(spot / PAGE_BITS)).join(F.broadcast(table), page, "left")
    there = F.coalesce(F.getbit(octet, (place % 8).cast("int")) == 1, F.lit(False))
    for c in names:
        there &= F.col(c).isNotNull()
    return marked.where(there).select(*df.columns), marked.where(~there).select(*df.columns)


def fold(key: Column | str, modulus: int) -> Column:
    """crc32 of a key as text, modulo modulus; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(""))) % modulus


def spare() -> None:
    """Give memory that nothing uses back to the system; workers that Spark keeps from task to task would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, with unused memory given back after each batch."""

    @wraps(run)
    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                spare()

        yield from run(each())
        spare()

    return thin


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose text column holds about limit bytes each; a longer text stands alone."""
    _, off = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; nulls count as empty."""
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Words:
    """The lower-cased words of the texts of a batch: byte spans, and the first word of each text.

    Blanks part words; with ``bare``, so does every ASCII character but letters and digits.
    """

    def __init__(self, array: pa.Array, bare: bool = False):
        raw, self.off = buffers(array)
        n = len(raw)
        self.low = np.zeros(n + 8, np.uint8)
        np.take(_LOWER, raw, out=self.low[:n])
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~(_MARKS if bare else _SPACE)[raw]
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.off)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        """The text that each word stands in."""
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same on every machine."""
        load = np.ndarray((max(len(self.low) - 7, 0),), dtype="<u8", buffer=self.low.data, strides=(1,))
        length = self.ends - self.starts
        h = length.astype(np.uint64) * _M2
        rest, k = np.arange(len(h)), 0
        while len(rest):
            left = length[rest] - 8 * k
            h[rest] = mix(h[rest] ^ (load[self.starts[rest] + 8 * k] & _MASKS[np.minimum(left, 8)]))
            rest, k = rest[left > 8], k + 1
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    h = h ^ (h >> _S32)
    h = h * _M1
    h = h ^ (h >> _S29)
    h = h * _M2
    return h ^ (h >> _S32)


def shingles(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size words in each text, and the first run of each text.

    A text with fewer words has one run, all its words; a text without any has none.
    """
    counts = words.counts
    total = len(hashes)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    doc = words.doc_of()
    left = words.first[1:][doc] - np.arange(total)  # words from here to the text's end
    rolled = np.zeros(total, np.uint64)
    for k in range(size):
        part = padded[k : k + total]
        rolled = mix(rolled ^ part) if k == 0 else np.where(left > k, mix((rolled << np.uint64(1)) ^ part), rolled)
    whole = (left >= size) | ((counts[doc] < size) & (left == counts[doc]))
    first = np.concatenate([[0], np.cumsum(whole)])[words.first]
    return rolled[whole], first
