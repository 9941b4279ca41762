"""Shared pieces of the training-data operators.

Everything here works on Arrow batches inside ``mapInArrow``: a slice of a batch is
seen as one byte buffer with an offset per text, so the heavy work is numpy over
bytes and its memory is bounded by the slice (one text can never be split).
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import bounded_batches  # noqa: F401

#: Odd multipliers and seeds of the rolling hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: ASCII white space: blank and \\t to \\r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The chars that are no continuation byte start a code point.
STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inverse(odd: int) -> np.uint64:
    """The multiplicative inverse of an odd number modulo 2**64."""
    return np.uint64(pow(int(odd), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * BASE
    return x ^ (x >> np.uint64(32))


def byte_values(seed: int = 1) -> np.ndarray:
    """A 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * BASE + np.uint64(seed))


#: Multipliers of the values of a gram; their number is its size.
GRAM = tuple(np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD))
_POWERS: dict[int, np.ndarray] = {}


def kept_powers(base: np.uint64, n: int) -> np.ndarray:
    """``powers``, kept in this process up to a million."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        held = powers(base, max(n, 1 << 18))
        if len(held) <= 1_000_000:
            _POWERS[int(base)] = held
    return held[:n]


class Rolling:
    """64-bit hashes of any segments of a sequence of 64-bit values.

    A polynomial modulo 2**64 over the values themselves gives some regular sequences one hash, whatever its
    base (Thue-Morse sequences of two values do). So the polynomial goes over grams: each four neighbours,
    weighted and then mixed, which is not linear. A segment has the grams that lie in it; one shorter than a gram is mixed whole.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.values = values
        self.back = kept_powers(inverse(int(BASE)), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        whole = max(n - len(GRAM) + 1, 0)
        grams = mix(sum(values[j : j + whole] * c for j, c in enumerate(GRAM)))
        np.cumsum(grams * kept_powers(BASE, whole), out=self.sums[1 : whole + 1])
        self.sums[whole + 1 :] = self.sums[whole]

    def segment(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = (self.sums[np.maximum(end - (len(GRAM) - 1), start)] - self.sums[start]) * self.back[start]
        few = np.flatnonzero(size < len(GRAM))
        if len(few) and len(self.values):
            at, n = start[few], size[few]
            held = n.astype(np.uint64)
            for j, c in enumerate(GRAM[:-1]):
                held += np.where(j < n, self.values[np.minimum(at + j, len(self.values) - 1)] * c, np.uint64(0))
            out[few] = mix(held)
        return out

    def windows(self, k: int) -> np.ndarray:
        """Of the k values from each start on."""
        n = len(self.values)
        if n < k:
            return np.zeros(0, np.uint64)
        if k < len(GRAM):
            return self.segment(np.arange(n - k + 1), np.arange(k, n + 1))
        last = k - len(GRAM) + 1
        return (self.sums[last : last + n - k + 1] - self.sums[: n - k + 1]) * self.back[: n - k + 1]


def keys_of(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each text, from a cryptographic hash of its bytes: rows of equal keys may be taken as equal."""
    held = memoryview(np.ascontiguousarray(data))
    cuts = bounds.tolist()
    return np.frombuffer(b"".join(hashlib.blake2b(held[a:b], digest_size=16).digest() for a, b in zip(cuts, cuts[1:], strict=False)), np.int64).reshape(-1, 2)


def text_keys(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return keys_of(data, bounds)[:, 0].copy()


def word_keys(data: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """``keys_of`` each text's words, one line feed behind each."""
    size = end - start
    place = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum() + len(size)), 10, np.uint8)
    out[np.repeat(place - (np.cumsum(size) - size), size) + np.arange(size.sum())] = data[~IS_SPACE[data]]
    ends = np.append(place, len(out))[np.searchsorted(doc, np.arange(len(bounds)))]
    return keys_of(out, ends)


def numbered(data: np.ndarray, sizes: np.ndarray) -> pa.DictionaryArray:
    """Pieces that lie one after another in the bytes, as an array with a dictionary: numbers that are equal if the pieces are."""
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pa.concat_arrays([column])  # drops the offset of a slice where it can
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 250_000) -> Iterator[pa.RecordBatch]:
    """The batches cut where their texts exceed a number of bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > begin and held + size > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        yield batch.slice(begin)
    pa.default_memory_pool().release_unused()  # the worker waits for its next task with little held


def per_doc(sums: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of a flag over each text; sums: the running sum with a leading 0."""
    return sums[bounds[1:]] - sums[bounds[:-1]]


def running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word ``[^\\x20\\x09-\\x0D]+``; words end where a text ends."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inner = ~IS_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[bounds] = True  # of each text
    begins = inner.copy()
    begins[1:] &= ~inner[:-1] | first[1:n]
    ends = inner.copy()
    ends[:-1] &= ~inner[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares; without one, a folder of this machine if all of Spark runs in this process, else an error."""
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place and not context._jsc.sc().getCheckpointDir().isEmpty():
        place = context._jsc.sc().getCheckpointDir().get()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        context.setCheckpointDir("/tmp/checkpoints")
        place = context._jsc.sc().getCheckpointDir().get()
    return f"{place.rstrip('/')}/lectern-{uuid.uuid4().hex}"


class Shelf:
    """Tables of one run in the shared folder: lineage ends with each, and a lost executor costs nothing that is done.

    A table goes when it is dropped, at the latest when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def _path(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def put(self, df: DataFrame) -> DataFrame:
        """The rows, written and read again."""
        path = shared_dir(self.spark)
        df.write.option("compression", "zstd").parquet(path)
        fs, where = self._path(path)
        fs.deleteOnExit(where)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = out, path
        return out

    def put_by(self, df: DataFrame, column: str, n: int) -> list[DataFrame]:
        """The rows of the values 0 to n - 1 of a column, which goes, as a table each."""
        path = shared_dir(self.spark)
        df.write.option("compression", "zstd").partitionBy(column).parquet(path)
        fs, where = self._path(path)
        fs.deleteOnExit(where)
        out, shape = [], df.drop(column).schema
        for i in range(n):
            part = f"{path}/{column}={i}"
            found = fs.exists(self._path(part)[1])
            out.append(self.spark.read.schema(shape).parquet(part) if found else self.spark.createDataFrame([], shape))
            self.held[id(out[-1])] = out[-1], part
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            fs, where = self._path(self.held.pop(id(t))[1])
            fs.delete(where, True)

    def clear(self, *but: DataFrame) -> None:
        """Drops all tables but those."""
        self.drop(*(t for t, _ in list(self.held.values()) if all(t is not x for x in but)))


def stored(df: DataFrame) -> DataFrame:
    return Shelf(df.sparkSession).put(df)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps whose results are written, and gives back what this process has freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    spark.sparkContext._jvm.System.gc()


class Sieve:
    """A Bloom filter of a fixed size over 64-bit keys, column ``k``: tells which rows surely have none of them."""

    BITS = 25

    def __init__(self, keys: DataFrame):
        mask = (1 << self.BITS) - 1
        places = keys.select(F.explode(F.array(F.col("k").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("k", self.BITS).bitwiseAND(F.lit(mask)))).alias("p"))
        words = places.groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(p % 64)))").alias("bits")).toArrow()  # at most 2**19 rows
        held = np.zeros((1 << self.BITS) // 64, np.uint64)
        held[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
        self.spread = keys.sparkSession.sparkContext.broadcast(held)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        held, mask, k = self.spread.value, np.uint64((1 << self.BITS) - 1), keys.view(np.uint64)
        test = lambda p: (held[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0
        return test(k & mask) & test((k >> np.uint64(self.BITS)) & mask)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest id that each linked node reaches.

    Alternates large-star and small-star steps (Kiveris et al. 2014) on the link
    table until nothing changes. Each step is an aggregation and a join on the
    node, so a hub is summed before its shuffle and its join can be split; links
    stay distributed and each round is written to the shared folder.
    """
    shelf, edges, last = Shelf(links.sparkSession), links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), None
    while True:
        # large star: all larger neighbours of a node to its smallest one
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours and the node itself to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen = Observation()
        edges = shelf.put(small.union(least.select("u", F.col("m").alias("v"))).distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
        shelf.clear(edges)
        state = seen.get
        if state == last or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state
