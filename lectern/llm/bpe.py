"""Byte-level BPE encoding and decoding with each distinct word encoded once.

Documents are read in blocks. A block's texts are cut into pre-tokens; each
document becomes the sequence of its words' places in the block's own word list,
and the list is exploded into buckets by the word's hash. A bucket meets the words
of all blocks, encodes each distinct word once, and the ids go back to the blocks,
where the documents are put together again by position. So a word crosses the
shuffle once for each block that has it, not once for each time it occurs; a
frequent word is a single entry of a block.

Both sides read the documents alike and in the same order; a check sum of the word
list ends the job if they ever differ. Nulls are empty texts and get no ids; ids
of rows may be null or repeated; other columns are never read. Shuffled payloads
are compressed here, as a cluster's own shuffle codec may not be.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCK_BYTES = 12_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file; its size is fixed."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pack(values: np.ndarray) -> bytes:
    """Numbers by byte planes, so that the high planes compress away."""
    flat = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(3).compress(flat.view(np.uint8).reshape(len(flat), flat.itemsize).T.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


class Places(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Block:
    def __init__(self, number: int, kind: pa.DataType):
        self.number, self.kind, self.places, self.ids, self.lengths, self.seqs, self.size = number, kind, Places(), [], [], [], 0

    def add(self, ident, words: list[str], size: int) -> None:
        self.ids.append(ident)
        self.lengths.append(len(words))
        self.seqs.append(np.fromiter(map(self.places.__getitem__, words), np.uint32, len(words)))
        self.size += size + 64


def check_sum(places: np.ndarray, lengths: np.ndarray) -> int:
    """Of words' places and bytes, whatever their order."""
    return int((common.mix(places.astype(np.uint64) * common.BASE) * (lengths.astype(np.uint64) + np.uint64(1))).sum().view(np.int64))


def blocks_of(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[Block]:
    """Blocks of a partition's documents in order; columns: id, text, number of the partition."""
    find = regex.compile(pattern).findall
    block, count = None, 0
    for part in common.slices(batches, "text"):
        base = part.column("part")[0].as_py() << 24
        for ident, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
            block = block or Block(base + count, part.schema.field("id").type)
            block.add(ident, find(text or ""), len(text or ""))
            if block.size >= BLOCK_BYTES:
                yield block
                block, count = None, count + 1
    if block:
        yield block


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each document's text, without special tokens."""
    common.bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    n_bytes = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n_buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // BLOCK_BYTES))
    vocabulary = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary file
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, pattern):
            own = [w.encode() for w in block.places]
            bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in own), np.int64, len(own))
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            rows = []
            for at in np.split(order, cuts[1:]) if len(order) else []:
                some = [own[i] for i in at.tolist()]
                rows.append((int(bucket[at[0]]), block.number, zstandard.compress(b"".join(some)), pack(np.array([len(w) for w in some], np.uint32)), pack(at.astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "words", "lengths", "places"])

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, pattern):
            seq = np.concatenate(block.seqs)
            yield pa.RecordBatch.from_arrays([pa.array([block.number]), pa.array([block.ids], pa.list_(block.kind)), pa.array([block.lengths], pa.list_(pa.int32())), pa.array([pack(seq)], pa.binary()), pa.array([len(block.places)], pa.int32()), pa.array([check_sum(np.arange(len(block.places)), np.array([len(w.encode()) for w in block.places], np.int64))], pa.int64())], ["block", "idents", "lengths", "seq", "n_words", "checked"])

    def encode_bucket(rows: pa.Table) -> pa.Table:
        encoding = encoder(vocabulary)
        done: dict[bytes, list[int]] = {}
        out = []
        for block, blob, lengths, places in zip(*(rows.column(c).to_pylist() for c in ("block", "words", "lengths", "places")), strict=True):
            blob, ends = zstandard.decompress(blob), np.cumsum(unpack(lengths, np.uint32)).tolist()
            ids, counts, begin = [], [], 0
            for end in ends:
                word, begin = blob[begin:end], end
                if (own := done.get(word)) is None:
                    own = done[word] = encoding.encode_ordinary(word.decode())
                ids += own
                counts.append(len(own))
            out.append((block, places, lengths, pack(np.array(counts, np.uint32)), pack(np.array(ids, np.uint32))))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "places", "lengths", "counts", "ids"])

    def assemble(found: pa.Table, own: pa.Table) -> pa.Table:
        kind = own.schema.field("idents").type.value_type
        n_words = own.column("n_words")[0].as_py()
        counts, spans = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
        ids, base, summed = [], 0, 0
        for places, lengths, count, some in zip(*(found.column(c).to_pylist() for c in ("places", "lengths", "counts", "ids")), strict=True):
            summed += check_sum(places := unpack(places, np.uint32), unpack(lengths, np.uint32))
            count, some = unpack(count, np.uint32).astype(np.int64), unpack(some, np.uint32)
            if len(places) and places.max() >= n_words:
                raise RuntimeError("the documents were not read alike twice")
            counts[places] = count
            spans[places] = base + np.cumsum(count) - count
            ids.append(some)
            base += len(some)
        if (counts == 0).any() or (summed - own.column("checked")[0].as_py()) % (1 << 64):
            raise RuntimeError("the documents were not read alike twice")
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        seq, lengths = unpack(own.column("seq")[0].as_py(), np.uint32), np.array(own.column("lengths")[0].as_py(), np.int64)
        size = counts[seq]
        cuts = np.concatenate([[0], np.cumsum(size)])
        tokens = ids[np.repeat(spans[seq] - cuts[:-1], size) + np.arange(cuts[-1])].astype(np.int32)
        bounds = cuts[np.concatenate([[0], np.cumsum(lengths)])]
        lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(tokens)).cast(pa.list_(pa.int32()))
        return pa.table([pa.array(own.column("idents")[0].as_py(), kind), lists], [id_col, "ids"])

    vocab = texts.mapInArrow(words, "bucket int, block long, words binary, lengths binary, places binary").groupBy("bucket").applyInArrow(encode_bucket, "block long, places binary, lengths binary, counts binary, ids binary")
    seqs = texts.mapInArrow(sequences, f"block long, idents array<{id_type}>, lengths array<int>, seq binary, n_words int, checked long")
    return vocab.groupBy("block").cogroup(seqs.groupBy("block")).applyInArrow(assemble, f"`{id_col}` {id_type}, ids array<int>")


_ENCODER: list = [None, None]


def encoder(vocabulary) -> tiktoken.Encoding:
    """Kept in the worker process for the next bucket; it is given one pre-token at a time."""
    if _ENCODER[0] is not vocabulary.value:
        _ENCODER[:] = vocabulary.value, tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary.value, special_tokens={})
    return _ENCODER[1]


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """The rows with the bytes of their ids joined from the token-byte table; null ids give no bytes, an unknown id is an error."""
    by_id = np.full(max(ranks.values(), default=-1) + 1, b"", object)
    for token, rank in ranks.items():
        by_id[rank] = token
    spread = encoded.sparkSession.sparkContext.broadcast(by_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = spread.value
        for part in batches:
            for i in range(0, part.num_rows, 256):
                some = part.slice(i, 256)
                lists = some.column(ids_col)
                tokens = table[lists.flatten().to_numpy()].tolist()
                cuts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).tolist()
                joined = [b"".join(tokens[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(joined, pa.binary())], [*some.schema.names, out])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())]))
