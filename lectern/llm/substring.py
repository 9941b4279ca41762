"""Exact substring dedup: finds what is covered by a string of ``length`` units that starts anywhere else.

A unit is a byte or, with ``words``, a word ``[^\\x20\\x09-\\x0D]+``; a document is its
sequence of units. Every window of ``length`` units takes as its anchor the k-gram with
the smallest hash in it (the first, on a tie), so equal windows have equal anchors at
equal places. Consecutive windows of one anchor form a string; all windows of the corpus
lie in exactly one string each. Only an anchor that comes twice can have a window that
does. Of the strings of such an anchor, equal ones are one string with a count
(all its windows repeat if it is counted twice), and the different ones are a shard:
its suffix array is built by induced sorting, permuted common prefixes tell which
neighbours share a window, and such neighbours are a class of equal windows. A shard of
more than ``shard_strings`` strings is not gathered: its strings are cut into pieces of
fewer windows, which are strings of smaller shards, those of the units that all windows
of a piece share; the same rules hold for them, down to pieces of one window.

All places of a repeated window are found or, with ``first_stays``, all but the first
one, in the order of ids, a hash of the text, and place; so a passage stays once.

Texts are UTF-8; null is empty. Documents are told apart by id and text, so rows that
share an id but not the text stay apart. Rows that are equal repeat each other and each
is returned; for ``first_stays`` they are one place. Null ids are allowed and come
first. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, sais

#: Window starts that are handled at once, and bits for a place among them.
CHUNK, PLACE_BITS = 1 << 23, 24
STEP = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Settings:
    length: int = 400
    anchor: int = 150
    words: bool = False
    first_stays: bool = False
    shard_strings: int = 256
    pieces: tuple[int, ...] = (16, 1)
    batch_bytes: int = 300_000
    slice_bytes: int = 250_000

    @property
    def unit_bytes(self) -> int:
        """Of a unit in a string's data."""
        return 8 if self.words else 1


#: Passages of more than 50 words.
PASSAGES = Settings(length=51, anchor=18, words=True)


def units(data: np.ndarray, bounds: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each unit of all texts, and n + 1 offsets."""
    if not s.words:
        return common.byte_values()[data], bounds
    start, end, doc = common.words_of(data, bounds)
    values = common.mix(common.Rolling(common.byte_values(4)[data]).segment(start, end) + (end - start).astype(np.uint64))
    return values, np.searchsorted(doc, np.arange(len(bounds)))


def values_of(raw: np.ndarray, s: Settings) -> np.ndarray:
    """The units' values of a string's data."""
    return raw.view(np.uint64) if s.words else common.byte_values()[raw]


def strings(values: np.ndarray, bounds: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Anchor hash, string hash, document, start in the document, number of windows of each string."""
    parts = []
    for begin in range(0, max(len(values) - s.length + 1, 0), CHUNK):
        hashes = common.Rolling(values[begin : begin + CHUNK + s.length - 1])
        grams = common.mix(hashes.windows(s.anchor))
        low = np.uint64((1 << PLACE_BITS) - 1)
        least, span, width = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1, s.length - s.anchor + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        anchor = (least & low).astype(np.int64)
        # where the text of each window's start ends
        stop = np.repeat(bounds[1:], np.diff(bounds))[begin : begin + len(anchor)] - begin
        inside = np.arange(s.length, s.length + len(anchor)) <= stop
        new = np.ones(len(anchor) + 1, bool)
        new[1:-1] = (anchor[1:] != anchor[:-1]) | (stop[1:] != stop[:-1]) | (inside[1:] != inside[:-1])
        cut = np.flatnonzero(new)
        start, end = cut[:-1], cut[1:]
        keep = inside[start]
        start, end = start[keep], end[keep]
        doc = np.searchsorted(bounds, start + begin, "right") - 1
        parts.append((grams[anchor[start]], common.mix(hashes.segment(start, end + s.length - 1) + (end - start).astype(np.uint64)), doc, begin + start - bounds[doc], end - start))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (*(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int64),) * 3)


def repeated_windows(found: list[np.ndarray], s: Settings) -> list[np.ndarray]:
    """For each string, in the order of first places, which of its windows go: those of classes of two or more, or all of a class but its first."""
    sizes = np.array([len(x) for x in found]) + 1
    ends = np.cumsum(sizes)
    raw = np.zeros(ends[-1], found[0].dtype)
    inner = np.ones(len(raw), bool)
    inner[ends - 1] = False
    raw[inner] = np.concatenate(found)
    joined = np.unique(raw, return_inverse=True)[1] + 2 if s.words else raw.astype(np.int64) + 2
    joined[ends - 1] = 1  # no unit of a string
    order = sais.suffix_array(np.append(joined, 0))[1:]
    left = np.repeat(ends - 1, sizes) - np.arange(len(joined))
    shared = sais.common_prefixes(joined, order, left, s.length)
    # a class is a run of suffixes that share a window each with the one before
    head = np.flatnonzero(shared[order] < s.length)
    many = np.diff(np.append(head, len(order)))
    again = np.zeros(len(joined), bool)
    again[order] = np.repeat(many > 1, many)
    if s.first_stays:
        again[np.minimum.reduceat(order, head)] = False
    starts = ends - sizes
    return [again[a : a + n - s.length] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def runs(again: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Start and end of the runs of units that the flagged windows cover."""
    at = np.flatnonzero(again)
    if not len(at):
        return [], []
    head = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + length]))
    return at[head].tolist(), (at[np.append(head[1:], len(at)) - 1] + length).tolist()


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order, with those that touch made one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.concatenate([[True], start[1:] > end[:-1]])
    return start[head], end[np.append(np.flatnonzero(head)[1:], len(start)) - 1]


SPANS = "starts array<long>, ends array<long>"
PLACE = ["id", "k", "start"]


def verdicts_of(kinds: DataFrame, partly: DataFrame, keys: list[str]) -> DataFrame:
    """Of each string with anything repeated: whether it comes twice, its first place, and the spans that go there."""
    some = kinds.join(partly, keys, "left").where("c > 1 OR starts IS NOT NULL")
    return some.select(*keys, (F.col("c") > 1).alias("all"), *[F.col(f"at.{c}").alias(f"first_{c}") for c in PLACE], "starts", "ends")


def found_spans(start: str, n: str, place: str, s: Settings) -> Column:
    """Spans of a string at a place: all of it if it comes twice (and this is not the place that stays), else those that were found in it; null if there are none."""
    whole = F.array(F.struct(F.col(start).cast("long").alias("f"), (F.col(start) + F.col(n) + (s.length - 1)).cast("long").alias("t")))
    some = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct((x["starts"] + F.col(start)).alias("f"), (x["ends"] + F.col(start)).alias("t")))
    first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("k") == F.col("first_k")) & (F.col(place) == F.col("first_start"))
    return F.when(F.col("all") & ~(first & F.lit(s.first_stays)), whole).otherwise(some)


def united(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of each key, in order and without overlaps."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for lists in part.column("found").to_pylist():
                both = np.array([(x["f"], x["t"]) for y in lists for x in y], np.int64)
                out.append(merged(both[:, 0], both[:, 1]))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *(pa.array([x[i].tolist() for x in out], pa.list_(pa.int64())) for i in (0, 1))], [*keys, "starts", "ends"])

    kinds = "".join(f"{k} {hits.schema[k].dataType.simpleString()}, " for k in keys)
    return hits.where("size(found) > 0").groupBy(*keys).agg(F.collect_list("found").alias("found")).mapInArrow(unite, kinds + SPANS)


def judged(strings_of: DataFrame, s: Settings, pieces: tuple[int, ...], shelf: common.Shelf) -> DataFrame:
    """(a, h, starts, ends) of the strings (a, h, kinds, id, k, start, data) with windows that come in another string of their anchor; the strings are stored."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judge(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.take(pc.sort_indices(table.select(PLACE), [(c, "ascending") for c in PLACE], null_placement="at_start"))
            same = np.unique(np.stack([table.column(c).to_numpy() for c in "ah"]), axis=1, return_index=True)[1]  # equal rows bring a string twice
            table = table.take(pa.array(np.sort(same)))
            again = repeated_windows([np.frombuffer(x, np.uint64 if s.words else np.uint8) for x in table.column("data").to_pylist()], s)
            found = [(a, h, *runs(x, s.length)) for a, h, x in zip(table.column("a").to_pylist(), table.column("h").to_pylist(), again, strict=True) if x.any()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["a", "h", "starts", "ends"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            begin = 0
            anchors = batch.column("a").to_numpy()
            sizes = pc.binary_length(batch.column("data")).to_numpy()
            for i in range(batch.num_rows):
                last = anchors[i - 1] if i else held[-1].column("a")[-1].as_py() if held else None
                if size >= s.batch_bytes and anchors[i] != last:
                    yield from judge(pa.Table.from_batches([*held, batch.slice(begin, i - begin)]))
                    held, begin, size = [], i, 0
                size += int(sizes[i])
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield from judge(pa.Table.from_batches(held))

    small = strings_of.where(F.col("kinds") <= s.shard_strings).select("a", "h", *PLACE, "data")
    out = small.repartition("a").sortWithinPartitions("a").mapInArrow(shard, "a long, h long, " + SPANS)
    large = strings_of.where(F.col("kinds") > s.shard_strings).select("a", "h", *PLACE, "data").dropDuplicates(["a", "h"])
    if not pieces or large.isEmpty():
        return out

    def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows are dealt by their distance to the anchor, so that equal ones are dealt alike."""
        size, width = pieces[0], s.length - s.anchor + 1
        for part in batches:
            found, of = [], []
            for i, text in enumerate(part.column("data")):
                values = values_of(np.frombuffer(text.as_buffer(), np.uint8), s)
                hashes = common.Rolling(values)
                grams = common.mix(hashes.windows(s.anchor))[:width]
                anchor = int((grams >> np.uint64(PLACE_BITS)).argmin())
                n = len(values) - s.length + 1
                far = (anchor - np.arange(n)) // size
                cut = np.flatnonzero(np.diff(far, prepend=far[0] + 1))
                end = np.append(cut[1:], n)
                # all windows of whole distance classes have these units; a class's first window may not be in the string
                core = np.stack([np.maximum(anchor - far[cut] * size, 0), np.minimum(anchor - (far[cut] + 1) * size + 1 + s.length, len(values))])
                key = common.mix(hashes.segment(core[0], np.maximum(core[1], core[0])) * STEP + np.uint64(part.column("a")[i].as_py() % (1 << 64)) + common.mix(far[cut].astype(np.uint64)))
                whole = common.mix(hashes.segment(cut, end + s.length - 1) + (end - cut).astype(np.uint64) + common.mix(core[0].astype(np.uint64) - cut.astype(np.uint64)))
                found.append((key.view(np.int64), whole.view(np.int64), cut, end - cut))
                of += [i] * len(cut)
            key, whole, cut, n = [np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
            a, h, ident, k, start = (part.column(c).take(pa.array(of, pa.int64())) for c in ("a", "h", *PLACE))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(whole), a, h, ident, k, pc.add(start, pa.array(cut)), pa.array(cut), pa.array(n)], ["a2", "h2", "a", "h", *PLACE, "o", "m"])

    kind = strings_of.schema["id"].dataType.simpleString()
    cut = shelf.put(large.mapInArrow(cut_pieces, f"a2 long, h2 long, a long, h long, id {kind}, k long, start long, o long, m long"))
    kinds = shelf.put(cut.groupBy("a2", "h2").agg(F.count("*").alias("c"), F.min(F.struct(*PLACE, "a", "h", "o", "m")).alias("at")))
    counts = shelf.put(kinds.groupBy("a2").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    unlike = kinds.join(counts, "a2").select("a2", "h2", "kinds", "at.*")
    data = F.expr(f"substring(data, int({s.unit_bytes} * o + 1), int({s.unit_bytes} * (m + {s.length - 1})))").alias("data")
    smaller = shelf.put(unlike.join(large.select("a", "h", "data"), ["a", "h"]).select(F.col("a2").alias("a"), F.col("h2").alias("h"), "kinds", *PLACE, data))
    partly = judged(smaller, s, pieces[1:], shelf).withColumnsRenamed({"a": "a2", "h": "h2"})
    verdicts = shelf.put(verdicts_of(kinds, partly, ["a2", "h2"]))
    hits = cut.join(verdicts, ["a2", "h2"]).select("a", "h", found_spans("o", "m", "start", s).alias("found"))
    return out.unionByName(united(hits, ["a", "h"]))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, k, starts, ends): the spans, in units, of each document that has any; ``k`` is a hash of its text."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shelf = common.Shelf(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    # a text of fewer bytes has no window
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") >= (2 * s.length - 1 if s.words else s.length))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", s.slice_bytes):
            data, bounds = common.text_bytes(part.column("text"))
            anchor, whole, doc, start, n = strings(*units(data, bounds, s), s)
            key = common.text_keys(data, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), part.column("id").take(pa.array(doc)), pa.array(key[doc]), pa.array(start), pa.array(n.astype(np.int32))], ["a", "h", "id", "k", "start", "n"])

    every = shelf.put(texts.mapInArrow(cut, f"a long, h long, id {kind}, k long, start long, n int"))
    often = shelf.put(every.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a"))
    rows = shelf.put(every.join(often, "a"))
    shelf.drop(every, often)
    # one of each different string, the number of its places, and how many an anchor has
    kinds = shelf.put(rows.groupBy("a", "h").agg(F.count("*").alias("c"), F.min(F.struct(*PLACE, "n")).alias("at")))
    common.released(spark)
    counts = shelf.put(kinds.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    unlike = kinds.join(counts, "a").select("a", "h", "kinds", "at.*")
    wanted = shelf.put(unlike.groupBy("id", "k").agg(F.collect_list(F.struct("a", "h", "kinds", "start", "n")).alias("wanted")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found, of = [], []
            for i, (text, wanted) in enumerate(zip(part.column("text"), part.column("wanted").to_pylist(), strict=True)):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                raw = units(raw, np.array([0, len(raw)]), s)[0] if s.words else raw
                found += [(w["a"], w["h"], w["kinds"], w["start"], raw[w["start"] : w["start"] + w["n"] + s.length - 1].tobytes()) for w in wanted]
                of += [i] * len(wanted)
            a, h, kinds, start, data = (pa.array(x, t) for x, t in zip(zip(*found, strict=True), (*(pa.int64(),) * 4, pa.binary()), strict=True))
            yield pa.RecordBatch.from_arrays([a, h, kinds, part.column("id").take(pa.array(of)), part.column("k").take(pa.array(of)), start, data], ["a", "h", "kinds", *PLACE, "data"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", s.slice_bytes):
            data, bounds = common.text_bytes(part.column("text"))
            key = common.text_keys(data, bounds)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key)], ["id", "text", "k"]).filter(pa.array(sieve.may_have(key)))

    sieve = common.Sieve(wanted.select("k"))
    with_key = texts.mapInArrow(keyed, f"id {kind}, text string, k long")
    same = lambda left, right: left["id"].eqNullSafe(right["id"]) & (left["k"] == right["k"])
    met = with_key.join(wanted, same(with_key, wanted)).select(with_key["id"], with_key["k"], "text", "wanted")
    bytes_of = shelf.put(met.mapInArrow(fetch, f"a long, h long, kinds long, id {kind}, k long, start long, data binary"))
    shelf.drop(wanted, counts)
    common.released(spark)

    partly = shelf.put(judged(bytes_of, s, s.pieces, shelf))
    verdicts = shelf.put(verdicts_of(kinds, partly, ["a", "h"]))
    hits = rows.join(verdicts, ["a", "h"]).select("id", "k", found_spans("start", "n", "start", s).alias("found"))
    out = shelf.put(united(hits, ["id", "k"]))
    shelf.clear(out)
    common.released(spark)
    return out


def _byte_spans(data: bytes, starts: list[int] | None, ends: list[int] | None, s: Settings) -> list[tuple[int, int]]:
    """Spans in bytes; a span of words goes up to the word that follows, or to its last word's end."""
    if not starts:
        return []
    if not s.words:
        return list(zip(starts, ends, strict=True))
    begin, end, _ = common.words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return [(int(begin[a]), int(begin[b]) if b < len(begin) else int(end[b - 1])) for a, b in zip(starts, ends, strict=True)]


def _cut_text(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    if not cuts:
        return data
    return b"".join(data[a:b] for a, b in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(data)], strict=True))


def with_spans(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, slice_bytes: int) -> DataFrame:
    """All rows and columns of the documents as a struct ``row``, with the columns of ``found`` (id, k, …) or nulls; only documents that may be found are shuffled."""
    sieve = common.Sieve(found.select("k"))
    others = [c for c in found.columns if c not in ("id", "k")]

    def keyed(some: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column("row")
                flat = pa.RecordBatch.from_arrays([rows.field(id_col), rows.field(text_col), rows], ["id", "text", "row"])
                for part in common.slices(iter([flat]), "text", slice_bytes):
                    key = common.text_keys(*common.text_bytes(part.column("text")))
                    part = pa.RecordBatch.from_arrays([part.column("id"), pa.array(key), part.column("row")], ["id", "k", "row"])
                    yield part.filter(pa.array(sieve.may_have(key) == some))

        return run

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    shape = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("k", T.LongType()), T.StructField("row", docs.schema)])
    rows, rest = (whole.mapInArrow(keyed(some), shape) for some in (True, False))
    joined = rows.join(found, rows["id"].eqNullSafe(found["id"]) & (rows["k"] == found["k"]), "left").select("row", *others)
    return joined.unionByName(rest.select("row", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in others]))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings(), passages: Settings = PASSAGES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words) of every document; the last counts the words in passages of more than 50 words that also start elsewhere, which are not removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = part.column("row")
            out = []
            for text, a, b, wa, wb in zip(rows.field(text_col).to_pylist(), *(part.column(c).to_pylist() for c in ("starts", "ends", "from", "to")), strict=True):
                data = (text or "").encode()
                cuts = _byte_spans(data, a, b, s)
                out.append((len(data), sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(_cut_text(data, cuts)).hexdigest(), sum(wb or ()) - sum(wa or ())))
            yield pa.RecordBatch.from_arrays([rows.field(id_col), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True))], [id_col, *FIGURES])

    narrow = docs.select(id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    x, y = spans(narrow, id_col, text_col, s), spans(narrow, id_col, text_col, passages)
    both = x.join(y.withColumnsRenamed({"id": "id2", "k": "k2", "starts": "from", "ends": "to"}), F.col("id").eqNullSafe(F.col("id2")) & (F.col("k") == F.col("k2")), "full")
    shelf = common.Shelf(docs.sparkSession)
    found = shelf.put(both.select(F.when(F.col("k").isNotNull(), F.col("id")).otherwise(F.col("id2")).alias("id"), F.coalesce("k", "k2").alias("k"), "starts", "ends", "from", "to"))
    return with_spans(narrow, found, id_col, text_col, s.slice_bytes).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")


FIGURES = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"]


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", s: Settings = Settings()) -> DataFrame:
    """The documents without the found spans, all columns; bytes of a character that was cut through go with it, and so do documents of which only blanks are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = part.column("row")
            texts, kept = [], []
            for i, (t, a, b) in enumerate(zip(rows.field(text_col).to_pylist(), part.column("starts").to_pylist(), part.column("ends").to_pylist(), strict=True)):
                if a:
                    data = t.encode()
                    t = _cut_text(data, _byte_spans(data, a, b, s)).decode(errors="ignore")
                    if not t.strip("\x20\t\n\x0b\x0c\r"):
                        continue
                texts.append(t)
                kept.append(i)
            rows = rows.take(pa.array(kept, pa.int64()))
            columns = {f.name: rows.field(f.name) for f in rows.type}
            columns[text_col] = pa.array(texts, pa.string())
            if size_col in columns:
                columns[size_col] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[size_col].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return with_spans(docs, spans(docs, id_col, text_col, s), id_col, text_col, s.slice_bytes).mapInArrow(run, docs.schema)
