"""Near-duplicates by ProbMinHash over weighted word shingles.

A text is its five-word shingles (all its words, if it has fewer), each weighted by
one plus the logarithm of how often it comes. Each element arrives in the
signature's slots by a Poisson process of its weight's rate; a slot keeps the element that arrives first, and an element is
followed no further than the latest first arrival so far. Two slots agree with the
probability Jaccard similarity of the weighted sets (the plain process of Ertl 2020).
A text with repeated shingles has a second signature, in which each counts once, so that
two texts meet if they are alike in either way.

Texts of the same words are one class from the start, found by an aggregation, so
copies are never paired. Words are told apart by a cryptographic hash of 128 bits. A class is known by
its smallest id and half of that hash, so rows that share an id but not the text stay apart. Signatures of the classes are banded. In
a bucket of at most ``few`` all members are compared. In a larger one every member
is compared with the hub, the member that shares most buckets with others, and with
the smallest id; and the bucket is split by the bands that follow, each in turn, into
finer buckets under the same rule, ``depth`` bands deep at most, the next band among
the ``further`` that follow. (Two texts that are 0.8 alike share 8.5 of the 26 bands on
average, and 11, 5.5 and 1.2 finer buckets of two, three and four bands.) So the
candidates grow with the members and not with their pairs. What these links leave apart
in a large bucket is then compared pair by pair: the bucket is dealt into blocks, and each
two blocks are a cell, in which products of matrices give the similarities of all pairs or
bounds of them; blocks of one component are not compared with each other. So all texts that
share a bucket are compared or linked already. Candidates are verified exactly: they
link if the probability Jaccard similarity, or the plain one of the shingles without
weights, is high enough, as repeats within a text should not hide a copy. The links'
connected components are the classes.

Texts without a word (null, empty, blank) are never grouped. Rows with a null id
are returned alone with a null class. Equal rows fall into one class, of which
``keep_first`` keeps one row: that with the smallest id, of those with the smallest text
hash, of those with the smallest hash of the whole row. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

STEP = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 26
    rows: int = 5
    few: int = 16
    further: int = 4
    depth: int = 4
    block: int = 250_000
    least: int = 200

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def shingles(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of each distinct shingle, in order; number of words and the key of all words, two numbers, of each document."""
    start, end, doc = common.words_of(data, bounds)
    word = common.mix(common.Rolling(common.byte_values()[data]).segment(start, end))
    n = len(bounds) - 1
    n_words = np.bincount(doc, minlength=n)[:n]
    hashes = common.Rolling(word)
    first = np.concatenate([[0], np.cumsum(n_words)])
    whole = common.word_keys(data, bounds, start, end, doc)
    at = np.arange(len(word))
    full = at + k <= first[doc + 1]
    short = (n_words[doc] < k) & (at == first[doc])
    at = at[full | short]
    value = common.mix(hashes.segment(at, np.minimum(at + k, first[doc[at] + 1])) + np.uint64(k))
    order = np.lexsort((value, doc[at]))
    d, v = doc[at][order], value[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    head = np.flatnonzero(new)
    return d[head], v[head], np.diff(np.append(head, len(v))), n_words, whole


def weight(count: np.ndarray) -> np.ndarray:
    """Of a shingle that comes so often: it grows with the logarithm, so that one phrase said over and over is not the whole text."""
    return 1 + np.log(count)


def signatures(doc: np.ndarray, value: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """The element that arrives first in each slot, for each document; documents without elements have zeros."""
    first = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    time, rate = np.zeros(len(value)), weight(count)
    active = np.arange(len(value))
    step = 0
    while len(active):
        step += 1
        draw = common.mix(value[active] + np.uint64(step * int(STEP) % (1 << 64)))
        uniform = ((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        time[active] -= np.log(uniform) / rate[active]
        slot = (common.mix(draw) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        key = doc[active] * m + slot.astype(np.int64)
        now = time[active]
        np.minimum.at(first, key, now)
        won = now == first[key]
        winner[key[won]] = value[active[won]]
        latest = first.reshape(n, m).max(1)
        active = active[now < latest[doc[active]]]
    return winner.reshape(n, m)


def band_keys(winner: np.ndarray, s: Settings) -> np.ndarray:
    key = np.zeros((len(winner), s.bands), np.uint64) + np.arange(1, s.bands + 1, dtype=np.uint64)
    for j in range(s.rows):
        key = common.mix(key * STEP + winner[:, j :: s.rows])
    return key.view(np.int64)


def similarity(va: np.ndarray, ca: np.ndarray, vb: np.ndarray, cb: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets, given their sorted elements and counts, or their plain one if that is more."""
    both, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    plain = len(both) / (len(va) + len(vb) - len(both))
    if ca.max() == 1 and cb.max() == 1:
        return plain
    wa, wb = weight(ca), weight(cb)
    union = np.union1d(va, vb)
    a, b = np.zeros(len(union)), np.zeros(len(union))
    a[np.searchsorted(union, va)] = wa
    b[np.searchsorted(union, vb)] = wb
    with np.errstate(divide="ignore"):
        ratio = b / a
    order = np.argsort(ratio, kind="stable")
    ratio, a, b = ratio[order], a[order], b[order]
    low = np.concatenate([[0], np.cumsum(a)])
    high = np.concatenate([np.cumsum(b[::-1])[::-1], [0]])
    x, y = wa[ia], wb[ib]
    cut = np.searchsorted(ratio, y / x, "right")
    return max(plain, float((1 / (low[cut] / x + high[cut] / y)).sum()))


def signed(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(id, t, k1, k2, bands): a key of the text, the two numbers of the key of its words in their order (null for texts without a word); the bands' keys, and again for shingles counted once where they are not the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text"):
            data, bounds = common.text_bytes(part.column("text"))
            doc, value, count, n_words, whole = shingles(data, bounds, s.words)
            n = part.num_rows
            keys = [band_keys(signatures(doc, value, count, n, s.slots), s)]
            more = np.zeros(n, bool)
            more[doc[count > 1]] = True
            often = more[doc]
            number = np.cumsum(more) - 1
            plain = band_keys(signatures(number[doc[often]], value[often], np.ones(int(often.sum()), np.int64), int(more.sum()), s.slots), s)
            none = n_words == 0
            k1, k2 = (pa.array(whole[:, i], mask=none) for i in (0, 1))
            ends = np.cumsum(s.bands * (1 + more))
            flat = np.empty(int(ends[-1]), np.int64)
            first = np.zeros(len(flat), bool)
            first[(ends - s.bands * (1 + more))[:, None] + np.arange(s.bands)] = True
            flat[first], flat[~first] = keys[0].ravel(), plain.ravel()
            bands = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(common.text_keys(data, bounds)), k1, k2, bands], ["id", "t", "k1", "k2", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, t long, k1 long, k2 long, bands array<long>")


def multisets(texts: DataFrame, sieve: common.Sieve, s: Settings) -> DataFrame:
    """(id, elements, counts) as packed numbers, of the rows whose key ``k`` the sieve lets through; the id is that of the class, one row for each."""
    kind = f"struct<id:{texts.schema['id'].dataType.simpleString()},k1:bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (b.filter(pa.array(sieve.may_have(b.column("k").to_numpy()))) for b in batches)
        for part in common.slices(some, "text"):
            data, bounds = common.text_bytes(part.column("text"))
            doc, value, count, _, whole = shingles(data, bounds, s.words)
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
            pairs = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            node = pa.StructArray.from_arrays([part.column("id"), pa.array(whole[:, 0])], ["id", "k1"])
            yield pa.RecordBatch.from_arrays([node, pa.array([value[i:j].tobytes() for i, j in pairs], pa.binary()), pa.array([count[i:j].astype(np.uint32).tobytes() for i, j in pairs], pa.binary())], ["id", "elements", "counts"])

    found = texts.mapInArrow(run, f"id {kind}, elements binary, counts binary")
    return found.groupBy("id").agg(F.first("elements").alias("elements"), F.first("counts").alias("counts"))


def verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of at least the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            columns = [part.column(c) for c in ("va", "ca", "vb", "cb")]
            keep = []
            for i in range(part.num_rows):
                va, ca, vb, cb = (np.frombuffer(c[i].as_buffer(), np.uint64 if j % 2 == 0 else np.uint32) for j, c in enumerate(columns))
                keep.append(similarity(va, ca, vb, cb) >= s.similarity)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("va"), F.col("counts").alias("ca"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("vb"), F.col("counts").alias("cb"))
    return pairs.join(left, "a").join(right, "b").select("a", "va", "ca", "b", "vb", "cb").mapInArrow(run, f"a {kind}, b {kind}")


def meetings(va: list[np.ndarray], ca: list[np.ndarray], vb: list[np.ndarray], cb: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Plain Jaccard similarity of each set of a with each of b, and a bound of the weighted one: no set has more of its weight in common."""
    size_a, size_b = (np.array([len(x) for x in v]) for v in (va, vb))
    doc_a, doc_b = (np.repeat(np.arange(len(x)), x) for x in (size_a, size_b))
    value_a, value_b = np.concatenate(va), np.concatenate(vb)
    if va is vb:
        both, often = np.unique(value_a, return_counts=True)
        both = both[often > 1]
    else:
        both = np.intersect1d(value_a, value_b)
    repeats = any(x.max() > 1 for x in (*ca, *cb))
    width = min(2048, max(len(both), 1))
    sides = []
    for value, doc, count, n in ((value_a, doc_a, ca, len(va)), (value_b, doc_b, cb, len(vb))):
        share = weight(np.concatenate(count))
        share /= np.bincount(doc, share, n)[doc]
        at = np.minimum(np.searchsorted(both, value), max(len(both) - 1, 0))
        keep = np.flatnonzero(both[at] == value) if len(both) else np.zeros(0, np.int64)
        keep = keep[np.argsort(at[keep], kind="stable")]
        sides.append((at[keep], doc[keep], share[keep], n))
    shared, of_a, of_b = (np.zeros((len(va), len(vb)), np.float32) for _ in range(3))
    for begin in range(0, len(both), width):
        known, parts = [], []
        for column, doc, share, n in sides:
            i, j = np.searchsorted(column, (begin, begin + width))
            known.append(np.zeros((n, width), np.float32))
            parts.append(np.zeros((n, width), np.float32))
            known[-1][doc[i:j], column[i:j] - begin] = 1
            parts[-1][doc[i:j], column[i:j] - begin] = share[i:j]
        shared += known[0] @ known[1].T
        if repeats:
            of_a += parts[0] @ known[1].T
            of_b += known[0] @ parts[1].T
    met = shared.astype(float)
    return met / (size_a[:, None] + size_b[None, :] - met), np.minimum(of_a, of_b)


def across(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) that join the components of each bucket, of its rows (key, id, root): all pairs of different components are compared."""
    sized = members.join(sets.select("id", F.greatest(F.octet_length("counts") / 4, F.lit(s.least)).alias("w")), "id")
    groups = sized.groupBy("key", "root").agg(F.sum("w").alias("own"))
    buckets = groups.groupBy("key").agg(F.sum("own").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    # a component larger than a block has blocks of its own
    solo = F.col("own") > s.block
    number = F.when(solo, F.pmod(F.xxhash64("id"), F.ceil(F.col("own") / s.block))).otherwise(F.pmod(F.xxhash64("root"), F.ceil(F.col("all") / s.block)))
    dealt = common.stored(members.join(groups, ["key", "root"]).join(buckets, "key").withColumn("solo", F.when(solo, F.col("root"))).select("key", "id", "root", "solo", F.xxhash64("solo", number).alias("block")))
    blocks = dealt.groupBy("key").agg(F.collect_set(F.struct("block", F.col("solo").alias("of"))).alias("blocks"))
    others = F.filter("blocks", lambda x: F.col("solo").isNull() | x["of"].isNull() | (x["of"] != F.col("solo")))
    cells = dealt.join(blocks, "key").select("key", "id", "root", "block", F.explode(others).alias("other"))
    cells = cells.select("key", F.least("block", "other.block").alias("ci"), F.greatest("block", "other.block").alias("cj"), "block", "id", "root").join(sets, "id")

    def compare(cell: pa.Table) -> pa.Table:
        block, ci, cj = cell.column("block").to_numpy(), cell.column("ci")[0].as_py(), cell.column("cj")[0].as_py()
        values, counts = ([np.frombuffer(x.as_buffer(), t) for x in cell.column(c)] for c, t in (("elements", np.uint64), ("counts", np.uint32)))
        fields = [x.dictionary_encode().indices.to_numpy().astype(np.int64) for x in cell.column("root").combine_chunks().flatten()]
        root = np.unique(fields[0] * (cell.num_rows + 1) + fields[1], return_inverse=True)[1]
        left, right = np.flatnonzero(block == ci), np.flatnonzero(block == cj)
        up = list(range(int(root.max()) + 1))
        found = []

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        if len(left) and len(right):
            va, ca = ([x[i] for i in left.tolist()] for x in (values, counts))
            vb, cb = (va, ca) if ci == cj else ([x[i] for i in right.tolist()] for x in (values, counts))
            plain, most = meetings(va, ca, vb, cb)
            apart = root[left][:, None] != root[right][None, :]
            if ci == cj:
                apart = np.triu(apart)
            sure = apart & (plain >= s.similarity)
            maybe = apart & ~sure & (most >= s.similarity - 1e-3)
            for flags in (sure, maybe):
                for i, j in zip(*(side[x].tolist() for side, x in zip((left, right), np.nonzero(flags), strict=True)), strict=True):
                    a, b = top(root[i]), top(root[j])
                    if a != b and (flags is sure or similarity(values[i], counts[i], values[j], counts[j]) >= s.similarity):
                        up[max(a, b)] = min(a, b)
                        found.append((i, j))
        at = np.array(found, np.int64).reshape(-1, 2)
        ids = cell.column("id").combine_chunks()
        return pa.table([ids.take(pa.array(at[:, 0])), ids.take(pa.array(at[:, 1]))], ["a", "b"])

    kind = members.schema["id"].dataType.simpleString()
    # so many partitions even if they are small: a cell is little data and much work
    parts = 2 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "key", "ci", "cj").groupBy("key", "ci", "cj").applyInArrow(compare, f"a {kind}, b {kind}")


def placed(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(id, t, k1, root): each row with its id, text hash, hash of words, and the class (smallest id, its hash of words) of its group; the last two are null for rows of no group."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shelf = common.Shelf(spark)
    rows = shelf.put(signed(docs, id_col, text_col, s))
    # a class of copies is one row from here on, summed where it is read
    alike = rows.where("k1 IS NOT NULL AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    classes = shelf.put(alike.select("k1", "k2", F.struct("id", "k1").alias("id"), "bands"))
    singles = classes.select("id", "bands")
    twin = F.get("bands", F.col("band") - s.bands)
    buckets = singles.select("id", "bands", F.posexplode("bands").alias("band", "key")).where((F.col("band") < s.bands) | (F.col("key") != twin)).select("id", "band", "key")
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = shelf.put(buckets.join(sizes, "key").select("key", "id", "band", "n"))
    degree = shelf.put(shared.groupBy("id").agg(F.sum("n").alias("degree")))
    common.released(spark)
    # texts that share no bucket are left out where they are read
    sieve = common.Sieve(degree.select(F.xxhash64("id.id").alias("k")))
    sets = shelf.put(multisets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("k")), sieve, s))

    def grouped(rows: DataFrame) -> DataFrame:
        """Rows (key, id, degree, …) of buckets of two or more, with the bucket's size n, hub and smallest id."""
        found = rows.groupBy("key").agg(F.count("*").alias("n"), F.max_by("id", F.struct("degree", "id")).alias("hub"), F.min("id").alias("low")).where("n > 1")
        return rows.join(found, "key")

    def candidates(level: DataFrame) -> DataFrame:
        """Pairs (id, other): all in a small bucket; with the hub and the smallest id in a large one."""
        large, small = level.where(F.col("n") > s.few), level.where(F.col("n") <= s.few)
        starred = [large.select("id", F.col(c).alias("other")).distinct() for c in ("hub", "low")]
        lists = small.groupBy("key").agg(F.collect_list("id").alias("ids"))
        paired = lists.select("ids", F.explode("ids").alias("id")).select("id", F.explode(F.filter("ids", lambda x: x > F.col("id"))).alias("other"))
        return starred[0].unionByName(starred[1]).unionByName(paired)

    with_degree = shared.join(degree, "id")
    level = shelf.put(with_degree.where(F.col("n") <= s.few).select("key", "id", "n", "band", "degree", F.col("id").alias("hub"), F.col("id").alias("low")).unionByName(grouped(with_degree.where(F.col("n") > s.few).drop("n")).select("key", "id", "n", "band", "degree", "hub", "low")))
    # a table for each level, so that no plan is large
    met = [shelf.put(candidates(level))]
    # the keys of the bands that follow split a large bucket, one after the other
    half, within = F.floor(F.col("band") / s.bands).cast("int") * s.bands, F.col("band") % s.bands
    ahead = F.transform(F.sequence(F.lit(1), F.lit(s.further)), lambda j: F.element_at("bands", (half + (within + j) % s.bands + 1).cast("int")))
    level = level.where(F.col("n") > s.few).join(singles, "id").select("key", "id", "degree", ahead.alias("ahead"))
    for _ in range(s.depth - 1):
        split = level.repartition("id", "key").select("key", "id", "degree", "ahead", F.posexplode("ahead").alias("at", "next"))
        split = split.select(F.xxhash64("key", "next").alias("key"), "id", "degree", F.slice("ahead", F.col("at") + 2, F.lit(s.further)).alias("ahead")).distinct()
        level = shelf.put(grouped(split))
        met.append(shelf.put(candidates(level)))
        level = level.where(F.col("n") > s.few).select("key", "id", "degree", "ahead")
        if level.isEmpty():
            break
    pairs = shelf.put(reduce(DataFrame.unionByName, met).where("id <> other").select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct())
    shelf.clear(rows, classes, shared, sets, pairs)
    common.released(spark)
    links = shelf.put(verified(pairs, sets, s))
    shelf.drop(pairs)
    roots = common.components(links)
    large = shared.where(F.col("n") > s.few).select("key", "id")
    if not large.isEmpty():
        members = shelf.put(large.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
        common.released(spark)
        links = shelf.put(across(members, sets, s))
        if not links.isEmpty():
            roots = common.components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
    rooted = shelf.put(classes.select("k1", "k2", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("k1", "k2", F.coalesce("root", "id").alias("root")))
    shelf.clear(rows, rooted)
    known = rows.where("id IS NOT NULL").select("id", "t", "k1", "k2").join(rooted, ["k1", "k2"], "left").select("id", "t", "k1", "root")
    return known.unionByName(rows.where("id IS NULL").select("id", "t", F.lit(None).cast("long").alias("k1"), F.lit(None).cast(known.schema["root"].dataType).alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, class_id): the smallest id of the document's group."""
    return placed(docs, id_col, text_col, s).select(F.col("id").alias(id_col), F.coalesce("root.id", "id").alias("class_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """The documents without those that are not the first of their group; all columns. Only documents that may go are shuffled."""
    shelf = common.Shelf(docs.sparkSession)
    grouped = shelf.put(placed(docs, id_col, text_col, s).where("root IS NOT NULL"))
    first = (F.col("id") == F.col("root.id")) & (F.col("k1") == F.col("root.k1"))
    chosen = grouped.where(first).groupBy("root").agg(F.min("t").alias("t"), F.count("*").alias("n"))
    # one text a class; its other rows go, and of equal rows all but one
    stays = chosen.select(F.col("root.id").alias("id"), "t").distinct()
    gone = shelf.put(grouped.select("id", "t").distinct().join(stays, ["id", "t"], "left_anti"))
    twice = shelf.put(grouped.where(first).join(chosen.where("n > 1").select("root", F.col("t").alias("best")), "root").where("t = best").groupBy("id", "t").agg(F.count("*").alias("n")).where("n > 1").select("id", "t"))
    shelf.drop(grouped)
    sieve = common.Sieve(gone.unionByName(twice).select(F.col("t").alias("k")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    shape = T.StructType([T.StructField("row", docs.schema), T.StructField("id", docs.schema[id_col].dataType), T.StructField("t", T.LongType())])

    def sifted(some: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column("row")
                flat = pa.RecordBatch.from_arrays([rows.field(id_col), rows.field(text_col), rows], ["id", "text", "row"])
                for part in common.slices(iter([flat]), "text"):
                    key = common.text_keys(*common.text_bytes(part.column("text")))
                    yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(key)], ["row", "id", "t"]).filter(pa.array(sieve.may_have(key) == some))

        return run

    maybe, sure = (whole.mapInArrow(sifted(some), shape) for some in (True, False))
    left = maybe.join(gone, ["id", "t"], "left_anti")
    if not twice.isEmpty():
        equal = Window.partitionBy("id", "t").orderBy(F.xxhash64(F.to_json("row")))
        again = left.join(twice, ["id", "t"], "left_semi").withColumn("n", F.row_number().over(equal)).where("n = 1").drop("n")
        left = left.join(twice, ["id", "t"], "left_anti").unionByName(again)
    return left.unionByName(sure).select("row.*")
