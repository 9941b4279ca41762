"""Language-model scoring by a hierarchical Pitman-Yor model of words.

A token is drawn in the restaurant of its context, the class of the word before it
(a hash deals words into ``CONTEXTS`` classes; before the first word stands the end
of a text). A customer there either shares a table with earlier ones of its word or
opens a new one, whose dish is drawn in the word restaurant, the parent that all
context restaurants share. A new table there has its word spelled by a hierarchy of
character restaurants: one for each context of up to three preceding bytes of the
word, every context's restaurant having that of the next shorter one as its parent,
down to a uniform base. So every string has a probability after every word, and those
of all strings sum to one. Contexts of both kinds are classed by hash so that each has
exactly one parent and their number is fixed.

Seating is sampled by Gibbs sweeps. In turn, each restaurant's tables for each dish are
drawn anew from the Chinese restaurant process, given its parent's probabilities and
the restaurant's number of tables: first in the contexts, whose tables are the word
restaurant's customers, then there, whose tables are the customers of the spelling
model, and there from the longest contexts to the root. Within a sweep the words are
dealt to buckets that know the totals of the sweep before. After ``burn_in`` sweeps
``samples`` seatings are kept, and each restaurant's probabilities are the mean of theirs.

Counts are of all training documents. Documents are read once, in blocks, which keep
their texts as numbers; a block's distinct pairs of a context and a word are counted
and meet those of the other blocks by the word's hash, so a frequent word or pair is
one entry of a block. A bucket reads its blocks' entries one after the other and holds
each pair once; a word has at most ``CONTEXTS`` of them. Buckets are as many as the
texts' size asks for. Nulls and empty texts are the end token alone; equal rows are
scored alike; null ids are allowed. Without any training token the base scores are 0
and words are spelled uniformly. Other columns are never read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import BLOCK_BYTES, Places, pack, unpack

#: Symbols: 0 before a word, 1 its end, then the bytes.
SYMBOLS = 258
#: Classes of the second and the third preceding symbol.
FANS = (16, 4)
SLOTS = (1, SYMBOLS, SYMBOLS * FANS[0], SYMBOLS * FANS[0] * FANS[1])
CLASS = [(common.mix(np.arange(SYMBOLS, dtype=np.uint64) + np.uint64(77 + i)) % np.uint64(f)).astype(np.int64) for i, f in enumerate(FANS)]
#: The token that ends each text; no word is empty.
END = b""
#: Classes of the preceding word.
CONTEXT_BITS = 14
CONTEXTS = 1 << CONTEXT_BITS
#: Bytes of text that a bucket stands for, and packed bytes of blocks that meet a bucket at once.
BUCKET_BYTES, MEET_BYTES = 16_000_000, 32_000_000


@dataclass(frozen=True)
class Settings:
    samples: int = 3
    burn_in: int = 2
    spelling_sweeps: int = 4
    strength: float = 1.0
    seed: int = 19


def symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words with their ends: symbol, slot of its longest context, and n + 1 offsets."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    symbol = np.ones(bounds[-1], np.int64)
    inner = np.ones(bounds[-1], bool)
    inner[bounds[1:] - 1] = False
    symbol[inner] = np.frombuffer(b"".join(words), np.uint8).astype(np.int64) + 2
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    before = []
    for k in (1, 2, 3):
        p = np.zeros(len(symbol), np.int64)
        p[k:] = symbol[:-k] if k <= len(symbol) else 0
        p[place < k] = 0
        before.append(p)
    slot = (before[0] * FANS[0] + CLASS[0][before[1]]) * FANS[1] + CLASS[1][before[2]]
    return symbol, slot, bounds


def parents(slot: np.ndarray, level: int) -> np.ndarray:
    """Slots of the contexts one symbol shorter than those of a level."""
    return slot // FANS[1] if level == 3 else slot // FANS[0] if level == 2 else np.zeros_like(slot)


def seat(customers: np.ndarray, open_: np.ndarray, base: np.ndarray, more: np.ndarray | float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, given all its customers, drawn customer by customer.

    With ``t`` tables so far, the next customer opens one in proportion to
    (open_ + discount t) (base + more t): ``open_`` is the strength and the discounts of
    the restaurant's other tables, ``base`` the parent's probability of the dish without
    this restaurant's customers there and ``more`` what each of them adds. Those who come
    later have the same dish, and a table that is opened now changes what their seating
    weighs: by about ((j - discount t) / (n - discount t)) to the power of the discount less
    what the table adds to the proportion. The first 64 are seated singly; after them, as
    many at once as are seated already, with a Poisson number of new tables.
    """
    tables = np.minimum(customers, 1).astype(float)
    more, half = np.broadcast_to(more, tables.shape), (1 + discount) / 2

    def pull(active: np.ndarray, j: float) -> np.ndarray:
        t, n = tables[active], customers[active]
        now, then = ((open_[active] + discount * x) * (base[active] + more[active] * x) for x in (t, t + 1))
        room = np.maximum(j + 1 - discount * t - half, 1e-9) / np.maximum(n - discount * t - half, 1e-9)
        return now * room ** np.clip(discount - (then - now), -1, 1)

    j, active = 1, np.flatnonzero(customers > 1)
    while len(active) and j < 64:
        s = pull(active, j)
        tables[active] += rng.random(len(active)) < s / (j - discount * tables[active] + s)
        j += 1
        active = active[customers[active] > j]
    while len(active):
        upto = np.minimum(customers[active], 2 * j)
        s = pull(active, np.sqrt(j * upto.astype(float)))
        free = np.maximum(s - discount * tables[active], 1 - j)
        mean = s * np.log(np.maximum((upto + free) / (j + free), 1))
        tables[active] += np.minimum(rng.poisson(np.minimum(mean, 1e15)), upto - j)
        j *= 2
        active = active[customers[active] > j]
    return tables


def discount_of(counts: np.ndarray) -> float:
    """From how many dishes have one and two customers."""
    one, two = float((counts == 1).sum()), float((counts == 2).sum())
    return min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5


def located(cells: list[np.ndarray], symbol: np.ndarray, slot: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level from the root on: the slots of the contexts, and where their dishes are among the cells, or -1."""
    slots = [slot]
    for level in (3, 2, 1):
        slots.append(parents(slots[-1], level))
    out = []
    for level, s in enumerate(reversed(slots)):
        code, own = s * SYMBOLS + symbol, cells[level]
        if not len(own):
            out.append((s, np.full(len(s), -1), own))
            continue
        at = np.minimum(np.searchsorted(own, code), len(own) - 1)
        out.append((s, np.where(own[at] == code, at, -1), own))
    return out


@dataclass
class Spelling:
    """One seating: for each level the cells (context and dish) that have customers, their discounted shares, and what goes to the parent."""

    cells: list[np.ndarray]
    shares: list[np.ndarray]
    rest: list[np.ndarray]

    def log10(self, symbol: np.ndarray, slot: np.ndarray, bounds: np.ndarray, places: list | None = None) -> np.ndarray:
        p = np.full(len(symbol), 1 / (SYMBOLS - 1))
        for (s, at, _), shares, rest in zip(places or located(self.cells, symbol, slot), self.shares, self.rest, strict=True):
            # the last share is that of a dish without customers
            p = shares[at] + rest[s] * p
        total = np.concatenate([[0.0], np.cumsum(np.log10(p))])
        return total[bounds[1:]] - total[bounds[:-1]]


def sample_spelling(slot: np.ndarray, symbol: np.ndarray, count: np.ndarray, s: Settings, sweep: int) -> Spelling:
    """A seating of the character restaurants for the customers of the longest contexts."""
    rng = np.random.default_rng([s.seed, sweep])
    # cells (restaurant, dish) of each level and where a cell's tables are customers
    order = np.argsort(slot * SYMBOLS + symbol)
    cells = [(slot * SYMBOLS + symbol)[order]]
    up = []
    for level in (3, 2, 1):
        code = parents(cells[-1] // SYMBOLS, level) * SYMBOLS + cells[-1] % SYMBOLS
        higher, where = np.unique(code, return_inverse=True)
        up.append(where)
        cells.append(higher)
    leaf = count[order].astype(float)
    levels = [3, 2, 1, 0]
    tables = [np.minimum(leaf, 1)]
    for where, higher in zip(up, cells[1:], strict=True):
        tables.append(np.minimum(np.bincount(where, tables[-1], len(higher)), 1))
    for _ in range(s.spelling_sweeps):
        customers = [leaf]
        for where, t, higher in zip(up, tables[:-1], cells[1:], strict=True):
            customers.append(np.bincount(where, t, len(higher)))
        p, weigh = np.full(len(cells[3]), 1 / (SYMBOLS - 1)), np.zeros(len(cells[3]))
        shares, rest = [None] * 4, [None] * 4
        for k in (3, 2, 1, 0):  # from the root down
            level = levels[k]
            restaurant = cells[k] // SYMBOLS
            c = customers[k]
            discount = discount_of(c)
            open_ = np.bincount(restaurant, tables[k], SLOTS[level])
            others = s.strength + discount * (open_[restaurant] - tables[k])
            tables[k] = seat(c, others, np.maximum(p - weigh * tables[k], 1e-12), weigh, discount, rng)
            open_ = np.bincount(restaurant, tables[k], SLOTS[level])
            all_ = np.bincount(restaurant, c, SLOTS[level])
            back = (s.strength + discount * open_) / (s.strength + all_)
            own = (c - discount * tables[k]) / (s.strength + all_[restaurant])
            shares[level] = np.append(own, 0.0)
            rest[level] = back
            if k:
                p, weigh = (own + back[restaurant] * p)[up[k - 1]], (1 / (s.strength + all_))[restaurant][up[k - 1]]
    return Spelling(cells[::-1], shares, rest)


# --- words ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Totals:
    """What a sweep needs to know of all buckets: tables of each context, customers and tables of the word restaurant, and both discounts."""

    open_at: np.ndarray
    customers: float
    tables: float
    of_contexts: float
    of_words: float


def word_shares(customers: np.ndarray, tables: np.ndarray, log: np.ndarray, t: Totals, s: Settings) -> np.ndarray:
    """log10 of the words' probabilities in the word restaurant; ``log`` has those of their spellings, which may be below the smallest double."""
    spelled = log + math.log10((s.strength + t.of_words * t.tables) / (s.strength + t.customers))
    with np.errstate(divide="ignore"):
        seen = np.log10(np.maximum(customers - t.of_words * tables, 0) / (s.strength + t.customers))
    top = np.maximum(spelled, seen)
    return top + np.log10(10.0 ** (spelled - top) + 10.0 ** (seen - top))


def seat_words(of: np.ndarray, at: np.ndarray, count: np.ndarray, seated: np.ndarray, singles: np.ndarray, customers: np.ndarray, tables: np.ndarray, log: np.ndarray, t: Totals, s: Settings, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sweep over some words: tables of their cells (word ``of``, context ``at``, customers ``count``, tables so far ``seated``) and the words' customers and tables in the word restaurant.

    A cell of one customer has one table; ``singles`` has their number for each word,
    the others are given one by one.
    """
    spelled = 10.0**log
    weigh = 1 / (s.strength + t.customers)
    back = (s.strength + t.of_words * t.tables) * weigh * spelled
    # the parent's probability without the cell's own customers there
    others = customers[of] - seated
    base = np.maximum((others - t.of_words * np.clip(tables[of], 1, np.maximum(others, 1))) * weigh, -t.of_words * weigh) + back[of]
    cells = seat(count, s.strength + t.of_contexts * np.maximum(t.open_at[at] - seated, 0), base, weigh, t.of_contexts, rng)
    customers = singles + np.bincount(of, cells, len(singles))
    return cells, customers, seat(customers, s.strength + t.of_words * np.maximum(t.tables - tables, 0), spelled, 0.0, t.of_words, rng)


class Block:
    def __init__(self, number: int, kind: pa.DataType):
        self.number, self.kind, self.places, self.ids, self.held, self.seqs, self.size = number, kind, Places(), [], [], [], 0
        self.end = self.places[END]

    def add(self, ident, held: bool, text: bytes) -> None:
        words = text.lower().split()
        seq = np.empty(len(words) + 1, np.uint32)
        seq[:-1] = np.fromiter(map(self.places.__getitem__, words), np.uint32, len(words))
        seq[-1] = self.end
        self.ids.append(ident)
        self.held.append(held)
        self.seqs.append(seq)
        self.size += len(text) + 64


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    block, count = None, 0
    for part in common.slices(batches, "text"):
        base = part.column("part")[0].as_py() << 24
        for ident, held, text in zip(part.column("id").to_pylist(), part.column("held").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            block = block or Block(base + count, part.schema.field("id").type)
            block.add(ident, held, text or b"")
            if block.size >= BLOCK_BYTES:
                yield block
                block, count = None, count + 1
    if block:
        yield block


def keys_of(seq: np.ndarray, sizes: np.ndarray, classes: np.ndarray, end_class: int) -> np.ndarray:
    """Word and context of each token; a text's first token comes after an end."""
    before = np.empty(len(seq), np.int64)
    before[1:] = classes[seq[:-1]]
    before[np.cumsum(sizes) - sizes] = end_class
    return (seq.astype(np.int64) << CONTEXT_BITS) | before


def counted(keys: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often each comes in training."""
    both = np.sort((keys << 1) | held)
    head = np.flatnonzero(np.diff(both >> 1, prepend=-1))
    return both[head] >> 1, np.add.reduceat(1 - (both & 1), head).astype(np.uint32)


def table_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds.values(), strict=True)], list(kinds))


def split_words(blob: bytes, lengths: np.ndarray) -> list[bytes]:
    cuts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).tolist()
    return [blob[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def binaries(*names: str) -> str:
    return ", ".join(f"{n} binary" for n in names)


class Bucket:
    """The words of a hash bucket and their cells, block by block."""

    def __init__(self, number: int):
        self.number, self.places, self.parts, self.pending = number, Places(), [], 0

    def add(self, words: list[bytes], n_cells: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        idx = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        self.parts.append(((np.repeat(idx, n_cells) << CONTEXT_BITS) | classes, counts.astype(np.int64), counts == 0))
        self.pending += len(counts)
        if self.pending > 2 * len(self.parts[0][0]) + 500_000:
            self.compact()
        return idx

    def compact(self) -> None:
        key, count, none = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, count, none = key[order], count[order], none[order]
        head = np.flatnonzero(np.diff(key, prepend=-1))
        self.parts, self.pending = [(key[head], np.add.reduceat(count, head), np.logical_or.reduceat(none, head))], 0

    def summary(self) -> tuple:
        self.compact()
        ((key, count, none),) = self.parts
        words = list(self.places)
        of, at = key >> CONTEXT_BITS, key & (CONTEXTS - 1)
        # a cell that is told apart from its only training block's own count is kept; the rest have one customer or none
        more = (count > 1) | ((count == 1) & none)
        single = (count == 1) & ~more
        per = lambda x, n: np.bincount(x, minlength=n)[:n]
        singles = per(of[single], len(words))
        total = np.bincount(of, count, len(words)).astype(np.uint64)
        customers = singles + per(of[more], len(words))
        sums = (int(count.sum()), int((total > 0).sum()), int((count == 1).sum()), int((count == 2).sum()), int((customers == 1).sum()), int((customers == 2).sum()))
        state = [pack(x.astype(np.uint32)) for x in (singles, customers, np.minimum(customers, 1), of[more], at[more], count[more], np.ones(int(more.sum())), np.zeros(int(more.sum())))]
        return (self.number, zstandard.compress(b"".join(words)), pack(np.array([len(w) for w in words], np.uint32)), pack(total), *state, [], np.bincount(at, count, CONTEXTS).astype(np.int64).tolist(), per(at[single], CONTEXTS).tolist(), per(at[single | more], CONTEXTS).tolist(), *sums)


STATE = ["singles", "customers", "tables", "of", "at", "count", "seated", "sum"]
SUMS = ["tokens", "kinds", "ones", "twos", "word_ones", "word_twos"]
BUCKET = f"bucket int, {binaries('words', 'lengths', 'total', *STATE)}, kept array<binary>, seen_at array<long>, singles_at array<long>, open_at array<long>, {', '.join(f'{c} long' for c in SUMS)}"
MEMBER = f"bucket int, block long, {binaries('idx', 'n_cells', 'classes')}"


def summed(rows: DataFrame, column: str) -> np.ndarray:
    """The sum of arrays of ``CONTEXTS`` numbers."""
    got = rows.select(F.posexplode(column).alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # CONTEXTS rows
    out = np.zeros(CONTEXTS)
    out[got.column("i").to_numpy()] = got.column("n").to_numpy()
    return out


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every document; learned from those that are not held out.

    ``score`` is log10 of the text's probability, its unseen words spelled; perplexity
    is that of a token.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shelf = common.Shelf(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    n_bytes = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n_buckets = max(2 * int(spark.sparkContext.defaultParallelism), -(-int(n_bytes) // BUCKET_BYTES))
    end_crc = np.array([zlib.crc32(END)], np.int64)
    class_of = lambda crc: (common.mix(crc.astype(np.uint64) * common.BASE + np.uint64(9)) >> np.uint64(64 - CONTEXT_BITS)).astype(np.int64)
    end_class = int(class_of(end_crc)[0])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's texts as numbers (kind 0), and its words and cells for each bucket (kind 1)."""
        for block in blocks_of(batches):
            own = list(block.places)
            crc = np.fromiter(map(zlib.crc32, own), np.int64, len(own))
            order = np.argsort(crc % n_buckets, kind="stable")
            rank = np.empty(len(own), np.uint32)
            rank[order] = np.arange(len(own))  # words of a bucket have numbers that follow each other
            sizes = np.array([len(q) for q in block.seqs], np.int64)
            seq, classes, bucket = rank[np.concatenate(block.seqs)], class_of(crc[order]), crc[order] % n_buckets
            cells, count = counted(keys_of(seq, sizes, classes, end_class), np.repeat(np.array(block.held, bool), sizes))
            n_cells = np.bincount(cells >> CONTEXT_BITS, minlength=len(own))
            edge = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            first = np.concatenate([[0], np.cumsum(n_cells)])
            kind = pa.list_(block.kind)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([None], pa.int32()), pa.array([block.number]), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([pack(classes.astype(np.uint16))], pa.binary()), pa.array([pack(seq)], pa.binary()), pa.array([block.ids], kind), pa.array([block.held], pa.list_(pa.bool_())), pa.array([sizes.tolist()], pa.list_(pa.int32()))], NAMES)
            for a, b in zip(edge, [*edge[1:], len(own)], strict=True):
                some, x, y = [own[i] for i in order[a:b].tolist()], first[a], first[b]
                row = [zstandard.compress(b"".join(some)), pack(np.array([len(w) for w in some], np.uint32)), pack(n_cells[a:b].astype(np.uint32)), pack((cells[x:y] & (CONTEXTS - 1)).astype(np.uint16)), pack(count[x:y])]
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([int(bucket[a])], pa.int32()), pa.array([block.number]), *(pa.array([v], pa.binary()) for v in row), pa.array([None], kind), pa.array([None], pa.list_(pa.bool_())), pa.array([None], pa.list_(pa.int32()))], NAMES)

    first = texts.mapInArrow(read, f"kind int, bucket int, block long, {binaries('words', 'lengths', 'n_cells', 'classes', 'data')}, idents array<{id_type}>, held array<boolean>, sizes array<int>")
    blocks, entries = shelf.put_by(first, "kind", 2)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's words by their numbers in the bucket (kind 0), and the bucket (kind 1)."""
        shape = pa.schema([("kind", pa.int32()), *MERGED])
        make = lambda **x: pa.RecordBatch.from_pylist([x], schema=shape)
        now = None
        for part in batches:
            for r in part.to_pylist():
                if now is None or now.number != r["bucket"]:
                    if now is not None:
                        yield make(kind=1, **dict(zip(BUCKET_NAMES, now.summary(), strict=True)))
                    now = Bucket(r["bucket"])
                idx = now.add(split_words(zstandard.decompress(r["words"]), unpack(r["lengths"], np.uint32)), unpack(r["n_cells"], np.uint32), unpack(r["classes"], np.uint16), unpack(r["data"], np.uint32))
                yield make(kind=0, bucket=r["bucket"], block=r["block"], idx=pack(idx.astype(np.uint32)), n_cells=r["n_cells"], classes=r["classes"])
        if now is not None:
            yield make(kind=1, **dict(zip(BUCKET_NAMES, now.summary(), strict=True)))

    dealt = entries.select("bucket", "block", "words", "lengths", "n_cells", "classes", "data").repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "block")
    of_blocks, of_buckets = shelf.put_by(dealt.mapInArrow(merge, f"kind int, block long, {binaries('idx', 'n_cells', 'classes')}, {BUCKET}"), "kind", 2)
    members, buckets = of_blocks.select(*MEMBER_NAMES), of_buckets.select(*BUCKET_NAMES)
    shelf.drop(entries)
    common.released(spark)
    sums = buckets.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS]).first()
    n, v = int(sums.tokens), int(sums.kinds)
    share = lambda one, two: min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
    of_contexts, of_words = share(sums.ones, sums.twos), share(sums.word_ones, sums.word_twos)
    seen_at = summed(buckets, "seen_at")

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Customers of the spelling model: the tables of the word restaurant."""
        for part in batches:
            for blob, lengths, tables in zip(*(part.column(c).to_pylist() for c in ("words", "lengths", "tables")), strict=True):
                tables = unpack(tables, np.uint32)
                words = split_words(zstandard.decompress(blob), unpack(lengths, np.uint32))
                symbol, slot, bounds = symbols([w for w, t in zip(words, tables.tolist(), strict=True) if t])
                at, where = np.unique(slot * SYMBOLS + symbol, return_inverse=True)
                total = np.bincount(where, np.repeat(tables[tables > 0], np.diff(bounds)), len(at)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total)], ["cell", "n"])

    def spelling(rows: DataFrame, sweep: int) -> Spelling:
        cells = rows.select("words", "lengths", "tables").mapInArrow(spelled, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most a cell for each context and symbol
        cell, customers = (cells.column(c).to_numpy() for c in ("cell", "n"))
        return sample_spelling(cell // SYMBOLS, cell % SYMBOLS, customers, s, sweep)

    def totals(rows: DataFrame) -> Totals:
        got = rows.agg(F.sum("customers_sum"), F.sum("tables_sum")).first()
        return Totals(summed(rows, "open_at"), float(got[0] or 0), float(got[1] or 0), of_contexts, of_words)

    def sweep(rows: DataFrame, model, t: Totals, number: int, keep: bool) -> DataFrame:
        spread, seed = spark.sparkContext.broadcast((model, t)), s.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, t = spread.value
            for part in batches:
                for i in range(part.num_rows):
                    one = part.slice(i, 1)
                    r = one.to_pylist()[0]
                    words = split_words(zstandard.decompress(r["words"]), unpack(r["lengths"], np.uint32))
                    singles, customers, tables, of, at, count, seated, total = (unpack(r[c], np.uint32).astype(np.int64) for c in STATE)
                    log = model.log10(*symbols(words))
                    cells, customers, tables = seat_words(of, at, count, seated, singles, customers, tables, log, t, s, np.random.default_rng([seed, number, r["bucket"]]))
                    state = [pack(x.astype(np.uint32)) for x in (customers, tables)]
                    new = r | {"customers": state[0], "tables": state[1], "seated": pack(cells.astype(np.uint32)), "open_at": (np.array(r["singles_at"]) + np.bincount(at, cells, CONTEXTS).astype(np.int64)).tolist(), "customers_sum": int(customers.sum()), "tables_sum": int(tables.sum())}
                    if keep:
                        new |= {"sum": pack((total + cells).astype(np.uint32)), "kept": [*r["kept"], *state]}
                    yield pa.RecordBatch.from_pylist([new], schema=one.schema)

        return shelf.put(rows.mapInArrow(run, rows.schema))

    rows = buckets.withColumns({"customers_sum": F.lit(None).cast("long"), "tables_sum": F.lit(None).cast("long")})
    # at the start each cell has one table, and each word that has customers
    opened = summed(buckets, "open_at")
    t = Totals(opened, float(opened.sum()), float(v), of_contexts, of_words)
    models, kept = [], []
    for number in range(s.burn_in + s.samples):
        model = spelling(rows, number)
        last, rows = rows, sweep(rows, model, t, number, number >= s.burn_in)
        shelf.drop(last if number else of_buckets)
        t = totals(rows)
        if number >= s.burn_in:
            models.append(model)
            kept.append(t)
    common.released(spark)
    spread = spark.sparkContext.broadcast((models, kept))
    samples = s.samples

    sizes = members.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("classes") + F.octet_length("idx")) / MEET_BYTES).cast("int").alias("parts"))
    sizes = shelf.put(sizes)
    mine = members.join(sizes, "bucket").select("*", F.pmod(F.xxhash64("block"), F.col("parts")).alias("salt")).drop("parts")
    theirs = rows.select("bucket", "words", "lengths", "total", "of", "at", "count", "sum", "kept").join(sizes, "bucket").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("salt")).drop("parts")

    def give_back(found: pa.Table, own: pa.Table) -> pa.Table:
        """The words' probabilities and counts, and the cells' customers less discounts, to the blocks that have them."""
        models, kept = spread.value
        r = own.to_pylist()[0]
        total, of, at, count, seated = unpack(r["total"], np.uint64), *(unpack(r[c], np.uint32).astype(np.int64) for c in ("of", "at", "count", "sum"))
        made = symbols(split_words(zstandard.decompress(r["words"]), unpack(r["lengths"], np.uint32)))
        places = located(models[0].cells, *made[:2])
        logs = np.array([word_shares(unpack(r["kept"][2 * i], np.uint32), unpack(r["kept"][2 * i + 1], np.uint32), models[i].log10(*made, places), kept[i], s) for i in range(samples)])
        top = logs.max(0)
        log = (top + np.log10((10.0 ** (logs - top)).mean(0))).astype(np.float32)
        key, value = (of << CONTEXT_BITS) | at, (count - of_contexts * seated / samples).astype(np.float32)
        out = []
        for block, idx, n_cells, classes in zip(*(found.column(c).to_pylist() for c in ("block", "idx", "n_cells", "classes")), strict=True):
            idx = unpack(idx, np.uint32).astype(np.int64)
            mine = (np.repeat(idx, unpack(n_cells, np.uint32)) << CONTEXT_BITS) | unpack(classes, np.uint16)
            where = np.minimum(np.searchsorted(key, mine), max(len(key) - 1, 0))
            hit = key[where] == mine if len(key) else np.zeros(len(mine), bool)
            out.append((block, r["bucket"], pack(log[idx]), pack(total[idx]), zstandard.compress(np.packbits(hit).tobytes()), len(mine), pack(value[where[hit]]) if hit.any() else None))
        return table_of(out, {"block": pa.int64(), "bucket": pa.int32(), "logs": pa.binary(), "counts": pa.binary(), "hits": pa.binary(), "cells": pa.int64(), "values": pa.binary()})

    given = mine.groupBy("bucket", "salt").cogroup(theirs.groupBy("bucket", "salt")).applyInArrow(give_back, "block long, bucket int, logs binary, counts binary, hits binary, cells long, values binary")
    open_at = np.mean([t.open_at for t in kept], 0)
    back = spark.sparkContext.broadcast((np.log10((s.strength + of_contexts * open_at) / (s.strength + seen_at)), s.strength + seen_at))

    def add_up(found: pa.Table, own: pa.Table) -> pa.Table:
        rest, all_ = back.value
        found = found.sort_by("bucket")
        join = lambda c, kind: np.concatenate([np.zeros(0, kind), *(unpack(x, kind) for x in found.column(c).to_pylist() if x)])
        log, count = join("logs", np.float32).astype(float), join("counts", np.uint64).astype(float)
        hits = np.concatenate([np.unpackbits(np.frombuffer(zstandard.decompress(x), np.uint8), count=n) for x, n in zip(found.column("hits").to_pylist(), found.column("cells").to_pylist(), strict=True)]).astype(bool)
        classes, seq = unpack(own.column("classes")[0].as_py(), np.uint16).astype(np.int64), unpack(own.column("data")[0].as_py(), np.uint32)
        sizes, held = np.array(own.column("sizes")[0].as_py(), np.int64), np.array(own.column("held")[0].as_py(), bool)
        keys = keys_of(seq, sizes, classes, end_class)
        order = np.argsort(keys)
        new = np.diff(keys[order], prepend=-1) != 0
        head = np.flatnonzero(new)
        cells, local = keys[order[head]], np.add.reduceat(np.repeat(~held, sizes)[order].astype(np.int64), head)
        cell_of = np.empty(len(keys), np.int64)
        cell_of[order] = np.cumsum(new) - 1
        # a cell that was not given back has no customers but its own block's: one or none
        value = np.where(local > 0, 1 - of_contexts, 0.0)
        value[hits] = join("values", np.float32)
        at, word = cells & (CONTEXTS - 1), cells >> CONTEXT_BITS
        below = log[word] + rest[at]
        with np.errstate(divide="ignore"):
            seen = np.log10(value / all_[at])
        top = np.maximum(below, seen)
        of_cell = top + np.log10(10.0 ** (below - top) + 10.0 ** (seen - top))
        starts = np.cumsum(sizes) - sizes
        per = lambda x: np.add.reduceat(x, starts)  # noqa: E731  no document is without its end token
        kind = own.schema.field("idents").type.value_type
        total = per(of_cell[cell_of])
        base = np.log10((count + 1) / (n + v + 1))
        return pa.table([pa.array(own.column("idents")[0].as_py(), kind), pa.array(held), pa.array(sizes), pa.array(per((count > 0).astype(np.int64)[seq])), pa.array(np.full(len(sizes), n, np.int64)), pa.array(per(base[seq])), pa.array(total), pa.array(10.0 ** np.minimum(-total / sizes, 300.0))], [id_col, *SCORED])

    seqs = blocks.select("block", "classes", "data", "idents", "held", "sizes")
    return given.groupBy("block").cogroup(seqs.groupBy("block")).applyInArrow(add_up, f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


NAMES = ["kind", "bucket", "block", "words", "lengths", "n_cells", "classes", "data", "idents", "held", "sizes"]
SCORED = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
MEMBER_NAMES = [x.strip().split(" ")[0] for x in MEMBER.split(",")]
BUCKET_NAMES = [x.strip().split(" ")[0] for x in BUCKET.split(",")]
KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
MERGED = [("block", pa.int64()), *((c, pa.binary()) for c in ("idx", "n_cells", "classes")), *((x.strip().split(" ")[0], KINDS[x.strip().split(" ")[1]]) for x in BUCKET.split(","))]
