"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform;
its hash is the nearest signed axis. ``hashes`` of them make a table's bucket, and
a vector also probes the next likely buckets of each table: those of the axes that
are nearly as near. Two vectors meet where one's own bucket is own or probed for
the other, and a pair that meets is verified by its cosine in double precision.

Equal vectors of a label are one class from the start and carry their number. A
bucket of many members is dealt into cells of two blocks each, so a task compares
bounded blocks; a pair counts only in the first bucket in which it meets, so no
list of pairs is ever built: a cell emits each member's number of links and a
spanning forest of them.

A label has as many hashes a table as keep its buckets small were its vectors spread
evenly, ``hashes`` at least, and ``more_tables`` tables more for each beyond that.

Vectors that are null, empty, zero or hold null or non-finite components, and those
with a null label or id, link with nothing; vectors of different lengths do not link
either. Components are doubles, and a vector is scaled by a power of two first, so that
squares neither vanish nor overflow. Labels of any type are compared as they are. Equal
rows are vectors of their own. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

STEP = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.93
    tables: int = 10
    hashes: int = 2
    probes: int = 4
    block: int = 1000
    seed: int = 3
    even: int = 4
    more_tables: int = 4

    def suited(self, members: int, width: int) -> Settings:
        """For labels of so many vectors: ``even`` of them a bucket at most, were they spread evenly."""
        hashes = self.hashes
        while self.even * (2 * width) ** hashes < members:
            hashes += 1
        return replace(self, hashes=hashes, tables=self.tables + self.more_tables * (hashes - self.hashes))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, width, half = len(x), x.shape[1], 1
    while half < width:
        x = x.reshape(n, width // (2 * half), 2, half)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def buckets(vectors: np.ndarray, label: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the own bucket in each table, and of own and probed buckets (own first)."""
    n, d = vectors.shape
    width = max(2, 1 << (d - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :d] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rng = np.random.default_rng([s.seed, d])
    all_keys = np.zeros((n, s.tables, s.probes), np.uint64)
    base = common.mix(label.astype(np.int64).view(np.uint64) * STEP + np.uint64(d))
    rows = np.arange(n)
    for t in range(s.tables):
        # for each hash the best axes and what a second choice costs
        axes, costs = [], []
        for _ in range(s.hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, : s.probes]
            axes.append(2 * top + (np.take_along_axis(y, top, 1) > 0))
            costs.append(size[rows, top[:, 0]][:, None] - np.take_along_axis(size, top, 1))
        # the combinations in order of their cost
        choice = np.stack(np.meshgrid(*[np.arange(a.shape[1]) for a in axes], indexing="ij"), -1).reshape(-1, s.hashes)
        cost = sum(c[:, choice[:, h]] for h, c in enumerate(costs))
        order = np.argsort(cost, axis=1, kind="stable")[:, : s.probes]
        key = np.broadcast_to((base + np.uint64(t + 1))[:, None], order.shape)
        for h in range(s.hashes):
            key = common.mix(key * STEP + np.take_along_axis(axes[h], choice[order, h], 1).astype(np.uint64))
        all_keys[:, t, : order.shape[1]] = key
        all_keys[:, t, order.shape[1] :] = key[:, :1]
    return all_keys[:, :, 0], all_keys


def first_meeting(own: np.ndarray, probed: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket in which each pair of rows meets first: of the first table, the lowest key."""
    out, open_ = np.zeros(len(a), np.uint64), np.ones(len(a), bool)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    for t in range(own.shape[1]):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        i, j = a[at], b[at]
        left = np.where((probed[j, t] == own[i, t][:, None]).any(1), own[i, t], most)
        right = np.where((probed[i, t] == own[j, t][:, None]).any(1), own[j, t], most)
        met = np.minimum(left, right)
        hit = met != most
        out[at[hit]] = met[hit]
        open_[at[hit]] = False
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Numbers of the links that span the components."""
    up, out = list(range(n)), []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        while up[j] != j:
            up[j] = up[up[j]]
            j = up[j]
        if i != j:
            up[max(i, j)] = min(i, j)
            out.append(k)
    return out


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def linked(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", s: Settings = Settings()) -> DataFrame:
    """(id, n_links, component_id) of every vector."""
    common.bounded_batches(vectors.sparkSession)
    spark = vectors.sparkSession
    shelf = common.Shelf(spark)
    label = F.col(label_col)
    if vectors.schema[label_col].dataType.typeName() in ("float", "double"):
        label = F.when(label == 0, F.lit(0.0)).otherwise(label)  # one zero
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), label.alias("label"))
    kind = rows.schema["id"].dataType.simpleString()
    # a null component makes forall null, which is not true
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    # one zero in vectors too, so that equal ones are alike
    good = rows.where(fine).withColumns({"v": F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)), "mark": F.xxhash64("label")})
    classes = shelf.put(good.groupBy("mark", "label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "v", F.col("mark").alias("label"), "n", F.col("label").alias("own_label")))
    largest = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).agg(F.max("n"), F.max("d")).first()
    s = s.suited(largest[0] or 0, max(2, 1 << ((largest[1] or 1) - 1).bit_length()))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.array([len(x) for x in whole.column("v")])
            for size in np.unique(sizes).tolist():
                part = whole.filter(pa.array(sizes == size))
                own, probed = buckets(matrix(part.column("v"), part.num_rows), part.column("label").to_numpy(), s)
                flat = probed.reshape(len(own), -1)
                is_own = (probed == own[:, :, None]).reshape(len(own), -1)
                # a key may come twice where there are few axes
                order = np.argsort(flat, axis=1, kind="stable")
                flat, is_own = np.take_along_axis(flat, order, 1), np.take_along_axis(is_own, order, 1)
                new = np.ones(flat.shape, bool)
                new[:, 1:] = flat[:, 1:] != flat[:, :-1]
                at = np.nonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(flat[at].view(np.int64)), part.column("id").take(pa.array(at[0])), pa.array(is_own[at])], ["key", "id", "own"])

    met = classes.select("id", "v", "label").mapInArrow(keys, f"key long, id {kind}, own boolean")
    met = shelf.put(met)
    counts = met.groupBy("key").agg(F.count("*").alias("members"), F.max("own").alias("any_own")).where("members > 1 AND any_own")
    counts = shelf.put(counts)
    blocks = F.ceil(F.col("members") / s.block).cast("int")
    own_block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cells = met.join(counts, "key").withColumn("blocks", blocks).withColumn("block", own_block).select("key", "id", "own", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("key", F.least("block", "other").alias("ci"), F.greatest("block", "other").alias("cj"), "id", "own", "block").join(classes.select("id", "v", "label", "n"), "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cell(table: pa.Table) -> list[tuple]:
            n = table.num_rows
            x = matrix(table.column("v"), n)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            ci, cj = table.column("ci")[0].as_py(), table.column("cj")[0].as_py()
            own, block = table.column("own").to_numpy(), table.column("block").to_numpy()
            near = (x @ x.T >= s.cosine - 1e-9) & (own[:, None] | own[None, :])
            near &= (block[:, None] != block[None, :]) if ci != cj else np.ones((n, n), bool)
            a, b = np.nonzero(np.triu(near, 1))
            if not len(a):
                return []
            exact = np.einsum("ij,ij->i", x[a], x[b]) >= s.cosine
            a, b = a[exact], b[exact]
            primary, probed = buckets(matrix(table.column("v"), n), table.column("label").to_numpy(), s)
            here = np.int64(table.column("key")[0].as_py()).view(np.uint64)
            mine = first_meeting(primary, probed, a, b) == here
            a, b = a[mine], b[mine]
            many = table.column("n").to_numpy()
            links = np.bincount(a, many[b], n) + np.bincount(b, many[a], n)
            ids = table.column("id").to_pylist()
            spanning = forest(a, b, n)
            return [(ids[i], int(links[i]), None) for i in np.flatnonzero(links).tolist()] + [(ids[a[k]], 0, ids[b[k]]) for k in spanning]

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], id_kind), pa.array([r[1] for r in found], pa.int64()), pa.array([r[2] for r in found], id_kind)], ["id", "links", "other"])

        held, id_kind = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            id_kind = batch.schema.field("id").type
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            place = [held.column(c).to_numpy() for c in ("key", "ci", "cj")]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in place], 0)) + 1
            found = [r for i, j in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True) for r in cell(held.slice(i, j - i))] if len(cut) else []
            held = held.slice(int(cut[-1])) if len(cut) else held
            if found:
                yield out(found)
        if held is not None:
            yield out(cell(held))

    dealt = cells.repartition("key", "ci", "cj").sortWithinPartitions("key", "ci", "cj", "id")
    found = shelf.put(dealt.mapInArrow(compare, f"id {kind}, links long, other {kind}"))
    shelf.drop(met, counts)
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = common.components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    summed = classes.join(sums, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    summed = shelf.put(summed.select(F.col("own_label").alias("label"), "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id")))
    shelf.clear(summed)
    of_good = good.join(summed, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return of_good.unionByName(alone).withColumnRenamed("id", id_col)
