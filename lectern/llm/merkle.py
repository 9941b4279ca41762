"""Merkle manifest of a table: a tree of digests for each group of rows, one root, and a proof for each row.

A row's leaf is the SHA-256 of its values, each written with its length. The leaves of a group
ascend by the row's id; while there is more than one node, every ``fan`` consecutive ones
become the digest of their digests. The groups' last nodes are the leaves of a tree of the same
rule, whose last node is the root. All of it is DataFrame functions:

* Leaves (ids and digests, no texts) are written to the shared folder, dealt by ranges of (group, id, leaf), so
  a group with most rows lies in many partitions. A row's place in its group is its place in its
  partition and the rows of the group in the partitions before, a sum over one row for each
  partition and group.
* Every fan**3 nodes of a group are a block: an ordered array, from which three levels are
  collapsed by ``sequence``, ``transform``, ``slice`` and ``aggregate``. What the blocks
  leave are the nodes of the next round, until each group is one block; a group's
  rows are never in one task.
* Downwards a block gets the siblings above it, one pair of strings (left of the node, right of
  it) a level, by a join of blocks with the blocks above; the leaves' blocks add their own
  levels, fold every row's proof and explode last.

Nulls in any column have a digest of their own, and a null group is a group, the first one. Null ids come first in
their group, rows of one id go by their leaf, and rows equal in all columns take
neighbouring places in either order, so the digests do not depend on how the table lies. A table without rows has no proof and no root. Only
the named columns are read; column names of the table cannot clash with the ones made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FAN, LEVELS = 16, 3
#: Groups and partitions for which their first places are sent to all tasks; beyond it they are joined.
FEW = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """Of values in order: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return digest(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def placed(nodes: DataFrame, shelf: common.Shelf) -> DataFrame:
    """Adds each node's place in its group ``g`` by (id, digest), from 0 on, and the size of the group."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["g", "id", "digest"]
    dealt = shelf.put(nodes.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    of_group = Window.partitionBy("g")
    heads = dealt.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    heads = heads.withColumns({"before": F.coalesce(F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "size": F.sum("n").over(of_group)})
    heads = shelf.put(heads.select("g", "part", (F.col("before") - F.col("first")).alias("shift"), "size"))
    found = dealt.join(F.broadcast(heads) if heads.count() <= FEW else heads, ["g", "part"])
    return found.withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def collapsed(nodes: Column) -> Column:
    """One level: the digest of every FAN nodes of an array."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN)), lambda j: F.sha2(F.array_join(F.slice(nodes, j.cast("int") * FAN + 1, FAN), "").cast("binary"), 256))


def blocks_of(nodes: DataFrame, *payload: str) -> DataFrame:
    """(g, size, block, levels, top, the payload as arrays): the nodes of every FAN**LEVELS places in order and the levels above them; top: their last node."""
    width = FAN**LEVELS
    rows = nodes.groupBy("g", "size", F.floor(F.col("pos") / width).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", *payload))).alias("row"))
    start = rows.select("g", "size", "block", F.array(F.col("row.digest")).alias("leaves"), *(F.col(f"row.{c}").alias(c) for c in payload))
    whole = F.col("size") > width
    grow = lambda acc, k: F.when(whole | (F.size(F.element_at(acc, -1)) > 1), F.concat(acc, F.array(collapsed(F.element_at(acc, -1))))).otherwise(acc)
    levels = start.withColumn("levels", F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.col("leaves"), grow)).drop("leaves")
    return levels.withColumn("top", F.element_at(F.element_at("levels", -1), 1))


def siblings(levels: Column, place: Column) -> Column:
    """Of the node at a place of a block the strings left and right of it, level by level; the last level is the block's last node, which has none here."""
    below = F.slice(levels, 1, F.size(levels) - 1)

    def pair(nodes: Column, k: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(float(FAN)), k)).cast("int")
        first = F.floor(at / FAN).cast("int") * FAN
        return F.struct(F.array_join(F.slice(nodes, first + 1, at - first), "").alias("l"), F.array_join(F.slice(nodes, at + 2, first + (FAN - 1) - at), "").alias("r"))

    return F.transform(below, pair)


def climbed(nodes: DataFrame, shelf: common.Shelf, *payload: str) -> list[DataFrame]:
    """The rounds of blocks from the nodes (g, size, pos, digest) up to one block for each group."""
    rounds = [shelf.put(blocks_of(nodes, *payload))]
    width = FAN**LEVELS
    while not rounds[-1].where(F.col("size") > width).isEmpty():
        last = rounds[-1].where(F.col("size") > width)
        rounds.append(shelf.put(blocks_of(last.select("g", F.ceil(F.col("size") / width).alias("size"), F.col("block").alias("pos"), F.col("top").alias("digest")))))
    return rounds


def tops(rounds: list[DataFrame]) -> DataFrame:
    """(g, digest): the last node of each group."""
    alone = [r.where(F.col("size") <= FAN**LEVELS).select("g", F.col("top").alias("digest")) for r in rounds]
    out = alone[0]
    for more in alone[1:]:
        out = out.union(more)
    return out


def descended(rounds: list[DataFrame], above: DataFrame, shelf: common.Shelf) -> DataFrame:
    """The lowest blocks with ``up``, the siblings above each; above: (g, up) of the groups' last nodes, and more columns, which are carried."""
    carried = [c for c in above.columns if c not in ("g", "up")]
    known = None
    for k in range(len(rounds) - 1, -1, -1):
        here = rounds[k]
        found = here.where(F.col("size") <= FAN**LEVELS).join(above, "g")
        if known is not None:
            found = found.unionByName(here.where(F.col("size") > FAN**LEVELS).join(known, ["g", "block"]))
        if not k:
            return found
        nodes = F.transform(F.element_at("levels", 1), lambda _, i: F.struct((F.col("block") * FAN**LEVELS + i).alias("block"), F.concat(siblings(F.col("levels"), i), F.col("up")).alias("up")))
        known = shelf.put(found.select("g", *carried, F.inline(nodes)))


def manifest(rows: DataFrame, group_col: str, id_col: str, leaf_col: str, claimed_col: str) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    leaf_col: the digest that the tree holds; claimed_col: the digest that is folded with the proof, as someone who
    has the row and its proof would, and verified against the root.
    """
    shelf = common.Shelf(rows.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # a null group is first; strings ascend by their bytes
    leaves = shelf.put(rows.select(key.alias("g"), F.col(id_col).alias("id"), F.col(leaf_col).alias("digest"), F.col(claimed_col).alias("claimed")))
    groups = climbed(placed(leaves, shelf), shelf, "id", "claimed")
    subroots = shelf.put(tops(groups))
    forest = climbed(placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("id"), "digest"), shelf), shelf, "id")
    root = tops(forest).select(F.lit("").alias("g"), F.array().cast("array<struct<l:string,r:string>>").alias("up"), F.col("digest").alias("root"))
    top = descended(forest, root, shelf)
    of_group = F.transform(F.element_at("levels", 1), lambda d, i: F.struct(F.element_at("id", i + 1).alias("g"), d.alias("subroot"), F.concat(siblings(F.col("levels"), i), F.col("up")).alias("up")))
    above = shelf.put(top.select("root", F.inline(of_group)))
    found = descended(groups, above, shelf)

    def proved(d: Column, i: Column) -> Column:
        path = F.concat(siblings(F.col("levels"), i), F.col("up"))
        folded = F.aggregate(path, F.element_at("claimed", i + 1), lambda acc, s: digest(s.l, acc, s.r))
        proof = F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.l, s.r)), "").cast("binary"), 256)
        return F.struct(F.get("id", i).alias(id_col), d.alias("leaf"), proof.alias("proof_sha256"), folded.alias("folded_root"))

    out = found.select("subroot", "root", F.inline(F.transform(F.element_at("levels", 1), proved)))
    return out.select(id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
