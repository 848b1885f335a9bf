"""A Merkle tree over a dataset, whose leaves prove themselves by the preimages of their parents.

A parent is the SHA-256 of its children's hashes written one after the other as lowercase hex; this concatenation, its
preimage, is what is stored: one row for each FAN children. A leaf's proof is the preimages of its ancestors. In each of
them the leaf's line has a slot of 64 characters, known from the leaf's position; what is left without it are the
siblings, and with another hash spliced in, its SHA-256 is the parent that a changed leaf would have.

Each group (a value of `by`) is a tree, and the groups' roots, in order, are the leaves of one more. Positions come from
a range sort and from counts for each range, so no group meets in a task, whatever its share of the rows. Levels are built upwards
by grouping FAN neighbours; ancestors are handed down from parents to children, a level at a time, so leaves are
shuffled once, with the preimages of the parent they share with FAN - 1 others.

Everything is DataFrame functions. Cases: a null field is written as -; a null group is first, a null id too; equal ids
are ordered by their leaf hashes, so repeated rows stand side by side and each gets a proof; an empty text is 0: and an empty
table gives no rows; further columns, whatever their names, are ignored unless they are among `fields`.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.shared import BROADCAST_ROWS, drop_stored, spread_join, stored

FAN, DIGEST = 8, 64  # children of a node; characters of a hash
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(*values: Column) -> Column:
    """The SHA-256 of values, each as its UTF-8 length, a colon and itself; a null as -."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def placed(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with pos, a row's number from 0 inside its group in an order, and total, the group's rows; group isn't null.

    Rows are sorted by ranges, whatever their group; a range starts a group's count where the ranges before end.
    """
    part, inside = F.spark_partition_id(), W.partitionBy("__part", group)
    ranged = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    ranged = stored(ranged.withColumns({"__part": part, "__row": F.monotonically_increasing_id()}), "ranged")
    counts = ranged.groupBy(group, "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    along = W.partitionBy(group).orderBy("__part")
    counts = counts.select(
        F.col(group), "__part", (F.sum("__n").over(along) - F.col("__n") - F.col("__first")).alias("__shift"), F.sum("__n").over(W.partitionBy(group)).alias("total"),
    )
    counts = stored(counts, "counts")  # a row for each range and each group in it
    few = counts.count() <= BROADCAST_ROWS
    out = ranged.join(F.broadcast(counts) if few else counts, [group, "__part"])
    return out.withColumn("pos", F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")


def levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(each level's (grp, pos, preimage, total), lowest first; the (grp, hash) of the roots) of nodes (grp, pos, hash, total).

    total is the number of nodes on a node's level of its group. A group's only node is its root.
    """
    made, roots = [], nodes.where("total = 1").select("grp", "hash")
    now, largest = nodes.where("total > 1"), nodes.agg(F.max("total")).first()[0] or 0
    while largest > 1:
        largest = -(-largest // FAN)
        slots = F.array_sort(F.collect_list(F.struct("pos", "hash")))
        up = now.groupBy("grp", F.expr(f"pos div {FAN}").alias("pos")).agg(slots.alias("s"), F.first("total").alias("below"))
        up = up.select("grp", "pos", F.array_join(F.col("s.hash"), "").alias("preimage"), F.ceil(F.col("below") / FAN).alias("total"))
        made.append(stored(up, "level"))
        hashed = made[-1].select("grp", "pos", F.sha2("preimage", 256).alias("hash"), "total")
        roots = roots.unionByName(hashed.where("total = 1").select("grp", "hash"))
        now = hashed.where("total > 1")
    return made, roots


def ancestry(made: list[DataFrame]) -> DataFrame | None:
    """(grp, pos, path): for each lowest parent the preimages from its own up to the root's; None without parents."""
    above = None
    for level in reversed(made):
        own = level.select("grp", "pos", F.array("preimage").alias("own"))
        if above is None:
            above = own.withColumnRenamed("own", "path")
            continue
        up = above.select("grp", F.col("pos").alias("up"), "path")
        joined = own.withColumn("up", F.expr(f"pos div {FAN}")).join(up, ["grp", "up"], "left")
        above = joined.select("grp", "pos", F.concat("own", F.coalesce("path", F.array().cast("array<string>"))).alias("path"))
    return above


def with_path(nodes: DataFrame, made: list[DataFrame]) -> DataFrame:
    """nodes (grp, pos, ...) with path, the preimages of their ancestors, lowest first; empty for a root."""
    above, none = ancestry(made), F.array().cast("array<string>")
    if above is None:
        return nodes.withColumn("path", none)
    joined = nodes.withColumn("up", F.expr(f"pos div {FAN}")).join(above.withColumnRenamed("pos", "up"), ["grp", "up"], "left")
    return joined.withColumn("path", F.coalesce("path", none)).drop("up")


def slots(path: Column, pos: Column) -> Column:
    """array<struct<slot, preimage>>: which of a preimage's slots, from 0, a node at pos and then its ancestors take."""
    return F.transform(path, lambda p, k: F.struct(F.floor(pos / F.pow(F.lit(float(FAN)), k)).cast("long").bitwiseAND(FAN - 1).cast("int").alias("slot"), p.alias("preimage")))


def siblings(steps: Column) -> Column:
    """The hashes beside the line of steps, level by level, left to right: preimages without the line's own slots."""
    cut = lambda s: F.concat(F.substring(s["preimage"], F.lit(1), s["slot"] * DIGEST), F.substring(s["preimage"], s["slot"] * DIGEST + DIGEST + 1, F.length(s["preimage"])))
    return F.array_join(F.transform(steps, cut), "")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that leaf leads to, spliced into its slot of each preimage of steps in turn."""
    spliced = lambda h, s: F.sha2(F.overlay(s["preimage"], h, s["slot"] * DIGEST + 1), 256)
    return F.aggregate(steps, leaf, spliced)


def manifest(docs: DataFrame, by: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: key, leaf, subroot, root, steps (the slots and preimages up to the root) and changed.

    changed is the leaf of the row with `tampered` in place of its fields, or null where that is the row itself.
    """
    cols = {c: F.col(f"`{c}`") for c in (*fields, key, by)}
    leaf = leaf_hash(*(cols[c] for c in fields))
    other = {c: (tampered or {}).get(c, cols[c]) for c in fields}
    same = reduce(and_, (cols[c].eqNullSafe(other[c]) for c in tampered or ()), F.lit(True))
    grp = F.coalesce(F.concat(F.lit("1"), cols[by].cast("string")), F.lit("0"))  # null first, then bytewise
    leaves = docs.select(cols[key].alias("key"), grp.alias("grp"), leaf.alias("hash"), F.when(~same, leaf_hash(*other.values())).alias("changed"))
    held = stored(leaves, "leaves")
    nodes = placed(held, "grp", F.col("key").asc_nulls_first(), F.col("hash"))
    made, roots = levels(nodes.select("grp", "pos", "hash", "total"))
    proved = with_path(nodes, made)

    tops = placed(stored(roots.withColumnRenamed("grp", "sub").withColumn("grp", F.lit("")), "roots"), "grp", F.col("sub"))
    made_top, root = levels(tops.select("grp", "pos", "hash", "total"))
    top = with_path(tops, made_top).join(root.select("grp", F.col("hash").alias("root")), "grp")
    top = stored(top.select(F.col("sub").alias("grp"), F.col("hash").alias("subroot"), "root", slots(F.col("path"), F.col("pos")).alias("over")), "tops")
    few = top.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10
    out = proved.join(F.broadcast(top), "grp") if few else spread_join(proved, top, "grp")
    steps = F.concat(slots(F.col("path"), F.col("pos")), F.col("over"))
    drop_stored(held)
    return out.select(F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", "root", steps.alias("steps"), "changed")


def verify(proofs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root and verified of manifest(): folds each changed leaf to the root."""
    steps = F.col("steps")
    out = proofs.withColumns({"proof_sha256": F.sha2(siblings(steps), 256), "folded_root": folded(F.coalesce("changed", "leaf"), steps)})
    return out.select(key, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
