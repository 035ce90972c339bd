"""Merkle manifest of a dataset: a tree of hashes for each language, and one over the languages' subroots.

A leaf is the SHA-256 of a row's fields; the leaves of a language ascend by id and are numbered by row_number. Each level
is one DataFrame step: indices are floor-divided by the fanout, the children of a parent are gathered as a sorted array
and hashed into it, until one node is left. The subroots, in the order of their languages, are the leaves of the last
tree. The way back down joins each level's parents with the paths found so far: a child's path is its siblings, then
its parent's path. All levels together hold less than twice the leaves, and no row passes through the driver but the root.

No tree lies in one task, however many rows a language has: rows are numbered within ranges of (language, id), to which
the counts of the ranges before are added, and what is gathered at a time is the children of one parent.

Defined results: a null field hashes as `-`; null ids come first in their language and the null language before all
others; rows with the same id are ordered by their leaves, and equal rows are a leaf each; an empty text is `0:`; an empty
table gives no rows. Further columns take no part, whatever they are called.
"""

from __future__ import annotations


from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlake.llm.common import fold, staged

FANOUT = 2
#: The fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: An id is tampered with where this divides its crc32.
TAMPERED = 7
#: Nodes of a level in a file, about; nodes up to which the paths of a level (a kilobyte or two each) are broadcast.
FILE_NODES, FEW_NODES = 100_000, 4_000
STEP = "struct<at:int,others:array<string>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The digest of a row, with some fields changed."""
    return F.sha2(F.concat(*(field(changed.get(f, F.col(f"`{f}`"))) for f in FIELDS)), 256)


@dataclass(frozen=True)
class Size:
    """What the driver knows of trees: how many there are, the leaves of the widest, and all leaves."""

    trees: int
    widest: int
    leaves: int

    def nodes(self, level: int, fanout: int) -> int:
        """The nodes of a level, at most."""
        return self.leaves // fanout**level + self.trees


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, Size]:
    """rows with idx, the place (from 0) in their tree by `order`, and n, the rows of their tree; equal rows are told apart by `uid`."""
    ranges = rows.repartitionByRange("tree", *order, "uid").withColumn("range", F.spark_partition_id())
    ranges = staged(ranges, "ranges")
    counts = ranges.groupBy("range", "tree").agg(F.count(F.lit(1)).alias("here"))
    tree = Window.partitionBy("tree")
    before = counts.select("range", "tree", (F.sum("here").over(tree.orderBy("range")) - F.col("here")).alias("before"), F.sum("here").over(tree).alias("n"))
    at = F.row_number().over(Window.partitionBy("range", "tree").orderBy(*order, "uid")) - 1
    placed = ranges.withColumn("at", at.cast("long")).join(before, ["range", "tree"])
    of = counts.groupBy("tree").agg(F.sum("here").alias("n")).agg(F.count(F.lit(1)).alias("trees"), F.max("n").alias("widest"), F.sum("n").alias("leaves")).first()
    return placed.withColumn("idx", F.col("at") + F.col("before")).drop("range", "at", "before", "uid"), Size(of["trees"], of["widest"] or 1, of["leaves"] or 0)


def parents(nodes: DataFrame, fanout: int, own: list[str]) -> DataFrame:
    """One level up: tree, idx, n, digest, the children in their order (with their own columns) and their tree's number of nodes.

    The only node of a tree is its own parent.
    """
    held = F.sort_array(F.collect_list(F.struct("idx", "digest", *own))).alias("children")
    up = nodes.groupBy("tree", F.floor(F.col("idx") / fanout).cast("long").alias("idx"), F.col("n").alias("below")).agg(held)
    joined = F.sha2(F.concat_ws("", "children.digest"), 256)
    digest = F.when(F.col("below") == 1, F.col("children")[0]["digest"]).otherwise(joined)
    return up.select("tree", "idx", F.ceil(F.col("below") / fanout).cast("long").alias("n"), digest.alias("digest"), "children", "below")


def climb(nodes: DataFrame, size: Size, fanout: int, own: list[str]) -> list[DataFrame]:
    """The levels above the leaves, each written once, until every tree has one node; a file for every FILE_NODES of them."""
    levels, widest = [], size.widest
    while widest > 1 or not levels:
        up = parents(nodes, fanout, [] if levels else own)
        levels.append(staged(up.coalesce(1 + size.nodes(len(levels) + 1, fanout) // FILE_NODES), "level"))
        nodes, widest = levels[-1].select("tree", "idx", "n", "digest"), -(-widest // fanout)
    return levels


def descend(levels: list[DataFrame], size: Size, fanout: int, tops: DataFrame, own: list[str], carried: list[str]) -> DataFrame:
    """Of each leaf: digest, own columns, `carried` and path, the siblings from its level up, then the path of its top.

    tops: tree, path and the carried columns, a row for each tree. Paths of a level that has FEW_NODES at most are broadcast.
    """
    paths = tops.select("tree", F.lit(0).cast("long").alias("idx"), "path", *carried)
    for depth, level in reversed(list(enumerate(levels))):
        few = size.nodes(depth + 1, fanout) <= FEW_NODES
        met = level.select("tree", "idx", "children", "below").join(F.broadcast(paths) if few else paths, ["tree", "idx"])
        digests = F.col("children.digest")
        each = met.select("tree", "below", "path", *carried, digests.alias("digests"), F.posexplode("children").alias("at", "child"))
        others = F.concat(F.slice("digests", F.lit(1), F.col("at")), F.slice("digests", F.col("at") + 2, F.size("digests")))
        step = F.array(F.struct(F.col("at"), others.alias("others")))
        path = F.when(F.col("below") > 1, F.concat(step, F.col("path"))).otherwise(F.col("path"))
        columns = ["digest", *own] if depth == 0 else ["idx"]
        paths = each.select("tree", *(F.col("child")[c].alias(c) for c in columns), path.alias("path"), *carried)
    return paths


def refolded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path fold to."""

    def up(digest: Column, step: Column) -> Column:
        others = step["others"]
        run = F.concat(F.slice(others, F.lit(1), step["at"]), F.array(digest), F.slice(others, step["at"] + 1, F.size(others) + 1))
        return F.sha2(F.concat_ws("", run), 256)

    return F.aggregate(path, start, up)


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, tampered (a changed leaf, or null), subroot, root and path of every row.

    path is an array of (at, others), from the leaf's level to the root: where the node stands in its run, and the rest of
    the run from left to right.
    """
    tampered = F.when(fold("doc_id", TAMPERED) == 0, leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1))
    rows = docs.select("doc_id", "lang", field(F.col("lang")).alias("tree"), leaf().alias("digest"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("uid"))
    rows = staged(rows, "leaves")
    own = ["doc_id", "tampered"]
    leaves, size = numbered(rows, ["doc_id", "digest"])
    levels = climb(leaves.select("tree", "idx", "n", "digest", *own), size, fanout, own)
    names = rows.groupBy("tree").agg(F.first("lang").alias("lang"))
    subroots = levels[-1].select("tree", "digest").join(names, "tree")
    subroots = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("uid"), "lang", "digest", F.col("tree").alias("key"))
    lowest, few = numbered(subroots, ["lang"])
    above = climb(lowest.select("tree", "idx", "n", "digest", "key"), few, fanout, ["key"])
    top = above[-1].select("digest").first()
    none = F.array().cast(f"array<{STEP}>").alias("path")
    tops = descend(above, few, fanout, above[-1].select("tree", none), ["key"], []).select(F.col("key").alias("tree"), F.col("digest").alias("subroot"), "path")
    out = descend(levels, size, fanout, tops, own, ["subroot"])
    return out.select("doc_id", F.col("digest").alias("leaf"), "tampered", "subroot", F.lit(top["digest"] if top else None).cast("string").alias("root"), "path")


def verify(found: DataFrame) -> DataFrame:
    """found with proof_sha256 (of the siblings in their order), folded_root (from the tampered leaf if there is one) and verified."""
    siblings = F.concat_ws("", F.flatten(F.transform("path", lambda s: s["others"])))
    folded = refolded(F.coalesce("tampered", "leaf"), F.col("path"))
    return found.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": folded}).withColumn("verified", F.col("folded_root") == F.col("root"))
