"""Near-duplicates by a chosen-path set similarity join.

A document is the set of its shingles. In each of several independent trees documents branch by the minwise token of
their set under the hash of tree and level; a node that is small is compared exhaustively, a larger one branches on, at
most LEVELS times. Two sets of similarity s share a first branch with probability s and a last one with s**LEVELS; the
number of trees follows from the least similarity that links, so that a pair is missed with a chance of 1.5e-4 at most
in the largest nodes: 12 trees at 0.85 (1.3e-10 in small nodes), 17 at 0.8 (1.3e-12).

Equal sets are one representative from the start. What must be found is the connected components, so comparing stays
near-linear in a node: first every member meets the node's first document and links are confirmed on full sets; only
nodes whose members are then still in several components are compared further, and only across components: in blocks,
the members of the largest component against the others, so that no task holds a whole node. A sketch of one byte for
each hash sorts out pairs that cannot be similar enough; every link is confirmed on full sets.

Defined results: texts without words have an empty set and link with nothing; a text of fewer words than a shingle is
one shingle; a null id keeps a null component; rows that repeat an id are one node.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.llm.common import U64, discard, docs_words, few_rows, free, mix, staged, text_bytes

WORDS = 5
LEVELS = 4
MISSED = 1.5e-4  #: chance at most that the trees miss a pair in the largest nodes
SMALL = 16  #: documents of a node that is not branched further
BLOCK = 1024  #: documents of a block in a large node
#: Salt of the comparisons with one document, and ids up to which a semi-join is broadcast.
MEMBERS, BROADCAST_IDS = 64, 200_000

_K, _D = (np.random.default_rng(i).integers(1, 1 << 63, n, dtype=np.int64).astype(U64) * U64(2) + U64(1) for i, n in ((6, WORDS), (7, 1)))


@dataclass(frozen=True)
class Settings:
    percent: int  #: similarity from which two sets link

    @property
    def trees(self) -> int:
        return math.ceil(math.log(MISSED) / math.log(1 - (self.percent / 100) ** LEVELS))

    @property
    def hashes(self) -> int:
        return self.trees * LEVELS

    @property
    def least(self) -> int:
        """Equal bytes of two sketches from which a pair is confirmed: five deviations below what the similarity gives."""
        p = self.percent / 100 + (1 - self.percent / 100) / 256
        return math.floor(self.hashes * p - 5 * math.sqrt(self.hashes * p * (1 - p)))

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(5)
        a, b = (rng.integers(1, 1 << 63, self.hashes, dtype=np.int64).astype(U64) * U64(2) + U64(1) for _ in range(2))
        return a, b


def shingles(words: np.ndarray) -> np.ndarray:
    """The distinct shingles of a text's words, in order of their hash."""
    n = min(len(words), WORDS)
    if not n:
        return words
    h = np.zeros(len(words) - n + 1, U64)
    for i in range(n):
        h += words[i : len(words) - n + 1 + i] * _K[i]
    return np.unique(mix(h + U64(n if n < WORDS else 0)))


def minwise(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least hash of a set under each function."""
    out = np.full(len(a), np.iinfo(U64).max, U64)
    for at in range(0, len(s), 2048):
        np.minimum(out, ((s[None, at : at + 2048] ^ b[:, None]) * a[:, None]).min(1), out=out)
    return out


def signatures(settings: Settings):
    """Function for mapInArrow: (doc_id, text) to the size and a 128-bit digest of its set, minwise hashes and sketch."""

    def run(batches):
        a, b = settings.functions()
        for batch in few_rows(batches, 1024):
            n = batch.num_rows
            size, digest, least = np.zeros(n, np.int64), np.zeros((2, n), U64), np.zeros((n, len(a)), U64)
            for place, words in docs_words(text_bytes(batch.column("text"))):
                s = shingles(words)
                size[place] = len(s)
                digest[:, place] = mix(s).sum(), mix(s ^ _D[0]).sum()
                least[place] = minwise(s, a, b)
            sketch = (mix(least) & U64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(size), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(a)), pa.array(least.ravel().view(np.int64))),
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                ],
                ["doc_id", "n_shingles", "d1", "d2", "least", "sketch"],
            )

    return run


SIGNATURES = "doc_id long, n_shingles long, d1 long, d2 long, least array<long>, sketch binary"
PAIRS = "a long, b long"


def pairs_arrow(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def small_nodes(sets: DataFrame, settings: Settings) -> DataFrame:
    """node, doc: the nodes of all trees in which documents are compared; nodes with equal members are one."""
    level = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(settings.trees - 1)), lambda t: F.slice("least", t * LEVELS + 1, LEVELS))).alias("tree", "path")
    front = sets.select(F.col("doc_id").alias("doc"), level).select("doc", F.xxhash64("tree", F.col("path")[0]).alias("node"), "path")
    leaves = []
    for depth in range(1, LEVELS + 1):
        size = front.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        front = staged(front.join(size, "node"), f"level{depth}")
        leaves.append(front.where((F.col("n") <= SMALL) | F.lit(depth == LEVELS)).select("node", "doc"))
        if depth < LEVELS:
            front = front.where(F.col("n") > SMALL).select("doc", F.xxhash64("node", F.col("path")[depth]).alias("node"), "path")
    all_ = leaves[0]
    for more in leaves[1:]:
        all_ = all_.unionByName(more)
    one = all_.groupBy("node").agg(F.min("doc").alias("pivot"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("members"))
    one = one.groupBy("pivot", "n", "members").agg(F.min("node").alias("node"))
    return all_.join(one.select("node", "n", "pivot"), "node")


def alike(left: str, right: str, settings: Settings):
    """Function for mapInArrow: pairs (a, b) whose sketches are alike enough."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, settings.hashes) for c in (left, right))
            near = pa.array((x == y).sum(1) >= settings.least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], ["a", "b"])

    return run


def across(settings: Settings):
    """Function for applyInArrow: members of a block for which another component has a member with a sketch alike enough."""

    def run(group: pa.Table) -> pa.Table:
        comp = group.column("comp").to_numpy()
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, settings.hashes)
        found = np.zeros(len(comp), bool)
        for i in range(len(comp) - 1):
            near = ((sketch[i + 1 :] == sketch[i]).sum(1) >= settings.least) & (comp[i + 1 :] != comp[i])
            found[i] |= near.any()
            found[i + 1 :] |= near
        return group.select(["node", "x", "y", "doc", "comp"]).filter(pa.array(found))

    return run


def compared(settings: Settings):
    """Function for applyInArrow: confirmed links that join the components of a block; pairs of one component are not compared."""

    def run(group: pa.Table) -> pa.Table:
        doc, comp = group.column("doc").to_pylist(), group.column("comp").to_pylist()
        words = dict(docs_words(text_bytes(group.column("text"))))
        sets = [shingles(words.get(i, np.empty(0, U64))) for i in range(len(doc))]
        size = np.array([len(s) for s in sets])
        _, flat = np.unique(np.concatenate([*sets, np.zeros(1, U64)]), return_inverse=True)
        flat, starts = flat[:-1], np.cumsum(size) - size
        owner, up = np.repeat(np.arange(len(doc)), size), {c: c for c in comp}

        def root(c):
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        mark, links = np.zeros(len(flat) + 1, bool), []
        for i in range(len(doc) - 1):
            own = flat[starts[i] : starts[i] + size[i]]
            mark[own] = True
            rest = slice(starts[i] + size[i], None)
            both = np.bincount(owner[rest], mark[flat[rest]], len(doc))[i + 1 :]
            mark[own] = False
            for j in (np.flatnonzero(100 * both >= settings.percent * (size[i + 1 :] + size[i] - both)) + i + 1).tolist():
                if both[j - i - 1] and root(comp[i]) != root(comp[j]):
                    links.append((min(doc[i], doc[j]), max(doc[i], doc[j])))
                    up[root(comp[i])] = root(comp[j])
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.Table.from_batches([pairs_arrow(a, b)])

    return run


def linked(settings: Settings):
    """Function for mapInArrow: rows (a, salt, b, text), those of an (a, salt) together and a's own first, to confirmed links."""

    def run(batches):
        pivot, own = None, None
        for batch in batches:
            a, salt, b = (batch.column(c).to_pylist() for c in ("a", "salt", "b"))
            links = []
            words = dict(docs_words(text_bytes(batch.column("text"))))
            for i in range(batch.num_rows):
                s = shingles(words[i]) if i in words else np.empty(0, U64)
                if b[i] == a[i]:
                    pivot, own = (a[i], salt[i]), s
                    continue
                if pivot != (a[i], salt[i]):
                    raise RuntimeError("comparison without its document")
                if 100 * min(len(s), len(own)) < settings.percent * max(len(s), len(own)):
                    continue
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= settings.percent * (len(own) + len(s) - both):
                    links.append((a[i], b[i]))
            if links:
                yield pairs_arrow(*zip(*links, strict=True))

    return run


def only(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of docs whose doc_id is among the distinct ids: a broadcast where these are few, a shuffle beyond."""
    few = ids.count() <= BROADCAST_IDS
    ids = ids.select(F.col(key).alias("_id"))
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("_id"), "left_semi")


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text for each of the distinct ids; of rows that repeat an id the largest text."""
    texts = only(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), staged(ids, "ids"), "id")
    return staged(texts.groupBy("doc_id").agg(F.max("text").alias("text")) if docs_repeat(docs) else texts, "texts")


def confirm(pairs: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) that are similar enough on their full sets."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs)
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    own = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("b"))
    rows = members.unionByName(own).join(texts, F.col("b") == F.col("doc_id")).select("a", "salt", "b", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b") != F.col("a"), "b")
    return rows.mapInArrow(linked(settings), PAIRS)


def docs_repeat(docs: DataFrame) -> bool:
    return not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """doc, comp for each linked document: alternating large and small stars, until nothing changes."""
    mark = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, staged(small, "edges")
        discard(old)
        after = mark(edges)
        if after == before:
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("comp"))
        before = after


def blocks(nodes: DataFrame) -> DataFrame:
    """node, x, y, doc, comp, sketch: nodes of several components in groups that together hold each pair across components.

    A small node is one group. In a larger one the members of the largest component (side 0) and the others (side 1) are
    dealt into blocks, and each block of others meets each block of either side.
    """
    several = nodes.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("node")
    nodes = nodes.join(several, "node")
    small = nodes.where(F.col("n") <= BLOCK).select("node", F.lit(0).alias("x"), F.lit(0).alias("y"), "doc", "comp", "sketch")
    large = nodes.where(F.col("n") > BLOCK)
    per = large.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("k"))
    most = per.groupBy("node").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"), F.max("k").alias("k"))
    large = large.join(most, "node").withColumn("side", (F.col("comp") != F.col("largest")).cast("int"))
    count = lambda n: F.ceil(n / BLOCK).cast("int")
    large = large.withColumn("bm", count(F.col("k"))).withColumn("bo", count(F.col("n") - F.col("k")))
    block = F.pmod(F.xxhash64("doc"), F.when(F.col("side") == 0, F.col("bm")).otherwise(F.col("bo"))).cast("int")
    large = large.withColumn("block", block)
    others = F.sequence(F.lit(0), F.col("bo") - 1)
    groups = F.when(F.col("side") == 0, F.transform(others, lambda y: F.struct((-1 - F.col("block")).alias("x"), y.alias("y"))))
    own = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("bm") - 1), lambda m: F.struct((-1 - m).alias("x"), F.col("block").alias("y"))),
        F.transform(others, lambda y: F.struct(F.least(y, F.col("block")).alias("x"), F.greatest(y, F.col("block")).alias("y"))),
    )
    large = large.withColumn("g", F.explode(groups.otherwise(own))).select("node", F.col("g.x").alias("x"), F.col("g.y").alias("y"), "doc", "comp", "sketch")
    return small.unionByName(large)


def marked(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; sets link from a similarity of percent hundredths on."""
    settings = Settings(percent)
    signed = staged(docs.select("doc_id", "text").mapInArrow(signatures(settings), SIGNATURES), "signatures")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = usable.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("first"))
    ones = first.select("first", F.col("n_shingles").alias("_n"), F.col("d1").alias("_1"), F.col("d2").alias("_2"))
    sets = usable.join(ones, (F.col("doc_id") == F.col("first")) & (F.col("n_shingles") == F.col("_n")) & (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")), "left_semi")
    sets = staged(sets.select("doc_id", "least", "sketch").dropDuplicates(["doc_id"]), "sets")
    nodes = staged(small_nodes(sets, settings), "nodes")
    sketch = sets.select(F.col("doc_id").alias("doc"), "sketch")
    members = staged(nodes.join(sketch, "doc"), "members")

    stars = members.where("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b"), "sketch").dropDuplicates(["a", "b"])
    stars = stars.join(sketch.select(F.col("doc").alias("a"), F.col("sketch").alias("own")), "a").mapInArrow(alike("sketch", "own", settings), PAIRS)
    links = staged(confirm(staged(stars, "stars"), docs, settings), "links")
    labels = components(links)

    labelled = members.join(labels, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    rest = staged(blocks(labelled).groupBy("node", "x", "y").applyInArrow(across(settings), "node long, x int, y int, doc long, comp long"), "rest")
    if not rest.isEmpty():
        texts = texts_of(rest.select(F.col("doc").alias("id")).distinct(), docs)
        rest = rest.join(texts, F.col("doc") == F.col("doc_id")).select("node", "x", "y", "doc", "comp", "text")
        more = staged(rest.groupBy("node", "x", "y").applyInArrow(compared(settings), PAIRS).distinct(), "more")
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    named = first.join(labels, F.col("first") == F.col("doc"), "left").select("n_shingles", "d1", "d2", F.coalesce("comp", "first").alias("component"))
    named = staged(repeated_ids(usable, named), "named")
    slim = signed.select("doc_id", "n_shingles", "d1", "d2")
    out = slim.where("n_shingles > 0").join(named, ["n_shingles", "d1", "d2"], "left").unionByName(slim.where("n_shingles = 0").withColumn("component", F.col("doc_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def repeated_ids(usable: DataFrame, named: DataFrame) -> DataFrame:
    """named, with sets under one id in one component; only tables that repeat ids need it."""
    ids = usable.select("doc_id", "n_shingles", "d1", "d2").distinct()
    many = staged(ids.groupBy("doc_id").count().where("count > 1").select("doc_id"), "many")
    if many.isEmpty():
        return named
    own = ids.join(named, ["n_shingles", "d1", "d2"])
    links = own.select(F.col("component").alias("a"), F.col("doc_id").alias("b"))
    labels = components(links).select(F.col("doc").alias("component"), "comp")
    return named.join(labels, "component", "left").select("n_shingles", "d1", "d2", F.coalesce("comp", "component").alias("component"))


def keep(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs that stay, in their own columns: of each component the document with the smallest id."""
    dropped = staged(marked(docs, percent).where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    few = dropped.count() <= BROADCAST_IDS
    (own,) = free(docs, "_id")
    ids = dropped.select(F.col("doc_id").alias(own))
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col(own), "left_anti")
