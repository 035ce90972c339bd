"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard.

Vectors are dealt by a hash of their id to shards of bounded size. A shard's index holds its distinct vectors, the ids of
each, and for each layer a flat array of neighbours; layers are drawn by a hash, each about a sixteenth of the one below.
Neighbours are the nearest in the layer, thinned so that none is nearer to a chosen one than to the vector itself, with
links back. That alone leaves a tight group of near copies an island, so each node is also tied both ways to its nearest in
the layer above, where a search comes from, thinned as well, and nodes that still cannot be reached from there get a link
until there are none. A search scans the highest layer, descends the others with a beam and ends in the lowest; some
queries are advanced together.

An index is a table: a row for each shard with its vectors, ids and each layer's nodes and neighbours as flat arrays.
Queries are dealt into blocks about as large as a shard's arrays; each block meets each shard once, so neither side is
sent more often than the other needs, and the best of all shards are merged. Scores are computed again in double
precision from the original vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; only vectors of
one dimension are compared; equal vectors are one node and lose no id; rows that repeat an id are one vector (the
largest); with fewer than k candidates all are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meetlake.llm.common import U64, mix, staged


@dataclass(frozen=True)
class Settings:
    k: int = 20
    shard_rows: int = 16_384
    block_rows: int = 32_768  #: queries that meet a shard at a time
    beam_rows: int = 1_024  #: queries that are advanced together
    links: int = 16  #: in upper layers; twice as many in the lowest
    near: int = 24  #: nearest vectors from which links are chosen
    ties: int = 2  #: nearest in the layer above to which a node is tied
    beam: int = 72
    upper_beam: int = 24


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, dim, v for the vectors that take part."""
    v = F.col(vector_column).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_column).isNotNull() & F.coalesce(good, F.lit(False))).groupBy(F.col(id_column).alias("id")).agg(F.max(v).alias("v")).select("id", F.size("v").alias("dim"), "v")


def matrix(column, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, dim)


def thinned(x: np.ndarray, own: np.ndarray, near: np.ndarray, score: np.ndarray, links: int) -> np.ndarray:
    """Of each row's nearest, the first ones that are nearer to the row than to any chosen before; -1 for none."""
    n, width = near.shape
    v = x[near]
    among = np.einsum("nid,njd->nij", v, v)
    chosen, count = np.zeros((n, width), bool), np.zeros(n, np.int64)
    for j in range(width):
        worst = np.where(chosen, among[:, j], -np.inf).max(1)
        take = (score[:, j] > worst) & (count < links) & (near[:, j] != own)
        chosen[:, j] = take
        count += take
    # where few are diverse, the nearest of the others fill up
    rank = np.where(near == own[:, None], 3 * width, np.where(chosen, 0, width) + np.arange(width))
    order = np.argsort(rank, axis=1)[:, :links]
    out = np.take_along_axis(near, order, 1)
    return np.where(np.take_along_axis(rank, order, 1) < 3 * width, out, -1)


def layer(x: np.ndarray, nodes: np.ndarray, links: int, near: int) -> np.ndarray:
    """Neighbours of the nodes of a layer, a row each, with links back; -1 fills up."""
    y = x[nodes]
    width = min(near + 1, len(nodes))
    out = np.full((len(nodes), 2 * links), -1, np.int32)
    for at in range(0, len(nodes), 512):
        s = y[at : at + 512] @ y.T
        top = np.argpartition(-s, width - 1, axis=1)[:, :width]
        score = np.take_along_axis(s, top, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        top, score = np.take_along_axis(top, order, 1), np.take_along_axis(score, order, 1)
        got = thinned(y, np.arange(at, at + len(top)), top, score, links)
        out[at : at + len(top), : got.shape[1]] = got
    a, slot = np.nonzero(out[:, :links] >= 0)
    b = out[a, slot]
    # links back, the strongest first, as far as there is room
    order = np.lexsort((-np.einsum("nd,nd->n", y[a], y[b]), b))
    a, b = a[order], b[order]
    rank = np.arange(len(b)) - np.searchsorted(b, b)
    room = rank < links
    out[b[room], links + rank[room]] = a[room]
    return np.where(out >= 0, nodes[out], -1).astype(np.int32)


def tied(x: np.ndarray, nodes: np.ndarray, above: np.ndarray, table: np.ndarray, links: int, ties: int) -> np.ndarray:
    """The links of a layer with ties to and from the layer above, and all nodes within reach of it."""
    place = np.full(len(x), -1, np.int64)
    place[nodes] = np.arange(len(nodes))
    up, score = np.zeros((len(nodes), ties), np.int64), np.zeros((len(nodes), ties), np.float32)
    for at in range(0, len(nodes), 512):
        s = x[nodes[at : at + 512]] @ x[above].T
        s[nodes[at : at + 512, None] == above] = -np.inf
        up[at : at + 512] = top = np.argsort(-s, axis=1, kind="stable")[:, :ties]
        score[at : at + 512] = np.take_along_axis(s, top, 1)
    down, y = np.full((len(nodes), links), -1, np.int64), x[nodes]
    who, owner, strength = np.repeat(np.arange(len(nodes)), ties), up.ravel(), score.ravel()
    order = np.lexsort((-strength, owner))
    bounds = np.searchsorted(owner[order], np.arange(len(above) + 1))
    for i, own in enumerate(place[above]):
        cell = order[bounds[i] : bounds[i + 1]][: 8 * links]
        if len(cell):
            got = thinned(y, np.array([own]), who[cell][None], strength[cell][None], links)[0]
            down[own, : len(got)] = got
    table = np.concatenate((table, above[up], np.where(down >= 0, nodes[down], -1)), 1).astype(np.int32)
    while True:
        reached = np.zeros(len(x) + 1, bool)
        reached[-1], front = True, above
        while len(front):
            reached[front] = True
            near = np.unique(table[place[front]])
            front = near[~reached[near]]
        lost = np.flatnonzero(~reached[nodes])
        if not len(lost):
            return table
        # the strongest lost node of each node above; what hangs on it comes with it
        lost = lost[np.lexsort((-score[lost, 0], up[lost, 0]))]
        owners, first = np.unique(up[lost, 0], return_index=True)
        more = np.full((len(nodes), 1), -1, np.int32)
        more[place[above[owners]], 0] = nodes[lost[first]]
        table = np.concatenate((table, more), 1)


def layers_of(x: np.ndarray, first_ids: np.ndarray, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes and their neighbours for each layer from the lowest."""
    u = (mix(first_ids.view(U64)) >> U64(11)).astype(float) / (1 << 53) + 1e-18
    level = np.floor(-np.log(u) / np.log(s.links)).astype(int)
    out = []
    for depth in range(int(level.max()) + 1):
        nodes = np.flatnonzero(level >= depth)
        if depth and len(nodes) <= s.upper_beam:
            break
        out.append((nodes, layer(x, nodes, s.links if depth else 2 * s.links, s.near)))
    for depth in range(len(out) - 1):
        (nodes, table), above = out[depth], out[depth + 1][0]
        out[depth] = nodes, tied(x, nodes, above, table, s.links if depth else 2 * s.links, s.ties)
    return out


class Index:
    """Distinct vectors, their ids (those of vector p at starts[p] to starts[p + 1]), and nodes and neighbours by layer from the lowest."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, starts: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.ids, self.starts, self.layers = vectors, ids, starts, layers

    @classmethod
    def built(cls, ids: np.ndarray, vectors: np.ndarray, s: Settings) -> Index:
        order = np.argsort(ids)
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order]) + 0.0  # no -0.0
        _, first, at = np.unique(vectors.view(f"V{vectors.itemsize * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
        by = np.argsort(at, kind="stable")
        return cls(vectors[first], ids[by], np.searchsorted(at[by], np.arange(len(first) + 1)), layers_of(vectors[first].astype(np.float32), ids[first], s))

    def row(self) -> list[pa.Array]:
        """The columns of INDEX from `vectors` on."""
        flat = lambda arrays, kind: pa.array([[np.ascontiguousarray(a).astype(kind).tobytes() for a in arrays]], pa.list_(pa.binary()))
        one = lambda a, kind: pa.array([np.ascontiguousarray(a).astype(kind).tobytes()], pa.binary())
        return [one(self.vectors, "<f8"), one(self.ids, "<i8"), one(self.starts, "<i8"), flat([n for n, _ in self.layers], "<i4"), flat([t for _, t in self.layers], "<i4")]

    @classmethod
    def read(cls, table: pa.Table, dim: int) -> Index:
        vectors, ids, starts, nodes, links = (table.column(c)[0].as_py() for c in ("vectors", "ids", "starts", "nodes", "links"))
        nodes = [np.frombuffer(n, "<i4") for n in nodes]
        layers = [(n, np.frombuffer(t, "<i4").reshape(len(n), -1)) for n, t in zip(nodes, links, strict=True)]
        return cls(np.frombuffer(vectors, "<f8").reshape(-1, dim), np.frombuffer(ids, "<i8"), np.frombuffer(starts, "<i8"), layers)

    def descend(self, q: np.ndarray, s: Settings) -> np.ndarray:
        """The places of the vectors found for each query, a row each; -1 fills up."""
        x = self.vectors.astype(np.float32)
        q32 = q.astype(np.float32)
        top = self.layers[-1][0]
        found = top[np.argsort(-(q32 @ x[top].T), axis=1, kind="stable")[:, : s.upper_beam]]
        for depth in range(len(self.layers) - 1, -1, -1):
            nodes, links = self.layers[depth]
            found = beam(x, q32, nodes, links, found, s.upper_beam if depth else s.beam)
        return found


def beam(x: np.ndarray, q: np.ndarray, nodes: np.ndarray, links: np.ndarray, entries: np.ndarray, width: int) -> np.ndarray:
    """The best width nodes of a layer for each query, best first, from the entries on."""
    n, row = len(q), np.arange(len(q))
    place = np.full(len(x) + 1, -1, np.int32)
    place[nodes] = np.arange(len(nodes))
    seen = np.zeros((n, len(x)), bool)
    best, score, done = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32), np.ones((n, width), bool)

    def join(rows: np.ndarray, new: np.ndarray) -> None:
        ok = new >= 0
        ok &= ~seen[rows[:, None], new]
        seen[np.broadcast_to(rows[:, None], new.shape)[ok], new[ok]] = True
        # a node that comes twice in one row counts once
        order = np.sort(np.where(ok, new, -1), axis=1)
        new = np.where((order >= 0) & np.column_stack((np.ones(len(order), bool), order[:, 1:] != order[:, :-1])), order, -1)
        got = np.where(new >= 0, np.einsum("nd,nkd->nk", q[rows], x[new]), -np.inf).astype(np.float32)
        b, c, d = np.concatenate((best[rows], new), 1), np.concatenate((score[rows], got), 1), np.concatenate((done[rows], new < 0), 1)
        keep = np.argsort(-c, axis=1, kind="stable")[:, :width]
        best[rows], score[rows], done[rows] = (np.take_along_axis(a, keep, 1) for a in (b, c, d))

    join(row, entries.astype(np.int32))
    while True:
        open_ = ~done
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            return best
        at = open_[rows].argmax(1)
        node = best[rows, at]
        done[rows, at] = True
        join(rows, links[place[node]])


INDEX = "dim int, shard int, vectors binary, ids binary, starts binary, nodes array<binary>, links array<binary>"
FOUND = "query_id long, vec_id long, score double"


def builder(s: Settings):
    def run(key, group):
        dim, shard = int(key[0].as_py()), int(key[1].as_py())
        index = Index.built(group.column("id").to_numpy(), matrix(group.column("v"), dim), s)
        return pa.table([pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), *index.row()], names=[c.split()[0] for c in INDEX.split(", ")])

    return run


def searcher(s: Settings):
    def run(key, queries, graph):
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not queries.num_rows or not graph.num_rows:
            return schema.empty_table()
        dim = int(key[0].as_py())
        index = Index.read(graph, dim)
        ids, q = queries.column("id").to_numpy(), matrix(queries.column("v"), dim)
        out = []
        for at in range(0, len(ids), s.beam_rows):
            for own, v, places in zip(ids[at : at + s.beam_rows].tolist(), q[at : at + s.beam_rows], index.descend(q[at : at + s.beam_rows], s), strict=True):
                places = places[places >= 0]
                exact = (index.vectors[places] * v).sum(1)
                take = [index.ids[index.starts[p] : index.starts[p + 1]][: s.k + 1] for p in places]
                near = np.concatenate(take)
                value = np.repeat(exact, [len(t) for t in take])
                value, near = value[near != own], near[near != own]
                first = np.lexsort((near, -value))[: s.k]
                out.append((np.full(len(first), own), near[first], value[first]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def search(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 20, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each vector whose id is divisible by `every`."""
    rows = staged(usable(vectors, id_column, vector_column), "vectors")
    sizes = rows.groupBy("dim").count().withColumn("shards", F.ceil(F.col("count") / s.shard_rows).cast("int")).select("dim", "shards")
    dealt = rows.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    index = staged(dealt.groupBy("dim", "shard").applyInArrow(builder(s), INDEX), "index")
    blocks = rows.where(F.col("id") % every == 0).groupBy("dim").count().select("dim", F.ceil(F.col("count") / s.block_rows).cast("int").alias("blocks"))
    queries = rows.where(F.col("id") % every == 0).join(blocks, "dim").join(sizes, "dim")
    queries = queries.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64(F.lit(1), "id"), F.col("blocks")).cast("int").alias("block"), "id", "v")
    graphs = index.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    found = queries.groupBy("dim", "shard", "block").cogroup(graphs.groupBy("dim", "shard", "block")).applyInArrow(searcher(s), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
