"""Deleted interpolation: a trigram model whose maximum-likelihood estimates are mixed by context frequency.

p(w | u, v) = a[b] * c(u, v, w) / c(u, v) + t[b] * c(v, w) / c(v) + o[b] * c(w) / N + z[b] / (V + 1), with b the bucket of the
frequencies of both contexts. The mixture weights of each bucket are learned by expectation-maximisation on deleted
counts: training documents lie in ROTATIONS groups, and each group is looked up in the counts of all the others. The
model then counts all training documents.

The counts grow with the corpus and are nowhere held as a whole. Documents are first written as chunks of bounded size,
each of one group, with an id; what follows reads those. Each task counts the n-grams of a chunk and deals the sorted keys
out by their range; the task of a range sums them over all chunks and hands each chunk the totals of just its own keys, in
their order. A chunk and those totals then meet in one group, where its documents are tuned on and scored. The number of
ranges follows from the bytes of text, so that a range's keys fit a task; they are counted in shares, one after the other; a range of which a chunk has no key sends
nothing. An n-gram that every document has costs one entry for each chunk, so no key is hot.

Defined results: a null or empty text is the end token alone; repeated rows count and are scored each; a null id is in
training; without training documents every token has the uniform probability.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetlake.llm.common import U64, few_rows, fold, mix, staged, text_bytes, words_of

END, START = U64(0xA0761D6478BD642E), U64(0xE7037ED1A0B428DA)
ONE, SPREAD = U64(1), U64(0x9E3779B97F4A7C15)
#: Groups of training folds, each deleted in turn; the number of a chunk of held-out documents.
ROTATIONS, HELD = 3, 3
#: Buckets of a trigram's context (powers of two) and of a bigram's (powers of four).
PAIRS, WORDS = 8, 8
#: Powers of two that probabilities are told apart by while the weights are learned, and the least one.
LEAST = 24


@dataclass(frozen=True)
class Settings:
    folds: int = 7
    held_out: int = 2  #: the fold that is never learned from
    chunk_bytes: int = 5 << 20  #: text that a task counts and scores at a time
    part_bytes: int = 2 << 20  #: text whose keys make up a range, about
    steps: int = 60
    passes: int = 2  #: shares of the ranges that are counted one after the other, so that disk holds one share's keys


def pack_ints(a: np.ndarray) -> bytes:
    """Unsigned integers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_ints(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a chunk of texts: for each, the place of its text, whether it is the first there, and the keys of its word, pair and triple."""
    parts = list(words_of(texts))
    place = np.concatenate([np.empty(0, np.int64), *(p for p, _ in parts)])
    ids = np.concatenate([np.empty(0, U64), *(i for _, i in parts)])
    del parts
    ends = np.searchsorted(place, np.arange(len(texts)), side="right")
    place = np.insert(place, ends, np.arange(len(texts)))
    word = np.insert(ids, ends, END)
    first = np.concatenate(([True], place[1:] != place[:-1]))[: len(word)]
    pair = mix(after(word, first, START) * SPREAD ^ word) | ONE  # odd: of several words
    triple = mix(after(pair, first, START) * SPREAD ^ mix(word)) | ONE
    return place, first, word & ~ONE, pair, triple


def after(keys: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """The key before each; `start` where a text begins."""
    return np.where(first, start, np.concatenate(([start], keys[:-1]))[: len(keys)])


class Grams:
    """The tokens of a chunk of texts: for each, the place of its text, and places in `unique` of its word, pair and triple, and of their contexts."""

    def __init__(self, texts: list[bytes]):
        self.place, first, word, pair, triple = keys_of(texts)
        # a text's start is seen as often as its end
        self.unique, at = np.unique(np.concatenate((word, pair, triple, [END & ~ONE])), return_inverse=True)
        n = len(word)
        self.word, self.pair, self.triple, end = at[:n], at[n : 2 * n], at[2 * n : 3 * n], at[-1]
        self.after_word, self.after_pair = after(self.word, first, end), after(self.pair, first, end)


def chunks(s: Settings):
    """Function for mapInArrow: rows (doc_id, fold, text) become chunks of one group each."""
    folds = [f for f in range(s.folds) if f != s.held_out]
    group = {f: i * ROTATIONS // len(folds) for i, f in enumerate(folds)} | {s.held_out: HELD, None: 0}

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {k: ([], []) for k in range(ROTATIONS + 1)}
        size = dict.fromkeys(held, 0)

        def done(kind):
            nonlocal n
            ids, texts = held[kind]
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            lengths = [len(t) for t in texts]
            held[kind], size[kind], n = ([], []), 0, n + 1
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | n]), pa.array([kind], pa.int32()), pa.array([sum(lengths)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["chunk", "kind", "bytes", "ids", "lengths", "texts"])

        for batch in few_rows(batches):
            for doc_id, at, data in zip(batch.column("doc_id").to_pylist(), batch.column("fold").to_pylist(), text_bytes(batch.column("text")), strict=True):
                kind = group[at]
                if held[kind][0] and size[kind] + len(data) > s.chunk_bytes:
                    yield done(kind)
                held[kind][0].append(doc_id)
                held[kind][1].append(data)
                size[kind] += len(data)
        for kind in held:
            if held[kind][0]:
                yield done(kind)

    return run


CHUNKS = "chunk long, kind int, bytes long, ids array<long>, lengths array<long>, texts binary"


def texts_of(lengths: list[int], packed: bytes) -> list[bytes]:
    data, stops = zstandard.ZstdDecompressor().decompress(packed), np.cumsum(lengths)
    return [data[b - n : b] for b, n in zip(stops.tolist(), lengths, strict=True)]


def counter(parts: int, passes: int, share: int):
    """Function for mapInArrow: for each chunk and range of keys of the share, the keys in order and their counts in the chunk."""
    shift = U64(64 - parts.bit_length() + 1)

    def run(batches):
        for batch in few_rows(batches, 1):
            chunk, kind, lengths, texts = (batch.column(c)[0].as_py() for c in ("chunk", "kind", "lengths", "texts"))
            # every chunk has an end token, so that these are the keys of Grams; counting needs no places of theirs
            unique, n = np.unique(np.concatenate(keys_of(texts_of(lengths, texts))[2:]), return_counts=True)
            n = n.astype(np.uint32) * np.uint32(kind != HELD)
            cuts = np.searchsorted(unique >> shift, np.arange(parts + 1, dtype=U64)) if parts > 1 else np.array([0, len(n)])
            rows = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a and p % passes == share]
            keys = [pack_ints(np.diff(unique[a:b], prepend=U64(0))) for _, a, b in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([kind] * len(rows), pa.int32()), pa.array(keys, pa.binary()), pa.array([pack_ints(n[a:b]) for _, a, b in rows], pa.binary())],
                ["part", "chunk", "kind", "keys", "n"],
            )

    return run


COUNTED = "part int, chunk long, kind int, keys binary, n binary"
FIGURES = ["tokens", "types", *(f"{x}{r}" for r in range(ROTATIONS) for x in ("tokens_", "types_"))]
SUMMED = "part int, chunk long, kind int, others binary, own binary, " + ", ".join(f"{c} long" for c in FIGURES)


def summed(group: pa.Table) -> pa.Table:
    """Of a range of keys: each chunk's totals in the order of its keys, those of its own group apart; the first row also has the figures of the range."""
    keys = [np.cumsum(unpack_ints(x, U64), dtype=U64) for x in group.column("keys").to_pylist()]
    n = [unpack_ints(x, np.uint32) for x in group.column("n").to_pylist()]
    kinds = group.column("kind").to_pylist()
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    ats = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
    del keys
    totals = np.zeros((ROTATIONS + 1, len(unique)), np.uint64)
    for a, c, kind in zip(ats, n, kinds, strict=True):
        totals[kind, a] += c  # keys of a chunk are distinct
    all_, word = totals.sum(0), (unique & ONE) == 0
    rest = all_[word] - totals[:ROTATIONS, word]
    first = [int(x) for x in (all_[word].sum(), (all_[word] > 0).sum(), *(f for r in rest for f in (r.sum(), (r > 0).sum())))]
    figures = [first, *([[0] * len(first)] * (len(kinds) - 1))]
    own = [pack_ints(totals[k][a]) for a, k in zip(ats, kinds, strict=True)]
    others = [pack_ints(all_[a] - totals[k][a]) for a, k in zip(ats, kinds, strict=True)]
    return pa.table(
        [group.column("part"), group.column("chunk"), group.column("kind"), pa.array(others, pa.binary()), pa.array(own, pa.binary()), *(pa.array(c, pa.int64()) for c in zip(*figures, strict=True))],
        names=["part", "chunk", "kind", "others", "own", *FIGURES],
    )


def looked_up(chunk: pa.Table, totals: pa.Table, with_own: bool) -> tuple[Grams, np.ndarray]:
    """A chunk's tokens and the totals of its keys."""
    g = Grams(texts_of(chunk.column("lengths")[0].as_py(), chunk.column("texts")[0].as_py()))
    n, at = np.zeros(len(g.unique)), 0
    totals = totals.sort_by("part")
    for i in range(totals.num_rows):
        got = unpack_ints(totals.column("others")[i].as_py(), np.uint64)
        if with_own:
            got = got + unpack_ints(totals.column("own")[i].as_py(), np.uint64)
        n[at : at + len(got)] = got
        at += len(got)
    if at != len(g.unique):
        raise RuntimeError("a chunk and its totals differ")
    return g, n


def estimates(g: Grams, n: np.ndarray, tokens: int, types: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token: the bucket of its contexts; its probability by triple, by pair, by word and by the uniform distribution."""
    pair, word = n[g.after_pair], n[g.after_word]
    bucket = np.minimum(np.log2(pair + 1), PAIRS - 1).astype(np.int64) * WORDS + np.minimum(np.log2(word + 1) / 2, WORDS - 1).astype(np.int64)
    p = np.column_stack((n[g.triple] / np.maximum(pair, 1), n[g.pair] / np.maximum(word, 1), n[g.word] / max(tokens, 1), np.full(len(pair), 1.0 / (types + 1))))
    return bucket, p


LEVELS = "bucket int, l3 int, l2 int, l1 int, n long, p3 double, p2 double, p1 double"


def tuner(figures: dict[str, int]):
    """Function for a cogroup of a chunk and its totals: tokens by bucket and powers of two of their probabilities in the other groups' counts."""

    def run(key, chunk, totals):
        names = [c.split()[0] for c in LEVELS.split(", ")]
        kinds = [pa.int32()] * 4 + [pa.int64()] + [pa.float64()] * 3
        if not chunk.num_rows:
            return pa.schema(list(zip(names, kinds, strict=True))).empty_table()
        r = chunk.column("kind")[0].as_py()
        g, n = looked_up(chunk, totals, with_own=False)
        bucket, p = estimates(g, n, figures[f"tokens_{r}"], figures[f"types_{r}"])
        level = np.where(p[:, :3] > 0, np.minimum(-np.floor(np.log2(np.maximum(p[:, :3], 1e-300))), LEAST), LEAST + 1).astype(np.int64)
        code = ((bucket * (LEAST + 2) + level[:, 0]) * (LEAST + 2) + level[:, 1]) * (LEAST + 2) + level[:, 2]
        codes, at = np.unique(code, return_inverse=True)
        sums = [np.bincount(at, p[:, i], len(codes)) for i in range(3)]
        split = [codes // (LEAST + 2) ** 3, codes // (LEAST + 2) ** 2 % (LEAST + 2), codes // (LEAST + 2) % (LEAST + 2), codes % (LEAST + 2)]
        return pa.table([pa.array(c, k) for c, k in zip([*split, np.bincount(at), *sums], kinds, strict=True)], names=names)

    return run


def expectation_maximisation(rows: np.ndarray, types: int, steps: int) -> np.ndarray:
    """Weights (triple, pair, word, uniform) of each bucket from rows (bucket, count, sums of the three probabilities).

    A bucket without rows takes those of the nearest lower one.
    """
    start = np.array([0.3, 0.3, 0.3, 0.1])
    weights, last = np.tile(start, (PAIRS * WORDS, 1)), start
    for b in range(PAIRS * WORDS):
        own = rows[rows[:, 0] == b]
        if len(own):
            n = own[:, 1]
            f = np.column_stack((own[:, 2:5] / n[:, None], np.full(len(own), 1.0 / (types + 1))))
            last = start
            for _ in range(steps):
                part = f * last
                last = np.maximum((part / part.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum(), 1e-6)
                last = last / last.sum()
        weights[b] = last
    return weights


def scorer(weights: np.ndarray, tokens: int, types: int):
    """Function for a cogroup of a chunk and its totals: its documents' scores."""

    def run(key, chunk, totals):
        if not chunk.num_rows:
            return SCORES.empty_table()
        g, n = looked_up(chunk, totals, with_own=True)
        bucket, p = estimates(g, n, tokens, types)
        by_token = np.log10((weights[bucket] * p).sum(1) if tokens else p[:, 3])
        base = np.log10((n[g.word] + 1) / (tokens + types + 1))
        ids = chunk.column("ids")[0].as_py()
        per = lambda x: np.bincount(g.place, x, len(ids))
        held = chunk.column("kind")[0].as_py() == HELD
        values = [np.full(len(ids), held), per(np.ones(len(by_token))).astype(np.int64), per(n[g.word] > 0).astype(np.int64), np.full(len(ids), tokens), per(base), per(by_token)]
        return pa.table([pa.array(ids, pa.int64()), *(pa.array(v) for v in values)], schema=SCORES)

    return run


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """SCORED for every row of docs."""
    rows = docs.select("doc_id", fold("doc_id", s.folds).cast("int").alias("fold"), "text")
    chunked = staged(rows.mapInArrow(chunks(s), CHUNKS), "chunks")
    size = chunked.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()["bytes"]
    parts = 1 << (size // s.part_bytes).bit_length()
    counted = lambda share: chunked.select("chunk", "kind", "lengths", "texts").mapInArrow(counter(parts, s.passes, share), COUNTED)
    shares = [staged(counted(i).groupBy("part").applyInArrow(summed, SUMMED), "totals") for i in range(s.passes)]
    totals = reduce(DataFrame.unionByName, shares)
    figures = totals.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FIGURES)).first().asDict()
    own = totals.select("chunk", "kind", "part", "others", "own")
    met = lambda where, *columns: chunked.where(where).groupBy("chunk").cogroup(own.where(where).select("chunk", "part", *columns).groupBy("chunk"))
    levels = met(f"kind <> {HELD}", "others").applyInArrow(tuner(figures), LEVELS)
    # at most a row for each bucket and three levels: a bound that does not grow with the data
    levels = levels.groupBy("bucket", "l3", "l2", "l1").agg(*(F.sum(c).alias(c) for c in ("n", "p3", "p2", "p1"))).select("bucket", F.col("n").cast("double"), "p3", "p2", "p1").toArrow()
    cells = np.column_stack([c.to_numpy().astype(np.float64) for c in levels.columns]) if levels.num_rows else np.empty((0, 5))
    weights = expectation_maximisation(cells, figures["types"], s.steps)
    return met("true", "others", "own").applyInArrow(scorer(weights, figures["tokens"], figures["types"]), SCORED)
