"""Recordings in chunks: rows (name, part, parts, first, n, rate, channels, samples) of some seconds each.

What depends on neighbouring samples gets the borders of the neighbouring chunks (`bordered`: keyed by recording and
chunk, so that an hour is dealt over many tasks), and gives sample by sample what the whole recording would. The band of the
envelope is a recursive filter: each chunk is filtered from rest, the states that chunks leave behind are carried on
over a recording (four numbers a chunk), and each chunk is then filtered from the state it is entered with. No task
holds more samples than those of a chunk and its borders.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.operators import wav
from meetlake.sources.shared import staged

RATE = 16_000
SCHEMA = "name string, part int, parts int, first long, n long, rate int, channels int, samples array<float>"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Seconds of a chunk, and lobes of the resampling kernel on either side.
CHUNK_S, LOBES = 10, 16
FRAME_MS = 10
#: Frames whose states are worked out at once.
BLOCK = 25
#: Chunks whose spans (some hundred bytes each) are broadcast, at most.
BROADCAST_CHUNKS = 100_000
#: The band of syllables in Hz.
LOW, HIGH = 300.0, 3000.0


def cut(recordings: DataFrame, seconds: int = CHUNK_S) -> DataFrame:
    """SCHEMA of recordings (name, content), one chunk in memory beside the file's bytes; faulty files have none, empty ones one empty chunk."""

    def run(frames):
        for f in frames:
            for name, data in zip(f["name"], f["content"], strict=True):
                try:
                    form = wav.form(data)
                except wav.Fault:
                    continue
                size = form.rate * seconds
                parts = max(1, -(-form.frames // size))
                for k in range(parts):
                    x = wav.samples(data, form, k * size, size).astype(np.float32)
                    yield pd.DataFrame([(name, k, parts, k * size, form.frames, form.rate, form.channels, x)], columns=COLUMNS)

    return recordings.select("name", "content").mapInPandas(run, SCHEMA)


def faults(recordings: DataFrame) -> DataFrame:
    """name, fault of every recording; null where it can be read."""

    def fault(data) -> str | None:
        try:
            wav.form(data)
        except wav.Fault as e:
            return str(e)
        return None

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"name": f["name"], "fault": [fault(x) for x in f["content"]]})

    return recordings.select("name", "content").mapInPandas(run, "name string, fault string")


def bordered(chunks: DataFrame, before: Column | int, after: Column | int) -> DataFrame:
    """chunks with `left` and `right`, the last and first samples of the neighbours, so many at most; one shuffle by recording and chunk."""
    before, after = (F.lit(c) if isinstance(c, int) else c for c in (before, after))
    own = [c for c in COLUMNS if c not in ("name", "part", "samples")]
    empty = F.array().cast("array<float>")
    size = F.size("samples")
    keep = F.least(before, size)
    tail = F.when(keep > 0, F.slice("samples", size - keep + 1, F.greatest(keep, F.lit(1)))).otherwise(empty)
    head = F.when(after > 0, F.slice("samples", F.lit(1), F.greatest(after, F.lit(1)))).otherwise(empty)
    sent = [(F.col("part"), 0, F.col("samples")), (F.col("part") + 1, -1, tail), (F.col("part") - 1, 1, head)]
    rows = chunks.select("name", "parts", F.explode(F.array(*(F.struct(p.alias("part"), F.lit(side).alias("side"), *own, x.alias("samples")) for p, side, x in sent))).alias("r"))
    rows = rows.select("name", "r.*").where("part >= 0 AND part < parts")
    of = lambda side, c: F.first(F.when(F.col("side") == side, F.col(c)), ignorenulls=True)
    out = rows.groupBy("name", "part").agg(*(of(0, c).alias(c) for c in own), of(0, "samples").alias("samples"), F.coalesce(of(-1, "samples"), empty).alias("left"), F.coalesce(of(1, "samples"), empty).alias("right"))
    return out.select(*COLUMNS, "left", "right")


def each(chunks: DataFrame, schema: str, one) -> DataFrame:
    """The rows that `one` (a chunk) gives, chunk by chunk."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for f in frames:
            for row in f.itertuples(index=False):
                rows = list(one(row))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return chunks.mapInPandas(run, schema)


def reach(source: int, target: int) -> int:
    """Samples on either side that a resampled one is made of."""
    return math.ceil(LOBES * max(1.0, source / target))


def resample(x: np.ndarray, source: int, target: int = RATE, first: int = 0, left: np.ndarray | None = None, right: np.ndarray | None = None) -> np.ndarray:
    """The samples at another rate that fall into x, which begins at `first`: windowed-sinc means, low-passed below both rates' limits.

    left and right are what lies beside x; beyond them is silence.
    """
    if source == target or not len(x):
        return np.asarray(x, np.float64)
    scale, wide = min(1.0, target / source), reach(source, target)
    left = np.empty(0) if left is None else left[-wide - 1 :]
    right = np.empty(0) if right is None else right[: wide + 1]
    near = np.zeros(len(x) + 2 * wide + 2)
    near[wide + 1 - len(left) : wide + 1] = left
    near[wide + 1 : wide + 1 + len(x)] = x
    near[wide + 1 + len(x) : wide + 1 + len(x) + len(right)] = right
    places = np.arange(-(-first * target // source), -(-(first + len(x)) * target // source))
    offsets, out = np.arange(-wide + 1, wide + 1), np.empty(len(places))
    for a in range(0, len(places), 4096):
        at = places[a : a + 4096] * (source / target)
        index = np.floor(at).astype(np.int64)[:, None] + offsets
        d = at[:, None] - index
        kernel = scale * np.sinc(scale * d) * np.where(np.abs(d) < wide, 0.5 + 0.5 * np.cos(np.pi * d / wide), 0)
        out[a : a + len(at)] = (near[index - first + wide + 1] * kernel).sum(1) / np.maximum(kernel.sum(1), 1e-9)
    return np.clip(out, -1, 1)


def resampled(chunks: DataFrame, target: int = RATE) -> DataFrame:
    """The chunks at another rate."""

    def one(c):
        x = resample(c.samples, c.rate, target, c.first, c.left, c.right).astype(np.float32)
        yield c.name, c.part, c.parts, -(-c.first * target // c.rate), -(-c.n * target // c.rate), target, c.channels, x

    wide = F.ceil(LOBES * F.greatest(F.lit(1.0), F.col("rate") / target)).cast("int") + 1
    wide = F.when(F.col("rate") == target, 0).otherwise(wide)
    return each(bordered(chunks, wide, wide), SCHEMA, one)


class Band:
    """A Butterworth high-pass and low-pass of two poles each, one after the other, as one linear system of four states.

    A frame is filtered by three products: of its samples with the response to each, of the state with what it adds, and
    of both with the state that follows. Samples are between -1 and 1; a state is a column of four numbers.
    """

    def __init__(self, rate: int):
        self.size = max(1, rate * FRAME_MS // 1000)
        (ah, bh, ch, dh), (al, bl, cl, dl) = self.section(LOW, rate, True), self.section(min(HIGH, 0.45 * rate), rate, False)
        a = np.block([[ah, np.zeros((2, 2))], [np.outer(bl, ch), al]])
        b, c, d = np.concatenate((bh, bl * dh)), np.concatenate((dl * ch, cl)), dl * dh
        power, adds, response, follows = np.eye(4), [], [d], []
        for _ in range(self.size):
            adds.append(c @ power)
            follows.append(power @ b)
            response.append(c @ power @ b)
            power = a @ power
        self.step, self.adds, self.follows = power, np.array(adds), np.array(follows[::-1])
        # the states behind each of BLOCK frames, of the state before them and of what each frame adds
        powers = [np.eye(4)]
        for _ in range(BLOCK):
            powers.append(self.step @ powers[-1])
        self.powers = np.vstack(powers[1:])
        self.carried = np.block([[powers[k - j] if j <= k else np.zeros((4, 4)) for j in range(BLOCK)] for k in range(BLOCK)])
        lag = np.subtract.outer(np.arange(self.size), np.arange(self.size))
        self.response = np.where(lag >= 0, np.array(response)[np.maximum(lag, 0)], 0.0)

    @staticmethod
    def section(cutoff: float, rate: int, high: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """One filter as a system s' = A s + B v, y = C s + D v."""
        w = 2 * math.pi * cutoff / rate
        alpha, cos = math.sin(w) / math.sqrt(2), math.cos(w)
        edge = 1 + cos if high else 1 - cos
        b = np.array([edge / 2, -edge if high else edge, edge / 2]) / (1 + alpha)
        a = np.array([-2 * cos, 1 - alpha]) / (1 + alpha)
        return np.array([[-a[0], 1.0], [-a[1], 0.0]]), b[1:] - a * b[0], np.array([1.0, 0.0]), float(b[0])

    def frames(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Root mean square of the band in each whole frame of x, and the state behind the last."""
        v = np.asarray(x, np.float64)[: len(x) // self.size * self.size].reshape(-1, self.size)
        blocks = -(-len(v) // BLOCK)
        fresh = np.zeros((blocks * BLOCK, 4))
        fresh[: len(v)] = v @ self.follows
        # what the frames of a block leave behind, the states that blocks are entered with, and both in all frames
        own, entered = fresh.reshape(blocks, 4 * BLOCK) @ self.carried.T, np.empty((blocks + 1, 4))
        entered[0], over = state, self.powers[-4:].T
        for k in range(blocks):
            entered[k + 1] = entered[k] @ over + own[k, -4:]
        states = np.concatenate((entered[:1], (own + entered[:-1] @ self.powers.T).reshape(-1, 4)[: len(v)]))
        y = v @ self.response.T + states[:-1] @ self.adds.T
        return np.sqrt(np.einsum("ij,ij->i", y, y) / self.size), states[-1]


@lru_cache(8)
def band(rate: int) -> Band:
    return Band(rate)


def own_frames(c, size: int) -> tuple[int, np.ndarray]:
    """The first of the frames that begin in a chunk, and the samples of all that are whole."""
    k = -(-c.first // size)
    x = np.concatenate((np.asarray(c.samples, np.float64), np.asarray(c.right, np.float64)))
    end = min(-(-(c.first + len(c.samples)) // size) * size, c.n // size * size)
    return k, x[k * size - c.first : max(k * size, end) - c.first]


def envelopes(chunks: DataFrame) -> DataFrame:
    """name, k, rms: the level of the band every ten milliseconds; `chunks` are read twice."""
    near = bordered(chunks, 0, F.ceil(F.col("rate") * FRAME_MS / 1000).cast("int"))

    def left_behind(c):
        b = band(c.rate)
        _, x = own_frames(c, b.size)
        yield c.name, c.part, c.rate, len(x) // b.size, b.frames(x, np.zeros(4))[1].tolist()

    def entered(f: pd.DataFrame) -> pd.DataFrame:
        state, out = np.zeros(4), []
        for row in f.sort_values("part").itertuples(index=False):
            out.append((row.name, row.part, state.tolist()))
            state = np.linalg.matrix_power(band(row.rate).step, row.frames) @ state + row.state
        return pd.DataFrame(out, columns=["name", "part", "state"])

    def one(c):
        b = band(c.rate)
        k, x = own_frames(c, b.size)
        yield from ((c.name, k + i, float(v)) for i, v in enumerate(b.frames(x, np.asarray(c.state))[0]))

    states = each(near, "name string, part int, rate int, frames int, state array<double>", left_behind).groupBy("name").applyInPandas(entered, "name string, part int, state array<double>")
    return each(near.join(states, ["name", "part"]), "name string, k long, rms double", one)


def sounds(chunks: DataFrame, spans: DataFrame, seconds: int = CHUNK_S) -> DataFrame:
    """name, id, rate, samples of each span (name, id, start_ms, end_ms) of recordings in chunks of so many seconds.

    A chunk gives each span that it overlaps its share; shares are joined by span, so that borders do not matter.
    """
    ms = 1000 * seconds
    wanted = spans.where("end_ms > start_ms").select("name", F.struct("id", "start_ms", "end_ms").alias("s"), F.explode(F.sequence(F.floor(F.col("start_ms") / ms).cast("int"), F.floor((F.col("end_ms") - 1) / ms).cast("int"))).alias("part"))
    wanted = wanted.groupBy("name", "part").agg(F.collect_list("s").alias("spans"))

    def one(c):
        x = np.asarray(c.samples)
        for s in c.spans:
            a, b = (s[k] * c.rate // 1000 - c.first for k in ("start_ms", "end_ms"))
            yield c.name, s["id"], c.part, c.rate, x[max(a, 0) : max(b, 0)]

    kind = dict(spans.dtypes)["id"]
    wanted = staged(wanted, "wanted")  # few beside the samples, which stay where they are unless there are very many
    few = wanted.count() <= BROADCAST_CHUNKS
    return joined(each(chunks.join(F.broadcast(wanted) if few else wanted, ["name", "part"]), f"name string, id {kind}, part int, rate int, samples array<float>", one))


def joined(shares: DataFrame) -> DataFrame:
    """name, id, rate, samples of spans of which each chunk (part) has given its share."""
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "samples"))), lambda x: x["samples"]))
    return shares.groupBy("name", "id").agg(F.max("rate").alias("rate"), whole.alias("samples"))
