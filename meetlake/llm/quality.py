"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Each passage is encoded from its make-up (shares of kinds of bytes,
word lengths, repeated words) by a learned layer; gated attention, learned from document labels alone, weighs the
passages; the weighted representation gives the score. So a document of good passages with one bad stretch is judged by
what the labels say of such stretches, not by its average.

The network is fitted in one task on a bounded sample of labelled rows (Settings.per_class and Settings.max_bytes) with both classes
weighing alike; scoring reads every row and whole texts, partition by partition, without a shuffle.

Defined results: a null or empty text is one empty passage; repeated rows are scored alike; without labels of both
classes every score is the share of label 1 (0 without labels); a null id is not held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetlake.llm.common import few_rows, fold, mix, pieces, powers, prefix_hashes, text_bytes, word_spans
from meetlake.llm.sampling import fitted, training_rows

PASSAGE = 384  #: bytes


@dataclass(frozen=True)
class Settings:
    per_class: int = 500  #: labelled texts of a class that the network is fitted on
    max_bytes: int = 16_384  #: longer texts are not taken into that sample
    hidden: int = 24
    attention: int = 12
    steps: int = 120
    rate: float = 0.02
    decay: float = 1e-3
    threshold: float = 0.3


def byte_kinds() -> np.ndarray:
    """A kind for each byte: the marks each their own, the others by what they are."""
    kind = np.zeros(256, np.int64)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    kind[marks] = np.arange(8, 8 + len(marks))
    for k, values in enumerate((range(97, 123), range(65, 91), range(48, 58), (32,), (10,), range(192, 256), range(128, 192)), 1):
        kind[list(values)] = k
    return kind


KINDS = byte_kinds()
N_KINDS = int(KINDS.max()) + 1
WIDTH = N_KINDS + 6


def passages(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of a run of texts, and the place of its text in the run."""
    size = np.array([len(t) + 1 for t in run])
    n = np.maximum(1, (size - 1 + PASSAGE - 1) // PASSAGE)
    buf = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
    start = np.cumsum(size) - size
    text = np.repeat(np.arange(len(run)), size)
    first = np.cumsum(n) - n
    at = first[text] + np.minimum((np.arange(len(buf)) - start[text]) // PASSAGE, n[text] - 1)
    total = int(n.sum())
    kinds = np.bincount(at * N_KINDS + KINDS[buf], minlength=total * N_KINDS).reshape(total, N_KINDS).astype(np.float32)
    a, b = word_spans(buf)
    c = prefix_hashes(buf)
    ids = mix((c[b] - c[a]) * powers(len(buf))[1][a])
    own = at[a]
    words = np.bincount(own, minlength=total)
    back = lambda k: np.bincount(own[k:][(ids[k:] == ids[:-k]) & (own[k:] == own[:-k])], minlength=total)
    length = (b - a).astype(np.float64)
    mean = np.bincount(own, length, total) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(own, length**2, total) / np.maximum(words, 1) - mean**2, 0))
    marked = np.bincount(own[KINDS[buf[b - 1]] >= 8], minlength=total)
    bytes_ = np.maximum(kinds.sum(1, keepdims=True), 1)
    w = np.maximum(words, 1)
    x = np.column_stack((np.sqrt(kinds / bytes_), back(1) / w, back(2) / w, np.log1p(mean), np.log1p(spread), marked / w, np.log1p(words)))
    return x.astype(np.float32), np.repeat(np.arange(len(run)), n)


class Network:
    """tanh layer, gated attention, logistic output; float32 weights in a dict."""

    def __init__(self, s: Settings, seed: int = 6):
        r = np.random.default_rng(seed)
        init = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"w": init(WIDTH, s.hidden), "b": np.zeros(s.hidden, np.float32), "v": init(s.hidden, s.attention), "u": init(s.hidden, s.attention), "a": init(s.attention, 1), "c": init(s.hidden, 1), "d": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = ((t * g) @ p["a"])[:, 0]
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, e)
        k = np.exp(e - top[bag])
        k /= np.bincount(bag, k, bags)[bag]
        z = np.zeros((bags, h.shape[1]), np.float32)
        np.add.at(z, bag, (h * k[:, None]).astype(np.float32))
        y = 1 / (1 + np.exp(-np.clip((z @ p["c"])[:, 0] + p["d"][0], -35, 35)))
        return {"x": x, "h": h, "t": t, "g": g, "k": k, "z": z, "y": y}

    def gradient(self, f: dict, bag: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
        p, d = self.p, (f["y"] - target) * weight
        dz = d[:, None] * p["c"][:, 0]
        dh = dz[bag] * f["k"][:, None]
        dk = (dz[bag] * f["h"]).sum(1)
        de = f["k"] * (dk - np.bincount(bag, f["k"] * dk, len(d))[bag])
        dq = de[:, None] * p["a"][:, 0]
        dt, dg = dq * f["g"] * (1 - f["t"] ** 2), dq * f["t"] * f["g"] * (1 - f["g"])
        dh = (dh + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ dh, "b": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de[:, None], "c": f["z"].T @ d[:, None], "d": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, s: Settings) -> Network:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 0.02)
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()).astype(np.float32)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for i in range(1, s.steps + 1):
            g = self.gradient(self.forward(x, bag, len(y)), bag, y, weight)
            for k, a in self.p.items():
                step = g[k] + s.decay * a * (k != "d")
                m[k] = 0.9 * m[k] + 0.1 * step
                v[k] = 0.99 * v[k] + 0.01 * step**2
                self.p[k] = (a - s.rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return self


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Passages of all texts and the place of each one's text; parts of a long text are one bag."""
    xs, at = [np.empty((0, WIDTH), np.float32)], [np.empty(0, np.int64)]
    for run, places in pieces(texts):
        x, own = passages(run)
        xs.append(x)
        at.append(np.asarray(places)[own])
    return np.concatenate(xs), np.concatenate(at)


def fit(texts: list[bytes], y: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """The weights of the network; nothing without labels of both classes."""
    if len(y) == 0 or np.bincount(y, minlength=2).min() < 2:
        return {}
    x, bag = bags(texts)
    net = Network(s).fit(x, bag, y.astype(np.float32), s)
    return net.p | {"mean": net.mean, "scale": net.scale}


def network(arrays: dict[str, np.ndarray], s: Settings) -> Network | None:
    if not arrays:
        return None
    net = Network(s)
    net.p = {name: arrays[name] for name in net.p}
    net.mean, net.scale = arrays["mean"], arrays["scale"]
    return net


def score(docs: DataFrame, labels: DataFrame, held_out_fold: tuple[int, int] = (5, 0), s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; learns from labels outside the held-out fold only."""
    n, left = held_out_fold
    rows, share = training_rows(docs, labels, "quality", fold("doc_id", n) != left, s.per_class, s.max_bytes)
    arrays = fitted(rows, lambda texts, y: fit(texts, y, s))

    def run(batches):
        net = network(arrays, s)
        for batch in few_rows(batches):
            texts = text_bytes(batch.column("text"))
            out = np.full(len(texts), share)
            if net:
                x, bag = bags(texts)
                out = net.forward(x, bag, len(texts))["y"].astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out)], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", F.coalesce(fold("doc_id", n) == left, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= s.threshold).cast("int"))
