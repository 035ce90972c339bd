"""Toxicity by class-conditional Kneser-Ney models.

Two Kneser-Ney models, of toxic and of ordinary text, give each word a probability after the word before it. Discounted
counts of the pair come first; what the discounts free goes to the counts of the pair in both classes together, and from
there to the word without its context. That is spelt out from its start: its first letters, a few more of them, then the
whole word, by continuation counts (distinct words before it), and at each step both classes back off to the shared
counts. So an expression that is rare in one class is not taken for evidence, while a word with an unseen ending is still
judged by its stem. A text's evidence is the difference of its length-normalised log-likelihoods under the two models,
over the whole text, in its most toxic window, and of its clearly one-sided words; a logistic curve fitted on labelled
texts that the models have not seen turns it into a score.

The models are fitted in one task on a bounded sample of labelled rows (Settings.per_class and Settings.max_bytes);
scoring reads every row and whole texts, partition by partition, without a shuffle.

Defined results: a null or empty text has no evidence and gets the score of evidence 0; repeated rows are scored alike
(and equal texts count once in the models); without labels of both classes every score is the share of toxic labels (0
without labels); a null id is not held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetlake.llm.common import U64, Lookup, few_rows, fold, mix, pieces, stems, text_bytes
from meetlake.llm.sampling import fitted, training_rows


@dataclass(frozen=True)
class Settings:
    per_class: int = 2500  #: labelled texts of a class that models and calibration are fitted on
    max_bytes: int = 32_768  #: longer texts are not taken into that sample
    discounts: tuple[float, float, float] = (0.9, 1.3, 1.6)  #: of a word's spelling, for counts of 1, 2 and more
    pair_discounts: tuple[float, float, float] = (1.0, 1.3, 1.6)  #: of a word after another one; those seen once back off
    stems: tuple[int, ...] = (2, 3, 4, 5, 6)  #: bytes of a word's start
    window: int = 64  #: words
    clear: float = 2.5  #: log ratio from which a word is clearly one-sided
    toxic_share: float = 0.6  #: of texts, that the curve assumes: a miss costs more than a false alarm
    threshold: float = 0.7


START = U64(0x5851F42D4C957F2D)


def discount(n: np.ndarray, amounts: tuple[float, ...]) -> np.ndarray:
    return np.minimum(np.array([0.0, *amounts])[np.minimum(n, len(amounts)).astype(int)], n)


def words_before(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The word before each; START where a text begins."""
    before = np.concatenate(([START], words[:-1]))[: len(words)]
    before[begins[begins < len(words)]] = START
    return before


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * U64(0x9E3779B97F4A7C15) ^ words)


def spelling(keys: np.ndarray, cls: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Known keys of words and word starts in order, and log p(ordinary), log p(toxic) of each. keys: stems() of an event each."""
    above, found, values = np.zeros(len(keys), np.int64), [], []
    total = np.maximum(np.bincount(cls, minlength=2), 1).astype(float)[None, :]
    logs = np.zeros((1, 2))
    for level in range(keys.shape[1]):
        own, first, at = np.unique(keys[:, level], return_index=True, return_inverse=True)
        n = np.zeros((len(own), 2))
        np.add.at(n, (at, cls), 1)
        parent, freed = above[first], np.zeros_like(total)
        np.add.at(freed, parent, discount(n, s.discounts))
        both = n.sum(1)
        shared = ((both + 1e-3) / (np.bincount(parent, both, len(total)) + 1)[parent])[:, None]
        p = np.where(total[parent] > 0, (n - discount(n, s.discounts) + freed[parent] * shared) / np.maximum(total[parent], 1), shared)
        logs = logs[parent] + np.log(p)
        found.append(own)
        values.append(logs)
        above, total = at, n
    known, first = np.unique(np.concatenate(found[::-1]), return_index=True)
    return known, np.concatenate(values[::-1])[first]


def models(texts: list[bytes], toxic: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """log p(toxic) - log p(ordinary) by word start, by pair of words that came twice, and what a context adds to any other word."""
    parts = [(stems(run, s.stems), places) for run, places in pieces(texts)]
    keys = np.concatenate([k for (k, _), _ in parts])
    sizes = [np.diff(np.append(b, len(k))) for (k, b), _ in parts]
    cls = np.concatenate([np.repeat(toxic[np.asarray(places)], n) for (_, places), n in zip(parts, sizes, strict=True)]).astype(np.int64)
    begins = np.cumsum(np.concatenate(([0], *sizes)))[:-1]
    del parts
    before, word = words_before(keys[:, -1], begins), keys[:, -1].copy()
    pair = pair_keys(before, word)
    # an event is a word after another one, once for each class
    _, event = np.unique(pair * U64(2) + cls.astype(U64), return_index=True)
    known, logs = spelling(keys[event], cls[event], s)
    del keys
    pairs, first, at = np.unique(pair, return_index=True, return_inverse=True)
    n = np.zeros((len(pairs), 2))
    np.add.at(n, (at, cls), 1)
    contexts, context = np.unique(before[first], return_inverse=True)
    total, freed = np.zeros((2, len(contexts), 2))
    np.add.at(total, context, n)
    np.add.at(freed, context, discount(n, s.pair_discounts))
    both = n.sum(1)
    plain = np.exp(logs[np.searchsorted(known, word[first])])
    shared = ((both - discount(both, s.pair_discounts))[:, None] + np.bincount(context, discount(both, s.pair_discounts), len(contexts))[context, None] * plain) / total.sum(1)[context, None]
    p = np.where(total[context] > 0, (n - discount(n, s.pair_discounts) + freed[context] * shared) / np.maximum(total[context], 1), shared)
    back = np.log(np.maximum(np.where(total > 0, freed / np.maximum(total, 1), 1.0), 1e-9))
    twice = both >= 2
    small = lambda a: (a[:, 1] - a[:, 0]).astype(np.float32)
    return {"starts": known, "start_values": small(logs), "pairs": pairs[twice], "pair_values": small(np.log(p[twice])), "contexts": contexts, "context_values": small(back)}


class KneserNey:
    """The fitted models, ready to weigh words."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.tables = {name: (Lookup(arrays[f"{name}s"]), arrays[f"{name}_values"]) for name in ("start", "pair", "context")}

    def evidence(self, keys: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log p(toxic) - log p(ordinary) of each word by its stems(): of the pair if known, else of the longest known start in its context."""
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        table, values = self.tables["start"]
        for level in range(keys.shape[1] - 1, -1, -1):
            at = table.find(keys[left, level])
            out[left[at >= 0]] = values[at[at >= 0]]
            left = left[at < 0]
        before = words_before(keys[:, -1], begins)
        (table, values), (pairs, pair_values) = self.tables["context"], self.tables["pair"]
        at = table.find(before)
        out[at >= 0] += values[at[at >= 0]]
        at = pairs.find(pair_keys(before, keys[:, -1]))
        out[at >= 0] = pair_values[at[at >= 0]]
        return out


def features(evidence: np.ndarray, s: Settings) -> tuple[float, ...]:
    """Mean evidence of the text, of its most toxic window and of its clearly one-sided words, by length."""
    if not len(evidence):
        return 0.0, 0.0, 0.0
    c = np.concatenate(([0.0], np.cumsum(evidence)))
    w = s.window
    best = (c[w:] - c[:-w]).max() if len(evidence) > w else c[-1]
    n = max(len(evidence), w / 2)
    return c[-1] / n, best / w, (np.maximum(evidence - s.clear, 0).sum() + np.minimum(evidence + s.clear, 0).sum()) / n


def texts_features(model: KneserNey | None, texts: list[bytes], s: Settings) -> np.ndarray:
    x = np.zeros((len(texts), 3))
    held: dict[int, list[np.ndarray]] = {}
    for run, places in pieces(texts) if model else ():
        keys, begins = stems(run, s.stems)
        for place, e in zip(places, np.split(model.evidence(keys, begins), begins[1:]), strict=True):
            held.setdefault(place, []).append(e)
        for place in [p for p in held if p != places[-1]]:
            x[place] = features(np.concatenate(held.pop(place)), s)
    for place, e in held.items():
        x[place] = features(np.concatenate(e), s)
    return x


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients, the last one the constant, by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    b, eye = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + eye, x.T @ (weight * (y - p)) - eye @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(texts: list[bytes], y: np.ndarray, share: float, s: Settings) -> dict[str, np.ndarray]:
    """The models from two thirds of the texts, and the curve from the rest; without both classes the curve is a constant."""
    place, first = np.arange(len(texts)), {t: i for i, t in reversed(list(enumerate(texts)))}
    used = np.array([bool(t.strip()) and first[t] == i for i, t in enumerate(texts)], bool)
    learn, check = used & (place % 3 != 0), used & (place % 3 == 0)
    if min((np.bincount(y[m], minlength=2).min() if m.any() else 0) for m in (learn, check)) < 2:
        return {"curve": np.array([0.0, 0.0, 0.0, np.log((share + 1e-9) / (1 - share + 1e-9))])}
    out = models([texts[i] for i in np.flatnonzero(learn)], y[learn], s)
    x, t = texts_features(KneserNey(out), [texts[i] for i in np.flatnonzero(check)], s), y[check]
    weight = np.where(t == 1, s.toxic_share / t.sum(), (1 - s.toxic_share) / (1 - t).sum()) * len(t)
    return out | {"curve": logistic(x, t, weight)}


def scorer(docs: DataFrame, labels: DataFrame, keep, s: Settings):
    """Fit on the sample; a function from texts to scores that a task makes ready once."""
    rows, share = training_rows(docs, labels, "toxic", keep, s.per_class, s.max_bytes)
    arrays = fitted(rows, lambda texts, y: fit(texts, y, share, s))

    def ready():
        model, curve = KneserNey(arrays) if "starts" in arrays else None, arrays["curve"]
        return lambda texts: 1 / (1 + np.exp(-np.clip(texts_features(model, texts, s) @ curve[:-1] + curve[-1], -35, 35)))

    return ready


def score(docs: DataFrame, labels: DataFrame, held_out_fold: tuple[int, int] = (3, 1), s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; learns from labels outside the held-out fold only."""
    n, left = held_out_fold
    ready = scorer(docs, labels, fold("doc_id", n) != left, s)

    def run(batches):
        scores = ready()
        for batch in few_rows(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores(text_bytes(batch.column("text"))))], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", F.coalesce(fold("doc_id", n) == left, F.lit(False)).alias("held_out"), "text")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= s.threshold).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of docs, in their own columns, that are not predicted toxic; each row is judged where it is, with no join."""
    ready = scorer(docs, labels, F.lit(True), s)

    def run(batches):
        scores = ready()
        for batch in few_rows(batches):
            yield batch.filter(pa.array(scores(text_bytes(batch.column(batch.schema.get_field_index("text")))) < s.threshold))

    return docs.mapInArrow(run, docs.schema)
