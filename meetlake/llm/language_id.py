"""Language identification by unigram pieces: the probability of a text is summed over all its segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word (letters, lower-cased, with a space
before it) can be cut into pieces in many ways; the forward algorithm sums the products of all of them. No piece crosses
words, so a text is the product of its words, and a distinct word is worked out once for all languages: its pieces are
looked up as integers of eight bytes at most, and all words of a block advance one byte at a time. The languages' shares
are the prior; the posterior of the best is the score.

Learning: expectation-maximisation by the forward and backward sums, each language in a task of its own, on a bounded
sample of its documents (`Settings`); probabilities of rare pieces are shrunk to those of all languages together.

Defined results: null texts and texts without a letter are `und` with score 0, and so is every text if nothing is learned;
of equally likely languages the first by name; a null id is not learned from and not held out; rows are scored each,
whole, however long; an empty table gives no rows; other columns take no part. A language is learned if it has a training
text with a letter of `max_bytes` at most. Words are told apart by 64-bit hashes: among a million of them, two collide
at odds of one in thirty million.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meetlake.llm.common import U64, Lookup, few_rows, fold, mix, pieces, powers, prefix_hashes

UNKNOWN = "und"
#: Bytes of words, and of pieces: letters, and all of other scripts than ASCII; a space stands before a word.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
PIECE = re.compile(rb" ?[a-z\x80-\xff]+| ")


@dataclass(frozen=True)
class Settings:
    folds: int = 5
    held_out: int = 0  #: the fold that is never learned from
    per_language: int = 400  #: texts of a language that are learned from, at most
    max_bytes: int = 16 << 10  #: length of these, at most
    piece_bytes: int = 8  #: longest piece, at most 8
    rounds: int = 4  #: of expectation-maximisation
    shrunk: float = 50.0  #: pieces of the pooled distribution that are added to a language's
    word_bytes: int = 24  #: parts in which long words are learned from, so that their products don't vanish
    held_words: int = 300_000  #: distinct words that a task remembers
    block: int = 1 << 21  #: values (states times languages) that a task works on at a time


def vocabulary(path: str, longest: int) -> np.ndarray:
    """The pieces of words as integers, little-endian, in ascending order: those of the file, and each single byte."""
    with open(path, "rb") as f:
        found = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    found = {p for p in found if len(p) <= longest and PIECE.fullmatch(p)} | {bytes([b]) for b in np.flatnonzero(LETTERS)} | {b" "}
    return np.sort(np.array([int.from_bytes(p, "little") for p in found], U64))


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer that begins and ends with a space."""
    word = LETTERS[buf]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    return edges[0::2], edges[1::2]


def buffer(run: list[bytes]) -> np.ndarray:
    return np.frombuffer(b" " + b" ".join(run) + b" ", np.uint8)


class Lattice:
    """All segmentations of a block of words: states from before a word's space to behind its last byte, and the pieces between them."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, known: Lookup, longest: int):
        """The words are buf[start:end]; each gets a space before it."""
        size = end - start + 2  # states of a word: one before each byte, the space's too, and one behind the last
        self.first = np.cumsum(size) - size
        self.last, self.length = self.first + size - 1, size - 1
        word = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(word)) - self.first[word]
        text = np.where(at == 0, 32, buf[np.minimum(start[word] + at - 1, len(buf) - 1)]).astype(U64)
        left, padded = size[word] - 1 - at, np.concatenate((text, np.zeros(8, U64)))
        window, src, dst, piece = np.zeros(len(text), U64), [], [], []
        for n in range(1, longest + 1):
            window |= padded[n - 1 : n - 1 + len(text)] << U64(8 * (n - 1))
            here = np.flatnonzero(left >= n)
            if not len(here):
                break
            which = known.find(window[here])
            hit = which >= 0
            src.append(here[hit])
            dst.append(here[hit] + n)
            piece.append(which[hit])
        src, dst, piece = (np.concatenate([np.empty(0, np.int64), *x]) for x in (src, dst, piece))
        order = np.argsort(np.minimum(at[src], 65535).astype(np.uint16), kind="stable") if not len(size) or size.max() < 65536 else np.argsort(at[src], kind="stable")
        self.src, self.dst, self.piece = src[order], dst[order], piece[order]
        self.steps = np.searchsorted(at[self.src], np.arange(int(self.length.max(initial=0)) + 1))
        self.states, self.longest = len(text), longest

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Logarithm of the sum over all segmentations, words by languages; p: pieces by languages."""
        a, scale = np.zeros((self.states, p.shape[1])), np.zeros((len(self.first), p.shape[1]))
        a[self.first] = 1
        for at, (i, j) in enumerate(zip(self.steps[:-1].tolist(), self.steps[1:].tolist(), strict=True)):
            if at and at % 16 == 0:  # only the next few states count from here on; keep them far from zero
                long = np.flatnonzero(self.length > at)
                near = np.minimum(self.first[long, None] + at + np.arange(self.longest), self.last[long, None])
                top = a[near].max(1)
                a[near] /= top[:, None, :]
                scale[long] += np.log(top)
            a[self.dst[i:j]] += a[self.src[i:j]] * p[self.piece[i:j]]  # pieces that begin at a word's same byte end apart
        return np.log(a[self.last]) + scale

    def expected(self, p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, which occur so many times; p: of one language."""
        a, b = np.zeros(self.states), np.zeros(self.states)
        a[self.first] = b[self.last] = 1
        cuts = list(zip(self.steps[:-1].tolist(), self.steps[1:].tolist(), strict=True))
        for i, j in cuts:
            a[self.dst[i:j]] += a[self.src[i:j]] * p[self.piece[i:j]]
        for i, j in reversed(cuts):
            np.add.at(b, self.src[i:j], b[self.dst[i:j]] * p[self.piece[i:j]])
        word = np.searchsorted(self.last, self.src)
        return np.bincount(self.piece, times[word] * a[self.src] * p[self.piece] * b[self.dst] / a[self.last][word], len(p))


def learn(texts: list[bytes], known: Lookup, s: Settings) -> np.ndarray:
    """Expected counts of the pieces in the texts of a language, after some rounds."""
    buf = buffer(texts)
    start, end = spans(buf)
    parts = -(-(end - start) // s.word_bytes)
    at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(start, parts) + at * s.word_bytes
    end = np.minimum(start + s.word_bytes, np.repeat(end, parts))
    keys, one, times = np.unique(word_keys(buf, start, end), return_index=True, return_counts=True)
    lattice = Lattice(buf, start[one], end[one], known, s.piece_bytes)
    counts = np.bincount(lattice.piece, times[np.searchsorted(lattice.last, lattice.src)], known.size)
    for _ in range(s.rounds):
        counts = lattice.expected((counts + 1e-3) / (counts.sum() + 1e-3 * known.size), times)
    return counts


def word_keys(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    c = prefix_hashes(buf)
    return mix((c[end] - c[start]) * powers(len(buf))[1][start])


def learner(path: str, s: Settings):
    """Function for applyInArrow: the sampled texts of a language become the counts of its pieces."""

    def run(rows: pa.Table) -> pa.Table:
        counts = learn([t.lower().encode() for t in rows.column("text").to_pylist()], Lookup(vocabulary(path, s.piece_bytes)), s)
        return pa.table([rows.column("lang")[:1], pa.array([counts.tobytes()], pa.binary())], names=["lang", "counts"])

    return run


def sample(docs: DataFrame, s: Settings) -> tuple[DataFrame, dict[str, int]]:
    """lang, text: a bounded sample of each language's training texts; and how many training texts each has. Reruns agree.

    The driver sees a number for each language.
    """
    trained = F.col("lang").isNotNull() & (fold("doc_id", s.folds) != s.held_out)
    rows = docs.where(trained & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= s.max_bytes)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    size = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not size:
        return rows.select("lang", "text"), size
    most = docs.sparkSession.createDataFrame([(k, min(1.0, 2 * s.per_language / n + 20 / n)) for k, n in size.items()], "lang string, share double")
    few = rows.join(F.broadcast(most), "lang").where(F.pmod("h", F.lit(1 << 20)) <= F.col("share") * (1 << 20)).dropDuplicates(["lang", "h"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return few.withColumn("place", place).where(F.col("place") <= s.per_language).select("lang", "text"), size


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  #: logarithms, by language
    p: np.ndarray  #: pieces by languages


def fit(docs: DataFrame, path: str, s: Settings = Settings()) -> Model:
    """The model: as many values as there are languages and pieces, whatever the number of documents."""
    rows, size = sample(docs, s)
    n = len(vocabulary(path, s.piece_bytes))
    counts = {r["lang"]: np.frombuffer(r["counts"]) for r in rows.groupBy("lang").applyInArrow(learner(path, s), "lang string, counts binary").collect()} if size else {}
    languages = sorted(counts)
    if not languages:
        return Model([], np.empty(0), np.empty((n, 0)))
    own = np.column_stack([counts[k] for k in languages])
    pooled = own.sum(1) + 0.01
    p = (own + s.shrunk * (pooled / pooled.sum())[:, None]) / (own.sum(0) + s.shrunk)
    prior = np.array([size[k] for k in languages], float)
    return Model(languages, np.log(prior / prior.sum()), p)


class Words:
    """Log probabilities of words by language, worked out once each."""

    def __init__(self, pieces_: np.ndarray, p: np.ndarray, s: Settings):
        self.s, self.p, self.pieces = s, p, Lookup(pieces_)
        self.forget()

    def forget(self) -> None:
        self.known, self.logs = Lookup(np.empty(0, U64)), np.empty((0, self.p.shape[1]))

    def of(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each word buf[start:end], a row of logarithms."""
        if self.known.size > self.s.held_words:
            self.forget()
        keys, one, back = np.unique(word_keys(buf, start, end), return_index=True, return_inverse=True)
        new = self.known.find(keys) < 0 if self.known.size else np.ones(len(keys), bool)
        at = one[new]
        order = np.argsort(end[at] - start[at], kind="stable")  # words of a block are about as long
        begin, stop = start[at][order], end[at][order]
        block = max(256, self.s.block // self.p.shape[1])
        cuts = np.flatnonzero(np.diff(np.cumsum(stop - begin + 2) // block)) + 1
        logs = [Lattice(buf, a, b, self.pieces, self.s.piece_bytes).forward(self.p) for a, b in zip(np.split(begin, cuts), np.split(stop, cuts), strict=True) if len(a)]
        if logs:
            self.known.add(keys[new][order])
            self.logs = np.concatenate((self.logs, *logs))
        return self.logs[self.known.find(keys)][back]


def likelihoods(texts: list[bytes], words: Words) -> np.ndarray:
    """Log probability of each lower-cased text by language."""
    out = np.zeros((len(texts), words.p.shape[1]))
    for run, places in pieces(texts):
        buf = buffer(run)
        start, end = spans(buf)
        if not len(start):
            continue
        logs = words.of(buf, start, end)
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in run]), start - 1, side="right")
        first = np.flatnonzero(np.diff(text, prepend=-1))
        np.add.at(out, np.asarray(places)[text[first]], np.add.reduceat(logs, first))
    return out


def scorer(model, path: str, s: Settings):
    """Function for mapInArrow: rows (doc_id, held_out, letter, text) get lang_pred and score."""

    def run(batches):
        m = model.value
        words = Words(vocabulary(path, s.piece_bytes), m.p, s) if m.languages else None
        for batch in few_rows(batches, 1024):
            letter = np.array([bool(x) for x in batch.column("letter").to_pylist()], bool)
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            if words and letter.any():
                logs = likelihoods([b"" if t is None else t.lower().encode() for t in batch.column("text").to_pylist()], words) + m.prior
                best = np.where(letter, logs.argmax(1), -1)
                score = np.where(letter, 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1), 0.0)
            names = [m.languages[i] if i >= 0 else UNKNOWN for i in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, path: str, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs; the model is sent to each executor once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    held = F.coalesce(fold("doc_id", s.folds) == s.held_out, F.lit(False)).alias("held_out")
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    rows = docs.select("doc_id", held, letter, "text")
    return rows.mapInArrow(scorer(sent, path, s), "doc_id long, held_out boolean, lang_pred string, score double")
