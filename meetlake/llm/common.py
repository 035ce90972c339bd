"""What the operators share: tables, the shared folder, word hashing in numpy."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by these bytes: space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker holds as numpy arrays at a time.
CHUNK_BYTES = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
#: Separators of bare words: as above, and ASCII punctuation.
_BREAKS = _SPACE.copy()
_BREAKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only where that is unset, a local session (tests) sets a folder of this machine; a cluster has none to share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "meetlake-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: its lineage ends there and a lost executor costs nothing.

    What the write shuffled is deleted when it ends, as nothing reads it any more, so that disk holds one step's shuffles.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until df has no column of that name; letter case does not count."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def powers(n: int, _kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_kept.get("p", ())) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for name, base in (("p", _BASE), ("q", _BASE_INVERSE)):
            a = np.full(size, base, U64)
            a[0] = 1
            _kept[name] = np.multiply.accumulate(a)
    return _kept["p"][:n], _kept["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of each 64-bit value over all its bits."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] the polynomial hash of buf[i:j], still to be multiplied by base**-i."""
    c = np.empty(len(buf) + 1, U64)
    c[0] = 0
    np.cumsum(_TABLE[buf] * powers(len(buf))[0], out=c[1:])
    return c


def word_spans(buf: np.ndarray, bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer that ends with a separator; bare words stop at punctuation too."""
    word = ~(_BREAKS if bare else _SPACE)[buf]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edges = np.concatenate(([0], edges))
    return edges[0::2], edges[1::2]


def word_ids(text: bytes) -> np.ndarray:
    """64-bit ids of the lower-cased (A-Z) words of a text, in order."""
    ids = [part for _, part in words_of([text])]
    return np.concatenate(ids) if ids else np.empty(0, U64)


def pieces(texts: Iterable[bytes]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Texts in runs of about CHUNK_BYTES, with their places; texts longer than that come in parts cut at separators."""
    held, places, size = [], [], 0
    for place, text in enumerate(texts):
        while len(text) > CHUNK_BYTES:
            cut = max(text.rfind(bytes([s]), 0, CHUNK_BYTES) for s in SPACES)
            if cut <= 0:
                cut = min((i for s in SPACES if (i := text.find(bytes([s]), CHUNK_BYTES)) > 0), default=len(text))
            head, text = text[:cut], text[cut:]
            if held:
                yield held, places
            yield [head], [place]
            held, places, size = [], [], 0
            if not text:
                break
        else:
            held.append(text)
            places.append(place)
            size += len(text) + 1
            if size >= CHUNK_BYTES:
                yield held, places
                held, places, size = [], [], 0
    if held:
        yield held, places


def words_of(texts: Iterable[bytes], bare: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place of the text and id of each word, a run of texts at a time; a text's words are in order."""
    for run, places in pieces(texts):
        buf = np.frombuffer(b"\n".join(run).lower() + b"\n", np.uint8)
        start, end = word_spans(buf, bare)
        c = prefix_hashes(buf)
        ids = mix((c[end] - c[start]) * powers(len(buf))[1][start])
        stops = np.cumsum([len(t) + 1 for t in run])
        yield np.asarray(places)[np.searchsorted(stops, start, side="right")], ids


def docs_words(texts: Iterable[bytes], bare: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(place, word ids) for each text that has words, in order."""
    last, held = -1, []
    for places, ids in words_of(texts, bare):
        if not len(ids):
            continue
        cuts = np.flatnonzero(places[1:] != places[:-1]) + 1
        for place, part in zip(places[np.concatenate(([0], cuts))].tolist(), np.split(ids, cuts), strict=True):
            if place != last and held:
                yield last, held[0] if len(held) == 1 else np.concatenate(held)
                held = []
            last = place
            held.append(part)
    if held:
        yield last, held[0] if len(held) == 1 else np.concatenate(held)


def few_rows(batches, rows: int = 256):
    """The batches in slices, so that a worker holds few texts and spans as Python values at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8; null is empty."""
    return [b"" if s is None else s.encode() for s in column.to_pylist()]


def stems(texts: list[bytes], lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each bare word of a run of texts: keys of its first bytes at each length, then of the whole word.

    A word that is shorter than a length has its whole-word key there. Beside them, where each text's words begin.
    """
    buf = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    start, end = word_spans(buf, bare=True)
    c, back = prefix_hashes(buf), powers(len(buf))[1][start]
    whole = mix((c[end] - c[start]) * back ^ U64(0x5851F42D4C957F2D))
    cols = [np.where(end - start < n, whole, mix((c[np.minimum(start + n, end)] - c[start]) * back)) for n in lengths]
    begins = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]))
    return np.column_stack([*cols, whole]), begins


class Lookup:
    """Vectorised hash table from distinct 64-bit keys to their places in the order they were added; -1 for absent ones."""

    def __init__(self, keys: np.ndarray):
        self.size, self.keys = 0, np.empty(0, U64)
        self.add(keys)

    def add(self, keys: np.ndarray) -> None:
        """keys: distinct ones, none of them in the table."""
        first, self.size = self.size, self.size + len(keys)
        if self.size > len(self.keys) or not len(self.keys):
            room = max(16, 1 << int(self.size).bit_length())
            self.keys = np.concatenate((self.keys[:first], np.empty(room - first, U64)))
            bits = int(room).bit_length()
            self.shift, self.mask, first = U64(64 - bits), (1 << bits) - 1, 0
            self.slots = np.full(1 << bits, -1, np.int32)
        self.keys[self.size - len(keys) : self.size] = keys
        left = np.arange(first, self.size, dtype=np.int32)
        at = self._home(self.keys[first : self.size])
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several that want a slot, the last gets it
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        found = self.slots[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found[open_] = self.slots[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])]
        return found
