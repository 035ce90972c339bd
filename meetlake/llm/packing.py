"""Packing token streams into sequences of fixed length by minimum bin slack.

Documents are tokenized where they lie and cut into whole windows and one remainder each. What is to be packed is then a
multiset of remainder lengths below the capacity, so its histogram is bounded by the capacity however many documents
there are. From it the plan is made: the longest remaining length opens a window, a bitset subset-sum programme over the
remaining lengths picks the multiset that fills the window closest to capacity, the counts are traced back, and the
pattern is repeated as often as the counts allow. Pieces then find their place by length and ordinal, without meeting
each other; ordinals come from counts in small hashed groups, so that a length shared by a third of all documents is
dealt over many tasks.

Defined results: a null or empty text is the end token alone; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meetlake.llm.common import Lookup, few_rows, mix, pieces, powers, prefix_hashes, staged, text_bytes, word_spans

CAPACITY = 4096
END = 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Groups in which pieces of a length are counted; for a fixed number of groups each holds a fixed share of the pieces.
GROUPS = 64

_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """Byte-level letters: printable bytes stand for themselves, the others for letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts by a word-level tokenizer: no token crosses white space, so each distinct word is encoded once."""

    ROOM = 1 << 18  #: distinct words that are kept, some 30 MB in a worker

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.reset()

    def reset(self) -> None:
        self.table, self.flat, self.used = Lookup(np.empty(0, np.uint64)), np.empty(1 << 16, np.uint32), 0
        self.first, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def encode(self, word: bytes) -> list[int]:
        text = word.decode()
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        ids = []
        for part in _PARTS.findall(text.lower()):
            ids += [t.id for t in self.model.tokenize(part if part.isascii() else "".join(self.letters[b] for b in part.encode()))]
        return ids

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        ids = [self.encode(w) for w in words]
        size, n, flat = self.table.size, len(ids), np.fromiter((i for x in ids for i in x), np.uint32)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while size + n > len(self.first):
            self.first, self.count = (np.concatenate((a, np.empty_like(a))) for a in (self.first, self.count))
        self.flat[self.used : self.used + len(flat)] = flat
        counts = np.fromiter(map(len, ids), np.int64, n)
        self.first[size : size + n] = self.used + np.cumsum(counts) - counts
        self.count[size : size + n] = counts
        self.used += len(flat)
        self.table.add(keys)

    def runs(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of parts of texts, in order."""
        for run, places in pieces(texts):
            joined = b"\n".join(run) + b"\n"
            buf = np.frombuffer(joined, np.uint8)
            start, end = word_spans(buf)
            c = prefix_hashes(buf)
            keys = mix((c[end] - c[start]) * powers(len(buf))[1][start])
            if self.table.size > self.ROOM or self.used > 8 * self.ROOM:
                self.reset()
            at = self.table.find(keys)
            if (at < 0).any():
                missing = np.flatnonzero(at < 0)
                new, first = np.unique(keys[missing], return_index=True)
                self.learn(new, [joined[start[i] : end[i]] for i in missing[first].tolist()])
                at[missing] = self.table.find(keys[missing])
            n = self.count[at]
            stop = np.cumsum(n)
            ids = self.flat[np.repeat(self.first[at] - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)]
            begins = np.searchsorted(start, np.cumsum([len(t) + 1 for t in run[:-1]]))
            cuts = np.concatenate(([0], stop))[begins] if len(begins) else []
            yield from zip(places, np.split(ids, cuts), strict=True)

    def texts(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of each text, in order."""
        last, held = None, []
        for place, ids in self.runs(texts):
            if place != last and held:
                yield last, np.concatenate(held)
                held = []
            last = place
            held.append(ids)
        if held:
            yield last, np.concatenate(held)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for a Python worker; what it has learnt serves the worker's next tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cutter(tokenizer: str, capacity: int, end: int):
    """Function for mapInArrow: rows (doc_id, text) become their pieces, whole windows and one remainder."""

    def run(batches):
        own = encoder(tokenizer)
        for batch in few_rows(batches):
            ids_of, out = batch.column("doc_id").to_pylist(), []
            for place, ids in own.texts(text_bytes(batch.column("text"))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    out.append((ids_of[place], start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, with the largest sum up to room; longer lengths are preferred."""
    if counts.get(room):
        return {room: 1}
    reached, steps, goal = 1, [], 1 << room
    full = (1 << (room + 1)) - 1
    for length in counts:  # from the longest on
        if length > room:
            continue
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reached))
            reached |= (reached << (length * take)) & full
            left -= take
            take *= 2
        if reached & goal:
            break
    at, picked = reached.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            picked[length] = picked.get(length, 0) + take
            at -= length * take
    return picked


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first ordinal, end ordinal, first sequence, pieces in a sequence, offset), and the number of sequences."""
    counts = {k: histogram[k] for k in sorted(histogram, reverse=True) if histogram[k] > 0}
    given, rows, sequences = dict.fromkeys(counts, 0), [], 0
    while counts:
        longest = next(iter(counts))
        rest = counts | {longest: counts[longest] - 1}
        pattern = best_fill({k: v for k, v in rest.items() if v} if not rest[longest] else rest, capacity - longest)
        pattern = {longest: 1 + pattern.pop(longest, 0)} | pattern
        times, offset = min(counts[k] // n for k, n in pattern.items()), 0
        for length, n in pattern.items():
            rows.append((length, given[length], given[length] + n * times, sequences, n, offset))
            given[length] += n * times
            counts[length] -= n * times
            offset += n * length
            if not counts[length]:
                del counts[length]
        sequences += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6), sequences


def placer(rows: np.ndarray, sequences: int, capacity: int):
    """Function for mapInArrow: pieces with their ordinal among those of their length get sequence_id and offset."""
    keys = rows[:, 0] << 45 | rows[:, 1]

    def run(batches):
        for batch in batches:
            length, ordinal = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "ordinal"))
            whole = length == capacity
            at = np.searchsorted(keys, length << 45 | ordinal, side="right") - 1
            own = rows[np.where(whole, 0, at)] if len(rows) else np.ones((len(length), 6), np.int64)
            k = ordinal - own[:, 1]
            sequence = np.where(whole, sequences + ordinal, own[:, 3] + k // own[:, 4])
            offset = np.where(whole, 0, own[:, 5] + k % own[:, 4] * length)
            kept = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "ordinal"]
            names = [n for n in batch.schema.names if n != "ordinal"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def with_ordinals(cut: DataFrame, capacity: int) -> DataFrame:
    """Number the pieces of each length from 0; groups by hash keep any one length from a single task."""
    shape = F.when(F.col("length") == capacity, F.pmod(F.xxhash64(F.lit(1), "doc_id", "start"), F.lit(GROUPS))).otherwise(F.lit(0))
    cut = cut.withColumn("_group", F.pmod(F.xxhash64(F.lit(2), "doc_id", "start"), F.lit(GROUPS)) + shape * GROUPS)
    sizes = cut.groupBy("length", "_group").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "_group", before.alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "start", "ids_crc32"))
    return cut.withColumn("_number", number).join(sizes, ["length", "_group"]).withColumn("ordinal", F.col("_before") + F.col("_number") - 1).drop("_before", "_number", "_group")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece of each document: PIECES, sequence_id, offset."""
    cut = staged(docs.select("doc_id", "text").mapInArrow(cutter(tokenizer, capacity, end), PIECES), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.where(F.col("length") < capacity).groupBy("length").count().collect()}  # below capacity rows
    rows, sequences = plan(histogram, capacity)
    placed = with_ordinals(cut, capacity)
    columns = PIECES.replace(" long", "").split(", ")
    return placed.select(*columns, "ordinal").mapInArrow(placer(rows, sequences, capacity), f"{PIECES}, sequence_id long, offset long")
