"""Alignment of two public tokenizers over a corpus: which token of one covers which token of the other, and how commonly.

A is a byte-level BPE over a space and the text, B a piece BPE that adds the space itself. Where tokens of both end on the
same byte, the text is cut into groups; a link is a token of A and one of B whose bytes overlap. A pair's count is the
number of documents that hold it linked.

The counts are a matrix of A's ids by B's ids. It is striped by A's id modulo a number of stripes; a stripe is a dense
block of fixed size. Chunks of documents are tokenized once and written with their links; each gives every stripe the
pairs it holds and in how many of its documents, np.add.at adds these into the block, and the maximum of a row is the best
count of its A id. The stripe then answers each chunk with the counts of just its pairs, and a chunk's links are scored
where they lie. What a stripe gathers is added up in splits of some hundred chunks each before the splits meet, so that no
task holds a stripe of the whole corpus; a pair that every document has is one entry for each chunk.

Words are tokenized once a task: both tokenizers always end a token where a space follows what is no white space, so a
text is the run of its parts between such spaces (checked of B's pieces when they are loaded; else texts stay whole).

Defined results: null and empty texts, and texts whose joined bytes of A or B differ from space and text (as those that
hold U+2581), have no tokens: zeros and an empty digest. The strings of special tokens are plain text. Repeated rows and ids
count each; a null id is kept; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetlake.llm.common import U64, few_rows, staged
from meetlake.llm.language_model import pack_ints, unpack_ints

SPACE = "▁"
#: A space after something that is no white space: where a text is cut; the space belongs to what follows.
CUT, UNCUT = re.compile(r"(?<=\S) "), re.compile(r"^ |\s ")
#: Below U+0250 the rank tokenizer and the JSON one classify characters alike; beyond, Unicode versions may differ.
BEYOND = re.compile("[^\x00-ɏ]")


@dataclass(frozen=True)
class Settings:
    json_path: str  #: byte-level BPE of A
    ranks_path: str  #: A's vocabulary as ranks, the faster form for most texts
    model_path: str  #: piece BPE of B
    pattern: str  #: how A splits texts before its merges
    stripes: int = 256
    chunk_bytes: int = 4 << 20  #: text that a task links at a time
    split_chunks: int = 512  #: chunks whose pairs of a stripe are added up at a time
    held_keys: int = 200_000  #: parts of texts whose tokens a task remembers
    long_key: int = 64  #: characters beyond which a part is not remembered


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by the published rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, s: Settings):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(s.ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}
        self.ranked = tiktoken.Encoding("a", pat_str=s.pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(s.json_path)
        self.exact.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=s.model_path)
        with open(s.json_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        alphabet = byte_alphabet()
        self.a = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            self.a[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        self.b = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.space = self.pieces.piece_to_id(SPACE)
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", n) for n in names) and names[self.space] == SPACE

    def parts(self, text: str) -> list[str]:
        """The parts of a text, each without the space before it."""
        if not self.cuts:
            return [text]
        return CUT.split(text) if UNCUT.search(text) else text.split(" ")

    def encode_a(self, part: str) -> list[int]:
        part = " " + part
        if BEYOND.search(part):
            return self.exact.encode(part, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(part)

    def encode_b(self, parts: list[str]) -> list[list[int]]:
        return [ids if part else [self.space] for part, ids in zip(parts, self.pieces.encode(parts, num_threads=1), strict=True)]


def flat(lists) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs start, start + 1, ... of the given lengths, one after the other."""
    stops = np.cumsum(lengths)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - (stops - lengths), lengths)


class Linker:
    """Tokens, groups and links of parts, remembered from one chunk to the next."""

    def __init__(self, s: Settings):
        self.s, self.t = s, Tokenizers(s)
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.t.a, self.t.b))
        self.rows = -(-len(self.t.a) // s.stripes)
        marks = lambda n, last: [f"{i}{end}".encode() for i in range(n) for end in (",", last)]
        self.marks = marks(len(self.t.a), "|") + marks(len(self.t.b), ";")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.strings: list[bytes] = []
        self.figures = np.empty((0, 4), np.int64)  # tokens of A and B, groups, links
        self.sound = np.empty(0, bool)
        self.links, self.starts = np.empty(0, np.int64), np.zeros(0, np.int64)

    def learn(self, parts: list[str]) -> None:
        """Add parts that are not known."""
        a, n_a = flat([self.t.encode_a(p) for p in parts])
        b, n_b = flat(self.t.encode_b(parts))
        whole = [(" " + p).encode("utf-8", "surrogatepass") for p in parts]
        size = np.array([len(w) for w in whole], np.int64)
        bytes_of = lambda ids, n, table: [b"".join(map(table.__getitem__, x.tolist())) for x in np.split(ids, np.cumsum(n)[:-1])]
        sums = lambda values, n: np.add.reduceat(np.append(values, 0), np.cumsum(n) - n) * (n > 0)
        same = b"".join(map(self.t.b.__getitem__, b.tolist())) == b"".join(map(self.t.a.__getitem__, a.tolist())) == b"".join(whole)
        if same and (sums(self.len_a[a], n_a) == size).all() and (sums(self.len_b[b], n_b) == size).all():
            sound = np.ones(len(parts), bool)
        else:
            sound = np.array([x == y == w for x, y, w in zip(bytes_of(a, n_a, self.t.a), bytes_of(b, n_b, self.t.b), whole, strict=True)])
            a, n_a, b, n_b = a[np.repeat(sound, n_a)], n_a * sound, b[np.repeat(sound, n_b)], n_b * sound
        stops = np.cumsum(size * sound)
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        part = np.searchsorted(stops, ends)
        common = ends[(end_a[at_a] == ends) & (end_b[at_b] == ends)] if len(ends) else ends
        n_links = np.bincount(part, minlength=len(parts))
        n_groups = np.bincount(np.searchsorted(stops, common), minlength=len(parts))
        id_a = a[at_a]
        links = (id_a % self.s.stripes * self.rows + id_a // self.s.stripes) * len(self.t.b) + b[at_b]
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        marks = np.empty(len(a) + len(b), np.int64)
        marks[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = 2 * a + (common[group_a] == end_a)
        marks[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = 2 * (len(self.t.a) + b) + (common[group_b] == end_b)
        written, cuts = list(map(self.marks.__getitem__, marks.tolist())), np.cumsum(n_a + n_b).tolist()
        self.strings += [b"".join(written[i:j]) for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]
        self.starts = np.append(self.starts, len(self.links) + np.cumsum(n_links) - n_links)
        self.links = np.append(self.links, links)
        self.figures = np.vstack((self.figures, np.column_stack((n_a, n_b, n_groups, n_links))))
        self.sound = np.append(self.sound, sound)

    def chunk(self, texts: list[str]) -> dict:
        """Of a chunk of texts: figures and digests by text; the pairs with their documents; and each text's pairs with how often."""
        if len(self.strings) > self.s.held_keys:
            self.forget()
        places, fresh = [], []
        for text in texts:
            own = []
            for p in self.t.parts(text) if text else ():
                i = self.known.get(p, -1)
                if i < 0:
                    i = len(self.strings) + len(fresh)
                    fresh.append(p)
                    if len(p) <= self.s.long_key:
                        self.known[p] = i
                own.append(i)
            places.append(own)
        if fresh:
            self.learn(fresh)
        part, n = flat(places)
        text = np.repeat(np.arange(len(texts)), n)
        bad = np.bincount(text, ~self.sound[part], len(texts)) > 0 if len(part) else np.zeros(len(texts), bool)
        good = ~bad & (n > 0)
        part, text = part[good[text]], text[good[text]]
        figures = [np.bincount(text, self.figures[part, k], len(texts)).astype(np.int64) for k in range(4)]
        digests = [hashlib.sha256(b"".join(map(self.strings.__getitem__, own))[:-1]).hexdigest() if ok else "" for own, ok in zip(places, good.tolist(), strict=True)]
        used, at = np.unique(part, return_inverse=True)
        pairs, own = np.unique(self.links[gathered(self.starts[used], self.figures[used, 3])], return_inverse=True)
        first = np.cumsum(self.figures[used, 3]) - self.figures[used, 3]
        once, times = np.unique(text * max(1, len(used)) + at, return_counts=True)
        text, at = once // max(1, len(used)), once % max(1, len(used))
        width = self.figures[used, 3][at]
        code = np.repeat(text, width) * max(1, len(pairs)) + own[gathered(first[at], width)]
        held, where = np.unique(code, return_inverse=True)
        times = np.bincount(where, np.repeat(times, width), len(held)).astype(np.uint32)
        text, pair = held // max(1, len(pairs)), held % max(1, len(pairs))
        return {
            "figures": figures,
            "digests": digests,
            "pairs": pairs.astype(U64),
            "documents": np.bincount(pair, minlength=len(pairs)).astype(np.uint32),
            "held": np.bincount(text, minlength=len(texts)).astype(np.uint32),
            "pair": pair.astype(np.uint32),
            "times": times,
        }


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
CHUNKS = "chunk long, ids array<long>, " + ", ".join(f"{c} array<long>" for c in FIGURES) + ", digests array<string>, pairs binary, documents binary, held binary, pair binary, times binary"


def linker(s: Settings):
    """Function for mapInArrow: rows (doc_id, text) become chunks of linked documents."""

    def run(batches):
        task, n, ids, texts, size, link = TaskContext.get().partitionId(), 0, [], [], 0, None

        def done():
            nonlocal n, ids, texts, size, link
            link = link or Linker(s)
            c, n = link.chunk(texts), n + 1
            gaps = np.diff(c["pairs"], prepend=U64(0))
            row = [[task << 32 | n], [ids], *([f.tolist()] for f in c["figures"]), [c["digests"]], *([pack_ints(x)] for x in (gaps, c["documents"], c["held"], c["pair"], c["times"]))]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.binary()] * 5]
            ids, texts, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in CHUNKS.split(", ")])

        for batch in few_rows(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if texts and size + len(text or "") > s.chunk_bytes:
                    yield done()
                ids.append(doc_id)
                texts.append(text or "")
                size += len(text or "")
        if texts:
            yield done()

    return run


def dealer(s: Settings, cells: int):
    """Function for mapInArrow: each chunk's pairs by stripe, as places in the stripe's block, with their documents."""

    def run(batches):
        for batch in few_rows(batches, 1):
            pairs = np.cumsum(unpack_ints(batch.column("pairs")[0].as_py(), U64), dtype=U64)
            documents = unpack_ints(batch.column("documents")[0].as_py(), np.uint32)
            cuts = np.searchsorted(pairs, np.arange(s.stripes + 1, dtype=U64) * U64(cells)).tolist()
            rows = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            places = [pack_ints(np.diff((pairs[a:b] - U64(k * cells)).astype(np.uint32), prepend=np.uint32(0))) for k, a, b in rows]
            counts = [pack_ints(documents[a:b].astype(U64)) for _, a, b in rows]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.int32()), pa.array(batch.column("chunk").to_pylist() * len(rows), pa.int64()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], ["stripe", "chunk", "places", "counts"])

    return run


def places_of(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data, np.uint32), dtype=np.uint32)


def block_of(rows: pa.Table, cells: int) -> np.ndarray:
    """The dense block of a stripe: what the rows count, added up."""
    block = np.zeros(cells, U64)
    for places, counts in zip(rows.column("places"), rows.column("counts"), strict=True):
        np.add.at(block, places_of(places.as_py()), unpack_ints(counts.as_py(), U64))
    return block


def adder(cells: int):
    """Function for applyInArrow: the rows of a stripe, or of a split of it, as one row."""

    def run(rows: pa.Table) -> pa.Table:
        block = block_of(rows, cells)
        places = np.flatnonzero(block).astype(np.uint32)
        return pa.table([pa.array([rows.column("stripe")[0].as_py()], pa.int32()), pa.array([pack_ints(np.diff(places, prepend=np.uint32(0)))], pa.binary()), pa.array([pack_ints(block[places])], pa.binary())], names=["stripe", "places", "counts"])

    return run


def answerer(cells: int, width: int):
    """Function for a cogroup of chunks' pairs and their stripe's totals: the count of each pair, and whether it is the best of its A id."""

    def run(key, asks: pa.Table, totals: pa.Table) -> pa.Table:
        block = block_of(totals, cells)
        best = block.reshape(-1, width).max(1)
        counts, marks = [], []
        for data in asks.column("places"):
            places = places_of(data.as_py())
            counts.append(pack_ints(block[places]))
            marks.append(np.packbits(block[places] == best[places // width]).tobytes())
        return pa.table([asks.column("chunk"), asks.column("stripe"), pa.array(counts, pa.binary()), pa.array(marks, pa.binary())], names=["chunk", "stripe", "counts", "marks"])

    return run


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def scored(key, chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """For a cogroup of a chunk and the answers to it: the rows of its documents."""
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.string()]
    if not chunk.num_rows:
        return pa.schema(list(zip(names, kinds, strict=True))).empty_table()
    own = {c: chunk.column(c)[0].as_py() for c in chunk.column_names}
    answers = answers.sort_by("stripe")
    count, best = [np.empty(0, U64)], [np.empty(0, np.uint8)]
    for counts, marks in zip(answers.column("counts"), answers.column("marks"), strict=True):
        count.append(unpack_ints(counts.as_py(), U64))
        best.append(np.unpackbits(np.frombuffer(marks.as_py(), np.uint8), count=len(count[-1])))
    count, best = np.concatenate(count).astype(np.int64), np.concatenate(best).astype(np.int64)
    held, pair, times = (unpack_ints(own[c], np.uint32).astype(np.int64) for c in ("held", "pair", "times"))
    stops = np.cumsum(held)
    summed = lambda x: (lambda c: c[stops] - c[stops - held])(np.concatenate(([0], np.cumsum(x))))
    columns = [own["ids"], *(own[c] for c in FIGURES), summed(best[pair] * times), summed(count[pair] * times), own["digests"]]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def align(docs: DataFrame, s: Settings) -> DataFrame:
    """ALIGNED for every row of docs."""
    t = Tokenizers(s)
    width, cells = len(t.b), -(-len(t.a) // s.stripes) * len(t.b)
    chunks = staged(docs.select("doc_id", "text").mapInArrow(linker(s), CHUNKS), "linked")
    splits = -(-chunks.count() // s.split_chunks)
    asks = chunks.select("chunk", "pairs", "documents").mapInArrow(dealer(s, cells), "stripe int, chunk long, places binary, counts binary")
    asks = asks.withColumn("split", F.pmod(F.xxhash64("chunk"), F.lit(max(1, splits))).cast("int"))
    summed = "stripe int, places binary, counts binary"
    parts = asks.groupBy("stripe", "split").applyInArrow(adder(cells), summed)
    totals = staged(parts.groupBy("stripe").applyInArrow(adder(cells), summed), "totals")
    each = totals.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(max(1, splits) - 1))))
    answers = asks.drop("counts").groupBy("stripe", "split").cogroup(each.groupBy("stripe", "split")).applyInArrow(answerer(cells, width), "chunk long, stripe int, counts binary, marks binary")
    return chunks.drop("pairs", "documents").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, ALIGNED)
