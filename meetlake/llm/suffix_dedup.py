"""Exact removal of repeated passages by a depth-limited radix sort of suffixes.

Every byte whose passage of LENGTH bytes also starts elsewhere is removed. Suffixes are ordered only through LENGTH
bytes, most significant digit first, and a suffix leaves as soon as it is alone with its digits:

1. First digit. The digit of a passage is its anchor, the DIGIT bytes in it with the least hash. Equal passages have
   equal anchors at equal places, and neighbouring suffixes share theirs, so suffixes go through this pass in runs (about
   one row for 50 bytes). A run whose anchor no other run has leaves here. Runs that are equal as a whole are repeated
   as a whole. What a task sees twice it settles at once; of an anchor it passes on two rows at most.
2. Further digits. Where runs share an anchor but differ, their suffixes are compared by digits of eight bytes through
   LENGTH bytes within the anchor. Groups that stay together are exactly the repeated passages. An anchor with very many
   runs is dealt out by whole passages instead of by anchor.
3. The spans of repeated suffixes meet their texts by a hash of the text, are joined to maximal spans and cut out.

Texts travel once (those that have undecided runs once more). All rows of equal texts share one key, so copies add
counts, not keys.

Defined results: null text is empty; texts shorter than LENGTH lose nothing; rows that repeat count as occurrences
elsewhere; overlapping occurrences in one text count; a null id is passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetlake.llm.common import CHUNK_BYTES, U64, few_rows, mix, powers, prefix_hashes, staged

LENGTH = 200  #: bytes of a passage
DIGIT = 80  #: bytes of the first digit
RANGE_BYTES = 1 << 20  #: bytes of text whose runs make up a range, about, however large the table is
LOW = U64(21)  #: bits for a place in a run of text; CHUNK_BYTES + LENGTH must fit


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row, by minima from both ends of blocks of w."""
    n = len(a)
    padded = np.concatenate((a, np.full(-n % w, np.iinfo(a.dtype).max, a.dtype))).reshape(-1, w)
    right = np.minimum.accumulate(padded, axis=1).ravel()[:n]
    left = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(left[: n - w + 1], right[w - 1 :])


def anchored(buf: np.ndarray, stops: np.ndarray, length: int = LENGTH, digit: int = DIGIT):
    """Runs of suffixes with the same anchor: (first suffix, last suffix, anchor hash, hash of the bytes they cover).

    The anchor of a suffix is the digit with the least hash that begins in its first length - digit + 1 bytes, so equal
    passages have equal anchors at the same place, wherever they stand. stops: ends of the texts in buf.
    """
    n = len(buf)
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty.astype(U64), empty.astype(U64)
    c, back = prefix_hashes(buf), powers(n)[1]
    h = mix((c[digit:] - c[: n - digit + 1]) * back[: n - digit + 1])
    key = (h >> LOW << LOW) | np.arange(len(h), dtype=U64)
    least = sliding_min(key, length - digit + 1)
    start = np.arange(len(least))
    inside = start + length <= stops[np.searchsorted(stops, start, side="right")]
    own = np.flatnonzero(inside)
    if not len(own):
        return empty, empty, empty.astype(U64), empty.astype(U64)
    at = (least[own] & ((U64(1) << LOW) - U64(1))).astype(np.int64)
    cuts = np.flatnonzero((at[1:] != at[:-1]) | (own[1:] != own[:-1] + 1)) + 1
    first, last = own[np.concatenate(([0], cuts))], own[np.concatenate((cuts - 1, [len(own) - 1]))]
    at = at[np.concatenate(([0], cuts))]
    covered = mix((c[last + length] - c[first]) * back[first] + (at - first).astype(U64) * U64(0x9E3779B97F4A7C15) + (last - first).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    return first, last, h[at], covered


#: What a row of the first pass says of its suffixes.
RUN, REPEATED, UNDECIDED, EXAMPLE = range(4)
ROWS = "part int, key long, crc int, kind int, anchor long, run long, n int, first int, last int"
ROWS_ARROW = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("crc", pa.int32()), ("kind", pa.int32()), ("anchor", pa.int64()), ("run", pa.int64()), ("n", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
#: Rows of an anchor from which its passages are dealt out one by one.
HOT = 20_000


def joined(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of adjacent or overlapping [first, last], which are in order of first."""
    if not len(first):
        return first, last
    reach = np.maximum.accumulate(last)
    cut = np.flatnonzero(first[1:] > reach[:-1] + 1) + 1
    return first[np.concatenate(([0], cut))], reach[np.concatenate((cut - 1, [len(first) - 1]))]


def text_runs(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts of at least LENGTH bytes in runs of about CHUNK_BYTES, with their places and offsets; longer ones overlap."""
    held, place, offset, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), CHUNK_BYTES):
            part = text[at : at + CHUNK_BYTES + LENGTH - 1]
            if size + len(part) > CHUNK_BYTES + LENGTH and held:
                yield held, np.array(place), np.array(offset)
                held, place, offset, size = [], [], [], 0
            held.append(part)
            place.append(i)
            offset.append(at)
            size += len(part)
    if held:
        yield held, np.array(place), np.array(offset)


def first_digit(parts: int):
    """Function for mapInArrow: rows (key, crc, text) become rows of runs, settled as far as the texts at hand allow."""

    def run(batches):
        for batch in batches:
            keys, crcs = batch.column("key").to_numpy(), batch.column("crc").to_numpy()
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for held, place, offset in text_runs(texts):
                stops = np.cumsum([len(t) for t in held])
                first, last, anchor, covered = anchored(np.frombuffer(b"".join(held), np.uint8), stops)
                if not len(first):
                    continue
                text = np.searchsorted(stops, first, side="right")
                shift = offset[text] - np.concatenate(([0], stops[:-1]))[text]
                first, last, place_ = first + shift, last + shift, place[text]
                order = np.lexsort((covered, anchor))
                new_anchor = np.concatenate(([True], anchor[order][1:] != anchor[order][:-1]))
                new = new_anchor | np.concatenate(([True], covered[order][1:] != covered[order][:-1]))
                group = np.cumsum(new) - 1
                n = np.bincount(group)
                kind = np.where(n[group] > 1, REPEATED, RUN)
                head = np.flatnonzero(new)
                rank = np.cumsum(new) - (np.cumsum(new) * new_anchor)[np.maximum.accumulate(np.where(new_anchor, np.arange(len(order)), 0))]
                # of an anchor two runs are passed on to its range; all others here are known to share it
                kind[(kind == RUN) & (rank >= 2)] = UNDECIDED
                send = np.concatenate((np.flatnonzero(kind == RUN), head[(n > 1) & (rank[head] < 2)]))
                send_kind = np.where(kind[send] == RUN, RUN, EXAMPLE)
                more = np.flatnonzero(kind == UNDECIDED)
                extra = head[(n > 1) & (rank[head] >= 2)]  # an example that others must be able to meet
                rows = [(order[send], send_kind, n[group[send]]), (order[more], np.full(len(more), UNDECIDED), np.ones(len(more), np.int64)), (order[extra], np.full(len(extra), UNDECIDED), np.ones(len(extra), np.int64))]
                at, kinds, counts = (np.concatenate(x) for x in zip(*rows, strict=True))
                again = np.sort(order[np.flatnonzero(kind == REPEATED)])  # by text, then by place in it
                base = place_[again].astype(np.int64) << 32
                a, b = joined(base + first[again], base + last[again])
                spans = np.column_stack((a >> 32, a & 0xFFFFFFFF, b & 0xFFFFFFFF))
                zero = np.zeros(len(spans), np.int64)
                key = np.concatenate((keys[place_[at]], keys[spans[:, 0]]))
                own_anchor = np.concatenate((anchor[at].view(np.int64), zero))
                by = np.where(np.concatenate((kinds, np.full(len(spans), REPEATED))) < REPEATED, own_anchor, key)
                by = np.where(np.concatenate((kinds == EXAMPLE, zero > 0)), own_anchor, by)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(((by.view(U64) >> U64(20)) % U64(parts)).astype(np.int32)), pa.array(key), pa.array(np.concatenate((crcs[place_[at]], crcs[spans[:, 0]]))),
                        pa.array(np.concatenate((kinds, np.full(len(spans), REPEATED))).astype(np.int32)), pa.array(own_anchor), pa.array(np.concatenate((covered[at].view(np.int64), zero))),
                        pa.array(np.concatenate((counts, zero)).astype(np.int32)), pa.array(np.concatenate((first[at], spans[:, 1])).astype(np.int32)), pa.array(np.concatenate((last[at], spans[:, 2])).astype(np.int32)),
                    ],
                    schema=ROWS_ARROW,
                )

    return run


DECIDED = "key long, crc int, kind int, anchor long, first int, last int"


def decided(group: pa.Table) -> pa.Table:
    """Of a range of anchors: which runs are repeated as a whole, undecided, or alone (these leave)."""
    kind, anchor, covered, n = (group.column(c).to_numpy() for c in ("kind", "anchor", "run", "n"))
    out = kind.copy()
    own = np.flatnonzero((kind == RUN) | (kind == EXAMPLE))
    if len(own):
        order = own[np.lexsort((covered[own], anchor[own]))]
        new_anchor = np.concatenate(([True], anchor[order][1:] != anchor[order][:-1]))
        new = new_anchor | np.concatenate(([True], covered[order][1:] != covered[order][:-1]))
        total = np.bincount(np.cumsum(new) - 1, n[order])[np.cumsum(new) - 1]
        runs = np.bincount(np.cumsum(new_anchor) - 1, new)[np.cumsum(new_anchor) - 1]
        whole = total > 1
        state = np.where(whole, REPEATED, np.where(runs > 1, UNDECIDED, RUN))
        out[order] = state
        examples = order[new & whole & (runs > 1)]
    else:
        examples = own
    kept = np.flatnonzero(out != RUN)
    at = np.concatenate((kept, examples))
    kinds = np.concatenate((out[kept], np.full(len(examples), EXAMPLE))).astype(np.int32)
    take = lambda c: group.column(c).take(pa.array(at))
    return pa.table([take("key"), take("crc"), pa.array(kinds), take("anchor"), take("first"), take("last")], names=["key", "crc", "kind", "anchor", "first", "last"])


SETTLED = "doc_id long, key long, crc int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, first array<int>, last array<int>, open_kind array<int>, open_anchor array<long>, open_first array<int>, open_last array<int>"
SETTLED_ARROW = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("crc", pa.int32()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32())), ("open_kind", pa.list_(pa.int32())), ("open_anchor", pa.list_(pa.int64())), ("open_first", pa.list_(pa.int32())), ("open_last", pa.list_(pa.int32()))])


def cut_out(text: bytes, first: np.ndarray, last: np.ndarray) -> tuple[int, int, str, bytes]:
    """n_removed, n_spans, digest and bytes of what is left when the passages that start in [first, last] are removed."""
    order = np.argsort(first, kind="stable")
    a, b = joined(first[order], last[order] + LENGTH - 1)
    left, at = [], 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        left.append(text[at:x])
        at = y + 1
    rest = b"".join([*left, text[at:]])
    return len(text) - len(rest), len(a), hashlib.sha256(rest).hexdigest(), rest


def settle(batches):
    """For mapInArrow: texts with the rows that belong to them; those without open ones are finished here."""
    for batch in few_rows(batches):
        out = []
        for doc_id, key, crc, text, rows in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "crc", "text", "rows")), strict=True):
            data = text.encode()
            done = [(r["first"], r["last"]) for r in rows or () if r["kind"] == REPEATED or r["twice"]]
            open_ = [r for r in rows or () if r["kind"] in (UNDECIDED, EXAMPLE)]
            spans = np.array(done, np.int64).reshape(-1, 2)
            if open_:
                out.append((doc_id, key, crc, len(data), None, None, None, text, spans[:, 0].tolist(), spans[:, 1].tolist(), [EXAMPLE if r["twice"] else r["kind"] for r in open_], [r["anchor"] for r in open_], [r["first"] for r in open_], [r["last"] for r in open_]))
            else:
                out.append((doc_id, key, crc, len(data), *cut_out(data, spans[:, 0], spans[:, 1])[:3], None, None, None, None, None, None, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SETTLED_ARROW, strict=True)], schema=SETTLED_ARROW)


SLICES = "key long, crc int, kind int, anchor long, place int, first int, passage binary"


def slices(batches):
    """For mapInArrow: the bytes of each open run, and where its anchor lies in its first passage."""
    names = ["key", "crc", "kind", "anchor", "place", "first", "passage"]
    for batch in few_rows(batches):
        out = []
        for key, crc, text, kinds, anchors, firsts, lasts in zip(*(batch.column(c).to_pylist() for c in ("key", "crc", "text", "open_kind", "open_anchor", "open_first", "open_last")), strict=True):
            data = text.encode()
            for kind, anchor, first, last in zip(kinds, anchors, firsts, lasts, strict=True):
                out.append((key, crc, kind, anchor, 0, first, data[first : last + LENGTH]))
        if out:
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def single(batches):
    """For mapInArrow: slices as rows of one passage each; the anchor becomes a hash of the passage."""
    for batch in few_rows(batches):
        key, crc, kind, first, data = (batch.column(c).to_pylist() for c in ("key", "crc", "kind", "first", "passage"))
        out = []
        for k, c, d, f, s in zip(key, crc, kind, first, data, strict=True):
            for i in range(len(s) - LENGTH + 1):
                p = s[i : i + LENGTH]
                out.append((k, c, d, int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "big", signed=True), 0, f + i, p))
        if out:
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "crc", "kind", "anchor", "place", "first", "passage"])


def radix_groups(data: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes that share depth bytes with another suffix of their group, by digits of eight bytes."""
    alive = np.arange(len(start))
    for at in range(0, depth, 8):
        width = min(8, depth - at)
        digit = np.zeros(len(alive), U64)
        for i in range(width):
            digit = digit << U64(8) | data[start[alive] + at + i].astype(U64)
        order = np.lexsort((digit, group))
        new = np.concatenate(([True], (group[order][1:] != group[order][:-1]) | (digit[order][1:] != digit[order][:-1])))[: len(order)]
        own = np.cumsum(new) - 1
        kept = np.bincount(own, minlength=1)[own] > 1
        alive, group = alive[order][kept], own[kept]
        if not len(alive):
            break
    return alive


def further_digits(group: pa.Table) -> pa.Table:
    """Of a range of anchors: the passages of open runs that occur twice, as spans of their starts."""
    key, crc, kind, anchor, first = (group.column(c).to_numpy() for c in ("key", "crc", "kind", "anchor", "first"))
    passages = group.column("passage").to_pylist()
    data = np.frombuffer(b"".join(passages), np.uint8)
    size = np.array([len(p) for p in passages])
    n = size - LENGTH + 1
    row = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = (np.cumsum(size) - size)[row] + inner
    _, group_of = np.unique(anchor, return_inverse=True)
    found = np.sort(radix_groups(data, start, group_of[row], LENGTH))
    found = found[kind[row[found]] != EXAMPLE]  # sorted: by row, then by place
    cut = np.flatnonzero((row[found][1:] != row[found][:-1]) | (found[1:] != found[:-1] + 1)) + 1 if len(found) else []
    heads = found[np.concatenate(([0], cut)).astype(int)] if len(found) else found
    tails = found[np.concatenate((np.asarray(cut, int) - 1, [len(found) - 1])).astype(int)] if len(found) else found
    own = row[heads]
    return pa.table([pa.array(key[own]), pa.array(crc[own]), pa.array((first[own] + inner[heads]).astype(np.int32)), pa.array((first[own] + inner[tails]).astype(np.int32))], names=["key", "crc", "first", "last"])


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def finish(with_text: bool):
    """For mapInArrow: open texts with all their repeated passages become their results."""

    def run(batches):
        for batch in few_rows(batches):
            out = []
            for doc_id, n, text, first, last, more in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "text", "first", "last", "more")), strict=True):
                spans = np.array([*zip(first, last, strict=True), *((r["first"], r["last"]) for r in more or ())], np.int64).reshape(-1, 2)
                removed, spans_n, digest, rest = cut_out(text.encode(), spans[:, 0], spans[:, 1])
                out.append((doc_id, n, removed, spans_n, digest, rest.decode(errors="replace") if with_text else None))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    text = F.coalesce("text", F.lit(""))
    parts = 8 + (docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // RANGE_BYTES
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"), (F.crc32(text.cast("binary")) - F.lit(1 << 31)).cast("int").alias("crc"))
    runs = rows.select("key", "crc", "text").where(F.octet_length("text") >= LENGTH).mapInArrow(first_digit(parts), ROWS)
    found = runs.groupBy("part").applyInArrow(decided, DECIDED)
    # rows of equal texts are one; an undecided run that two of them have is repeated, and still an example to others
    once = found.groupBy("key", "crc", "kind", "anchor", "first", "last").agg(((F.col("kind") == UNDECIDED) & (F.count(F.lit(1)) > 1)).alias("twice"))
    by_text = once.groupBy("key", "crc").agg(F.collect_list(F.struct("kind", "anchor", "first", "last", "twice")).alias("rows"))
    met = rows.join(by_text.hint("shuffle_hash"), ["key", "crc"], "left")
    settled = staged(met.select("doc_id", "key", "crc", "text", "rows").mapInArrow(settle, SETTLED), "settled")
    open_ = settled.where("text IS NOT NULL")
    cut = open_.dropDuplicates(["key", "crc"]).select("key", "crc", "text", "open_kind", "open_anchor", "open_first", "open_last").mapInArrow(slices, SLICES)
    cut = staged(cut, "slices")
    hot = cut.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    cut = cut.join(hot, "anchor", "left").select("key", "crc", "kind", "anchor", "place", "first", "passage", "hot")
    columns = [c.split()[0] for c in SLICES.split(", ")]
    cut = cut.where("hot IS NULL").select(columns).unionByName(cut.where("hot").select(columns).mapInArrow(single, SLICES))
    again = cut.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts))).groupBy("part").applyInArrow(further_digits, "key long, crc int, first int, last int")
    again = again.groupBy("key", "crc").agg(F.collect_list(F.struct("first", "last")).alias("more"))
    finished = open_.join(again.hint("shuffle_hash"), ["key", "crc"], "left").select("doc_id", "n_bytes", "text", "first", "last", "more").mapInArrow(finish(False), REPORT)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return settled.where("text IS NULL").select(columns).unionByName(finished.select(columns))
