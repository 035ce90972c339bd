"""Each query against a plain version of its contract, over the whole small tables."""

import base64
import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from meetlake.llm import ann, queries, suffix_dedup
from tests.llm.helpers import crc, words


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def test_packing(spark, sf, documents):
    from tokenizers import Tokenizer

    import zlib

    tok = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op1_packing(spark, sf).collect()
    ids = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [2] for r in documents}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for d, own in ids.items():
        at = 0
        for start, length in sorted(by_doc[d]):
            assert start == at
            at += length
        assert at == len(own)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= math.ceil(total / 4096) + 1
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_dedup(spark, sf, documents, monkeypatch, hot):
    """Also with anchors that count as hot as soon as three slices have them."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    n, starts = 200, Counter()
    texts = {r.doc_id: (r.text or "").encode() for r in documents}
    for t in texts.values():
        starts.update(t[i : i + n] for i in range(len(t) - n + 1))
    got = {r.doc_id: r for r in queries.op2_suffix_dedup(spark, sf).collect()}
    assert set(got) == set(texts)
    removed = 0
    for d, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if starts[t[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        left = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
        removed += int(gone.sum())
    assert removed > 0


@pytest.mark.parametrize("name, label, fold, threshold, least", [("op3_toxicity", "toxic", (3, 1), 0.7, 0.85), ("op6_quality", "quality", (5, 0), 0.3, 0.7)])
def test_classifiers(spark, name, label, fold, threshold, least):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in got.values():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) and r.held_out == (crc(r.doc_id) % fold[0] == fold[1])
    held = [(r.score, truth[d]) for d, r in got.items() if r.held_out and truth.get(d) is not None]
    one, zero = ([s for s, y in held if y == k] for k in (1, 0))
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in zero] for a in one])
    print(name, "held-out AUC", auc, len(one), len(zero), "recall", np.mean([s >= threshold for s in one]), "false alarms", np.mean([s >= threshold for s in zero]))
    assert auc >= least


def recall(rows, got):
    """Share of the true 20 nearest that were found, after checks of ranks, order and scores."""
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        own = got[q]
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1)) and len(own) == len(order)
        for _, v, score in own:
            assert v != q and abs(score - s[ids == v][0]) < 1e-9
        assert own == sorted(own, key=lambda r: (-r[2], r[1]))
        hit += len({v for _, v, _ in own} & set(ids[order]))
        total += len(order)
    return hit / total


def by_query(found):
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    return got


def vectors(spark, sf):
    return [(r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding]


def test_nearest(spark, sf):
    assert recall(vectors(spark, sf), by_query(queries.op4_nearest(spark, sf))) >= 0.9


def test_nearest_in_several_shards_and_blocks(spark):
    """The larger table in shards and blocks so small that there are several of both."""
    sf = "/root/testdata/sf0.1"
    found = ann.search(spark.read.parquet(f"{sf}/embeddings.parquet"), s=ann.Settings(shard_rows=1_000, block_rows=60, beam_rows=40))
    assert recall(vectors(spark, sf), by_query(found)) >= 0.9


def test_near_dedup(spark, sf, documents):
    sets = {}
    for r in documents:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op5_near_dedup(spark, sf).collect()}
    assert got == {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def test_exact_dedup(spark, sf, documents):
    own = defaultdict(list)
    for r in documents:
        own[r.text or ""].append(r.doc_id)
    want = {d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in own.items() for d in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in queries.op7_exact_dedup(spark, sf).collect()} == want


def targets(sizes, limit=3):
    """Shares by weight 1, 2, 3 over sources in order, with what is above the limits reshared until none is."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, total = {}, float(sum(sizes.values()))
    while True:
        left = {s: weight[s] for s in names if s not in capped}
        level = (total - sum(capped.values())) / sum(left.values()) if left else 0
        over = {s: float(limit * sizes[s]) for s in left if level * weight[s] > limit * sizes[s]}
        if not over:
            return capped | {s: level * w for s, w in left.items()}
        capped |= over


def test_mixing(spark, sf, documents):
    size = {r.doc_id: len(words(r.text)) for r in documents}
    of = {r.doc_id: r.source for r in documents}
    per = Counter()
    for d, n in size.items():
        per[of[d]] += n
    want = targets(per)
    got = {r.doc_id: r for r in queries.op8_mixing(spark, sf).collect()}
    assert set(got) == set(size)
    taken = Counter()
    for d, r in got.items():
        assert r["size"] == size[d] and r.source_size == per[of[d]] and abs(r.target - want[of[d]]) < 1e-6 * max(1, r.target)
        assert r.taken <= 3 * size[d] and (size[d] == 0 or r.taken % size[d] == 0)
        taken[of[d]] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(size[d] for d in size if of[d] == s)
    again = {r.doc_id: r.taken for r in queries.op8_mixing(spark, sf).collect()}
    assert again == {d: r.taken for d, r in got.items()}


def test_language_model(spark, sf, documents):
    tokens = {r.doc_id: [*words(r.text), None] for r in documents}
    c = Counter(t for d, own in tokens.items() if crc(d) % 7 != 2 for t in own)
    n, v = sum(c.values()), len(c)
    gain = 0
    for r in queries.op9_language_model(spark, sf).collect():
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 7 == 2, len(own), sum(c[t] > 0 for t in own), n)
        base = sum(math.log10((c[t] + 1) / (n + 1 * (v + 1))) for t in own)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score <= 0
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0


def test_warc(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for p in sorted(pages):
        first.setdefault(pages[p], p)
    want = {p: (len(t), base64.b32encode(hashlib.sha1(t).digest()).decode(), "response" if first[t] == p else "revisit", None if first[t] == p else first[t]) for p, t in pages.items()}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op10_warc(spark, sf).collect()} == want
