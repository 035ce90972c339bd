"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from meetlake.llm import ann, exact_dedup, language_model, mixing, near_dedup, packing, quality, queries, suffix_dedup, toxicity, warc
from meetlake.llm.common import shared_dir
from pyspark.sql import functions as F
from tests.llm.helpers import CLASHING, SCHEMA, awkward, empty, labels


def test_marking_operators(spark):
    for docs, n in ((awkward(spark), 13), (awkward(spark, extra=True), 13), (empty(spark), 0)):
        pieces = packing.pack(docs, queries.tokenizer_path())
        own = pieces.groupBy("doc_id", "start").count().collect()
        assert sum(r["count"] for r in own if r.start == 0) == n
        removed = {r.doc_id: r for r in suffix_dedup.remove(docs).collect()}
        assert len(removed) == max(n - 1, 0)
        if n:
            assert [removed[i].n_removed for i in (1, 2, 3)] == [330] * 3 and [removed[i].n_bytes for i in (1, 2, 3)] == [330, 330, 333]
            assert removed[11].n_removed == 5000 and removed[11].kept_sha256 == hashlib.sha256(b"").hexdigest()
        assert toxicity.score(docs, labels(spark)).count() == n
        assert quality.score(docs, labels(spark)).count() == n
        scored = language_model.score(docs).collect()
        assert len(scored) == n and all(r.n_tokens >= 1 for r in scored)
        near = {r.doc_id: r for r in near_dedup.marked(docs).collect()}
        if n:
            assert near[2].component_id == 1 and not near[2].kept and near[4].n_shingles == near[5].n_shingles == near[6].n_shingles == 0
            assert near[5].component_id == 5 and near[None].component_id is None and near[8].component_id == 7
        marks = exact_dedup.mark(docs).collect()
        assert len(marks) == n
        if n:
            by = {r.doc_id: r for r in marks}
            assert (by[1].keep_id, by[1].group_size, by[1].kept) == (2, 2, False) and (by[7].keep_id, by[7].group_size) == (8, 3)
            assert (by[4].keep_id, by[4].group_size) == (5, 2) and by[None].keep_id is None and by[None].kept
        mixed = mixing.mix(docs).collect()
        assert len(mixed) == n


def test_filters_keep_columns(spark):
    docs = awkward(spark, extra=True)
    for kept in (toxicity.reject(docs, labels(spark)), exact_dedup.keep(docs), near_dedup.keep(docs), mixing.draw(docs)):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    for kept in (toxicity.reject(empty(spark), labels(spark)), exact_dedup.keep(empty(spark)), near_dedup.keep(empty(spark)), mixing.draw(empty(spark))):
        assert kept.count() == 0


def test_exact_keep(spark):
    ids = Counter(r.doc_id for r in exact_dedup.keep(awkward(spark)).collect())
    assert ids == Counter([2, 3, 5, 6, 8, 9, 10, None, 11])


def test_later_arrivals_meet_what_came_before(spark):
    """Two arrivals in one store, each in several micro-batches: the state of the first is met by the second."""
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text ', id % 100) AS text").repartition(4)
    store = exact_dedup.Store(spark, shared_dir(spark, "two"), docs.dtypes)
    assert store.arrive(docs.where("doc_id < 150")) > 1
    first = {r.doc_id: (r.keep_id, r.group_size) for r in store.marks().collect()}
    assert first == {i: (i + 100 if i < 50 else i, 2 if i % 100 < 50 else 1) for i in range(150)}
    store.arrive(docs.where("doc_id >= 150"))
    exact_dedup.Store(spark, store.root, docs.dtypes).arrive(spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in store.marks().collect()}
    assert got == {i: (200 + i % 100, 3) for i in range(300)} | {None: (None, 2)}


def test_texts_that_share_a_digest(spark, monkeypatch):
    """With a digest of the first letter only, bytes are compared and the texts are grouped by them."""
    monkeypatch.setattr(exact_dedup, "sha", lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 1).cast("binary"))
    texts = ["a one", "a two", "a one", "b", None, "", "a two", "a three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: max(j for j, u in enumerate(texts) if (u or "") == (t or "")) for i, t in enumerate(texts)}
    assert {r.doc_id: r.keep_id for r in exact_dedup.mark(docs).collect()} == want
    assert {r.doc_id for r in exact_dedup.keep(docs).collect()} == set(want.values())


def test_draw_follows_mix(spark):
    docs = awkward(spark)
    want = {r.doc_id: r.n for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0").collect()}
    size = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    got = {r.doc_id: r.n for r in mixing.draw(docs).groupBy("doc_id").agg(F.sum(size).alias("n")).collect()}
    assert got == want


def test_draw_gives_left_over_copies_once(spark):
    """Equal rows that a budget takes unequally often: as many rows come out as the mix takes, over several partitions."""
    rows = [(1, "a b c d e f g", "en", "x", 13)] * 7 + [(i, "w " * 11, "en", "y", 22) for i in range(50, 54)] + [(None, "q r s", "en", None, 5)] * 50
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("count", F.lit(1)).withColumn("_p", F.lit(2)).repartition(3)
    n = {r.doc_id: r.n for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum(F.col("taken") / F.col("size")).alias("n")).collect()}
    assert n[1] % 7 and n[1] > 0 and n[None] > 0
    assert Counter(r.doc_id for r in mixing.draw(docs).collect()) == {d: k for d, k in n.items() if k}


def test_labels_of_one_class(spark):
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(awkward(spark), one).collect()} == {1.0}
    assert all(r.score < 1e-3 for r in toxicity.score(awkward(spark), one).collect())
    none = one.where("false")
    assert quality.score(awkward(spark), none).count() == toxicity.score(awkward(spark), none).count() == 13


def test_nearest_awkward(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (20, [0.0, 2.0]), (8, [])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("own")).withColumn("v", F.lit(1))).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 7, 0.5), (0, 3, 20, 0.0), (20, 1, 7, 1.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_warc_awkward(spark):
    pages = spark.createDataFrame([(3, "u\r\nx", "a\r\n\r\nb"), (1, None, None), (2, "v", ""), (5, "w", "a\r\n\r\nb"), (None, "n", "null id"), (9, "l", "z" * 3_000_000)], "page_id long, url string, html string").withColumn("digest", F.lit("own"))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {3: (6, "response", None), 1: (0, "response", None), 2: (0, "revisit", 1), 5: (6, "revisit", 3), None: (7, "response", None), 9: (3_000_000, "response", None)}
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_repeated_ids(spark):
    """An id with two payloads is two records: each revisits, or is revisited, by its own payload."""
    rows = [(3, "A"), (5, "A"), (5, "B"), (4, "B"), (7, "C"), (7, "C"), (8, "C")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    sha = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = Counter([(3, sha("A"), "response", None), (5, sha("A"), "revisit", 3), (5, sha("B"), "revisit", 4), (4, sha("B"), "response", None), (8, sha("C"), "revisit", 7)] + [(7, sha("C"), "response", None)] * 2)
    assert Counter((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()) == want


def test_warc_bundles_roll_over(spark, monkeypatch, tmp_path):
    """Many frames in many bundles, each read back through its seek table."""
    rows = [(i, "u", random.Random(i).randbytes(3000).hex()) for i in range(60)]
    monkeypatch.setattr(warc, "FRAME_BYTES", 20_000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 50_000)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*((i, u, h, None) for i, u, h in rows), strict=True)], ["page_id", "url", "html", "refers_to"])
    index = pa.Table.from_batches(list(warc.writer(f"file://{tmp_path}")(iter([batch]))))
    assert len(set(index["bundle"].to_pylist())) > 1 and max(index["frame"].to_pylist()) > 0
    ordered = index.sort_by([("bundle", "ascending"), ("frame", "ascending"), ("offset", "ascending")])
    got = pa.Table.from_batches(list(warc.reader(f"file://{tmp_path}")(iter(ordered.to_batches()))))
    assert dict(zip(got["page_id"].to_pylist(), got["payload"].to_pylist(), strict=True)) == {i: h.encode() for i, _, h in rows}


def test_large_group_of_near_copies(spark):
    """Many documents that differ in one word each: one component, compared in blocks."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:30], f"x{i}", *base[31:], *(f"y{j}" for j in range(120))]), "en", "a", 1) for i in range(1500)]
    got = near_dedup.marked(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_copies_with_a_shared_passage(spark):
    """Copies in several partitions, runs that share an anchor, and one text that shares a passage with a copied one."""
    draw = random.Random(2)
    letters = lambda n: "".join(draw.choices("abcdefghij ", k=n))
    core = letters(150)
    variants = [letters(400) + core + letters(400) for _ in range(6)]
    other = letters(250) + variants[3][380:700] + letters(250)
    texts = [*variants * 3, other, letters(900), letters(120) + core + letters(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    starts = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for parts in (1, 3, 7):
        got = {r.doc_id: r for r in suffix_dedup.remove(docs.repartitionByRange(parts, "doc_id")).collect()}
        for d, t in enumerate(texts):
            gone = {j for i in range(len(t) - 199) if starts[t[i : i + 200]] > 1 for j in range(i, i + 200)}
            left = "".join(c for j, c in enumerate(t) if j not in gone)
            assert (got[d].n_removed, got[d].kept_sha256) == (len(gone), hashlib.sha256(left.encode()).hexdigest())
        assert got[18].n_removed >= 320 and got[19].n_removed == 0


def test_nearest_in_groups_of_near_copies(spark):
    """Groups of 25 to 500 near copies in two shards: the queries of each group find their true neighbours."""
    rng = np.random.default_rng(3)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    sizes = [0, *[25] * 4, *[60] * 12, *[100] * 4, 200, 500]
    sizes[0] = 20_000 - sum(sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)
    centre = unit(rng.standard_normal((60, 64)))
    x = np.where((group == 0)[:, None], centre[rng.integers(0, 60, len(group))], unit(rng.standard_normal((len(sizes), 64)))[group])
    x = unit(x + np.where(group == 0, 0.12, 0.002)[:, None] * rng.standard_normal(x.shape))
    ids = rng.permutation(len(x))
    asked = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(asked, s=ann.Settings(shard_rows=10_000)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = {}
    for at in np.flatnonzero(ids % 20 == 0):
        near = x @ x[at]
        near[at] = -np.inf
        hit.setdefault(group[at], []).append(len(got[ids[at]] & set(ids[np.argpartition(-near, 20)[:20]])) / 20)
    assert min(np.mean(h) for h in hit.values()) >= 0.9
