"""Language identification against sums over every single segmentation, and by held-out accuracy."""

import math
import re

import numpy as np
import pytest
from meetlake.llm import language_id
from meetlake.llm.common import U64, Lookup
from meetlake.llm.language_id import Lattice, Settings
from meetlake.llm.queries import tokenizer_path
from pyspark.sql import functions as F
from tests.llm.helpers import SCHEMA, awkward, crc, empty

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")


def segmentations(word, p):
    """The product of each way to cut a word."""
    if not word:
        return [1.0]
    return [p[word[:n]] * rest for n in range(1, len(word) + 1) if word[:n] in p for rest in segmentations(word[n:], p)]


def integers(p):
    keys = sorted(int.from_bytes(k, "little") for k in p)
    return np.array(keys, U64), [k.to_bytes(8, "little").rstrip(b"\0") for k in keys]


def block(words):
    buf = language_id.buffer([b" ".join(words)])
    return buf, *language_id.spans(buf)


def test_forward_sums_all_segmentations():
    p = {b" ": 0.1, b"a": 0.2, b"b": 0.15, b"ab": 0.1, b" a": 0.05, b"aba": 0.2, b"ba": 0.07, b" ab": 0.03, b"bbbb": 0.01}
    q = {k: 0.05 + 0.01 * i for i, k in enumerate(p)}
    words = [b"a", b"ab", b"abab", b"bbbbab", b"babababa", b"aabbaabbab"]
    keys, names = integers(p)
    buf, start, end = block(words)
    lattice = Lattice(buf, start, end, Lookup(keys), 8)
    got = lattice.forward(np.array([[p[n], q[n]] for n in names]))
    for w, row in zip(words, got):
        for model, x in zip((p, q), row):
            assert x == pytest.approx(math.log(sum(segmentations(b" " + w, model))), abs=1e-9)


def test_expected_counts_by_enumeration():
    p = {b" ": 0.1, b"a": 0.2, b"b": 0.15, b"ab": 0.1, b" a": 0.05, b"ba": 0.07}
    keys, names = integers(p)
    words = [b"abab", b"aab"]
    buf, start, end = block(words)
    got = Lattice(buf, start, end, Lookup(keys), 8).expected(np.array([p[n] for n in names]), np.array([2.0, 3.0]))

    def cuts(word):
        return [[]] if not word else [[word[:n], *rest] for n in range(1, len(word) + 1) if word[:n] in p for rest in cuts(word[n:])]

    want = dict.fromkeys(names, 0.0)
    for w, times in zip(words, (2, 3)):
        ways = cuts(b" " + w)
        weights = [math.prod(p[x] for x in way) for way in ways]
        for way, weight in zip(ways, weights):
            for x in way:
                want[x] += times * weight / sum(weights)
    assert got == pytest.approx([want[n] for n in names])


def test_long_words_do_not_vanish():
    p = {b" ": 1e-6, b"a": 1e-7, b"aa": 1e-9}
    keys, names = integers(p)
    buf, start, end = block([b"a" * 5000, b"a"])
    got = Lattice(buf, start, end, Lookup(keys), 8).forward(np.array([[p[n]] for n in names]))
    last, now = 0.0, 1.0  # f(n) = 1e-7 f(n-1) + 1e-9 f(n-2), scaled by the growth
    log = math.log(1e-6)
    for _ in range(5000):
        last, now = now, 1e-7 * now + 1e-9 * last
        log += math.log(now)
        last, now = last / now, 1.0
    assert got[0, 0] == pytest.approx(log, rel=1e-9) and got[1, 0] == pytest.approx(math.log(1e-13))


def plain(model, names, text):
    """Posterior of each language by a dictionary and a loop over the bytes of every word."""
    logs = model.prior.copy()
    table = {n: model.p[i] for i, n in enumerate(names)}
    for word in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()):
        word, sums = b" " + word, [np.ones(len(model.languages))]
        scale = np.zeros(len(model.languages))
        for end in range(1, len(word) + 1):
            sums.append(sum(sums[end - n] * table[word[end - n : end]] for n in range(1, min(8, end) + 1) if word[end - n : end] in table))
            if end % 10 == 0:
                scale += np.log(sums[-1])
                sums = [x / sums[-1] for x in sums]
        logs += np.log(sums[-1]) + scale
    e = np.exp(logs - logs.max())
    return e / e.sum()


def test_scores_against_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s = Settings(per_language=20, held_words=500, block=5000)
    model = language_id.fit(docs, PATH, s)
    names = [int(k).to_bytes(8, "little").rstrip(b"\0") for k in language_id.vocabulary(PATH, 8)]
    assert model.p.sum(0) == pytest.approx(1) and (model.p > 0).all()
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect() if len(r.text) < 3000] + ["a", "é ", "Zz 12 zz!", "x" * 300, "日本語"]
    rows = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, PATH, s).collect()
    for r in rows:
        want = plain(model, names, texts[r.doc_id])
        assert r.score == pytest.approx(want.max(), abs=1e-6)
        assert want[model.languages.index(r.lang_pred)] == pytest.approx(want.max(), abs=1e-9)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs, PATH), PATH).collect()}
    held = [r for r in docs.collect() if crc(r.doc_id) % 5 == 0 and re.search(r"[^\W\d_]", r.text)]
    assert all(got[r.doc_id].held_out for r in held) and len(got) == docs.count()
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_labels_of_the_held_out_are_not_read(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = docs.withColumn("lang", F.when(held, F.lit("en")).otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    rows = lambda d: sorted(map(tuple, language_id.predict(d, language_id.fit(d, PATH), PATH).collect()))
    assert rows(docs) == rows(other)


def test_edges(spark):
    assert language_id.predict(empty(spark), language_id.fit(empty(spark), PATH), PATH).collect() == []
    docs = awkward(spark, extra=True).withColumn("letter", F.lit(False)).withColumn("h", F.lit(1))
    rows = language_id.predict(docs, language_id.fit(docs, PATH), PATH).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 13 and {by[i].lang_pred for i in (4, 5, 6)} == {"und"} and by[4].score == 0 and not by[None].held_out
    assert by[1].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows)
    texts = spark.createDataFrame([(1, "€ 12 ¡¿ — …", "en", "a", 1), (2, "hello", None, "a", 1)], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(texts, language_id.fit(texts, PATH), PATH).collect()}
    assert got == {1: ("und", 0.0), 2: ("und", 0.0)}  # nothing is learned
