"""The scores of the models against plain versions: dictionaries and loops over single words."""

import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from meetlake.llm import language_model, mixing, packing, quality, queries, suffix_dedup, toxicity
from meetlake.llm.common import CHUNK_BYTES, pieces, stems, table
from pyspark.sql import functions as F
from tests.llm.helpers import SCHEMA, crc, words


def labelled(spark, sf, label, n):
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where(F.col(label).isNotNull()), "doc_id").orderBy("doc_id").limit(n).collect()
    return [r.text.encode() for r in rows], np.array([r[label] for r in rows])


# op3: Kneser-Ney


def bare(text):
    return [w for w in re.split(rb"[ \t\n\x0b\x0c\r!-/:-@\[-`{-~]+", text.lower()) if w]


def less(n, amounts):
    return min(n, [0, *amounts][min(n, len(amounts))])


class PlainKneserNey:
    def __init__(self, texts, toxic, s):
        self.s, tokens = s, []
        for t, y in zip(texts, toxic):
            own = bare(t)
            tokens += [(before, w, y) for before, w in zip([None, *own], own)]
        events = set(tokens)
        self.logs, parents = {}, {"": [0.0, 0.0]}
        total = {"": [max(1, sum(y == c for _, _, y in events)) for c in (0, 1)]}
        for level in range(len(s.stems) + 1):
            n, up = defaultdict(lambda: [0, 0]), {}
            for _, w, y in events:
                k = self.key(w, level)
                n[k][y] += 1
                up[k] = self.key(w, level - 1)
            freed, below = defaultdict(lambda: [0.0, 0.0]), Counter()
            for k, own in n.items():
                below[up[k]] += sum(own)
                for c in (0, 1):
                    freed[up[k]][c] += less(own[c], s.discounts)
            logs = {}
            for k, own in n.items():
                shared = (sum(own) + 1e-3) / (below[up[k]] + 1)
                p = [(own[c] - less(own[c], s.discounts) + freed[up[k]][c] * shared) / max(total[up[k]][c], 1) if total[up[k]][c] > 0 else shared for c in (0, 1)]
                logs[k] = [parents[up[k]][c] + math.log(p[c]) for c in (0, 1)]
            self.logs |= logs  # the last level at which a key stands counts
            parents, total = logs, n
        pairs, self.context, shared_free = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), Counter()
        for before, w, y in tokens:
            pairs[before, w][y] += 1
            self.context[before][y] += 1
        freed = defaultdict(lambda: [0.0, 0.0])
        for (before, _), own in pairs.items():
            shared_free[before] += less(sum(own), s.pair_discounts)
            for c in (0, 1):
                freed[before][c] += less(own[c], s.pair_discounts)
        self.pairs = {}
        for (before, w), own in pairs.items():
            if sum(own) < 2:
                continue
            all_, plain = self.context[before], [math.exp(x) for x in self.logs[self.key(w, len(s.stems))]]
            p = []
            for c in (0, 1):
                shared = (sum(own) - less(sum(own), s.pair_discounts) + shared_free[before] * plain[c]) / sum(all_)
                p.append((own[c] - less(own[c], s.pair_discounts) + freed[before][c] * shared) / all_[c] if all_[c] else shared)
            self.pairs[before, w] = math.log(p[1]) - math.log(p[0])
        self.back = {b: [math.log(max(freed[b][c] / all_[c] if all_[c] else 1.0, 1e-9)) for c in (0, 1)] for b, all_ in self.context.items()}

    def key(self, word, level):
        if level < 0:
            return ""
        if level == len(self.s.stems) or len(word) < self.s.stems[level]:
            return ("whole", word)
        return ("start", word[: self.s.stems[level]])

    def evidence(self, text):
        out, before = [], None
        for w in bare(text):
            if (before, w) in self.pairs:
                out.append(self.pairs[before, w])
            else:
                known = next((self.logs[k] for k in (self.key(w, n) for n in range(len(self.s.stems), -1, -1)) if k in self.logs), [0, 0])
                back = self.back.get(before, [0, 0])
                out.append(known[1] - known[0] + back[1] - back[0])
            before = w
        return out


def plain_features(e, s):
    if not e:
        return [0.0, 0.0, 0.0]
    n, w = max(len(e), s.window / 2), s.window
    best = max(sum(e[i : i + w]) for i in range(len(e) - w + 1)) if len(e) > w else sum(e)
    return [sum(e) / n, best / w, sum(max(x - s.clear, 0) + min(x + s.clear, 0) for x in e) / n]


def test_toxicity_is_the_plain_model(spark, sf):
    s = toxicity.Settings()
    texts, y = labelled(spark, sf.replace("0.001", "0.01"), "toxic", 150)
    arrays = toxicity.fit(texts, y, 0.1, s)
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    learn = [i for i, t in enumerate(texts) if t.strip() and first[t] == i and i % 3]
    plain = PlainKneserNey([texts[i] for i in learn], y[learn].tolist(), s)
    model = toxicity.KneserNey(arrays)
    asked = [t for t in texts[::4] if len(t) < 4000] + [b"", b"word", b"never seen qqq zzz", texts[learn[0]]]
    got = toxicity.texts_features(model, asked, s)
    for text, row in zip(asked, got):
        e = plain.evidence(text)
        for run, _ in pieces([text]):
            assert model.evidence(*stems(run, s.stems)) == pytest.approx(e, abs=2e-5)
        assert row == pytest.approx(plain_features(e, s), abs=1e-4)
    x, t = np.array([plain_features(plain.evidence(texts[i]), s) for i in range(0, len(texts), 3) if first[texts[i]] == i]), np.array([y[i] for i in range(0, len(texts), 3) if first[texts[i]] == i])
    p = 1 / (1 + np.exp(-(x @ arrays["curve"][:-1] + arrays["curve"][-1])))
    weight = np.where(t == 1, s.toxic_share / t.sum(), (1 - s.toxic_share) / (1 - t).sum()) * len(t)
    assert x.T @ (weight * (t - p)) == pytest.approx(1e-2 * arrays["curve"][:-1], abs=1e-3)  # where the penalised likelihood is level


# op6: attention over passages


def plain_passages(text):
    """The features of each passage, byte by byte and word by word."""
    n = max(1, -(-len(text) // quality.PASSAGE))
    whole, rows = text + b"\n", []
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", whole)]
    for k in range(n):
        a, b = k * quality.PASSAGE, (k + 1) * quality.PASSAGE if k < n - 1 else len(whole)
        kinds = np.bincount(quality.KINDS[list(whole[a:b])], minlength=quality.N_KINDS)
        own = [whole[i:j] for i, j in spans if min(i // quality.PASSAGE, n - 1) == k]
        length = [len(w) for w in own]
        mean = sum(length) / max(1, len(own))
        spread = math.sqrt(max(0.0, sum(x * x for x in length) / max(1, len(own)) - mean**2))
        back = lambda d: sum(x == y for x, y in zip(own[d:], own)) / max(1, len(own))  # noqa: B023, E731
        marked = sum(quality.KINDS[w[-1]] >= 8 for w in own) / max(1, len(own))
        rows.append([*np.sqrt(kinds / max(1, kinds.sum())), back(1), back(2), math.log1p(mean), math.log1p(spread), marked, math.log1p(len(own))])
    return rows


def plain_score(net, rows):
    """One document: every passage by itself."""
    p, hidden, energy = net.p, [], []
    for x in rows:
        x = np.clip((np.array(x, np.float64) - net.mean) / net.scale, -8, 8)
        h = np.tanh([sum(x[i] * p["w"][i, j] for i in range(len(x))) + p["b"][j] for j in range(p["w"].shape[1])])
        t, g = np.tanh(h @ p["v"].astype(float)), 1 / (1 + np.exp(-(h @ p["u"].astype(float))))
        hidden.append(h)
        energy.append(sum(p["a"][j, 0] * t[j] * g[j] for j in range(len(t))))
    k = np.exp(np.array(energy) - max(energy))
    z = sum(w * h for w, h in zip(k / k.sum(), hidden))
    return 1 / (1 + math.exp(-(sum(z[j] * p["c"][j, 0] for j in range(len(z))) + p["d"][0])))


def test_quality_is_the_plain_network(spark, sf):
    s = quality.Settings(per_class=40, steps=30)
    texts, y = labelled(spark, sf, "quality", 60)
    texts = [t[:3000] for t in texts]
    net = quality.network(quality.fit(texts, y, s), s)
    asked = [*texts[:20], b"", b"a", b"same same same same " * 60, "é日 ...".encode() * 90]
    x, bag = quality.bags(asked)
    got = net.forward(x, bag, len(asked))["y"]
    for i, text in enumerate(asked):
        rows = plain_passages(text)
        assert x[bag == i] == pytest.approx(np.array(rows), abs=1e-4)
        assert got[i] == pytest.approx(plain_score(net, rows), abs=1e-4)


def test_the_networks_gradient_is_that_of_its_loss(spark, sf):
    texts, y = labelled(spark, sf, "quality", 24)
    s = quality.Settings(hidden=5, attention=3)
    x, bag = quality.bags([t[:1500] for t in texts])
    net = quality.Network(s)
    net.mean, net.scale = x.mean(0).astype(np.float64), np.maximum(x.std(0), 0.02).astype(np.float64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    weight = np.linspace(0.5, 1.5, len(y))

    def loss():
        p = net.forward(x.astype(np.float64), bag, len(y))["y"]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    found = net.gradient(net.forward(x.astype(np.float64), bag, len(y)), bag, y, weight)
    rng = random.Random(1)
    for name, values in net.p.items():
        for _ in range(4):
            at = tuple(rng.randrange(n) for n in values.shape)
            kept, h = values[at], 1e-4
            values[at] = kept + h
            above = loss()
            values[at] = kept - h
            below = loss()
            values[at] = kept
            assert found[name][at] == pytest.approx((above - below) / (2 * h), rel=2e-2, abs=2e-3), name


# op9: deleted interpolation


def plain_language_model(texts, s):
    """(n_tokens, n_known, base, score) of each of texts (doc_id, text), by dictionaries of tokens."""
    end, folds = "</end>", [f for f in range(s.folds) if f != s.held_out]
    group = {f: i * language_model.ROTATIONS // len(folds) for i, f in enumerate(folds)}
    of = {i: None if crc(d) % s.folds == s.held_out else group[crc(d) % s.folds] for i, (d, _) in enumerate(texts)}
    own = {i: [*words(t), end] for i, (_, t) in enumerate(texts)}
    start = "<start>"

    def counts(which):
        one, two, three, begins = Counter(), Counter(), Counter(), 0
        for i in which:
            t = own[i]
            begins += 1
            one.update(t)
            two.update(zip([start, *t], t))
            three.update(zip([start, start, *t], [start, *t], t))
        return one, two, three

    def estimates(i, c):
        one, two, three = c
        n, v = sum(one.values()), len(one)
        t = own[i]
        for k, w in enumerate(t):
            before, pair_before = (t[k - 1] if k else start), (t[k - 2] if k > 1 else start)
            # the start of a text is counted by its end
            n1 = one[end] if k == 0 else one[before]
            n2 = one[end] if k == 0 else two[pair_before, before]
            bucket = min(int(math.log2(n2 + 1)), language_model.PAIRS - 1) * language_model.WORDS + min(int(math.log2(n1 + 1) / 2), language_model.WORDS - 1)
            yield bucket, (three[pair_before, before, w] / max(n2, 1), two[before, w] / max(n1, 1), one[w] / max(n, 1), 1 / (v + 1))

    cells = defaultdict(lambda: [0, 0.0, 0.0, 0.0])
    for r in range(language_model.ROTATIONS):
        others = counts([i for i, g in of.items() if g is not None and g != r])
        for i, g in of.items():
            if g == r:
                for bucket, p in estimates(i, others):
                    levels = tuple(min(-math.floor(math.log2(x)), language_model.LEAST) if x > 0 else language_model.LEAST + 1 for x in p[:3])
                    cell = cells[bucket, *levels]
                    cell[0] += 1
                    for k in range(3):
                        cell[k + 1] += p[k]
    all_ = counts([i for i, g in of.items() if g is not None])
    tokens, types = sum(all_[0].values()), len(all_[0])
    weights, last = {}, [0.3, 0.3, 0.3, 0.1]
    for b in range(language_model.PAIRS * language_model.WORDS):
        rows = [(n, x / n, y / n, z / n) for (bucket, *_), (n, x, y, z) in cells.items() if bucket == b]
        if rows:
            last = [0.3, 0.3, 0.3, 0.1]
            for _ in range(s.steps):
                sums = [0.0] * 4
                for n, *p in rows:
                    parts = [w * f for w, f in zip(last, (*p, 1 / (types + 1)))]
                    for k in range(4):
                        sums[k] += n * parts[k] / sum(parts)
                last = [max(x / sum(n for n, *_ in rows), 1e-6) for x in sums]
                last = [x / sum(last) for x in last]
        weights[b] = last
    out = []
    for i in range(len(texts)):
        base = sum(math.log10((all_[0][w] + 1) / (tokens + types + 1)) for w in own[i])
        score = sum(math.log10(sum(w * f for w, f in zip(weights[b], p))) for b, p in estimates(i, all_))
        out.append((len(own[i]), sum(all_[0][w] > 0 for w in own[i]), base, score))
    return out


def test_language_model_is_the_plain_model(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()] + [(900, None), (901, "the the the"), (901, "the the the"), (902, " ")]
    s = language_model.Settings(chunk_bytes=20_000, part_bytes=20_000)
    want = plain_language_model(rows, s)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in language_model.score(docs, s).collect()))
    plain = sorted((d, a, b, round(c, 6), round(e, 6)) for (d, _), (a, b, c, e) in zip(rows, want))
    assert len(got) == len(plain)
    for x, y in zip(got, plain):
        assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], rel=1e-6, abs=1e-4)


# op8: what is taken


def test_what_is_taken_is_the_plain_draw(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights = {r.doc_id: r.quality_weight for r in mixing.label_weights(spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(8), "doc_id", "text"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = docs.select("doc_id", "source", "text", u.alias("u")).collect()
    got = {r.doc_id: r for r in queries.op8_mixing(spark, sf).collect()}
    sources = sorted({r.source for r in rows if r.source is not None}) + [None] * any(r.source is None for r in rows)
    size = {r.doc_id: len(words(r.text)) for r in rows}
    own = {x: sum(size[r.doc_id] for r in rows if r.source == x) for x in sources}
    weight, target, capped = {x: i % 3 + 1 for i, x in enumerate(sources)}, {}, set()
    while True:
        rest, w = sum(own.values()) - sum(3 * own[x] for x in capped), sum(weight[x] for x in sources if x not in capped)
        target = {x: 3.0 * own[x] if x in capped else rest * weight[x] / w for x in sources}
        over = {x for x in sources if target[x] > 3 * own[x] + 1e-9}
        if not over:
            break
        capped |= over
    for x in sources:
        epochs = int(target[x] // own[x]) if own[x] else 0
        budget, before = target[x] - epochs * own[x], 0
        for r in sorted((r for r in rows if r.source == x), key=lambda r: (-math.log(r.u) / weights.get(r.doc_id, 1.0), r.doc_id)):
            n = size[r.doc_id]
            taken = n * (epochs + (before + n / 2 < budget))
            before += n
            assert (got[r.doc_id].size, got[r.doc_id].taken) == (n, taken) and got[r.doc_id].target == pytest.approx(target[x])


# long texts, hot anchors, the pipeline as a whole


def test_texts_above_a_mebibyte(spark):
    """A text of several chunks: words without end between few separators, then a repeated passage."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(80))
    long_ = " ".join(rng.choice(vocabulary) for _ in range(260_000)) + " " + passage
    assert len(long_) > 1.3 * CHUNK_BYTES
    rows = [(1, long_), (2, passage), (3, "x" * (CHUNK_BYTES + 5)), (4, "short one")]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], SCHEMA)
    want = plain_language_model(rows, language_model.Settings())
    got = {r.doc_id: r for r in language_model.score(docs).collect()}
    for (d, _), (n, known, base, score) in zip(rows, want):
        assert (got[d].n_tokens, got[d].n_known) == (n, known) and got[d].base_score == pytest.approx(base) and got[d].score == pytest.approx(score, rel=1e-6)
    tokens = Counter()
    for r in packing.pack(docs, queries.tokenizer_path()).collect():
        tokens[r.doc_id] += r.length
        assert r.doc_tokens >= tokens[r.doc_id]
    assert set(tokens) == {1, 2, 3, 4} and all(tokens[r.doc_id] == r.doc_tokens for r in packing.pack(docs, queries.tokenizer_path()).collect())
    gone = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove(docs).collect()}
    assert gone[2] == (len(passage), len(passage)) and gone[3] == (CHUNK_BYTES + 5,) * 2 and gone[4] == (9, 0)
    assert len(passage) <= gone[1][1] <= len(passage) + 40


def test_pipeline_as_a_whole(spark, sf):
    """run() gives what the stages give one after the other."""
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    want = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.pack_sequences(spark, docs, sf).collect())
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert len({g[0] for g in got}) > 20 and {g[0] for g in got} == {w[0] for w in want}
    total = lambda rows: Counter({d: sum(r[2] for r in rows if r[0] == d) for d in {r[0] for r in rows}})
    assert total(got) == total(want)
