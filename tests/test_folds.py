"""Folds against plain loops over whole tables and in linear time; sketches against exact aggregates; checked replies."""

import random
import time

from meetlake.functions import replies
from meetlake.operators import events as E
from meetlake.operators import sketches
from meetlake.operators import spans as S
from meetlake.plans import queries as plans
from meetlake.sources import adapters as D
from meetlake.sources.shared import staged
from pyspark.sql import functions as F


def plain_chunks(spans, gap=1000, longest=28_000, pad=250):
    """The joined and split spans of one track; spans are merged and sorted."""
    joined = []
    for a, b in spans:
        if joined and a - joined[-1][1] < gap and b - joined[-1][0] <= longest:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    out, last = [], max(b for _, b in spans)
    for a, b in joined:
        n = max(1, -(-(b - a) // longest))
        out += [(max(0, int(a + k * (b - a) / n) - pad), min(last, int(a + (k + 1) * (b - a) / n) + pad)) for k in range(n)]
    return out


def test_speech_chunks_of_a_whole_table(spark, sf):
    spans = S.normalize(plans.speech(spark, sf))
    of, want = {}, []
    for r in spans.orderBy("start_ms").collect():
        of.setdefault((r.meeting_id, r.track), []).append((r.start_ms, r.end_ms))
    want = sorted((*k, *c) for k, own in of.items() for c in plain_chunks(own))
    assert sorted(map(tuple, S.speech_chunks(plans.speech(spark, sf)).collect())) == want and len(want) > 100


def test_greedy_phrases_of_a_whole_table(spark):
    rng = random.Random(3)
    rows = [(m, i, j, rng.randint(1, 3), 10 * j, f"p{j}") for m in range(20) for i, j in enumerate(sorted(rng.sample(range(200), rng.randint(0, 120))))]
    rows += [(m, i, j, 4 - n, at, p + "x") for m, i, j, n, at, p in rows[::3] if n != 2]
    got = sorted(tuple(r) for r in E.crutches(spark.createDataFrame(rows, "meeting_id long, i long, j long, n int, start_ms long, phrase string")).select("meeting_id", "start_ms", "n").collect())
    want = []
    for m in range(20):
        free, best = -1, {}
        for _, _, j, n, _, _ in (r for r in rows if r[0] == m):
            best[j] = max(best.get(j, 0), n)
        for j in sorted(best):
            if j >= free:
                want.append((m, 10 * j, best[j]))
                free = j + best[j]
    assert got == sorted(want) and len(want) > 300


def test_ten_times_the_spans_take_about_ten_times_as_long(spark):
    def took(n):
        spans = spark.range(n).select(F.lit(1).alias("meeting_id"), F.lit("mic").alias("track"), (F.col("id") * 500).alias("start_ms"), (F.col("id") * 500 + 300).alias("end_ms"))
        began = time.time()
        assert S.speech_chunks(spans).count() == -(-n // 56)
        return time.time() - began

    took(1000)
    short, long_ = took(20_000), took(200_000)
    assert long_ < 20 * max(short, 0.5)


def test_sketches_are_near_the_exact_aggregates(spark, sf):
    rows = D.catalog(spark, sf.replace("0.001", "0.01")).withColumn("month", F.trunc("started_at", "MM"))
    parts = staged(sketches.sketched(rows, ["month", "status"], "value", "speaker"), "sketches")
    assert parts.count() > 100
    for by in (["status"], ["month"], []):
        got = {tuple(r[c] for c in by): r for r in sketches.read(sketches.merged(parts, by), by).collect()}
        exact = {}
        for r in rows.select(*by, "value", "speaker").collect():
            exact.setdefault(tuple(r[c] for c in by), []).append((float(r.value), r.speaker))
        assert set(got) == set(exact)
        for k, own in exact.items():
            values = sorted(v for v, _ in own)
            assert got[k].n == len(values) and abs(got[k].members - len({s for _, s in own})) <= max(1, 0.03 * len(own))
            for q in (10, 50, 90):
                below = sum(v <= got[k][f"q{q}"] for v in values) / len(values)
                assert abs(below - q / 100) <= 0.02 + 1 / len(values)


def test_sketches_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", 1.0, "x"), ("b", None, "x")], "g string, value double, member string")
    out = {r.g: r for r in sketches.read(sketches.merged(sketches.sketched(rows, ["g"], "value", "member"), ["g"]), ["g"]).collect()}
    assert (out["a"].n, out["a"].q50, out["a"].members) == (0, None, 0) and (out["b"].n, out["b"].q50, out["b"].members) == (1, 1.0, 1)
    assert sketches.read(sketches.sketched(rows.limit(0), ["g"], "value", "member"), ["g"]).collect() == []


def test_replies(spark):
    fields = [("title", "string", True), ("share", "double", True), ("ids", "array<long>", False)]
    cases = {
        '{"title": "a", "share": 0.5}': (("a", 0.5, None), None),
        'well: ```json\n{"title": "a", "share": 1, "ids": [1, 2], "more": {}}\n```': (("a", 1.0, [1, 2]), None),
        '{"title": "a"}': (None, "share is missing"),
        '{"title": null, "share": 1}': (None, "title is missing"),
        '{"title": "a", "share": "x"}': (None, "share is not a double"),
        '{"title": "a", "share": 1, "ids": 7}': (None, "ids is not a array<long>"),
        "no": (None, "no JSON"),
        "{broken": (None, "no JSON"),
        "{broken}": (None, "no JSON"),
        "": (None, "no JSON"),
        None: (None, "no JSON"),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", replies.checked(F.col("t"), fields).alias("r")).collect()
    for r in rows:
        value = None if r.r.value is None else tuple(r.r.value)
        assert (value, r.r.fault) == cases[r.t], r.t


