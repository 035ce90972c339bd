"""Every registered query against its SQL at the smallest size, and golden cases of single operators."""

import pytest
from meetlake.functions import scoring as J
from meetlake.functions import text as T
from meetlake.operators import catalog as K
from meetlake.operators import metrics as M
from meetlake.operators import spans as S
from meetlake.plans import patterns, prosody, queries as _queries, registry, reports, sound, streams, texts, values, views  # noqa: F401
from pyspark.sql import functions as F
from tests.oracle import compare, duck

SPANS = "meeting_id long, track string, start_ms long, end_ms long"


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, sf, con, name):
    assert compare(spark, con, sf, registry.QUERIES[name], registry.ORACLE[name]) is None


def spans(spark, rows, track="mic"):
    return spark.createDataFrame([(1, track, a, b) for a, b in rows], SPANS)


def got(df):
    return sorted((r.start_ms, r.end_ms) for r in df.collect())


def test_span_goldens(spark):
    assert got(S.normalize(spans(spark, [(2, 3), (0, 1), (0, 1), (5, 5)]))) == [(0, 1), (2, 3)]
    assert got(S.normalize(spans(spark, [(0, 10), (10, 20)]))) == [(0, 20)]
    a, b = spans(spark, [(0, 10)]), spans(spark, [(2, 4), (8, 12)])
    assert got(S.intersect(a, b, ["meeting_id"])) == [(2, 4), (8, 10)] and got(S.subtract(a, b, ["meeting_id"])) == [(0, 2), (4, 8)]
    assert got(S.merge_gaps(spans(spark, [(0, 1000), (1300, 2000), (3000, 4000)]), 500)) == [(0, 2000), (3000, 4000)]
    assert got(S.merge_gaps(spans(spark, [(0, 1000), (1500, 2000)]), 500)) == [(0, 1000), (1500, 2000)]
    # across the minutes by which spans meet
    assert got(S.intersect(spans(spark, [(0, 200_000)]), spans(spark, [(59_000, 130_000)]), ["meeting_id"])) == [(59_000, 130_000)]


def test_speech_chunks(spark):
    chunks = got(S.speech_chunks(spans(spark, [(0, 10_000), (10_500, 20_000), (20_400, 30_000), (40_000, 100_000)])))
    assert chunks == [(0, 20_250), (20_150, 30_250), (39_750, 60_250), (59_750, 80_250), (79_750, 100_000)]


def test_tokens(spark):
    df = spark.createDataFrame([("Ёлка,",), ("Э-э,",), ("юнит-экономика?",), ("«Привет»!",), ("...",)], "t string")
    assert [r[0] for r in df.select(T.norm("t")).collect()] == ["елка", "э-э", "юнит-экономика", "привет", ""]
    assert spark.range(1).select(T.timecode(F.lit(83)), T.timecode(F.lit(3723))).first() == ("01:23", "1:02:03")


def test_status_and_penalty(spark):
    rows = [(115.0, 100.0, 130.0), (136.0, 100.0, 130.0), (137.0, 100.0, 130.0), (0.24, None, 0.2), (0.3, None, 0.2), (50.0, 60.0, None), (None, 1.0, 2.0), (1.0, None, None)]
    out = spark.createDataFrame(rows, "value double, ref_low double, ref_high double").select(J.status(), J.penalty()).collect()
    assert [r[0] for r in out] == ["good", "warn", "bad", "warn", "bad", "warn", "na", "na"]
    assert [r[1] is None or round(r[1], 4) for r in out] == [0.0, 0.2, 0.2333, 0.04, 0.1, 0.1667, True, True]


def test_streak(spark):
    rows = [(1, d) for d in ("2024-01-04", "2024-01-05", "2024-01-08")] + [(2, "2024-01-06")]
    df = spark.createDataFrame(rows, "speaker long, started_at string").withColumn("started_at", F.to_timestamp_ntz("started_at"))
    at = lambda day: {r.speaker: r.streak_days for r in K.streaks(df, day).collect()}
    assert at("2024-01-08") == {1: 3, 2: 0} and at("2024-01-09") == {1: 3, 2: 0} and at("2024-01-10") == {1: 0, 2: 0} and at("2024-01-07") == {1: 2, 2: 0}


def test_mtld():
    assert M.mtld_of(["a"] * 40) is None and M.mtld_of(["a"] * 60) < 5
    assert M.mtld_of([f"w{i}" for i in range(60)]) >= 60 and 5 < M.mtld_of([f"w{i % 10}" for i in range(100)]) < 60


def test_empty_tables(spark):
    none = spans(spark, [])
    assert S.normalize(none).count() == S.subtract(none, none, ["meeting_id"]).count() == S.speech_chunks(none).count() == 0
