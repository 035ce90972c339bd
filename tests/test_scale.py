"""What grew faster than its input or went through the wrong place: the same results by the way that scales."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from meetlake.functions import text as T
from meetlake.operators import prosody as P
from meetlake.operators import quotes as Q
from meetlake.operators import segment as G
from meetlake.operators import sound as A
from meetlake.operators import spans as S
from meetlake.plans import prosody, queries, sound, texts
from meetlake.plans.meetings import Meetings
from meetlake.sources import adapters as D
from meetlake.sources import recordings as R
from meetlake.streaming import recording
from meetlake.streaming.recording import Limits, Recorder
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_samples_are_made_where_their_frames_are(spark, sf):
    """no samples in a shuffle, and the frames of words that the whole recording gives, those across borders of chunks too."""
    words = D.words(spark, sf).where("meeting_id < 3").withColumn("sentence_i", F.col("i").cast("long")).cache()
    got = R.overheard(words)
    assert "samples" not in plan(got)
    rows = lambda df: {(r.meeting_id, r.i, r.t_ms): (r.sentence_i, r.f0, r.db) for r in df.collect()}
    got, want = rows(got), rows(R.heard(R.spoken(words), words))
    assert got.keys() == want.keys() and len(got) > 1000
    assert any(t % 10_000 > 9_950 for _, _, t in got)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_fillers_need_no_samples_of_other_chunks(spark, sf):
    """chunks without a filler are left out before they are made."""
    text = plan(sound.recorded_fillers(spark, sf))
    assert "exists(ws" in text and "BroadcastHashJoin [name" not in text


def test_rests_do_not_count():
    """an unsteady voice with long rests, against all samples of it."""
    rng, parts = np.random.default_rng(3), []
    for k in range(40):
        parts += [np.zeros(int(rng.integers(0, 4000))), *(0.4 * np.sin(2 * np.pi * np.arange(n) / n) for n in rng.integers(60, 100, 30))]
    x = np.concatenate([*parts, np.zeros(9000)])
    length, _ = A.cycles(x, 8000)
    fits = (length >= 1e-4) & (length <= 0.02)
    a, b = length[:-1], length[1:]
    ok = fits[:-1] & fits[1:] & (np.maximum(a, b) <= 1.3 * np.minimum(a, b))
    assert A.unsteadiness(x, 8000)[0] == pytest.approx(100 * np.abs(b - a)[ok].mean() / length[fits].mean())
    short = A.without_rests(x, 240)
    assert len(short) < 0.7 * len(x) and np.array_equal(short[short != 0], x[x != 0])
    assert A.unsteadiness(np.zeros(9000), 8000) == (None, None)


class Counting:
    """The state of one key, and how often it was asked for a chunk that waits."""

    def __init__(self):
        self.value, self.map, self.puts = None, {}, 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def exists(self):
        return False

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        self.puts += 1

    def listTimers(self):
        return []

    def registerTimer(self, at):
        pass


def test_chunks_in_their_turn_do_not_wait():
    """a batch's chunks are put in order, and only those behind a gap are kept as state."""
    state = Counting()
    own = Recorder(Limits(tick_ms=1000))
    own.init(state)
    at = pd.Timestamp("2024-01-01")
    rows = [(k, at + pd.Timedelta(seconds=k), 2000, np.full(2000, 0.1, np.float32)) for k in (2, 0, 3, 1, 5)]
    out = pd.concat(own.handleInputRows((1,), [pd.DataFrame(rows, columns=["seq", "at", "rate", "samples"])], None))
    assert out["at_ms"].tolist() == [1000, 2000, 3000, 4000] and state.puts == 1


def test_frames_near_a_point_are_counted_not_broadcast(spark, sf):
    """no frames as rows, and no broadcast of what was exploded."""
    text = plan(prosody.tolerance_join(spark, sf))
    assert "Broadcast" not in text and "0 AS f0" not in text and "sequence(start_ms" not in text


def test_a_difference_of_spans_reads_its_source_once(spark, sf):
    """One reading and one sweep instead of four."""
    assert "Union" not in plan(queries.span_subtract(spark, sf))
    assert "Broadcast" not in plan(queries.active_seconds(spark, sf))
    spans = [(1, "mic", 0, 10), (1, "mic", 8, 30), (1, "system", 5, 12), (1, "system", 12, 20), (2, "mic", 0, 5), (3, "system", 0, 5)]
    own = spark.createDataFrame(spans, "meeting_id long, track string, start_ms long, end_ms long")
    got = [tuple(r) for r in S.remaining(own, F.col("track") == "mic", ["meeting_id"]).orderBy("meeting_id", "start_ms").collect()]
    assert got == [(1, 0, 5), (1, 20, 30), (2, 0, 5)]


def test_an_envelope_is_judged_word_by_word(spark, sf):
    """no frame is a row that is sorted or joined."""
    text = plan(sound.envelope_activity(spark, sf))
    assert "Join" not in text and text.count("Window [avg") == 0 and "Generate inline" in text


def test_steps_are_counted_before_they_are_dealt_to_windows(spark, sf):
    """frames are counted by step and pitch, and only these counts are dealt to windows."""
    assert "keys=[meeting_id" in (text := plan(prosody.timeline_pitch_loudness(spark, sf))) and "bin" in text


def test_what_words_tell_of_the_voice_is_what_their_frames_tell(spark, sf):
    """F16, F17 and the metrics: frames worked out behind windows over words, against frames as rows."""
    words = G.with_sentences(D.words(spark, sf)).cache()
    mine, frames, sentences = words.where("track = 'mic'"), D.frames_of(words).cache(), G.sentences(words).cache()
    for got, want, keys in (
        (P.word_decays(mine, D.framed(), sentences), P.decays(frames, sentences), 2),
        (P.word_rises(mine, D.framed(), sentences), P.rises(frames, sentences), 2),
        (P.word_tone(mine, D.framed()), P.tone(frames), 1),
    ):
        assert got.columns == want.columns or set(got.columns) == set(want.columns)
        rows = lambda df: {tuple(r)[:keys]: tuple(r)[keys:] for r in df.select(want.columns).collect()}  # noqa: B023, E731
        a, b = rows(got), rows(want)
        assert a.keys() == b.keys() and a
        for k in a:
            assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-9)


def test_blocks_of_words_are_read_row_by_row(spark, sf):
    """no batch of blocks becomes Python objects at once."""
    text = plan(texts.find_quote(spark, sf))
    assert "MapInArrow" in text and "MapInPandas" not in text


def test_frames_are_compiled_rows_not_lambdas(spark, sf):
    """Frames of words are expressions over places, which Spark compiles, and reach no shuffle."""
    words = G.with_sentences(D.words(spark, sf)).where("track = 'mic'")
    marks = G.sentences(words)
    for df in (P.word_decays(words, D.framed(), marks), P.word_rises(words, D.framed(), marks), P.word_tone(words, D.framed())):
        assert "lambda" not in (text := plan(df)).split("collect_list")[0] and "Generate explode(sequence(" in text


def test_plain_words_keep_their_norm_and_label(spark):
    """The short way of plain words gives what all patterns give."""
    rows = spark.createDataFrame([("Word",), ("ab\r",), ("Er",), ("h-a",), ("ERR-",), ("thy",), ("-",), ("",), (None,), ("Ё1",)], "text string")
    got = rows.select("text", T.norm("text").alias("n"), T.filler_label(T.norm("text"), [("^er+$", "er"), ("^ha+$|^thy$", "ha")]).alias("l")).collect()
    assert [(r.n, r.l) for r in got] == [("word", None), ("ab", None), ("er", "er"), ("h-a", "ha"), ("err", "er"), ("thy", "ha"), ("", None), ("", None), (None, None), ("е1", None)]


def test_overlaps_are_summed_by_one_sweep(spark):
    """no pairs and no join; overlapping spans count each, empty ones and meetings without the other side nothing."""
    rng = np.random.default_rng(5)
    spans = lambda n, longest: [(int(m), k, int(s), int(s + d)) for k, (m, s, d) in enumerate(zip(rng.integers(0, 4, n), rng.integers(0, 200_000, n), rng.integers(0, longest, n), strict=True))]
    a, b = [*spans(60, 90_000), (0, 60, 5000, 5000), (9, 61, 0, 10)], spans(80, 9000)
    frame = lambda rows: spark.createDataFrame(rows, "meeting_id long, i long, start_ms long, end_ms long")
    out = S.overlap_sums(frame(a), frame(b).drop("i"), ["meeting_id"], ["meeting_id", "i"], "x")
    assert "Join" not in plan(out) and out.columns == ["meeting_id", "i", "start_ms", "end_ms", "x"]
    want = {(m, i): sum(max(0, min(e, t) - max(s, r)) for n, _, r, t in b if n == m) for m, i, s, e in a}
    assert {(r.meeting_id, r.i): r.x for r in out.collect()} == want and any(want.values())


def test_tables_dealt_by_meeting_are_not_shuffled_again(spark, sf):
    """turns are shuffled instead of tokens, and what is grouped by meeting reads its staged words where they are."""
    m = Meetings(spark, sf)
    for df in (G.sentences(m.words), S.vad(m.words), G.with_sentences(m.words.drop("sentence_i")), P.word_tone(m.mine, D.framed())):
        assert "Exchange" not in plan(df)
    text = plan(D.words(spark, sf, 3))
    assert text.count("Exchange") == 1 and text.index("Generate posexplode") < text.index("Exchange")
    assert [D.parts(spark, f"/root/testdata/{x}") for x in ("sf0.001", "check_s")] == [1, 24]


def test_texts_of_pairs_travel_by_block(spark):
    """a text is shuffled once for a block of questions and one of sentences, not for each pair it is in."""
    met = spark.createDataFrame([(m, i, (i * 7 + k) % 300) for m in (1, 2) for i in range(200) for k in range(5)], "meeting_id long, question_id long, sentence_i long").distinct()
    q = spark.createDataFrame([(m, i, [f"q{m}-{i}"]) for m in (1, 2) for i in range(200)], "meeting_id long, question_id long, qa array<string>")
    said = spark.createDataFrame([(m, i, i == 3, [f"s{m}-{i}"]) for m in (1, 2) for i in range(300)], "meeting_id long, sentence_i long, is_question boolean, sa array<string>")
    out = Q.paired(met, q, said, 3)
    rows = {tuple(map(str, r)) for r in out.collect()}
    assert rows == {tuple(map(str, r)) for r in met.join(q, ["meeting_id", "question_id"]).join(said, ["meeting_id", "sentence_i"]).select(out.columns).collect()} and len(rows) == 2000


def test_windows_of_an_envelope_share_their_work():
    """F1 of the fourth round: the tempo of all ticks at once is that of each window alone, near its ends and on flat tops too."""
    rng = np.random.default_rng(7)
    steps = np.repeat(rng.choice([0, 0, 0.1, 0.3], 60), 40)
    for rms in (np.abs(rng.normal(size=2400)) * np.sin(np.arange(2400) * 0.07) ** 2, steps, steps * (1 + 1e-15 * rng.integers(-3, 4, 2400)), np.zeros(2400)):
        for last, step in ((1000, 100), (400, 7), (106, 25), (60, 25)):
            ends = np.arange(step, len(rms) + 1, step)
            assert A.rolling_tempo(rms, ends, last) == [A.tempo(rms[max(0, e - last) : e]) for e in ends]


def test_a_stream_takes_words_and_makes_their_samples(spark, sf, monkeypatch):
    """F1 of the fourth round: no sample is written or shuffled, chunks in their turn are taken together, and the rows are those of the samples."""
    words = D.words(spark, sf, 2).where("meeting_id < 2")
    made = recording.cut(R.scored(words, 2000, 2, spread=False))
    assert "samples" not in made.columns and "hashpartitioning(name" not in plan(made)
    counts, take = [], recording.Recording.take
    monkeypatch.setattr(recording.Recording, "take", lambda self, x, rate, count=1: counts.append(count) or take(self, x, rate, count))

    def rows(chunks, **how):
        out = []
        for meeting, own in chunks.toPandas().groupby("meeting_id"):
            r = Recorder(Limits(tick_ms=1000, longest_ms=240_000), **how)
            r.init(Counting())
            out += r.handleInputRows((meeting,), [own], None)
        return pd.concat(out).reset_index(drop=True)

    got = rows(made, samples=R.played)
    assert max(counts) > 30 and got["at_ms"].max() > 60_000
    want = rows(recording.cut(R.spoken(words, 2000, 2)))
    pd.testing.assert_frame_equal(got, want)


def test_questions_meet_blocks_of_sentences(spark, monkeypatch):
    """F2 of the fourth round: no pair of a question and a sentence is a row; the best of blocks are those of all pairs, equal texts and ties too."""
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "of", "the", "red", "house", "river", "stone", "green", "light"])
    said = [(m, i, int(rng.randrange(0, 90)) * 1000, rng.random() < 0.3, " ".join(word() for _ in range(rng.randrange(0, 9)))) for m, n in ((1, 70), (2, 9), (3, 1)) for i in range(n)]
    asked = [(m, i, t + 500, " ".join(w for w in x.split() if rng.random() < 0.7)) for m, i, t, _, x in said] + [(7, 0, 5, "red house")]
    monkeypatch.setattr(Q, "TEXTS", 8)
    sentences = spark.createDataFrame(said, "meeting_id long, sentence_i long, start_ms long, is_question boolean, text string")
    questions = spark.createDataFrame(asked, "meeting_id long, question_id long, start_ms long, question string")
    found = Q.met(questions.selectExpr("meeting_id", "question_id", "start_ms AS at", "question AS words"), sentences.selectExpr("meeting_id", "sentence_i", "start_ms", "is_question", "text AS words"))
    assert "row_number" not in plan(found) and found.count() < 0.2 * 70 * 70
    keys = lambda x: {k for k in x if len(k) > 2} or set(x)
    want = {}
    for m, i, at, x in asked:
        best = None
        for n, j, t, asks, y in said:
            a, b = x.split(), y.split()
            like = max(SequenceMatcher(None, a, b, autojunk=False).ratio(), len(keys(a) & keys(b)) / len(keys(a))) if n == m and a and b else 0
            if like >= 0.5:
                best = max(best or (-1,), (round(like + 0.1 * asks, 6), -abs(t - at), -j))
        want[m, i] = (-best[2], best[0]) if best else None
    for parts in (None, 3):
        got = {(r.meeting_id, r.question_id): (r.sentence_i, r.score) for r in Q.anchor(questions, sentences, parts=parts).collect()}
        assert got.keys() == want.keys() and sum(w is not None for w in want.values()) > 50
        for k, w in want.items():
            assert (got[k] == w) if w else got[k][1] is None


def test_frames_of_words_travel_as_arrays(spark, sf):
    """F3, F4 of the fourth round: a row for each word behind the samples, no frame in a shuffle or a sort, and the voice that frames as rows give."""
    words = G.with_sentences(D.words(spark, sf)).where("meeting_id < 4").cache()
    rows, own, marks = R.overheard(words).cache(), R.whole(R.shares(words)).cache(), G.sentences(words).cache()
    assert own.count() == rows.select("meeting_id", "i").distinct().count() < R.shares(words).count() < rows.count() / 10
    got = {r.meeting_id: tuple(r) for r in P.word_voice(own, R.framed(), marks).collect()}
    want = P.voice(rows, P.decays(rows, marks), P.rises(rows, marks))
    for r in want.collect():
        assert got[r.meeting_id] == pytest.approx(tuple(r), rel=1e-9, abs=1e-9)
    assert len(got) == 4 and "explode" not in plan(sound.recorded_pitch(spark, sf))


def test_pitch_by_short_transforms_is_that_of_long_ones():
    """F3, F4 of the fourth round: lags up to the highest do not meet their mirror in a transform that is just long enough."""
    rng = np.random.default_rng(2)
    for rate in (8000, 16_000, 44_100):
        x = 0.4 * np.sin(2 * np.pi * np.cumsum(rng.uniform(60, 400) + np.zeros(rate // 2)) / rate) + rng.normal(size=rate // 2) * rng.choice([0.001, 0.3])
        size, (low, high, length, window, _) = A.pitch_size(rate), A._lags(rate)
        assert length < 2 * size
        for k, f0 in enumerate(A.pitch_frames(x, rate)[0]):
            y = x[k * (rate // 100) :][:size]
            y = (y - y.mean()) * window
            r = np.array([(y[: size - j] * y[j:]).sum() / (window[: size - j] * window[j:]).sum() for j in range(low - 1, high + 2)]) / ((y * y).sum() / (window * window).sum())
            near = [j for j in range(1, len(r) - 1) if r[j] >= max(r[j - 1], r[j + 1]) and r[j] >= 0.9 * r[1:-1].max()]
            j = near[0] if near else 1
            bend = r[j - 1] - 2 * r[j] + r[j + 1]
            shift = min(max(0.5 * (r[j - 1] - r[j + 1]) / bend, -0.5), 0.5) if abs(bend) > 1e-12 else 0
            assert f0 == pytest.approx(rate / (low - 1 + j + shift) if r[j] >= 0.45 else 0, rel=1e-9)
