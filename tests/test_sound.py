"""Recordings in chunks against whole ones, files that cannot be read, and what known tones sound like.

Of the tones, by a nation's number k: steady for k % 3 = 0, else four bursts a second for 3 + k % 4 seconds.
"""

import struct

import numpy as np
import pytest
from meetlake.operators import chunks as C
from meetlake.operators import prosody as P
from meetlake.operators import segment as G
from meetlake.operators import sound as A
from meetlake.operators import wav
from meetlake.plans import sound
from meetlake.sources import recordings as R
from pyspark.sql import functions as F


def speech(seconds, rate, seed=1):
    """A voice that wanders in pitch and loudness."""
    rng, t = np.random.default_rng(seed), np.arange(int(seconds * rate)) / rate
    f = 140 + 30 * np.sin(2 * np.pi * 0.7 * t)
    return (0.4 * np.sin(2 * np.pi * np.cumsum(f) / rate) * np.abs(np.sin(2 * np.pi * 1.9 * t)) + 0.05 * rng.normal(size=len(t))).clip(-1, 1)


@pytest.fixture(scope="module")
def recordings(spark):
    made = {"a": (speech(7.3, 8000), 8000), "b": (speech(5.01, 44_100, 2), 44_100), "c": (speech(4, 16_000, 3), 16_000), "d": (speech(0.004, 48_000), 48_000), "e": (np.zeros(0), 16_000)}
    return spark.createDataFrame([(n, bytearray(wav.written(x, r))) for n, (x, r) in made.items()], "name string, content binary")


def whole(recordings, name):
    data = bytes(recordings.where(F.col("name") == name).first().content)
    form = wav.form(data)
    return wav.samples(data, form, 0, form.frames).astype(np.float32), form.rate


def joined(chunks):
    out = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.name, r.part)):
        assert r.first == sum(map(len, out.get(r.name, [])))
        out.setdefault(r.name, []).append(r.samples)
    return {n: np.concatenate([np.asarray(x, np.float32) for x in parts]) for n, parts in out.items()}


def test_chunks_are_the_recording(recordings):
    got = joined(C.cut(recordings, 1))
    for name in "abcde":
        assert np.array_equal(got[name], whole(recordings, name)[0])


def test_resampling_in_chunks_is_sample_by_sample_that_of_the_whole(recordings):
    """Of chunks of a second, whose borders fall between samples of the other rate."""
    got = joined(C.resampled(C.cut(recordings, 1)))
    for name in "abcde":
        x, rate = whole(recordings, name)
        want = C.resample(x, rate).astype(np.float32)
        assert len(want) == -(-len(x) * 16_000 // rate) and np.array_equal(got[name], want), name


def test_pitch_across_borders(recordings):
    got = {}
    for r in A.pitches(C.cut(recordings, 1)).collect():
        got.setdefault(r.name, {})[r.k] = (r.f0, r.db)
    for name in "abc":
        f0, level = A.pitch_frames(whole(recordings, name)[0].astype(np.float64), whole(recordings, name)[1])
        assert sorted(got[name]) == list(range(len(f0)))
        assert np.allclose([got[name][k] for k in range(len(f0))], np.column_stack((f0, level)), atol=1e-9)
    assert "d" not in got and "e" not in got


def plain_filter(x, cutoff, rate, high):
    """The published two-pole Butterworth filter, sample by sample."""
    w = 2 * np.pi * cutoff / rate
    alpha, c = np.sin(w) / np.sqrt(2), np.cos(w)
    k = (1 + c) / 2 if high else (1 - c) / 2
    b, a = np.array([k, -2 * k if high else 2 * k, k]) / (1 + alpha), np.array([1, -2 * c / (1 + alpha), (1 - alpha) / (1 + alpha)])
    y = np.zeros(len(x) + 2)
    v = np.concatenate(([0, 0], x))
    for i in range(2, len(v)):
        y[i] = b @ v[[i, i - 1, i - 2]] - a[1] * y[i - 1] - a[2] * y[i - 2]
    return y[2:]


def test_the_filters_state_is_carried_over_borders(recordings):
    got = {}
    for r in C.envelopes(C.cut(recordings, 1)).collect():
        got.setdefault(r.name, {})[r.k] = r.rms
    for name in "abc":
        x, rate = whole(recordings, name)
        size = rate // 100
        y = plain_filter(plain_filter(x.astype(np.float64), 300, rate, True), min(3000, 0.45 * rate), rate, False)
        want = np.sqrt((y[: len(y) // size * size].reshape(-1, size) ** 2).mean(1))
        assert sorted(got[name]) == list(range(len(want)))
        assert np.allclose([got[name][k] for k in range(len(want))], want, atol=1e-10)


def test_chunked_facts_are_those_of_the_whole(recordings):
    rows = {r.name: r for r in A.scan(recordings).collect()}
    for name in "abc":
        x, rate = whole(recordings, name)
        x = C.resample(x, rate).astype(np.float32).astype(np.float64)
        r = rows[name]
        assert (r.rate, r.fault) == (rate, None) and r.duration_s == pytest.approx(len(x) / 16_000)
        assert r.peak_db == pytest.approx(20 * np.log10(np.abs(x).max())) and r.rms_db == pytest.approx(10 * np.log10((x**2).mean()))
        assert r.loud_db == pytest.approx(np.percentile(A.tenths(x, 16_000), 95))
    assert rows["e"].silent and rows["e"].short and rows["e"].duration_s == 0 and rows["e"].peak_db == -120


def file(form=(1, 1, 8000, 8000, 1, 8), body=b"\x80\xff\x00\x80", before=b"", size=None, riff=b"RIFF"):
    head = b"WAVE" + struct.pack("<4sIHHIIHH", b"fmt ", 16, *form) + before + struct.pack("<4sI", b"data", len(body) if size is None else size) + body
    return riff + struct.pack("<I", len(head)) + head


def test_forms_and_faults(spark):
    note = struct.pack("<4sI", b"LIST", 3) + b"abc\0"
    extensible = b"WAVE" + struct.pack("<4sIHHIIHH", b"fmt ", 40, 0xFFFE, 1, 8000, 16_000, 2, 16) + struct.pack("<HHIH14s", 22, 16, 0, 1, b"") + struct.pack("<4sI", b"data", 4) + struct.pack("<2h", 16384, -32768)
    good = {
        "8 bits": (file(), [0, 127 / 128, -1, 0]),
        "a note before": (file(before=note), [0, 127 / 128, -1, 0]),
        "length unknown": (file(size=0xFFFFFFFF), [0, 127 / 128, -1, 0]),
        "24 bits": (file((1, 1, 8000, 24_000, 3, 24), b"\0\0\x40\xff\xff\xff"), [0.5, -1 / 2**23]),
        "32 bits": (file((1, 1, 8000, 32_000, 4, 32), struct.pack("<i", -(2**30))), [-0.5]),
        "real": (file((3, 1, 8000, 32_000, 4, 32), struct.pack("<3f", 0.25, float("nan"), 2.0)), [0.25, 0, 2]),
        "two channels": (file((1, 2, 8000, 32_000, 4, 16), struct.pack("<4h", 16384, 0, -16384, -16384)), [0.25, -0.5]),
        "extensible": (b"RIFF" + struct.pack("<I", len(extensible)) + extensible, [0.5, -1]),
    }
    for name, (data, want) in good.items():
        form = wav.form(data)
        assert wav.samples(data, form, 0, 99).tolist() == pytest.approx(want), name
        assert wav.samples(data, form, 1, 1).tolist() == pytest.approx(want[1:2]), name
    bad = {"cut": file(size=400), "other": b"ID3 something else", "empty": b"", "null": None, "form": file((7, 1, 8000, 8000, 1, 8)), "headless": b"RIFF\0\0\0\0WAVEdata\4\0\0\0abcd", "no data": b"RIFF\0\0\0\0WAVE", "no rate": file((1, 1, 0, 0, 1, 8))}
    rows = spark.createDataFrame([(n, None if d is None else bytearray(d)) for n, d in [*bad.items(), ("good", good["8 bits"][0])]], "name string, content binary")
    scanned = {r.name: r for r in A.scan(rows).collect()}
    assert set(scanned) == {*bad, "good"} and scanned["good"].fault is None and scanned["good"].channels == 1
    assert all(scanned[n].fault and scanned[n].rate is None for n in bad) and scanned["cut"].fault == "the samples are cut short"
    assert {r.name for r in A.converted(rows).collect()} == {"good"}
    seconds = {r.name: r.s for r in spark.createDataFrame([(n, bytearray(d)) for n, (d, _) in good.items()], "name string, content binary").select("name", wav.seconds(F.col("content")).alias("s")).collect()}
    for name, (data, _) in good.items():
        assert seconds[name] == pytest.approx(wav.form(data).frames / 8000), name
    assert all(r.s is None for r in rows.where("name IN ('other', 'empty', 'null')").select(wav.seconds(F.col("content")).alias("s")).collect())


def test_bursts_are_counted(spark, sf):
    for r in sound.live_tempo(spark, sf).collect():
        k = int(r.name[1:])
        assert r.peaks == (4 * (3 + k % 4) if k % 3 else 0) and r.speech_s == 3 + k % 4
        assert (r.wpm > 100) == bool(k % 3)


def test_peaks_by_plain_loops():
    """Peaks by a loop over heights, each against all that were kept."""
    for seed in range(30):
        level = np.random.default_rng(seed).integers(0, 12, 200).astype(float)
        at = 1 + np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] >= level[2:]))
        kept = []
        for i in sorted(at, key=lambda i: (-level[i], i)):
            if all(abs(i - k) >= 6 for k in kept):
                kept.append(i)
        assert A.apart(level[at], at).tolist() == sorted(kept)
        for i, got in zip(at, A.stand_out(level, at, 50)):
            lows = []
            for step in (-1, 1):
                low, j = level[i], i + step
                while 0 <= j < len(level) and abs(j - i) <= 50 and level[j] <= level[i]:
                    low, j = min(low, level[j]), j + step
                lows.append(low)
            assert got == level[i] - max(lows)


def test_steady_tones_neither_jitter_nor_shimmer(spark, sf):
    rows = {int(r.name[1:]): r for r in sound.audio_jitter(spark, sf).collect()}
    assert len(rows) == 25
    for k, r in rows.items():
        assert 0 <= r.jitter_pct < 0.2 and (r.shimmer_pct > 1 if k % 3 else r.shimmer_pct < 0.5)


def test_the_start_may_be_less_steady(spark):
    """A voice whose cycles vary in its first two minutes only, and one that is too short to tell."""
    rng, rate = np.random.default_rng(1), 8000

    def voice(seconds, shaky):
        n = np.where(np.arange(seconds * 100) < shaky * 100, rng.integers(70, 91, seconds * 100), rng.integers(80, 82, seconds * 100))
        return (0.5 * np.concatenate([np.sin(2 * np.pi * np.arange(k) / k) for k in n])).astype(np.float32)

    rows = spark.createDataFrame([("long", bytearray(wav.written(voice(260, 118), rate))), ("even", bytearray(wav.written(voice(260, 0), rate))), ("short", bytearray(wav.written(voice(200, 100), rate)))], "name string, content binary")
    got = {r.name: r for r in A.voices(C.cut(rows, A.VOICE_S)).collect()}
    assert got["long"].start_jitter_ratio > 5 and got["short"].start_jitter_ratio is None and 0.5 < got["even"].start_jitter_ratio < 2
    assert got["long"].jitter_pct > 3 * got["even"].jitter_pct


def test_centroids_one_by_one():
    sounds = [speech(n / 16_000, 16_000, n) for n in (15, 400, 400, 1600)] + [np.zeros(400), np.empty(0)]
    for x, got in zip(sounds, A.centroids(sounds)):
        want = 0.0
        if len(x) >= 16 and np.ptp(x):
            a = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x))))
            hz = np.fft.rfftfreq(len(x), 1 / 16_000)
            want = sum(f * v for f, v in zip(hz, a) if f <= 4000) / sum(v for f, v in zip(hz, a) if f <= 4000)
        assert got == pytest.approx(want)


def test_metrics_of_a_recorded_meeting(spark):
    """Two sentences of one word each: the pitch rises within the second, and the first falls off at its end."""
    words = [(1, "mic", 0, i, 400 * i + (3000 if i >= 5 else 0), 400 * i + 380 + (3000 if i >= 5 else 0), "w." if i in (4, 9) else "w", "w", 0 if i < 5 else 1, "word") for i in range(10)]
    own = spark.createDataFrame(words, "meeting_id long, track string, turn long, i long, start_ms long, end_ms long, text string, norm string, sentence_i long, kind string")
    frames = R.heard(R.spoken(own, seconds=1), own).cache()
    for i in range(10):
        f0 = [r.f0 for r in frames.where(F.col("i") == i).collect()]
        assert len(f0) == (380 - 50) // 10 + 1 and np.median(f0) == pytest.approx(100 + (13 + 7 * i) % 60, abs=0.5)
    sentences = G.sentences(own)
    decay = {r.sentence_i: r.decay_db for r in P.decays(frames, sentences).collect()}
    level = lambda i: -((5 + 11 * i) % 20)  # noqa: E731  dB below the common level
    power = lambda levels: 10 * np.log10(np.mean(10 ** (np.array(levels) / 10)))
    for s, first in ((0, 0), (1, 5)):
        rows = [level(first + k // 34) for k in range(170)]
        assert decay[s] == pytest.approx(power(rows[170 // 4 : 3 * 170 // 4]) - power(rows[-50:]), abs=0.4)
    voice = P.voice(frames, P.decays(frames, sentences), P.rises(frames, sentences)).first()
    assert voice.pitch_median_hz == pytest.approx(np.median([100 + (13 + 7 * i) % 60 for i in range(10) for _ in range(34)]), abs=1) and voice.jitter_pct >= 0


def test_sounds_across_borders(recordings):
    spans = [("a", 1, 0, 500), ("a", 2, 900, 3100), ("a", 3, 7000, 9000), ("b", 1, 1999, 2001), ("b", 2, 100, 100)]
    asked = recordings.sparkSession.createDataFrame(spans, "name string, id long, start_ms long, end_ms long")
    got = {(r.name, r.id): r.samples for r in C.sounds(C.cut(recordings, 1), asked, 1).collect()}
    assert set(got) == {s[:2] for s in spans[:4]}
    for name, i, a, b in spans[:4]:
        x, rate = whole(recordings, name)
        assert np.array_equal(np.asarray(got[name, i], np.float32), x[a * rate // 1000 : b * rate // 1000])
