"""Streams against batches: any cut into files, late rows, lost chunks, a failure and a restart."""

import random

import numpy as np
import pandas as pd
import pytest
from meetlake.operators.chunks import band
from meetlake.operators.sound import tempo
from meetlake.sources.shared import shared_dir
from meetlake.streaming import live, recording
from meetlake.streaming.recording import Limits, Recording
from pyspark.sql import functions as F

RATE = 2000
BEGAN = pd.Timestamp("2024-01-01")


def sound(meeting, seconds):
    """Bursts of noise, so that there are syllables to count."""
    rng = np.random.default_rng(meeting)
    t = np.arange(int(seconds * RATE)) / RATE
    return (rng.normal(size=len(t)) * 0.2 * np.sin(np.pi * (3 + meeting % 3) * t) ** 4).astype(np.float32)


def chunked(meeting, x, ms=250):
    size = RATE * ms // 1000
    return [(meeting, k, BEGAN + pd.Timedelta(milliseconds=1000 * (min(len(x), (k + 1) * size)) // RATE), RATE, x[k * size : (k + 1) * size].tolist()) for k in range(-(-len(x) // size))]


class Source:
    """A folder of files of chunks, and a stream over it that can be stopped and started again."""

    def __init__(self, spark, limits, late="2 seconds"):
        self.spark, self.own, self.limits, self.late = spark, live.on_disk(spark), limits, late
        self.path, self.at = shared_dir(spark, "chunks"), (shared_dir(spark, "rows"), shared_dir(spark, "log"))

    def add(self, rows):
        f = pd.DataFrame(rows, columns=["meeting_id", "seq", "at", "rate", "samples"])
        self.spark.createDataFrame(f, recording.CHUNKS).coalesce(1).write.mode("append").parquet(self.path)

    def run(self):
        stream = self.own.readStream.schema(recording.CHUNKS).parquet(self.path)
        return [r.asDict() for r in live.drained(recording.live(stream, self.limits, self.late), "live", "append", self.at).collect()]


def plain_ticks(x, limits):
    """(at_ms, frames, peaks) of every tick by filtering the whole recording at once."""
    rms, _ = band(RATE).frames(np.asarray(x, np.float64), np.zeros(4))
    out = []
    for n in range(limits.tick_ms // 10, len(rms) + 1, limits.tick_ms // 10):
        found = tempo(rms[max(0, n - limits.ring) : n]) or {}
        out.append((10 * n, min(n, limits.ring), found.get("peaks"), found.get("wpm")))
    return out


def ticks(rows, meeting):
    found = sorted((r for r in rows if r["meeting_id"] == meeting and r["kind"] == "tick"), key=lambda r: r["at_ms"])
    blank = lambda v: None if v is None or v != v else v
    return [(r["at_ms"], r["frames"], blank(r["peaks"]), blank(r["wpm"])) for r in found]


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == [w[3] if w[3] is None else pytest.approx(w[3]) for w in want]


def test_any_cut_of_samples_gives_the_same_ticks():
    x, limits = sound(1, 14).astype(np.float64), Limits(tick_ms=500)
    rng, own, at, rows = random.Random(1), Recording(limits), 0, []
    while at < len(x):
        n = rng.choice([1, 7, 20, 333, 5000])
        rows += own.take(x[at : at + n], RATE)
        own = Recording(limits, own.kept())  # as it comes back from the state
        at += n
    same(ticks([r | {"meeting_id": 1} for r in rows], 1), plain_ticks(x, limits))
    assert len(own.ring) == 1000


def test_batches_restart_and_late_chunks(spark):
    limits = Limits(tick_ms=1000, silence_ms=4000, longest_ms=12_000, patience=8)
    sounds = {1: sound(1, 15), 2: sound(2, 6), 3: sound(3, 11)}
    chunks = {m: chunked(m, x) for m, x in sounds.items()}
    source, rng, so_far = Source(spark, limits), random.Random(2), {m: 0 for m in chunks}
    for second in range(0, 16, 3):  # three seconds a batch, out of order within it; each batch is a restart from the checkpoint
        batch = [c for own in chunks.values() for c in own if second <= (c[2] - BEGAN).total_seconds() - 0.25 < second + 3]
        rng.shuffle(batch)
        if batch:
            source.add(batch + batch[:3])  # some chunks come twice
            rows = source.run()
        for m in chunks:
            so_far[m] = min(len(sounds[m]), (second + 3) * RATE)
            same(ticks(rows, m), plain_ticks(sounds[m][: min(so_far[m], 12 * RATE)], limits))
    stops = sorted((r["meeting_id"], r["reason"], r["at_ms"]) for r in rows if r["kind"] == "stop")
    assert stops == [(1, "longest", 12_000), (2, "silent", 6_000)]  # the third still runs
    source.add(chunked(9, sound(9, 40))[-1:])  # a later meeting moves the watermark on
    source.add([(1, 60, BEGAN + pd.Timedelta(seconds=39), RATE, [0.1] * 500)])  # the first goes on sending
    rows = source.run()
    stops = sorted((r["meeting_id"], r["reason"], r["at_ms"]) for r in rows if r["kind"] == "stop")
    assert stops[:3] == [(1, "longest", 12_000), (2, "silent", 6_000), (3, "silent", 11_000)]
    assert [s for s in stops if s[0] == 1] == [(1, "longest", 12_000)]


def test_a_failed_batch_is_run_again_with_the_same_result(spark):
    limits, x = Limits(tick_ms=500), sound(4, 5)
    source, chunks = Source(spark, limits), chunked(4, x)
    source.add(chunks[:10])
    source.run()
    source.add(chunks[10:])
    stream = source.own.readStream.schema(recording.CHUNKS).parquet(source.path)

    def broken(rows, batch):
        rows.collect()  # the state is worked out, then the sink fails
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        recording.live(stream, limits).writeStream.outputMode("append").option("checkpointLocation", source.at[1]).foreachBatch(broken).trigger(availableNow=True).start().awaitTermination()
    same(ticks(source.run(), 4), plain_ticks(x, limits))


def test_lost_and_late_chunks_are_silence(spark):
    limits, x = Limits(tick_ms=500, patience=4), sound(5, 8)
    chunks = chunked(5, x)
    source = Source(spark, limits)
    source.add([c for c in chunks if c[1] != 7])
    source.run()
    source.add([chunks[7]])  # too late: its place was passed
    rows = source.run()
    silent = x.copy()
    silent[7 * 500 : 8 * 500] = 0
    same(ticks(rows, 5), plain_ticks(silent, limits))
    assert [(r["at_ms"]) for r in rows if r["kind"] == "gap"] == [1750]


def events(spark, rows):
    f = pd.DataFrame([(u, BEGAN + pd.Timedelta(minutes=m), float(v)) for u, m, v in rows], columns=["user_id", "ts", "value"])
    return spark.createDataFrame(f, "user_id long, ts timestamp, value double")


def streamed(spark, batches, build, mode):
    path, at = shared_dir(spark, "events"), (shared_dir(spark, "out"), shared_dir(spark, "log"))
    for rows in batches:  # each batch is a start of the query from its checkpoint
        events(spark, rows).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("user_id long, ts timestamp, value double").parquet(path)
        out = live.drained(build(stream), "events", mode, at)
    return out.drop("run", "batch") if mode == "append" else out


def test_late_rows_merge_sessions(spark):
    batches = [[(1, 0, 1), (1, 50, 2), (2, 10, 1)], [(1, 25, 9), (2, 12, 5)], [(1, 300, 1), (2, 300, 7), (1, 290, 3)], [(1, 20, 100), (1, 310, 4)]]
    closed = streamed(spark, batches, lambda s: live.sessions(s, "user_id", late="1 hour"), "append")
    on_time = [r for b in batches for r in b if r != (1, 20, 100)]  # that one is behind the watermark
    whole = sorted(map(tuple, live.sessions(events(spark, on_time), "user_id").collect()))
    got = sorted(map(tuple, live.with_open(closed, events(spark, on_time), "user_id").collect()))
    assert got == whole and (1, 3) in {(r[0], r[3]) for r in got}  # 0, 25 and 50 are one session
    assert len(closed.collect()) == 2


def test_windows_with_late_rows_and_restarts(spark):
    batches = [[(1, 0, 1), (1, 20, 2)], [(1, 3, 8)], [(1, 200, 1)], [(1, 4, 99), (1, 201, 3)]]
    out = live.latest(streamed(spark, batches, lambda s: live.rates(s, "user_id", late="30 minutes"), "update"), ["user_id", "start"])
    on_time = events(spark, [r for b in batches for r in b if r != (1, 4, 99)])
    whole = on_time.groupBy("user_id", F.window("ts", "10 minutes", "5 minutes").alias("w")).agg(F.count(F.lit(1)), F.max("value")).select("user_id", "w.start", "count(1)", "max(value)")
    assert sorted(map(tuple, out.select("user_id", "start", "n", "level").collect())) == sorted(map(tuple, whole.collect()))
