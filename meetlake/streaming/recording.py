"""A recording while it runs: ticks with the level and the tempo of the last ten seconds, and the end of the recording.

Chunks of samples arrive as a stream of (meeting_id, seq, at, rate, samples), in any order and any cut into batches. Each
meeting has a state that is kept by Spark on disk: the states of its filters, the samples of an unfinished frame, a ring of the
last thousand frames, and chunks that came before their turn. It is as large after an hour as after ten seconds.

A chunk that is missing while `patience` later ones wait, or when its meeting ends, was lost: it counts as silence as long as the
chunk after it and gives a row of kind "gap". Chunks that came twice, or after their place was passed, are left out, as are
those of a meeting that has ended. A meeting ends once: when it is as long as it may be ("longest"), or when its source has
sent nothing for `silence_ms` of event time ("silent", by a timer of the state). An ended meeting is forgotten when its
source has been silent for `forget_ms`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from meetlake.operators.chunks import FRAME_MS, band
from meetlake.operators.sound import db, rolling_tempo

CHUNKS = "meeting_id long, seq long, at timestamp, rate int, samples array<float>"
ROWS = "meeting_id long, kind string, at_ms long, level_db double, frames int, peaks int, speech_s double, wpm double, reason string"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
#: Samples of chunks in their turn that are taken together, at most.
TOGETHER = 1 << 17


@dataclass(frozen=True)
class Limits:
    tick_ms: int = 250
    ring: int = 1000  #: frames of the last ten seconds
    patience: int = 40
    silence_ms: int = 5_000
    longest_ms: int | None = None
    forget_ms: int = 3_600_000
    floor_db: float = -60.0


#: Arrays of numbers are kept as bytes: eight for each.
STATE = "seq long, rate int, done long, squares double, band binary, rest binary, ring binary, last long, ended boolean"


class Recording:
    """What is known of a running recording; samples go in, rows come out."""

    def __init__(self, limits: Limits, kept: tuple | None = None):
        self.limits = limits
        seq, rate, done, squares, state, rest, ring, last, ended = kept or (0, 0, 0, 0.0, bytes(32), b"", b"", 0, False)
        self.seq, self.rate, self.done, self.squares, self.last, self.ended = seq, rate, done, squares, last, ended
        self.state, self.rest, self.ring = (np.frombuffer(bytes(x), np.float64) for x in (state, rest, ring))

    def kept(self) -> tuple:
        return self.seq, self.rate, self.done, float(self.squares), *(np.ascontiguousarray(x, np.float64).tobytes() for x in (self.state, self.rest, self.ring)), self.last, self.ended

    def row(self, kind: str, **more) -> dict:
        return dict.fromkeys(NAMES) | {"kind": kind, "at_ms": self.done * FRAME_MS} | more

    def end(self, reason: str) -> dict:
        self.ended, self.rest, self.ring = True, np.empty(0), np.empty(0)
        return self.row("stop", reason=reason)

    def take(self, samples: np.ndarray, rate: int, count: int = 1) -> list[dict]:
        """The rows that the samples of the next `count` chunks give: a tick for each `tick_ms` that is full, and the end."""
        limits, self.rate, self.seq = self.limits, rate, self.seq + count
        filters, x = band(rate), np.concatenate((self.rest, samples))
        tick, frames = limits.tick_ms // FRAME_MS, len(x) // filters.size
        if limits.longest_ms is not None:
            frames = min(frames, max(-(-limits.longest_ms // FRAME_MS) - self.done, 0))
        part, self.rest = x[: frames * filters.size], x[frames * filters.size :]
        rms, self.state = filters.frames(part, self.state)
        # the ticks that become full, and the squares that each of them and the unfinished one behind them got
        ends = np.arange(tick - self.done % tick, frames + 1, tick)
        own = part.reshape(-1, filters.size)
        squares = np.diff(np.concatenate((np.zeros(1), np.cumsum(np.einsum("ij,ij->i", own, own))))[np.concatenate(([0], ends, [frames]))])
        squares[0] += self.squares
        self.squares = float(squares[-1])
        level = np.maximum(limits.floor_db, db(np.sqrt(squares[:-1] / (tick * filters.size))))
        heard = np.concatenate((self.ring, rms))
        behind = ends + len(self.ring)
        rows = []
        for at, v, end, found in zip((self.done + ends).tolist(), level.tolist(), behind.tolist(), rolling_tempo(heard, behind, limits.ring), strict=True):
            rows.append(self.row("tick", level_db=v, frames=min(end, limits.ring), **{k: v for k, v in (found or {}).items() if k in NAMES}) | {"at_ms": at * FRAME_MS})
        self.ring, self.done = heard[-limits.ring :], self.done + frames
        if limits.longest_ms is not None and self.done * FRAME_MS >= limits.longest_ms:
            rows.append(self.end("longest"))
        return rows


class Recorder(StatefulProcessor):
    """The state of each meeting: its Recording, and the chunks that wait for their turn."""

    def __init__(self, limits: Limits, samples: Callable = lambda c: c.samples):
        self.limits, self.samples = limits, samples

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("recording", STATE)
        self.waiting = handle.getMapState("waiting", "seq long", "rate int, samples binary")

    def handleInputRows(self, key, rows, timerValues):
        known = self.kept.exists()
        own = Recording(self.limits, self.kept.get() if known else None)
        for f in rows:
            out, turn, held = [], [], 0
            own.last = max(own.last, int(f["at"].max().timestamp() * 1000))
            for c in f.sort_values("seq", kind="stable").itertuples(index=False):
                if own.ended or c.seq < own.seq + len(turn):
                    continue
                x = np.asarray(self.samples(c), np.float32)
                if c.seq > own.seq + len(turn):
                    self.waiting.updateValue((int(c.seq),), (int(c.rate), x.tobytes()))
                    continue
                # its turn: it need not wait
                if turn and (c.rate != rate or held + len(x) > TOGETHER):
                    out += own.take(np.concatenate(turn, dtype=np.float64), rate, len(turn))
                    turn, held = [], 0
                rate = int(c.rate)
                turn.append(x)
                held += len(x)
            if turn and not own.ended:
                out += own.take(np.concatenate(turn, dtype=np.float64), rate, len(turn))
            if out:
                yield self.frame(key, out)
        yield from self.drain(key, own, self.limits.patience)
        self.watch(own, known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.kept.exists():
            return
        own = Recording(self.limits, self.kept.get())
        if own.ended:
            self.kept.clear()
            return
        yield from self.drain(key, own, 0)
        if not own.ended:
            yield self.frame(key, [own.end("silent")])
        self.watch(own)

    def drain(self, key, own: Recording, patience: int):
        """Rows of the chunks whose turn it is, one chunk in memory at a time."""
        left = sorted(s for (s,) in self.waiting.keys()) if self.waiting.exists() else []
        while left and not own.ended:
            rows, seq = [], left[0]
            if seq > own.seq and len(left) <= patience:
                break
            rate, samples = self.waiting.getValue((seq,))
            x = np.frombuffer(bytes(samples), np.float32).astype(np.float64)
            if seq > own.seq:
                rows.append(own.row("gap"))
                rows += own.take(np.zeros(len(x)), rate)
            else:
                self.waiting.removeKey((left.pop(0),))
                if seq == own.seq:
                    rows += own.take(x, rate)
            if rows:
                yield self.frame(key, rows)
        if own.ended and left:
            self.waiting.clear()

    def watch(self, own: Recording, known: bool = True) -> None:
        """Keep the state and set its timer anew; a meeting that was not known has none."""
        for t in list(self.handle.listTimers()) if known else ():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(own.last + (self.limits.forget_ms if own.ended else self.limits.silence_ms))
        self.kept.update(own.kept())

    @staticmethod
    def frame(key, rows: list[dict]) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=NAMES)
        f["meeting_id"] = key[0]
        return f.astype({"frames": "Int32", "peaks": "Int32", "at_ms": "int64", "level_db": float, "speech_s": float, "wpm": float})

    def close(self) -> None:
        pass


def live(chunks: DataFrame, limits: Limits = Limits(), late: str = "2 seconds", samples: Callable = lambda c: c.samples) -> DataFrame:
    """ROWS of a stream of CHUNKS, in append mode; chunks later than the watermark count as lost. samples: how those of a row are come by."""
    stream = chunks.withWatermark("at", late).groupBy("meeting_id")
    return stream.transformWithStateInPandas(Recorder(limits, samples), ROWS, "Append", "EventTime")


def cut(recorded: DataFrame, began: str = "2024-01-01 00:00:00") -> DataFrame:
    """CHUNKS of recordings in chunks (`operators/chunks.py`) named by meeting, or what their samples are made of instead of these: a chunk arrives when its last sample is recorded."""
    made = [c for c in recorded.columns if c not in ("name", "part", "parts", "channels", "meeting_id", "rate", "samples")]
    size, rest = (F.size("samples"), ["samples"]) if "samples" in recorded.columns else (F.col("size"), made)
    end = F.unix_millis(F.lit(began).cast("timestamp")) + F.floor(1000 * (F.col("first") + size) / F.col("rate"))
    return recorded.select(F.col("name").cast("long").alias("meeting_id"), F.col("part").cast("long").alias("seq"), F.timestamp_millis(end.cast("long")).alias("at"), "rate", *rest)
