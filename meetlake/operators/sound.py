"""What recordings sound like: levels, spectra, pitch, the steadiness of the voice and the tempo of syllables.

Recordings come in chunks (`operators/chunks.py`); a task holds a chunk's samples, and what a whole recording has is an
aggregate over the rows of its chunks. Samples are between -1 and 1, one channel.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetlake.operators import chunks as C
from meetlake.operators import wav

RATE = C.RATE
SILENT_DB, SHORT_S = -55.0, 10.0
#: Lowest and highest pitch in Hz, and the step of frames in seconds.
PITCH, STEP_S = (60.0, 400.0), 0.01
#: Below this centre of its spectrum, in Hz, a sound is a hum.
HUM_HZ = 500.0
#: Seconds in which jitter is measured; the first part of a recording, and its least length, for their ratio.
VOICE_S, FIRST_S, LEAST_S = 30, 120, 240
#: Seconds of the longest cycle of voice.
LONGEST_S = 0.02
#: Frames on either side in which a peak of the envelope stands out, how far it does in dB, and frames between two peaks.
REACH, RISE_DB, APART = 50, 1.5, 6
#: Windows of an envelope that are worked out at once.
WINDOWS = 256
#: Frames that are correlated at once.
CORRELATED = 256


def db(rms: float | np.ndarray, floor: float = -120.0):
    return np.where(np.asarray(rms) > 10 ** (floor / 20), 20 * np.log10(np.maximum(rms, 1e-30)), floor)


def tenths(x: np.ndarray, rate: int) -> np.ndarray:
    """Levels in dB of whole tenths of a second; of all samples where there is none, and of none nothing."""
    size = rate // 10
    if len(x) < size:
        x = x[: len(x)].reshape(1, -1) if len(x) else np.empty((0, 1))
    else:
        x = x[: len(x) // size * size].reshape(-1, size)
    return db(np.sqrt((np.asarray(x, np.float64) ** 2).mean(1)))


def centroids(sounds: list[np.ndarray], rate: int = RATE, most: float = 4000.0) -> np.ndarray:
    """The centre in Hz of the amplitude spectrum up to `most` of each sound under a Hann window; 0 for silence and below 16 samples.

    Sounds of one length are one matrix: its spectra are weighted by their frequencies in one product.
    """
    out = np.zeros(len(sounds))
    length = np.array([len(x) for x in sounds], np.int64)
    for n in np.unique(length[length >= 16]).tolist():
        which = np.flatnonzero(length == n)
        hz = np.fft.rfftfreq(n, 1 / rate)
        band = hz <= most
        x = np.array([sounds[i] for i in which], np.float64)
        amplitude = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * np.hanning(n)))[:, band]
        total = amplitude.sum(1)
        out[which] = np.divide(amplitude @ hz[band], total, out=np.zeros(len(which)), where=total > 1e-9)
    return out


def pitch_size(rate: int) -> int:
    return int(3 * rate / PITCH[0])


@lru_cache(8)
def _lags(rate: int) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """Lowest and highest lag of a pitch, the length of transforms in which lags up to one more do not meet their mirror, the window and its own autocorrelation from one lag less."""
    size, low, high = pitch_size(rate), int(rate / PITCH[1]), int(rate / PITCH[0])
    plain = lambda n: n % 2 == 0 and 60 ** n.bit_length() % n == 0  # noqa: E731  a product of twos, threes and fives
    length = next(n for n in itertools.count(size + high + 1) if plain(n))
    window = np.hanning(size)
    own = np.fft.irfft(np.abs(np.fft.rfft(window, 2 * size)) ** 2)[: high + 2]
    return low, high, length, window, own[low - 1 :] / own[0]


def pitch_frames(x: np.ndarray, rate: int = RATE, count: int | None = None, voiced: float = 0.45, quiet: float = -60.0, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(f0, db) every ten milliseconds: f0 by the highest peak of the normalised autocorrelation, 0 where that is below `voiced`.

    Quiet frames have no pitch and are not correlated. count: of so many frames only; at: of the frames that begin at these samples.
    """
    size, step = pitch_size(rate), int(rate * STEP_S)
    n = max(0, (len(x) - size) // step + 1)
    n = n if count is None else min(n, count)
    starts = np.arange(n) * step if at is None else at
    n = len(starts)
    f0, level = np.zeros(n), np.full(n, -120.0)
    if not n:
        return f0, level
    low, high, length, window, own = _lags(rate)
    frames = np.lib.stride_tricks.sliding_window_view(x, size)
    for a in range(0, n, CORRELATED):
        y = frames[starts[a : a + CORRELATED]]
        y -= y.mean(1, keepdims=True)
        level[a : a + len(y)] = db(np.sqrt(np.einsum("ij,ij->i", y, y) / size))
        loud = np.flatnonzero(level[a : a + len(y)] > quiet)
        if not len(loud):
            continue
        y = y if len(loud) == len(y) else y[loud]
        y *= window
        spectrum = np.fft.rfft(y, length)
        power = spectrum.real**2
        power += spectrum.imag**2
        # from the lag before the lowest to the one behind the highest
        r = np.fft.irfft(power, length)[:, low - 1 : high + 2] / (np.maximum(np.einsum("ij,ij->i", y, y), 1e-12)[:, None] * own)
        # the earliest lag that is nearly as high as any: octaves below have peaks too
        part = r[:, 1:-1]
        peak = (part >= np.maximum(r[:, :-2], r[:, 2:])) & (part >= 0.9 * part.max(1, keepdims=True))
        best = peak.argmax(1) + 1
        row = np.arange(len(loud))
        left, mid, right = r[row, best - 1], r[row, best], r[row, best + 1]
        bend = left - 2 * mid + right
        shift = np.divide(0.5 * (left - right), bend, out=np.zeros(len(loud)), where=np.abs(bend) > 1e-12)
        f0[a + loud] = np.where(mid >= voiced, rate / (low - 1 + best + np.clip(shift, -0.5, 0.5)), 0)
    return f0, level


def pitches(chunks: DataFrame) -> DataFrame:
    """name, k, f0, db every ten milliseconds, those across the border of two chunks too."""

    def one(c):
        step = c.rate * 10 // 1000
        k = -(-c.first // step)
        count = min(-(-(c.first + len(c.samples)) // step), (c.n - pitch_size(c.rate)) // step + 1) - k
        if count > 0:
            x = np.concatenate((np.asarray(c.samples, np.float64), np.asarray(c.right, np.float64)))
            f0, level = pitch_frames(x[k * step - c.first :], c.rate, count)
            yield from zip([c.name] * len(f0), range(k, k + len(f0)), f0.tolist(), level.tolist(), strict=True)

    near = C.bordered(chunks, 0, F.ceil(3 * F.col("rate") / PITCH[0]).cast("int"))
    return C.each(near, "name string, k long, f0 double, db double", one)


def cycles(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths in seconds and peak amplitudes of the cycles of voice: from one upward crossing of zero to the next, after a low-pass."""
    width = max(1, int(rate / PITCH[1] / 2))
    smooth = np.convolve(x, np.ones(width) / width, "same")
    up = np.flatnonzero((smooth[:-1] < 0) & (smooth[1:] >= 0))
    at = up + smooth[up] / (smooth[up] - smooth[up + 1])
    tops = np.maximum.reduceat(np.abs(x), up)[:-1] if len(up) > 1 else np.empty(0)
    return np.diff(at) / rate, tops


def without_rests(x: np.ndarray, most: int) -> np.ndarray:
    """x with `most` zeros left of a longer stretch of zeros on either side of what sounds."""
    at = np.flatnonzero(x)
    if not len(at):
        return x[:0]
    cut = np.flatnonzero(np.diff(at) > 2 * most + 1)
    starts, ends = np.concatenate((at[:1], at[cut + 1])), np.concatenate((at[cut], at[-1:]))
    return np.concatenate([x[max(a - most, 0) : b + most + 1] for a, b in zip(starts, ends, strict=True)])


def unsteadiness(x: np.ndarray, rate: int = RATE, jump: float = 1.3, amplitude_jump: float = 1.6) -> tuple[float | None, float | None]:
    """(jitter, shimmer): the mean change from a cycle to the next in percent of the mean, of lengths and of amplitudes.

    Cycles out of bounds and jumps are left out; null below half a second and without two cycles side by side. Silence that
    outlasts the longest cycle is cut short before: no cycle across it counts.
    """
    if len(x) < rate // 2:
        return None, None
    x = without_rests(np.asarray(x, np.float64), int(LONGEST_S * rate) + rate // 100)
    if not len(x):
        return None, None
    length, top = cycles(x, rate)
    fits = (length >= 1e-4) & (length <= LONGEST_S)

    def change(values: np.ndarray, most: float, ok: np.ndarray) -> float | None:
        a, b = values[:-1], values[1:]
        ok = ok & (np.maximum(a, b) <= most * np.minimum(a, b))
        return float(100 * np.abs(b - a)[ok].mean() / values[fits].mean()) if ok.any() else None

    beside = fits[:-1] & fits[1:]
    near = beside & (np.maximum(length[:-1], length[1:]) <= jump * np.minimum(length[:-1], length[1:]))
    return change(length, jump, beside), change(top, amplitude_jump, near & (top[:-1] > 0) & (top[1:] > 0))


VOICES = "name string, jitter_pct double, shimmer_pct double, start_jitter_ratio double"


def voices(chunks: DataFrame, samples: Callable = lambda c: c.samples) -> DataFrame:
    """VOICES of recordings that are all speech: each chunk's unsteadiness is a row, weighted by its samples.

    The ratio is that of the jitter in the first two minutes to that of the rest; null below four minutes. Chunks are of
    VOICE_S seconds, so that two minutes end with one. samples: how those of a row are come by.
    """

    def one(c):
        x = samples(c)
        yield c.name, c.first, c.n, c.rate, len(x), *unsteadiness(x, c.rate)

    rows = C.each(chunks, "name string, first long, n long, rate int, weight long, jitter double, shimmer double", one)
    mean = lambda value, where: F.try_divide(F.sum(F.when(where, F.col("weight") * F.col(value))), F.sum(F.when(where & F.col(value).isNotNull(), F.col("weight"))))
    start, every = F.col("first") < FIRST_S * F.col("rate"), F.lit(True)
    ratio = F.when(F.max("n") >= LEAST_S * F.max("rate"), F.try_divide(mean("jitter", start), mean("jitter", ~start)))
    return rows.groupBy("name").agg(mean("jitter", every).alias("jitter_pct"), mean("shimmer", every).alias("shimmer_pct"), ratio.alias("start_jitter_ratio"))


def labels(sounds: DataFrame) -> DataFrame:
    """sounds (keys, rate, samples) with centroid_hz and label: a hum ("mm") or a vowel ("er")."""
    keys = [c for c in sounds.columns if c not in ("rate", "samples")]

    def run(frames):
        for f in frames:
            hz = np.zeros(len(f))
            for rate in f["rate"].unique():
                which = np.flatnonzero(f["rate"] == rate)
                hz[which] = centroids([f["samples"].iloc[i] for i in which], int(rate))
            yield f[keys].assign(centroid_hz=hz, label=np.where(hz < HUM_HZ, "mm", "er"))

    kinds = dict(sounds.dtypes)
    return sounds.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "centroid_hz double", "label string"]))


def stand_out(level: np.ndarray, at: np.ndarray, reach: int = REACH) -> np.ndarray:
    """How far the peaks at `at` rise over the higher of the lows on their two sides; a side ends before the first higher frame."""
    return rises(np.concatenate((np.full(reach, np.inf), level, np.full(reach, np.inf))), at + reach, reach)


def rises(padded: np.ndarray, at: np.ndarray, reach: int = REACH) -> np.ndarray:
    """stand_out() of frames that have so many others on either side; past an end the level is infinite."""
    top = padded[at][:, None]
    lows = []
    for step in (-1, 1):
        side = padded[at[:, None] + step * np.arange(1, reach + 1)]
        within = np.logical_and.accumulate(side <= top, axis=1)
        lows.append(np.where(within, side, top).min(1))
    return padded[at] - np.maximum(*lows)


def apart(height: np.ndarray, at: np.ndarray, least: int = APART) -> np.ndarray:
    """Of peaks closer than `least` frames the higher, then the earlier: rounds of all that beat every rival, which then go."""
    kept = np.empty(0, np.int64)
    while len(at):
        order = np.lexsort((at, -height))
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at))
        low, high = np.searchsorted(at, at - least + 1), np.searchsorted(at, at + least)
        wins = np.array([rank[a:b].min() for a, b in zip(low, high, strict=True)]) == rank
        kept = np.sort(np.concatenate((kept, at[wins])))
        place = np.searchsorted(kept, at)
        gap = np.minimum(np.abs(at - kept[np.minimum(place, len(kept) - 1)]), np.abs(at - kept[np.maximum(place - 1, 0)]))
        height, at = height[gap >= least], at[gap >= least]
    return kept


def tempo(rms: np.ndarray, frame_ms: int = 10) -> dict[str, float] | None:
    """Syllables a second, seconds of speech and peaks of an envelope; null with less than two seconds of speech.

    The envelope in dB is smoothed over three frames. Frames above the threshold are active, frames within 200 ms of one
    are speech; peaks among active frames stand out by 1.5 dB and are 60 ms apart.
    """
    n = len(rms)
    if n < 6:
        return None
    ones = np.ones(3)
    level = np.convolve(20 * np.log10(np.maximum(rms, 1e-6)), ones, "same") / np.convolve(np.ones(n), ones, "same")
    middle, top = np.partition(level, n // 2)[n // 2], level.max()
    active = level > max(min(middle + 6, top - 12), -75)
    speech_s = np.count_nonzero(np.convolve(active, np.ones(41), "same") > 0.5) * frame_ms / 1000
    if speech_s < 2:
        return None
    at = 1 + np.flatnonzero(active[1:-1] & (level[1:-1] > level[:-2]) & (level[1:-1] >= level[2:]))
    at = at[stand_out(level, at) >= RISE_DB] if len(at) else at
    return spoken_at(len(apart(level[at], at)), speech_s)


def spoken_at(peaks: int, speech_s: float) -> dict[str, float]:
    return {"per_s": peaks / speech_s, "speech_s": float(speech_s), "peaks": peaks, "wpm": peaks / speech_s / 0.67 * 60 / 2.7}


def rolling_tempo(rms: np.ndarray, ends: np.ndarray, last: int) -> list[dict[str, float] | None]:
    """tempo() of the last frames, `last` at most, before each of the ascending `ends`, frame by frame the same.

    Windows that overlap share their smoothed envelope and how far its peaks stand out; only what is near an end of a window
    is its own.
    """
    n = last if last > 2 * REACH + 4 else len(rms) + 1
    short = int(np.searchsorted(ends, n))
    out = [tempo(rms[max(0, e - last) : e]) for e in ends[:short].tolist()]
    if short == len(ends):
        return out
    raw, place = 20 * np.log10(np.maximum(rms, 1e-6)), np.arange(n)
    smooth = np.convolve(raw, np.ones(3), "same") / 3
    for a in range(short, len(ends), WINDOWS):
        starts = ends[a : a + WINDOWS] - n
        padded = np.full((len(starts), n + 2 * REACH), np.inf)
        level = padded[:, REACH:-REACH]
        level[:] = np.lib.stride_tricks.sliding_window_view(smooth, n)[starts]
        level[:, 0], level[:, -1] = (raw[starts] + raw[starts + 1]) / 2, (raw[starts + n - 2] + raw[starts + n - 1]) / 2
        middle, top = np.partition(level, n // 2, axis=1)[:, n // 2], level.max(1)
        active = level > np.maximum(np.minimum(middle + 6, top - 12), -75)[:, None]
        before = np.zeros((len(starts), n + 1), np.int32)
        np.cumsum(active, axis=1, out=before[:, 1:])
        speech_s = np.count_nonzero(before[:, np.minimum(place + 21, n)] > before[:, np.maximum(place - 20, 0)], axis=1) * 10 / 1000
        row, at = np.nonzero(active[:, 1:-1] & (level[:, 1:-1] > level[:, :-2]) & (level[:, 1:-1] >= level[:, 2:]))
        at += 1
        inner, rise = (at > REACH) & (at < n - REACH - 1), np.empty(len(at))
        shared, which = np.unique(starts[row[inner]] + at[inner], return_inverse=True)
        rise[inner] = rises(smooth, shared)[which]
        rise[~inner] = rises(padded.ravel(), (row * padded.shape[1] + at + REACH)[~inner])
        row, at = row[rise >= RISE_DB], at[rise >= RISE_DB]
        peaks = np.bincount(row, minlength=len(starts))
        for k in np.unique(row[1:][(np.diff(row) == 0) & (np.diff(at) < APART)]).tolist():
            own = at[row == k]
            peaks[k] = len(apart(level[k, own], own))
        out += [spoken_at(p, s) if s >= 2 else None for p, s in zip(peaks.tolist(), speech_s.tolist(), strict=True)]
    return out


TEMPO = "name string, peaks int, speech_s double, wpm double"


def tempos(envelopes: DataFrame, last: int = 1000) -> DataFrame:
    """TEMPO of the last ten seconds of each recording's envelope (name, k, rms); null where there is too little speech."""
    top = envelopes.groupBy("name").agg(F.max("k").alias("top"))
    frames = envelopes.join(top, "name").where(F.col("k") > F.col("top") - last)
    rows = frames.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "rms"))), lambda x: x["rms"]).alias("rms"))

    def run(frames):
        for f in frames:
            found = [tempo(np.asarray(x)) or {} for x in f["rms"]]
            yield pd.DataFrame({"name": f["name"], "peaks": pd.array([t.get("peaks") for t in found], "Int32"), "speech_s": [t.get("speech_s") for t in found], "wpm": [t.get("wpm") for t in found]})

    return rows.mapInPandas(run, TEMPO)


def meters(chunks: DataFrame, floor: float = -60.0) -> DataFrame:
    """name, k, db: the level of each tenth of a second, as a meter shows it. Chunks are of whole seconds."""

    def one(c):
        first = c.first * 10 // c.rate
        yield from ((c.name, first + i, max(floor, float(v))) for i, v in enumerate(tenths(c.samples, c.rate)))

    return C.each(chunks, "name string, k long, db double", one)


def tracks(chunks: DataFrame) -> DataFrame:
    """name, channels, duration_s, peak_db, rms_db, loud_db (95th percentile of tenths of a second), silent, short of each recording."""

    def one(c):
        x = np.asarray(c.samples, np.float64)
        yield c.name, c.channels, c.rate, c.n, float(np.abs(x).max(initial=0)), float((x**2).sum()), tenths(x, c.rate).tolist()

    rows = C.each(chunks, "name string, channels int, rate int, n long, peak double, squares double, levels array<double>", one)
    level = lambda v: F.when(v > 1e-6, 20 * F.log10(v)).otherwise(-120.0)
    whole = rows.groupBy("name").agg(
        F.max("channels").alias("channels"),
        (F.max("n") / F.max("rate")).alias("duration_s"),
        level(F.max("peak")).alias("peak_db"),
        level(F.sqrt(F.coalesce(F.try_divide(F.sum("squares"), F.max("n")), F.lit(0.0)))).alias("rms_db"),
    )
    loud = rows.select("name", F.explode("levels").alias("level")).groupBy("name").agg(F.percentile("level", 0.95).alias("loud_db"))
    out = whole.join(loud, "name", "left")
    return out.withColumns({"silent": F.coalesce(F.col("loud_db") < SILENT_DB, F.lit(True)), "short": F.col("duration_s") < SHORT_S})


def scan(recordings: DataFrame) -> DataFrame:
    """Every recording (name, content): its rate, what tracks() says of it at RATE, and what is wrong with it; a faulty file has a fault and nulls."""
    pieces = C.cut(recordings)
    rates = pieces.where("part = 0").select("name", "rate")
    known = tracks(C.resampled(pieces)).join(rates, "name")
    return C.faults(recordings).join(known, "name", "left")


def converted(recordings: DataFrame) -> DataFrame:
    """name, content: each readable recording as a WAV file of RATE, 16 bits, one channel."""

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("part")
        return pd.DataFrame({"name": f["name"][:1], "content": [wav.written(np.concatenate([np.asarray(x, np.float64) for x in f["samples"]]), RATE)]})

    return C.resampled(C.cut(recordings)).select("name", "part", "samples").groupBy("name").applyInPandas(whole, "name string, content binary")
