"""Levels of sample arrays and of frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Frames:
    """The frames of a word, as expressions: how many there are, and what (t_ms, f0, db) the one at place k holds.

    Spark compiles expressions over a row for each place, as it does not the lambdas of arrays. `of` are the columns that they read;
    voiced, where a word tells it at once: the pitches of frames that have one, and the t_ms of the last of them.
    """

    count: Column
    at: Callable[[Column], dict[str, Column]]
    of: tuple[str, ...] = ("start_ms", "end_ms")
    voiced: tuple[Column, Column] | None = None

    def array(self) -> Column:
        one = lambda k: F.struct(*(v.alias(c) for c, v in self.at(k).items()))
        return F.when(self.count > 0, F.transform(F.sequence(F.lit(0), (self.count - 1).cast("int")), one)).otherwise(F.array())

    def each(self, words: DataFrame) -> DataFrame:
        """words with k, a row for each frame."""
        return words.where(self.count > 0).withColumn("k", F.explode(F.sequence(F.lit(0), (self.count - 1).cast("int"))))


def mean_square(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(samples)


def dbfs(samples: Column, floor: float = -120.0) -> Column:
    """Level of the root mean square in dB of full scale."""
    ms = mean_square(samples)
    return F.when(ms > 0, F.greatest(F.lit(floor), 10 * F.log10(ms))).otherwise(floor)


def peak_dbfs(samples: Column, floor: float = -120.0) -> Column:
    top = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    return F.when(top > 0, F.greatest(F.lit(floor), 20 * F.log10(top))).otherwise(floor)


def semitones(f0: Column, base: float = 100.0) -> Column:
    return 12 * F.log2(f0 / base)


def quantile(ordered: Column, share: float, of: Callable[[Column], Column] = lambda x: x) -> Column:
    """percentile() of an ascending array, between two values that `of` is taken of; null where it is empty."""
    place = (F.size(ordered) - 1) * F.lit(share)
    low, high = F.floor(place), F.ceil(place)
    a, b = (of(F.get(ordered, k.cast("int"))) for k in (low, high))
    return F.when(low == high, a).otherwise((high - place) * a + (place - low) * b)


def energy_mean(db: Column) -> Column:
    """Mean of levels by energy."""
    return 10 * F.log10(F.avg(F.pow(F.lit(10.0), db / 10)))


def pitch(frames: DataFrame, least: int = 10) -> DataFrame:
    """Median pitch and range (P90 - P10) in semitones of voiced frames."""
    st = semitones(F.col("f0"))
    out = frames.where("f0 > 0").groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n"), F.percentile("f0", 0.5).alias("pitch_median_hz"), (F.percentile(st, 0.9) - F.percentile(st, 0.1)).alias("r"))
    return out.select("meeting_id", "pitch_median_hz", F.when(F.col("n") >= least, F.col("r")).alias("pitch_range_st"))


def frame_p95(rows: DataFrame, key: str, samples: str, size: int) -> DataFrame:
    """key, p95_db: 95th percentile of the levels of a row's frames of `size` samples; the last may be shorter."""
    frames = F.transform(F.sequence(F.lit(0), F.floor((F.size(samples) - 1) / size).cast("int")), lambda k: F.slice(samples, k * size + 1, F.lit(size)))
    return rows.where(F.size(samples) > 0).select(key, F.explode(frames).alias("_f")).groupBy(key).agg(F.percentile(dbfs(F.col("_f")), 0.95).alias("p95_db"))


def downmix(samples: Column, channels: int) -> Column:
    """Mean of the channels of interleaved samples; a last incomplete group is dropped."""
    n = F.floor(F.size(samples) / channels).cast("int")
    one = lambda k: F.aggregate(F.slice(samples, k * channels + 1, F.lit(channels)), F.lit(0.0), lambda a, x: a + x.cast("double")) / channels
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<double>"))


def aligned(samples: Column, offset_ms: Column, rate: int, least_ms: int = 20, most_ms: int = 600_000) -> Column:
    """Samples after silence as long as the track began late; offsets out of (least, most] leave them as they are."""
    silence = F.array_repeat(F.lit(0.0), (offset_ms * rate / 1000).cast("int"))
    return F.when((offset_ms > least_ms) & (offset_ms <= most_ms), F.concat(silence, samples)).otherwise(samples)
