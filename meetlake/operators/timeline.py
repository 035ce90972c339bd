"""Sliding windows over a meeting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meetlake.functions import constants as C
from meetlake.operators import spans as S

SIZE, STEP = 15_000, 5_000


def durations(words: DataFrame) -> DataFrame:
    return words.groupBy("meeting_id").agg(F.max("end_ms").alias("duration_ms"))


def windows(durations: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """meeting_id, a, b: whole windows from 0 on; a shorter meeting has one window, an empty one none."""
    starts = F.when(F.col("duration_ms") >= size, F.sequence(F.lit(0).cast("long"), F.greatest(F.col("duration_ms") - size, F.lit(0)), F.lit(step).cast("long"))).when(F.col("duration_ms") > 0, F.array(F.lit(0).cast("long")))
    return durations.select("meeting_id", "duration_ms", F.explode(starts).alias("a")).select("meeting_id", "a", F.least(F.col("a") + size, "duration_ms").alias("b"))


def window_words(words: DataFrame, wins: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """wins with n_words: own words that begin in them. A word is dealt to its windows, then counted by window."""
    own = words.where("track = 'mic' AND kind <> 'filler'")
    k = F.explode(F.sequence(F.greatest(F.floor((F.col("start_ms") - size) / step) + 1, F.lit(0)), F.floor(F.col("start_ms") / step)))
    n = own.select("meeting_id", "start_ms", k.alias("k")).select("meeting_id", (F.col("k") * step).alias("a")).groupBy("meeting_id", "a").agg(F.count(F.lit(1)).alias("n_words"))
    return wins.join(n, ["meeting_id", "a"], "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)))


def timeline(words: DataFrame, speech: DataFrame) -> DataFrame:
    """meeting_id, a, b, n_words, speech_ms, my_ms, wpm, articulation of each window."""
    counted = window_words(words, windows(durations(words)))
    wins = counted.withColumn("start_ms", F.col("a")).withColumn("end_ms", F.col("b"))
    mic = speech.where("track = 'mic'").drop("track")
    wins = S.overlap_sums(wins, mic, ["meeting_id"], ["meeting_id", "a"], "speech_ms")
    wins = S.overlap_sums(wins, S.remaining(speech, F.col("track") == "system", ["meeting_id"]), ["meeting_id"], ["meeting_id", "a"], "other_ms")
    my = F.col("b") - F.col("a") - F.col("other_ms")
    rate = lambda ms: F.when((F.col("speech_ms") > 0) & (ms > 0), F.col("n_words") * 60000.0 / ms).otherwise(0.0)
    return wins.select("meeting_id", "a", "b", "n_words", "speech_ms", my.alias("my_ms"), rate(my).alias("wpm"), rate(F.col("speech_ms")).alias("articulation"))


def medians(points: DataFrame, least: int = 5) -> DataFrame:
    own = F.when(F.col("n_words") >= least, F.col("wpm"))
    spoken = F.when((F.col("n_words") >= least) & (F.col("speech_ms") > 0), F.col("articulation"))
    return points.groupBy("meeting_id").agg(F.percentile(own, 0.5).alias("wpm"), F.percentile(spoken, 0.5).alias("articulation_wpm"))


def bursts(points: DataFrame, factor: float = 1.2, least: int = 5, usual: float = 130.0) -> DataFrame:
    """Windows (with type) of enough words that are faster than their type's upper bound by the factor."""
    refs = points.sparkSession.createDataFrame([(t, h) for t, m, _, h, _ in C.TYPE_RANGES if m == "wpm"], "type string, high double")
    own = points.join(F.broadcast(refs), "type", "left")
    return own.where((F.col("n_words") >= least) & (F.col("wpm") > factor * F.coalesce("high", F.lit(usual)))).drop("high")


def by_minute(events: DataFrame, durations: DataFrame) -> DataFrame:
    """Events of each minute, empty minutes too; what lies beyond the last counts in it."""
    last = F.greatest(F.ceil(F.col("duration_ms") / 60000) - 1, F.lit(0))
    minutes = durations.withColumn("last", last).withColumn("minute", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    own = events.join(durations.withColumn("last", last).select("meeting_id", "last"), "meeting_id").groupBy("meeting_id", F.least(F.floor(F.col("start_ms") / 60000), "last").alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return minutes.select("meeting_id", "minute").join(own, ["meeting_id", "minute"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def runs(points: DataFrame, step: int = STEP) -> DataFrame:
    """Runs of windows that follow each other at the step: start_ms, end_ms, n_windows."""
    place = F.row_number().over(Window.partitionBy("meeting_id").orderBy("a"))
    marked = points.withColumn("_run", F.floor(F.col("a") / step) - place)
    return marked.groupBy("meeting_id", "_run").agg(F.min("a").alias("start_ms"), F.max("b").alias("end_ms"), F.count(F.lit(1)).alias("n_windows")).drop("_run")
