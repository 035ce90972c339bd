"""Metrics of a meeting, judged, scored and compared."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meetlake.functions import constants as C
from meetlake.functions import scoring as J
from meetlake.operators import spans as S


def metrics(words: DataFrame, sentences: DataFrame, speech: DataFrame, counts: DataFrame, medians: DataFrame, meetings: DataFrame, voice: DataFrame, diversity: DataFrame) -> DataFrame:
    """A row of metrics for each meeting; null where the owner said nothing. counts: meeting_id, kind, n; voice, diversity: a row for each meeting with speech."""
    per = counts.groupBy("meeting_id").pivot("kind", ["filler", "crutch", "structural_pause", "hesitation_pause", "by_me", "by_other"]).agg(F.sum("n"))
    talk = S.total(speech, ["meeting_id", "track"]).groupBy("meeting_id").pivot("track", ["mic", "system"]).agg(F.sum("total_ms"))
    own = sentences.where("track = 'mic' AND n_words > 0").groupBy("meeting_id").agg(F.avg("n_words").alias("mean_sentence_len"), F.avg((F.col("n_words") > 22).cast("double")).alias("long_sentences_share"))
    n = words.where("track = 'mic' AND kind <> 'filler'").groupBy("meeting_id").agg(F.count(F.lit(1)).alias("words_total"))
    wide = meetings.join(n, "meeting_id", "left").join(talk, "meeting_id", "left").join(per, "meeting_id", "left").join(own, "meeting_id", "left").join(medians, "meeting_id", "left").join(voice, "meeting_id", "left").join(diversity, "meeting_id", "left")
    spoke = F.col("words_total") > 0
    rate = lambda c: F.when(spoke & (F.col("mic") > 0), F.coalesce(c, F.lit(0)) * 60000.0 / F.col("mic"))
    plain = F.when((F.col("words_total") >= 5) & (F.col("mic") > 0), F.col("words_total") * 60000.0 / F.col("mic"))
    count = lambda c: F.when(spoke & F.col("has_system"), F.coalesce(F.col(c), F.lit(0)).cast("double"))
    return wide.select(
        "meeting_id", "type", "speaker", F.coalesce("words_total", F.lit(0)).alias("words_total"), F.coalesce("mic", F.lit(0)).alias("my_speech_ms"),
        F.when(spoke, F.coalesce("wpm", plain)).alias("wpm"), F.when(spoke, F.coalesce("articulation_wpm", plain)).alias("articulation_wpm"),
        rate("filler").alias("filled_pauses_per_min"), rate("crutch").alias("crutch_words_per_min"), rate("structural_pause").alias("structural_pauses_per_min"), rate("hesitation_pause").alias("hesitation_pauses_per_min"),
        F.when(spoke & F.col("has_system"), F.coalesce("mic", F.lit(0)) / (F.coalesce("mic", F.lit(0)) + F.coalesce("system", F.lit(0)))).alias("talk_ratio"),
        F.when(spoke, F.col("mean_sentence_len")).alias("mean_sentence_len"), F.when(spoke, F.col("long_sentences_share")).alias("long_sentences_share"),
        count("by_me").alias("interruptions_by_me"), count("by_other").alias("interruptions_by_other"),
        F.when(spoke, F.col("mtld")).alias("mtld"), *C.VOICE,
    )


def long_form(wide: DataFrame, names: list[str] = C.METRICS) -> DataFrame:
    return wide.unpivot(["meeting_id", "type", "speaker"], names, "metric", "value")


def judged(metrics: DataFrame) -> DataFrame:
    """metrics (type, metric, value) with ref_low, ref_high, better, status; a type's row replaces the default as a whole."""
    spark = metrics.sparkSession
    own = spark.createDataFrame(C.TYPE_RANGES, "type string, metric string, o_low double, o_high double, o_better string")
    base = spark.createDataFrame(C.RANGES, "metric string, d_low double, d_high double, d_better string")
    both = metrics.join(F.broadcast(own), ["type", "metric"], "left").join(F.broadcast(base), "metric", "left")
    pick = lambda c: F.when(F.col("o_better").isNotNull(), F.col(f"o_{c}")).otherwise(F.col(f"d_{c}"))
    both = both.select(*metrics.columns, pick("low").alias("ref_low"), pick("high").alias("ref_high"), F.coalesce(pick("better"), F.lit("inside")).alias("better"))
    return both.withColumn("status", J.status())


def components(judged: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """weight and penalty of each scored metric: weights rescaled to 100 over those with a value. baseline: speaker, metric, mean, std."""
    weights = judged.sparkSession.createDataFrame(C.WEIGHTS, "metric string, w double")
    rows = judged.join(F.broadcast(weights), "metric").withColumn("p", J.penalty())
    if baseline is not None:
        rows = rows.join(baseline.select("speaker", "metric", "mean", "std"), ["speaker", "metric"], "left")
        z = J.bad_side_z(F.col("value"), F.col("mean"), F.col("std"), F.col("better"), F.col("ref_low"), F.col("ref_high"))
        rows = rows.withColumn("p", F.when(F.col("mean").isNotNull(), 0.5 * F.col("p") + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), z / 2))).otherwise(F.col("p")))
    active = F.sum(F.when(F.col("p").isNotNull(), F.col("w"))).over(Window.partitionBy("meeting_id"))
    weight = F.when(F.col("p").isNull(), 0.0).otherwise(F.round(F.col("w") * 100 / active, 2))
    return rows.select("meeting_id", "metric", weight.alias("weight"), F.coalesce(F.round("p", 4), F.lit(0.0)).alias("penalty"))


def overall(components: DataFrame) -> DataFrame:
    s = components.groupBy("meeting_id").agg(F.sum(F.col("weight") * F.col("penalty")).alias("lost"), F.sum("weight").alias("w"))
    score = F.when(F.col("w") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.rint(F.round(100 - F.col("lost"), 6))))).otherwise(0.0)
    return s.select("meeting_id", score.cast("int").alias("score"))


def baseline(history: DataFrame, keys: list[str], first_n: int = 3) -> DataFrame:
    """keys, n, mean, std (of the population, at least 5 % of the mean and 0.01) of the first values by time. history: keys, started_at, meeting_id, value."""
    order = Window.partitionBy(*keys).orderBy("started_at", "meeting_id")
    first = history.withColumn("_r", F.row_number().over(order)).where(f"_r <= {first_n} AND value IS NOT NULL")
    stats = first.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return stats.withColumn("std", F.greatest("std", 0.05 * F.abs("mean"), F.lit(0.01)))


def compared(values: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    both = values.join(baseline.select(*keys, "mean", "std"), keys)
    return both.withColumn("delta", F.col("value") - F.col("mean")).withColumn("z", F.when(F.col("std") > 0, F.col("delta") / F.col("std")))


def stretches(previous: np.ndarray, threshold: float) -> float:
    """Into how many stretches tokens fall that end as soon as the share of distinct ones is at most the threshold; the last counts in part.

    previous: the place of each token's last occurrence before it, -1 for none. A token is new in a stretch if that lies
    before the stretch, so the shares of a whole block come from one running sum.
    """
    start, found = 0, 0.0
    while start < len(previous):
        width, end, share = 128, None, 1.0
        while end is None:
            shares = np.cumsum(previous[start : start + width] < start) / np.arange(1, len(previous[start : start + width]) + 1)
            low = np.flatnonzero(shares <= threshold)
            if len(low):
                end = start + int(low[0]) + 1
            elif start + width >= len(previous):
                return found + (1 - shares[-1]) / (1 - threshold)
            width *= 2
        start, found = end, found + 1
    return found


def mtld_of(tokens: list[str], threshold: float = 0.72, least: int = 50) -> float | None:
    """Lexical diversity: mean length of stretches (above), read in both directions; null below `least` tokens."""
    n = len(tokens)
    if n < least:
        return None
    _, ids = np.unique(np.array(tokens, object), return_inverse=True)
    means = []
    for own in (ids, ids[::-1]):
        order = np.argsort(own, kind="stable")
        same = np.concatenate(([False], own[order][1:] == own[order][:-1]))
        previous = np.full(n, -1)
        previous[order[same]] = order[np.flatnonzero(same) - 1]
        found = stretches(previous, threshold)
        means.append(n / found if found else float(n))
    return sum(means) / 2


def tokens(words: DataFrame) -> DataFrame:
    """meeting_id, tokens: the owner's words in order, fillers left out. A row holds what one person says in one meeting."""
    own = words.where("track = 'mic' AND kind <> 'filler' AND norm <> ''").groupBy("meeting_id").agg(F.sort_array(F.collect_list(F.struct("i", "norm"))).alias("w"))
    return own.select("meeting_id", F.col("w.norm").alias("tokens"))


def mtld(texts: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, n_tokens, mtld of each row's token array: a fold that SQL functions do several times slower."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({key: f[key], "n_tokens": f[tokens].map(len), "mtld": [mtld_of(list(t)) for t in f[tokens]]})

    kind = dict(texts.dtypes)[key]
    return texts.select(key, tokens).mapInPandas(run, f"{key} {kind}, n_tokens long, mtld double")
