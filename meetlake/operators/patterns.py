"""Patterns over a speaker's meetings: starts, streaks, what needs work, exercises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlake.functions import constants as C
from meetlake.operators import catalog as K

FIRST_MS = 180_000
OUT = "status IN ('warn', 'bad')"


def compressed(points: DataFrame, events: DataFrame, questions: DataFrame, durations: DataFrame) -> DataFrame:
    """A row for each meeting: tempo and fillers a minute of its first three minutes and of the rest, questions asked."""
    early = (F.col("a") + F.col("b")) / 2 < FIRST_MS
    tempo = points.where("wpm > 0").groupBy("meeting_id").agg(F.round(F.avg(F.when(early, F.col("wpm"))), 1).alias("wpm_first"), F.round(F.avg(F.when(~early, F.col("wpm"))), 1).alias("wpm_rest"))
    fill = events.where("kind = 'filler'").groupBy("meeting_id").agg(F.count_if(F.col("start_ms") < FIRST_MS).alias("nf"), F.count_if(F.col("start_ms") >= FIRST_MS).alias("nr"))
    asked = questions.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("questions"))
    first, rest = F.least("duration_ms", F.lit(FIRST_MS)), F.greatest(F.col("duration_ms") - FIRST_MS, F.lit(0))
    rate = lambda n, ms: F.when(ms > 0, F.round(F.coalesce(n, F.lit(0)) * 60000.0 / ms, 1))
    wide = durations.join(tempo, "meeting_id", "left").join(fill, "meeting_id", "left").join(asked, "meeting_id", "left")
    return wide.select("meeting_id", "wpm_first", "wpm_rest", rate(F.col("nf"), first).alias("fillers_first"), rate(F.col("nr"), rest).alias("fillers_rest"), F.coalesce("questions", F.lit(0)).alias("questions"))


def with_metrics(compressed: DataFrame, wide: DataFrame, scores: DataFrame) -> DataFrame:
    """compressed with type, score and the kept metrics to two places."""
    kept = wide.select("meeting_id", "type", *(F.round(m, 2).alias(m) for m in C.COMPRESSED))
    return compressed.join(kept, "meeting_id").join(scores, "meeting_id", "left")


def insights(rows: DataFrame, used: DataFrame, known: list[str] = C.METRICS, most: int = 5) -> DataFrame:
    """rows (speaker, place, title, metric, meeting_ids) that have a title, the first `most` of each speaker: ids only of the speaker's used meetings, metrics only known ones.

    used: speaker, meeting_id.
    """
    own = rows.where((F.trim("title") != "") & (F.col("place") <= most)).withColumn("title", F.trim("title"))
    name = F.regexp_replace(F.trim("metric"), "^layer[12][.]", "")
    own = own.withColumn("metric", F.when(name.isin(known), name))
    ids = own.select("speaker", "place", F.posexplode("meeting_ids").alias("_at", "meeting_id")).join(used.distinct(), ["speaker", "meeting_id"])
    kept = ids.groupBy("speaker", "place").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "meeting_id"))), lambda x: x["meeting_id"]).alias("_ids"))
    return own.drop("meeting_ids").join(kept, ["speaker", "place"], "left").withColumn("meeting_ids", F.coalesce("_ids", F.array().cast("array<bigint>"))).drop("_ids")


def fast_start() -> Column:
    return F.coalesce((F.col("wpm_first") > 0) & (F.col("wpm_rest") > 0) & (F.col("wpm_first") >= F.col("wpm_rest") * 1.1), F.lit(False))


def filler_start() -> Column:
    return F.coalesce(F.col("fillers_first") >= F.col("fillers_rest") * 1.5 + 0.5, F.lit(False))


def repeated(reports: DataFrame, flag: Column, least: int = 2) -> DataFrame:
    """speaker, n_flag, n, run at the end, for speakers with the flag in `least` meetings or more."""
    return K.trailing_runs(reports.withColumn("_flag", flag), ["speaker"], ["started_at", "meeting_id"], "_flag").where(f"n_flag >= {least}")


def out_of_range(judged: DataFrame) -> DataFrame:
    """speaker, metric, run, n_flag, n where a metric was out of its range in the last two meetings, or in three and 60 % of all."""
    runs = K.trailing_runs(judged.withColumn("_flag", F.expr(OUT)), ["speaker", "metric"], ["started_at", "meeting_id"], "_flag")
    return runs.where("run >= 2 OR (n_flag >= 3 AND n_flag >= 0.6 * n)")


def worst(judged: DataFrame) -> DataFrame:
    """speaker, metric, harm, place: (2 bad + warn) times the metric's weight; ties in the metrics' order."""
    known = [(m, i, dict(C.WEIGHTS).get(m, C.OTHER_WEIGHT)) for i, m in enumerate(C.METRICS)]
    weights = judged.sparkSession.createDataFrame(known, "metric string, _i int, _w double")
    points = F.sum(F.when(F.col("status") == "bad", 2).otherwise(1))
    harm = judged.where(OUT).groupBy("speaker", "metric").agg(points.alias("_p")).join(F.broadcast(weights), "metric").withColumn("harm", F.col("_p") * F.col("_w"))
    place = F.row_number().over(Window.partitionBy("speaker").orderBy(F.col("harm").desc(), "_i"))
    return harm.select("speaker", "metric", "harm", place.alias("place"))


def exercises(speakers: DataFrame, worst: DataFrame, tasks: list[tuple[str, str, int]] = C.TASKS, least: int = 2, most: int = 4) -> DataFrame:
    """speaker, place, task, minutes: a task for each worst metric, at most `most`; with fewer than `least`, more in the tasks' order."""
    rows = [(i, t, m, max(1.0, round(s / 60, 1))) for i, (t, m, s) in enumerate(tasks)]
    first = [r for r in rows if r[2] not in {q[2] for q in rows[: r[0]]}]
    spark = speakers.sparkSession
    by_metric = F.broadcast(spark.createDataFrame(first, "i int, task string, metric string, minutes double"))
    wanted = worst.join(by_metric, "metric").select("speaker", "task", "minutes", F.lit(0).alias("pad"), F.col("place").alias("r"))
    all_ = F.array(*(F.struct(F.lit(t).alias("task"), F.lit(m).alias("minutes"), F.lit(1).alias("pad"), F.lit(i).alias("r")) for i, t, _, m in rows))
    padded = wanted.unionByName(speakers.select("speaker", F.inline(all_)))
    one = padded.groupBy("speaker", "task", "minutes").agg(F.min(F.struct("pad", "r")).alias("o"))
    place = F.row_number().over(Window.partitionBy("speaker").orderBy("o"))
    return one.withColumn("place", place).where(f"place <= {most} AND (o.pad = 0 OR place <= {least})").select("speaker", "place", "task", "minutes")


def summary(reports: DataFrame, worst: DataFrame) -> DataFrame:
    """speaker, text: a few lines of markdown on the number of meetings, the score's course and the three weakest metrics. reports: speaker, started_at, meeting_id, score."""
    at = F.struct("started_at", "meeting_id")
    course = reports.groupBy("speaker").agg(F.count(F.lit(1)).alias("n"), F.min_by("score", at).alias("a"), F.max_by("score", at).alias("b"))
    weak = worst.where("place <= 3").groupBy("speaker").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "metric"))), lambda x: x["metric"]), ", ").alias("weak"))
    lines = F.concat_ws("\n", F.concat(F.lit("- meetings: "), F.col("n")), F.concat(F.lit("- score: "), F.col("a"), F.lit(" → "), F.col("b")), F.concat(F.lit("- focus: "), F.coalesce("weak", F.lit("—"))))
    return course.join(weak, "speaker", "left").select("speaker", lines.alias("text"))
