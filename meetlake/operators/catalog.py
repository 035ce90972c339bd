"""The catalog of meetings: cards, progress, streaks, patterns over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cards(catalog: DataFrame) -> DataFrame:
    """Each meeting with the score of the speaker's last ready meeting before it."""
    order = Window.partitionBy("speaker").orderBy("started_at", "meeting_id").rowsBetween(Window.unboundedPreceding, -1)
    return catalog.withColumn("prev_score", F.last_value(F.when(F.col("status") == "ready", F.col("score")), ignoreNulls=True).over(order))


def last_n(catalog: DataFrame, n: int = 12) -> DataFrame:
    order = Window.partitionBy("speaker").orderBy(F.col("started_at").desc(), F.col("meeting_id").desc())
    return catalog.where("status = 'ready'").withColumn("_r", F.row_number().over(order)).where(f"_r <= {n}").drop("_r")


def streaks(catalog: DataFrame, today: str) -> DataFrame:
    """Working days in a row with a meeting, up to today or the working day before; weekends never count."""
    day = F.to_date("started_at")
    number = lambda d: F.floor(F.datediff(d, F.lit("1970-01-05").cast("date")) / 7) * 5 + F.weekday(d)
    now = F.lit(today).cast("date")
    current = F.when(F.weekday(now) < 5, number(now)).otherwise(F.floor(F.datediff(now, F.lit("1970-01-05").cast("date")) / 7) * 5 + 5)
    days = catalog.where((F.weekday(day) < 5) & (day <= now)).select("speaker", number(day).alias("d")).distinct()
    rank = F.row_number().over(Window.partitionBy("speaker").orderBy(F.col("d").desc()))
    ranked = days.withColumn("last", F.max("d").over(Window.partitionBy("speaker"))).withColumn("rank", rank)
    run = ranked.where(F.col("last") >= current - 1).where(F.col("d") == F.col("last") - F.col("rank") + 1)
    n = run.groupBy("speaker").agg(F.count(F.lit(1)).alias("streak_days"))
    return catalog.select("speaker").distinct().join(n, "speaker", "left").select("speaker", F.coalesce("streak_days", F.lit(0)).alias("streak_days"))


def months(catalog: DataFrame, today: str) -> DataFrame:
    """Mean score of this calendar month and of the one before."""
    this = F.trunc(F.lit(today).cast("date"), "MM")
    own = F.trunc(F.to_date("started_at"), "MM")
    ready = catalog.where("status = 'ready'")
    return ready.groupBy("speaker").agg(F.avg(F.when(own == this, F.col("score"))).alias("this_month"), F.avg(F.when(own == F.add_months(this, -1), F.col("score"))).alias("prev_month"))


def trailing_runs(rows: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """keys, run: rows at the end of each key's order for which the flag holds; n_flag: all for which it holds."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = rows.withColumn("_r", rank)
    return numbered.groupBy(*keys).agg((F.max("_r") - F.coalesce(F.max(F.when(~F.col(flag), F.col("_r"))), F.lit(0))).alias("run"), F.count_if(flag).alias("n_flag"), F.count(F.lit(1)).alias("n"))


def changes(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def recovered(catalog: DataFrame) -> DataFrame:
    """After a crash: what was being recorded or analysed counts as recorded."""
    return catalog.withColumn("status", F.when(F.col("status").isin("recording", "analyzing"), "recorded").otherwise(F.col("status")))


def applied(catalog: DataFrame, reports: DataFrame, values: list[str] = ("score", "wpm", "filled_pauses_per_min", "talk_ratio")) -> DataFrame:
    """catalog with what newer reports say: their values as they are, duration only where given, type only where the user did not set it.

    reports: meeting_id, new_duration, new_type and a new_ column for each of `values`; one row for a meeting.
    """
    both = catalog.join(reports.withColumn("_found", F.lit(True)), "meeting_id", "left")
    kept = [F.when(F.col("_found"), F.col(f"new_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    kind = F.when(F.col("_found") & (F.col("type_source") == "default"), F.coalesce("new_type", "type")).otherwise(F.col("type"))
    return both.select("meeting_id", *kept, F.coalesce("new_duration", "duration").alias("duration"), kind.alias("type"), "type_source")


def inserted(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """catalog with new meetings; one that is there already stays as it is, and of new ones with one id one comes in."""
    fresh = new.dropDuplicates(["meeting_id"]).join(catalog.select("meeting_id"), "meeting_id", "left_anti")
    return catalog.unionByName(fresh.select(*catalog.columns))


def with_values(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """catalog with the changes (meeting_id and some of its columns) where these are not null."""
    names = [c for c in changes.columns if c != "meeting_id"]
    both = catalog.join(changes.select("meeting_id", *(F.col(n).alias(f"_{n}") for n in names)), "meeting_id", "left")
    return both.select(*(F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in catalog.columns))


def deleted(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    return catalog.join(ids.select("meeting_id"), "meeting_id", "left_anti")


def staged_progress(events: DataFrame, stages: list[tuple[str, float, float]], keys: list[str], order: list[str]) -> DataFrame:
    """events (stage, frac) with pct: the base of the stage and its share times frac, never less than before. stages: (name, base, share)."""
    known = F.broadcast(events.sparkSession.createDataFrame(stages, "stage string, _base double, _share double"))
    now = F.coalesce(F.col("_base") + F.col("_share") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("frac"))), F.lit(0.0))
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.join(known, "stage", "left").withColumn("pct", F.max(now).over(upto)).drop("_base", "_share")


def edited(catalog: DataFrame, edits: DataFrame) -> DataFrame:
    """catalog with a user's edits: a blank title is none, a given type is the user's. edits: meeting_id, new_title, new_type."""
    both = catalog.join(edits.withColumn("_e", F.lit(True)), "meeting_id", "left")
    title = F.when(F.col("_e"), F.nullif(F.trim("new_title"), F.lit(""))).otherwise(F.col("title"))
    return both.select("meeting_id", title.alias("title"), F.coalesce("new_type", "type").alias("type"), F.when(F.col("new_type").isNotNull(), "user").otherwise(F.col("type_source")).alias("type_source"))


def groups_of_days(catalog: DataFrame) -> DataFrame:
    """Each meeting with the number of its group: meetings next to each other on one day."""
    order = Window.partitionBy("speaker").orderBy("started_at", "meeting_id")
    day = F.to_date("started_at")
    new = F.coalesce((day != F.lag(day).over(order)).cast("int"), F.lit(1))
    return catalog.withColumn("_new", new).withColumn("group", F.sum("_new").over(order)).drop("_new")


def rate_limited(rows: DataFrame, allowed: int, window_s: int, key: str = "user_id") -> DataFrame:
    """rows (key, ts, event_id) with `allowed`: at most so many in a sliding window by key; refused ones do not count.

    The decision depends on those before it. Each task walks its sorted rows and keeps the last `allowed` times of one
    key, so that memory does not grow with a key's rows.
    """

    def walk(frames):
        from collections import deque

        held, last = deque(), None
        for f in frames:
            ok = []
            for k, t in zip(f[key], f["at"], strict=True):
                if k != last:
                    held, last = deque(), k
                while held and t - held[0] >= window_s * 1_000_000:
                    held.popleft()
                ok.append(len(held) < allowed)
                if ok[-1]:
                    held.append(t)
            yield f[["event_id", key]].assign(allowed=ok)

    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    dealt = rows.where(F.col("ts").isNotNull()).select("event_id", key, at).repartition(key).sortWithinPartitions(key, "at", "event_id")
    return dealt.mapInPandas(walk, f"event_id {dict(rows.dtypes)['event_id']}, {key} {dict(rows.dtypes)[key]}, allowed boolean")


def speakers_of(catalog: DataFrame, year: int) -> DataFrame:
    """speaker of each ready meeting of a year."""
    return catalog.where((F.col("status") == "ready") & (F.year("started_at") == year)).select("speaker")


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that both have, once each; nulls are equal."""
    return a.intersect(b)


def in_first_only(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of the first that the second has not, once each; nulls are equal."""
    return a.subtract(b)
