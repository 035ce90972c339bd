"""Registered queries that run as streams over a table until it is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from meetlake.plans.registry import query
from meetlake.plans.sql import over
from meetlake.sources import adapters as D
from meetlake.sources import recordings as R
from meetlake.sources.shared import shared_dir
from meetlake.streaming import live, recording

#: Milliseconds after which a live meeting ends by itself, and samples a second of what is streamed.
LONGEST_MS, LIVE_RATE = 240_000, 2_000


def arriving(spark, sf):
    """events as a stream; a pattern, for a stream takes no single file."""
    shape = D.table(spark, sf, "events").schema
    return spark.readStream.schema(shape).parquet(f"{sf}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, start, count(*) AS n, max(value) AS level FROM (SELECT user_id, value, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS start FROM events) GROUP BY 1, 2")
def live_rates(spark, sf):
    """Sliding windows of a stream of events, kept whole: the last update of each."""
    out = live.latest(live.drained(live.rates(arriving(spark, sf), "user_id"), "rates"), ["user_id", "start"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n, max(value) AS level
    FROM (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island
        FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, TRUE)::INT AS cut FROM events WHERE ts IS NOT NULL))
    GROUP BY user_id, island""")
def live_sessions(spark, sf):
    """Sessions of a stream of events: those that closed, and those that are open when the input is read."""
    closed = live.drained(live.sessions(arriving(spark, sf), "user_id", late="1 hour"), "sessions", "append").drop("batch", "run")
    rows = D.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = live.with_open(closed, rows, "user_id")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(over(f"""
    SELECT meeting_id, ms // 1000 AS ticks, least(ms // 1000 * 100, 1000)::INT AS frames, CASE WHEN ms >= {LONGEST_MS} THEN 'longest' WHEN ended + 5000 <= max(ended) OVER () - 2000 THEN 'silent' END AS reason
    FROM (SELECT meeting_id, least({LONGEST_MS}, 10 * (n // {LIVE_RATE // 100})) AS ms, 1000 * n // {LIVE_RATE} AS ended FROM (SELECT meeting_id, max(end_ms) * {LIVE_RATE} // 1000 AS n FROM words WHERE track = 'mic' GROUP BY 1))"""))
def live_recording(spark, sf):
    """Recorded meetings as a stream of chunks, whose samples are made where they are taken: ticks, the frames behind the last, and why each ended; a meeting still runs if others did not outlast it."""
    path, own = shared_dir(spark, "arriving"), live.on_disk(spark)
    chunks = recording.cut(R.scored(D.words(spark, sf, D.parts(spark, sf)), LIVE_RATE, 2, spread=False))
    chunks.write.parquet(path)
    limits = recording.Limits(tick_ms=1_000, longest_ms=LONGEST_MS, silence_ms=5_000)
    rows = live.drained(recording.live(own.readStream.schema(chunks.schema).parquet(path), limits, samples=R.played), "recording", "append")
    last = F.max_by("frames", F.when(F.col("kind") == "tick", F.col("at_ms")))
    return rows.groupBy("meeting_id").agg(F.count_if(F.col("kind") == "tick").alias("ticks"), F.max("reason").alias("reason"), last.alias("frames"))
