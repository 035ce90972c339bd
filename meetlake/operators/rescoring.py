"""Reports of meetings as rows, and reports judged anew under another type from nothing but what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.operators import metrics as M
from meetlake.operators import timeline as L

METRIC = ["metric", "value", "ref_low", "ref_high", "better", "status"]
POINT = ["a", "b", "n_words", "wpm"]
EVENT = ["start_ms", "end_ms", "kind"]
BURST = "fast_burst"


def held(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """meeting_id and an array of the rows' structs, in their order."""
    return rows.groupBy("meeting_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def assembled(meetings: DataFrame, judged: DataFrame, line: DataFrame, events: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """meetings with score, metrics, timeline and events: a report is a row, as long as its meeting's windows and events."""
    score = M.overall(M.components(judged, baseline))
    parts = [score, held(judged, METRIC, "metrics"), held(line, POINT, "timeline"), held(events, EVENT, "events")]
    out = meetings
    for part in parts:
        out = out.join(part, "meeting_id", "left")
    return out


def rescored(reports: DataFrame, type_: Column, baseline: DataFrame | None = None) -> DataFrame:
    """reports under another type: references, statuses, score and fast bursts follow from the stored metrics and windows.

    Bursts are made of the windows alone, so that any number of words counts.
    """
    own = reports.withColumn("type", type_)
    values = own.select("meeting_id", "type", "speaker", F.inline("metrics")).select("meeting_id", "type", "speaker", "metric", "value")
    judged = M.judged(values)
    points = own.select("meeting_id", "type", F.inline("timeline"))
    bursts = L.bursts(points, least=0).select("meeting_id", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"), F.lit(BURST).alias("kind"))
    others = own.select("meeting_id", F.inline(F.filter("events", lambda e: e["kind"] != BURST))).select("meeting_id", *EVENT)
    rest = [c for c in reports.columns if c not in ("score", "metrics", "timeline", "events")]
    lines = own.select("meeting_id", "timeline")
    out = own.select(*rest).join(M.overall(M.components(judged, baseline)), "meeting_id", "left").join(held(judged, METRIC, "metrics"), "meeting_id", "left")
    return out.join(lines, "meeting_id", "left").join(held(others.unionByName(bursts), EVENT, "events"), "meeting_id", "left").select(*reports.columns)
