"""Registered queries on written reports: each writes them below the shared folder and scans them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from meetlake.plans.registry import query
from meetlake.sources import adapters as D
from meetlake.sources import reports as R
from meetlake.sources.shared import shared_dir


def written(spark, sf):
    """The folder of a report for each event; each ninth line is cut short."""
    metric = lambda c: F.struct(c.cast("double").alias("value"))
    layer1 = F.create_map(F.lit("wpm"), metric(F.col("value")), F.lit("talk_ratio"), metric(F.col("user_id") % 100 / 100))
    layer2 = F.create_map(F.lit("pitch_range_st"), metric(F.col("event_id") % 24 / 2))
    report = F.struct(
        F.col("event_id").alias("meeting_id"), F.col("event_type").alias("type"), (F.col("event_id") % 101).alias("score"),
        F.create_map(F.lit("layer1"), layer1, F.lit("layer2"), layer2).alias("metrics"), F.lit("unread").alias("note"),
    )
    line = R.as_json(report)
    cut = F.when(F.col("event_id") % 9 == 0, F.expr("left(line, 20)")).otherwise(F.col("line"))
    path = shared_dir(spark, "reports")
    R.write(D.table(spark, sf, "events").where("event_id IS NOT NULL").withColumn("line", line).select(cut.alias("value")), path)
    return path


@query("SELECT event_id AS meeting_id, event_type AS type, event_id % 101 AS score FROM events WHERE event_id % 9 <> 0")
def report_scan(spark, sf):
    return R.scan(spark, written(spark, sf)).select("meeting_id", "type", "score")


@query("SELECT count(*) FILTER (event_id % 9 <> 0) AS n_read, count(*) FILTER (event_id % 9 = 0) AS n_bad FROM events")
def report_faults(spark, sf):
    found = R.scan(spark, written(spark, sf), bad="keep")
    return found.agg(F.count_if(F.col("_bad").isNull()).alias("n_read"), F.count_if(F.col("_bad").isNotNull()).alias("n_bad"))


@query("""SELECT event_id AS meeting_id, m[1] AS layer, m[2] AS metric, CASE m[2] WHEN 'wpm' THEN value WHEN 'talk_ratio' THEN user_id % 100 / 100 ELSE event_id % 24 / 2 END AS value
    FROM events, (SELECT unnest([['layer1', 'wpm'], ['layer1', 'talk_ratio'], ['layer2', 'pitch_range_st']]) AS m) WHERE event_id % 9 <> 0""")
def report_metrics(spark, sf):
    """The metrics of all layers of the reports, a row each."""
    return R.by_metric(R.scan(spark, written(spark, sf)))
