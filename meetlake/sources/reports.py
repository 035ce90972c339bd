"""Reports of meetings as JSON, one a line: written, scanned, and read by metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a scan reads of a report; other fields are left alone.
SCHEMA = "meeting_id long, type string, score long, metrics map<string, map<string, struct<value: double>>>, _bad string"


def as_json(report: Column) -> Column:
    return F.to_json(report, {"ignoreNullFields": "false"})


def write(lines: DataFrame, path: str) -> None:
    """lines: one string column, a report in each."""
    lines.write.mode("overwrite").text(path)


def scan(spark: SparkSession, path: str, bad: str = "skip") -> DataFrame:
    """meeting_id, type, score, metrics of the reports below a path.

    What is not a report is left out ("skip"), kept in the column _bad ("keep"), or an error ("fail"). Blank lines are none.
    """
    if bad not in ("skip", "keep", "fail"):
        raise ValueError(f"bad is skip, keep or fail, not {bad}")
    mode = "FAILFAST" if bad == "fail" else "PERMISSIVE"
    lines = spark.read.text(path).where(F.trim("value") != "")
    found = lines.select(F.from_json("value", SCHEMA, {"mode": mode, "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return found if bad == "keep" else found.where("_bad IS NULL AND meeting_id IS NOT NULL").drop("_bad")


def by_metric(reports: DataFrame) -> DataFrame:
    """meeting_id, layer, metric, value: a row for each metric that a report holds."""
    layers = reports.select("meeting_id", F.explode("metrics").alias("layer", "own"))
    return layers.select("meeting_id", "layer", F.explode("own").alias("metric", "m")).select("meeting_id", "layer", "metric", F.col("m.value").alias("value"))
