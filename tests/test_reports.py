"""Reports that are not reports, and templates without a value."""

import pytest
from meetlake.functions import text as T
from meetlake.sources import reports as R
from pyspark.sql import functions as F

GOOD = '{"meeting_id": 1, "type": "demo", "score": 70, "metrics": {"layer1": {"wpm": {"value": 120.5}, "mtld": {"value": null}}}, "more": [1]}'


def test_scan(spark, tmp_path):
    path = f"{tmp_path}/reports"
    R.write(spark.createDataFrame([(x,) for x in (GOOD, GOOD[:30], "", "[]", '{"type": "demo"}')], "value string"), path)
    assert [(r.meeting_id, r.type, r.score) for r in R.scan(spark, path).collect()] == [(1, "demo", 70)]
    assert sorted(r._bad is None for r in R.scan(spark, path, "keep").collect()).count(False) >= 1
    with pytest.raises(Exception, match="(?i)malformed"):
        R.scan(spark, path, "fail").collect()
    with pytest.raises(ValueError):
        R.scan(spark, path, "drop")
    assert {(r.layer, r.metric, r.value) for r in R.by_metric(R.scan(spark, path)).collect()} == {("layer1", "wpm", 120.5), ("layer1", "mtld", None)}


def test_render(spark):
    one = spark.range(1)
    assert one.select(T.render("a {id} b", {"id": F.col("id")})).first()[0] == "a 0 b"
    with pytest.raises(KeyError):
        T.render("{name}", {})
    with pytest.raises(Exception, match="null"):
        one.select(T.render("{x}", {"x": F.lit(None).cast("string")})).collect()
