"""Snapshots: readers and writers side by side, and a writer that is lost midway; the engine's calls and commands over them."""

import json

import pytest
from meetlake import __main__ as shell
from meetlake.api import Engine
from meetlake.sources.shared import shared_dir
from meetlake.sources.snapshots import Conflict, Table
from pyspark.sql import functions as F


def table(spark):
    return Table(spark, shared_dir(spark, "table"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_readers_keep_their_snapshot(spark):
    t = table(spark)
    assert t.newest() is None
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.commit(spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")) == 1
    before = t.read()
    assert t.merge(spark.createDataFrame([(2, "c"), (3, "d")], "id long, s string"), ["id"], spark.createDataFrame([(1,)], "id long")) == 2
    assert rows(before) == [(1, "a"), (2, "b")] == rows(t.read(1)) and rows(t.read()) == [(2, "c"), (3, "d")]
    assert t.commit(spark.createDataFrame([], "id long, s string")) == 3 and rows(t.read()) == []


def test_a_lost_writer_leaves_the_old_snapshot(spark):
    t = table(spark)
    t.commit(spark.createDataFrame([(1, "a")], "id long, s string"))

    def broken(x):
        raise RuntimeError("executor lost")

    bad = spark.createDataFrame([(2,)], "id long").select("id", F.udf(broken, "string")("id").alias("s"))
    with pytest.raises(Exception, match="executor lost"):
        t.merge(bad, ["id"])
    assert rows(t.read()) == [(1, "a")] and t.versions() == [1]
    spark.createDataFrame([(7, "x")], "id long, s string").write.parquet(f"{t.root}/data/unnamed")  # lost between data and pointer
    out = t._fs.create(t._pointer(2), False)  # lost while it wrote the pointer
    out.write(b'{"folder": "da')
    out.close()
    assert rows(t.read()) == [(1, "a")]
    assert t.merge(spark.createDataFrame([(2, "b")], "id long, s string"), ["id"]) == 3
    assert rows(t.read()) == [(1, "a"), (2, "b")]
    assert t.expire(keep=1) >= 2 and rows(t.read()) == [(1, "a"), (2, "b")]


def test_of_two_writers_the_later_fails(spark):
    t = table(spark)
    t.commit(spark.createDataFrame([(1, "a")], "id long, s string"))
    other = Table(spark, t.root)
    version = t.newest().version
    other.commit(spark.createDataFrame([(2, "b")], "id long, s string"), version)
    with pytest.raises(Conflict):
        t.commit(spark.createDataFrame([(3, "c")], "id long, s string"), version)
    assert rows(t.read()) == [(2, "b")]


@pytest.fixture(scope="module")
def engine(spark, sf):
    e = Engine(spark, shared_dir(spark, "home"))
    e.analyze(sf)
    return e


def test_rescore_is_written_back(engine):
    card = engine.list_meetings().where("type <> 'sales' AND score > 0").first()
    old = engine.get_report(card.meeting_id).first()
    new = engine.rescore(card.meeting_id, "sales").first()
    assert new.type == "sales" and engine.get_meeting(card.meeting_id).first().score == new.score
    assert [(m.metric, m.value) for m in new.metrics] == [(m.metric, m.value) for m in old.metrics] and new.timeline == old.timeline
    want = {m.metric: (m.ref_low, m.ref_high) for m in new.metrics}
    assert want["talk_ratio"] == (0.4, 0.45) and want["interruptions_by_me"] == (None, 1.0)
    bursts = sorted((e.start_ms, e.end_ms) for e in new.events if e.kind == "fast_burst")
    assert bursts == sorted((p.a, p.b) for p in new.timeline if p.wpm > 1.2 * 130)
    assert [e for e in new.events if e.kind != "fast_burst"] == [e for e in old.events if e.kind != "fast_burst"]
    back = engine.rescore(card.meeting_id, card.type).first()
    assert (back.score, back.metrics) == (old.score, old.metrics)
    others = engine.list_meetings().where(F.col("meeting_id") != card.meeting_id).count()
    assert others == engine.list_meetings().count() - 1


def test_calls(engine):
    n = engine.list_meetings().count()
    first = engine.list_meetings().first()
    assert engine.update_meeting(first.meeting_id, title="Renamed").first().title == "Renamed"
    engine.delete_meeting(first.meeting_id)
    assert engine.list_meetings().count() == n - 1 and engine.get_report(first.meeting_id).isEmpty()
    with pytest.raises(KeyError):
        engine.update_meeting(first.meeting_id, title="x")
    with pytest.raises(ValueError):
        engine.update_meeting(1, type_="party")
    assert {"speaker", "metric", "mean"} <= set(engine.get_baseline().columns) and engine.get_baseline().count() > 0
    assert engine.get_progress().count() > engine.get_patterns().count() > 0
    assert engine.list_training_tasks().count() > 0 and engine.weekly().count() > 0
    plan = engine.prepare_meeting("  a   topic ", "Sales", ["x", "x", " "], ["why now?"]).first()
    assert (plan.topic, plan.type, len(plan.checklist), plan.likely_questions[0], len(plan.likely_questions)) == ("a topic", "sales", 5, "why now?", 3)


def test_commands(engine, spark, capsys):
    home = engine.reports.root.removesuffix("/reports")

    def run(*argv):
        code = shell.main([*argv, "--home", home], spark)
        lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
        return code, lines[:-1], lines[-1]

    code, cards, last = run("list")
    assert code == 0 and last == {"ok": True, "command": "list", "rows": len(cards)} and cards
    code, report, _ = run("rescore", "--meeting", str(cards[0]["meeting_id"]), "--type", "demo")
    assert code == 0 and report[0]["type"] == "demo"
    assert run("baseline", "--out", shared_dir(spark, "baseline"))[2]["ok"]
    assert {c["check"] for c in run("doctor")[1]} == {"spark", "shared folder", "reports"}
    code, _, last = run("rename", "--meeting", "-5", "--title", "x")
    assert code == 1 and last["error"].startswith("KeyError")
    with pytest.raises(SystemExit):
        shell.main(["rescore", "--home", home, "--meeting", "1", "--type", "party"], spark)
