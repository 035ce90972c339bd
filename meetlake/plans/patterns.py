"""Registered queries over many meetings: patterns, baselines, catalog edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meetlake.functions import constants as C
from meetlake.functions import scoring as J
from meetlake.functions import text as T
from meetlake.operators import catalog as K
from meetlake.operators import metrics as M
from meetlake.operators import patterns as P
from meetlake.operators import rescoring as S
from meetlake.operators import timeline as L
from meetlake.plans.meetings import Meetings
from meetlake.plans.queries import r6
from meetlake.plans.registry import query
from meetlake.plans.sql import CTES, long_of, over, values
from meetlake.sources import adapters as D
from meetlake.sources.shared import shared_dir
from meetlake.sources.snapshots import Table

CTES |= {
    "compress": """SELECT d.meeting_id, (SELECT round(avg(wpm), 1) FROM line l WHERE l.meeting_id = d.meeting_id AND wpm > 0 AND (a + b) / 2 < 180000) AS wpm_first, (SELECT round(avg(wpm), 1) FROM line l WHERE l.meeting_id = d.meeting_id AND wpm > 0 AND (a + b) / 2 >= 180000) AS wpm_rest,
        CASE WHEN duration_ms > 0 THEN round((SELECT count(*) FROM events_all e WHERE e.meeting_id = d.meeting_id AND kind = 'filler' AND start_ms < 180000) * 60000.0::DOUBLE / least(duration_ms, 180000), 1) END AS fillers_first,
        CASE WHEN duration_ms > 180000 THEN round((SELECT count(*) FROM events_all e WHERE e.meeting_id = d.meeting_id AND kind = 'filler' AND start_ms >= 180000) * 60000.0::DOUBLE / (duration_ms - 180000), 1) END AS fillers_rest,
        (SELECT count(*) FROM utter u WHERE u.meeting_id = d.meeting_id AND is_question) AS questions FROM dur d""",
    "history": "SELECT j.*, started_at FROM judged j JOIN (SELECT meeting_id AS mid, started_at, status AS done FROM meetings) m ON mid = j.meeting_id WHERE done = 'ready'",
    "base_first": "SELECT speaker, metric, value, row_number() OVER (PARTITION BY speaker, metric ORDER BY started_at, l.meeting_id) AS r FROM long l JOIN (SELECT meeting_id AS mid, started_at, status FROM meetings) m ON mid = l.meeting_id WHERE type <> 'training' AND status = 'ready'",
    "base_stats": "SELECT speaker, metric, mean, greatest(std, 0.05 * abs(mean), 0.01) AS std FROM (SELECT speaker, metric, avg(value) AS mean, stddev_pop(value) AS std FROM base_first WHERE r <= 3 AND value IS NOT NULL GROUP BY 1, 2)",
    "zs": """SELECT j.meeting_id, j.metric, CASE WHEN value IS NULL THEN 0.0 WHEN better = 'lower' THEN greatest(0, (value - mean) / std) WHEN better = 'higher' THEN greatest(0, (mean - value) / std)
        WHEN ref_low IS NULL OR ref_high IS NULL THEN abs((value - mean) / std) WHEN value >= (ref_low + ref_high) / 2 THEN greatest(0, (value - mean) / std) ELSE greatest(0, (mean - value) / std) END AS z FROM judged j JOIN base_stats USING (speaker, metric)""",
    "pen_own": "SELECT meeting_id, metric, w, CASE WHEN z IS NULL OR p IS NULL THEN p ELSE 0.5 * p + 0.5 * least(1.0, z / 2) END AS p FROM pen LEFT JOIN zs USING (meeting_id, metric)",
    "comp_own": "SELECT meeting_id, metric, CASE WHEN p IS NULL THEN 0.0 ELSE round(w * 100 / sum(w) FILTER (p IS NOT NULL) OVER (PARTITION BY meeting_id), 2) END AS weight, coalesce(round(p, 4), 0.0) AS penalty FROM pen_own",
    "worst": "SELECT speaker, metric, harm, row_number() OVER (PARTITION BY speaker ORDER BY harm DESC, o)::INT AS place FROM (SELECT speaker, h.metric, sum(CASE status WHEN 'bad' THEN 2 ELSE 1 END) * any_value(w)::DOUBLE AS harm, any_value(o) AS o FROM history h JOIN "
    + values([(i, m, dict(C.WEIGHTS).get(m, C.OTHER_WEIGHT)) for i, m in enumerate(C.METRICS)])
    + " AS k(o, metric, w) ON k.metric = h.metric WHERE status IN ('warn', 'bad') GROUP BY 1, 2)",
    "tasks": "SELECT * FROM " + values([(i, t, m, max(1.0, round(s / 60, 1))) for i, (t, m, s) in enumerate(C.TASKS)]) + " AS t(o, task, metric, minutes)",
    "wanted": "SELECT speaker, task, minutes, 0 AS pad, place AS r FROM worst JOIN tasks USING (metric) UNION ALL SELECT speaker, task, minutes, 1, o FROM (SELECT DISTINCT speaker FROM history), tasks",
}


def compressed(m: Meetings):
    return P.compressed(m.line, m.fillers, m.questions, L.durations(m.words))


def against_base(rows, m: Meetings):
    """rows (speaker, metric) with the speaker's mean and std."""
    return rows.join(m.base.select("speaker", "metric", "mean", "std"), ["speaker", "metric"])


@query(over("SELECT compress.*, wide.type, " + ", ".join(f"round({m}, 2) AS {m}" for m in C.COMPRESSED) + ", score FROM compress JOIN wide USING (meeting_id) LEFT JOIN score USING (meeting_id)"))
def compress_report(spark, sf):
    m = Meetings(spark, sf)
    return P.with_metrics(compressed(m), m.wide, M.overall(M.components(m.judged)))


INSIGHTS = "SELECT speaker, r::INT AS place, CASE WHEN r % 4 = 3 THEN '  ' ELSE ' Note ' || r END AS title, CASE r % 3 WHEN 0 THEN 'layer1.wpm' WHEN 1 THEN 'mtld' ELSE 'layer3.wpm' END AS metric, [meeting_id, meeting_id + 1, meeting_id + 10] AS meeting_ids FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY meeting_id) AS r FROM meetings)"


@query(over(f"""
    SELECT speaker, place, trim(title) AS title, CASE place % 3 WHEN 0 THEN 'wpm' WHEN 1 THEN 'mtld' END AS metric,
        coalesce(array_to_string(list_filter(meeting_ids, lambda x: coalesce(list_contains(ready, x), FALSE)), ','), '') AS meeting_ids
    FROM ({INSIGHTS}) LEFT JOIN (SELECT speaker, list(meeting_id) AS ready FROM meetings WHERE status = 'ready' GROUP BY 1) USING (speaker)
    WHERE trim(title) <> '' AND place <= 5"""))
def insight_validate(spark, sf):
    """Notes of a speaker with loose metric names, and ids of which some are not the speaker's."""
    own, k = D.meetings(spark, sf), F.col("place")
    rows = own.withColumn("place", F.row_number().over(Window.partitionBy("speaker").orderBy("meeting_id")))
    rows = rows.select("speaker", "place", F.when(k % 4 == 3, "  ").otherwise(F.concat(F.lit(" Note "), k)).alias("title"), F.when(k % 3 == 0, "layer1.wpm").when(k % 3 == 1, "mtld").otherwise("layer3.wpm").alias("metric"), F.array("meeting_id", F.col("meeting_id") + 1, F.col("meeting_id") + 10).alias("meeting_ids"))
    kept = P.insights(rows, own.where("status = 'ready'").select("speaker", "meeting_id"))
    return kept.withColumn("meeting_ids", F.concat_ws(",", F.col("meeting_ids").cast("array<string>")))


@query(over("SELECT speaker, metric, meeting_id, round(value, 6) AS value FROM history WHERE value IS NOT NULL AND metric IN " + repr(tuple(C.CHARTS))))
def progress_charts(spark, sf):
    own = Meetings(spark, sf).history.where(F.col("metric").isin(C.CHARTS) & F.col("value").isNotNull())
    return own.select("speaker", "metric", "meeting_id", r6("value"))


@query(over("SELECT speaker, count(*) FILTER (status = 'ready') AS n_ready, count(*) AS n FROM meetings GROUP BY 1"))
def progress_totals(spark, sf):
    return D.meetings(spark, sf).groupBy("speaker").agg(F.count_if(F.col("status") == "ready").alias("n_ready"), F.count(F.lit(1)).alias("n"))


@query(over("SELECT speaker, count(*) FILTER (f) AS n_flag, count(*) AS n, count(*) - coalesce(max(r) FILTER (NOT f), 0) AS run FROM (SELECT speaker, coalesce(wpm_first >= wpm_rest * 1.1 AND wpm_first > 0 AND wpm_rest > 0, FALSE) AS f, row_number() OVER (PARTITION BY speaker ORDER BY started_at, meeting_id) AS r FROM compress JOIN meetings USING (meeting_id) WHERE status = 'ready') GROUP BY 1 HAVING count(*) FILTER (f) >= 2"))
def fast_start_streak(spark, sf):
    reports = compressed(Meetings(spark, sf)).join(D.meetings(spark, sf).where("status = 'ready'"), "meeting_id")
    return P.repeated(reports, P.fast_start()).select("speaker", "n_flag", "n", F.col("run").cast("long").alias("run"))


@query(over("SELECT speaker, count(*) FILTER (f) AS n_flag, count(*) AS n FROM (SELECT speaker, coalesce(fillers_first >= fillers_rest * 1.5 + 0.5, FALSE) AS f FROM compress JOIN meetings USING (meeting_id) WHERE status = 'ready') GROUP BY 1 HAVING count(*) FILTER (f) >= 2"))
def filler_start(spark, sf):
    reports = compressed(Meetings(spark, sf)).join(D.meetings(spark, sf).where("status = 'ready'"), "meeting_id")
    return P.repeated(reports, P.filler_start()).select("speaker", "n_flag", "n")


@query(over("SELECT * FROM (SELECT speaker, metric, count(*) FILTER (f) AS n_flag, count(*) AS n, count(*) - coalesce(max(r) FILTER (NOT f), 0) AS run FROM (SELECT speaker, metric, status IN ('warn', 'bad') AS f, row_number() OVER (PARTITION BY speaker, metric ORDER BY started_at, meeting_id) AS r FROM history) GROUP BY 1, 2) WHERE run >= 2 OR (n_flag >= 3 AND n_flag >= 0.6 * n)"))
def out_of_range_streaks(spark, sf):
    return P.out_of_range(Meetings(spark, sf).history).select("speaker", "metric", "n_flag", "n", F.col("run").cast("long").alias("run"))


@query(over("SELECT * FROM worst"))
def worst_metrics(spark, sf):
    return P.worst(Meetings(spark, sf).history)


@query(over("SELECT speaker, place, task, minutes FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY pad, r)::INT AS place FROM (SELECT speaker, task, any_value(minutes)::DOUBLE AS minutes, min(pad) AS pad, arg_min(r, pad) AS r FROM wanted GROUP BY 1, 2)) WHERE place <= 4 AND (pad = 0 OR place <= 2)"))
def exercises(spark, sf):
    own = Meetings(spark, sf).history
    return P.exercises(own.select("speaker").distinct(), P.worst(own))


@query(over("SELECT speaker, '- meetings: ' || count(*) || chr(10) || '- score: ' || arg_min(score, struct_pack(a := started_at, b := meeting_id)) || ' → ' || arg_max(score, struct_pack(a := started_at, b := meeting_id)) || chr(10) || '- focus: ' || coalesce((SELECT string_agg(metric, ', ' ORDER BY place) FROM worst w WHERE w.speaker = m.speaker AND place <= 3), '—') AS text FROM meetings m JOIN score USING (meeting_id) WHERE m.status = 'ready' GROUP BY speaker"))
def weekly_summary(spark, sf):
    m = Meetings(spark, sf)
    scores = M.overall(M.components(m.judged)).join(m.meetings.where("status = 'ready'"), "meeting_id")
    return P.summary(scores, P.worst(m.history))


@query(over("SELECT speaker, metric, meeting_id, started_at, round(value, 6) AS value FROM history WHERE value IS NOT NULL AND metric <> 'interruptions_by_other'"))
def progress_series(spark, sf):
    own = Meetings(spark, sf).history.where(F.col("metric").isin(C.PROGRESS))
    return own.where("value IS NOT NULL").select("speaker", "metric", "meeting_id", "started_at", r6("value"))


@query(over("SELECT meeting_id, metric, round(z, 4) AS z FROM zs"))
def bad_side_z(spark, sf):
    m = Meetings(spark, sf)
    both = against_base(m.judged, m)
    z = J.bad_side_z(F.col("value"), F.col("mean"), F.col("std"), F.col("better"), F.col("ref_low"), F.col("ref_high"))
    return both.select("meeting_id", "metric", F.round(z, 4).alias("z"))


@query(over("SELECT meeting_id, CASE WHEN sum(weight) > 0 THEN greatest(0, least(100, round_even(round(100 - sum(weight * penalty), 6), 0)))::INT ELSE 0 END AS score FROM comp_own GROUP BY 1"))
def score_baseline(spark, sf):
    m = Meetings(spark, sf)
    return M.overall(M.components(m.judged, m.base))


def rescored(spark, sf):
    """Reports, stored as a snapshot and read back, under the type of a sale."""
    m, store = Meetings(spark, sf), Table(spark, shared_dir(spark, "reports"))
    store.commit(S.assembled(m.meetings, m.judged, m.line.select("meeting_id", *S.POINT), m.events))
    return S.rescored(store.read(), F.lit("sales"))


@query(over("SELECT * FROM score", long=long_of("'sales'")))
def rescore(spark, sf):
    """Every stored report as if it were of another type, from nothing but what it holds."""
    return rescored(spark, sf).select("meeting_id", F.coalesce("score", F.lit(0)).alias("score"))


@query(over("SELECT meeting_id, 'fast_burst' AS kind, a AS start_ms, b AS end_ms FROM line WHERE wpm > 1.2 * 130.0"))
def rescore_bursts(spark, sf):
    """The fast bursts of every stored report as if it were of another type: from its windows alone, so any number of words counts."""
    return rescored(spark, sf).select("meeting_id", F.inline("events")).where("kind = 'fast_burst'").select("meeting_id", "kind", "start_ms", "end_ms")


@query(over("SELECT meeting_id, metric, delta, z, place FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY abs(z) DESC, metric)::INT AS place FROM (SELECT meeting_id, metric, round(value - mean, 4) AS delta, round((value - mean) / std, 4) AS z FROM long JOIN base_stats USING (speaker, metric) WHERE value IS NOT NULL)) WHERE place <= 6"))
def top_deltas(spark, sf):
    m = Meetings(spark, sf)
    rows = against_base(m.long.where("value IS NOT NULL"), m)
    rows = rows.select("meeting_id", "metric", F.round(F.col("value") - F.col("mean"), 4).alias("delta"), F.round((F.col("value") - F.col("mean")) / F.col("std"), 4).alias("z"))
    place = F.row_number().over(Window.partitionBy("meeting_id").orderBy(F.abs("z").desc(), "metric"))
    return rows.withColumn("place", place).where("place <= 6")


@query(over("SELECT meeting_id, metric, CASE WHEN abs(d) < 0.5 OR better = 'inside' OR d = 0 THEN 'same' WHEN (better = 'higher') = (d > 0) THEN 'better' ELSE 'worse' END AS direction FROM (SELECT j.*, round(value - mean, 6) AS d FROM judged j JOIN base_stats USING (speaker, metric) WHERE value IS NOT NULL)"))
def delta_direction(spark, sf):
    m = Meetings(spark, sf)
    both = against_base(m.judged.where("value IS NOT NULL"), m)
    return both.select("meeting_id", "metric", J.delta_direction(F.round(F.col("value") - F.col("mean"), 6), F.col("better"), 1.0).alias("direction"))


@query(over("SELECT DISTINCT type, metric, ref_low, ref_high, better FROM judged"))
def reference_lookup(spark, sf):
    return Meetings(spark, sf).named.select("type", "metric", "ref_low", "ref_high", "better").distinct()


@query(over("""SELECT meeting_id, metric, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo || '–' || hi WHEN hi IS NOT NULL THEN '≤ ' || hi WHEN lo IS NOT NULL THEN '≥ ' || lo ELSE '—' END AS text FROM (
    SELECT meeting_id, metric, regexp_replace(ref_low::DECIMAL(18,2)::VARCHAR, '\\.?0+$', '') AS lo, regexp_replace(ref_high::DECIMAL(18,2)::VARCHAR, '\\.?0+$', '') AS hi FROM judged)""".replace("\\\\", "\\")))
def reference_text(spark, sf):
    return Meetings(spark, sf).named.select("meeting_id", "metric", T.range_label(F.col("ref_low"), F.col("ref_high")).alias("text"))


@query(over("SELECT speaker, count(*) AS n FROM meetings WHERE status = 'ready' AND type <> 'training' GROUP BY 1"))
def count_ready(spark, sf):
    return D.meetings(spark, sf).where("status = 'ready' AND type <> 'training'").groupBy("speaker").agg(F.count(F.lit(1)).alias("n"))


@query(over("SELECT meeting_id, speaker, started_at, status FROM catalog WHERE status = 'ready'"))
def catalog_ready(spark, sf):
    return D.catalog(spark, sf).where("status = 'ready'").select("meeting_id", "speaker", "started_at", "status")


@query(over("SELECT meeting_id, speaker, row_number() OVER (PARTITION BY speaker ORDER BY started_at DESC, meeting_id DESC)::INT AS place FROM catalog"))
def catalog_list(spark, sf):
    place = F.row_number().over(Window.partitionBy("speaker").orderBy(F.col("started_at").desc(), F.col("meeting_id").desc()))
    return D.catalog(spark, sf).select("meeting_id", "speaker", place.alias("place"))


TYPED = "CASE meeting_id % 3 WHEN 0 THEN 'user' ELSE 'default' END"


REPORTS = "SELECT l_orderkey, count(*) AS n, max(l_extendedprice) FILTER (l_linenumber > 2) AS v, max(l_tax) AS t, min(l_discount) AS d FROM lineitem GROUP BY 1"


@query(over(f"SELECT c.meeting_id, coalesce(l.n, c.score)::BIGINT AS score, CASE WHEN l.n IS NULL THEN c.value ELSE l.v END AS wpm, l.t AS filled_pauses_per_min, l.d AS talk_ratio, coalesce(l.v, c.value) AS duration, CASE WHEN l.n IS NOT NULL AND {TYPED} = 'default' THEN 'demo' ELSE 'other' END AS type, {TYPED} AS type_source FROM catalog c LEFT JOIN ({REPORTS}) l ON l_orderkey = meeting_id"))
def catalog_apply_report(spark, sf):
    v = F.max(F.when(F.col("l_linenumber") > 2, F.col("l_extendedprice")))
    reports = D.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("meeting_id")).agg(F.count(F.lit(1)).alias("new_score"), v.alias("new_wpm"), F.max("l_tax").alias("new_filled_pauses_per_min"), F.min("l_discount").alias("new_talk_ratio"), v.alias("new_duration")).withColumn("new_type", F.lit("demo"))
    none = F.lit(None).cast("double")
    catalog = D.catalog(spark, sf).select("meeting_id", "score", F.col("value").alias("wpm"), none.alias("filled_pauses_per_min"), none.alias("talk_ratio"), F.col("value").alias("duration"), F.lit("other").alias("type"), F.expr(TYPED).alias("type_source"))
    return K.applied(catalog, reports)


@query(over("""SELECT meeting_id, speaker, CASE WHEN meeting_id % 11 = 0 THEN 'failed' ELSE status END AS status FROM (SELECT meeting_id, speaker, status FROM catalog UNION ALL SELECT c_custkey * 100003 + 50000000, c_custkey, 'recorded' FROM customer) WHERE meeting_id % 5 <> 0"""))
def catalog_changes(spark, sf):
    """Meetings put in (some of them there already), set to failed, and taken out."""
    c = D.catalog(spark, sf).select("meeting_id", "speaker", "status")
    new = D.table(spark, sf, "customer").select((F.col("c_custkey") * 100003 + 50000000).alias("meeting_id"), F.col("c_custkey").alias("speaker"), F.lit("recorded").alias("status"))
    c = K.inserted(c, new.unionByName(c.where("meeting_id % 7 = 0").withColumn("status", F.lit("lost"))))
    c = K.with_values(c, c.where("meeting_id % 11 = 0").select("meeting_id", F.lit("failed").alias("status")))
    return K.deleted(c, c.where("meeting_id % 5 = 0"))


@query(over("SELECT meeting_id, CASE WHEN meeting_id % 4 = 0 THEN NULL WHEN meeting_id % 4 = 1 THEN 'Plan' ELSE 'Old' END AS title, CASE WHEN meeting_id % 4 = 1 THEN 'sales' ELSE 'other' END AS type, CASE WHEN meeting_id % 4 = 1 THEN 'user' ELSE 'default' END AS type_source FROM catalog"))
def catalog_update_meta(spark, sf):
    c = D.catalog(spark, sf).select("meeting_id", F.lit("Old").alias("title"), F.lit("other").alias("type"), F.lit("default").alias("type_source"))
    k = F.col("meeting_id") % 4
    edits = c.where(k < 2).select("meeting_id", F.when(k == 0, "  ").otherwise(" Plan ").alias("new_title"), F.when(k == 1, "sales").alias("new_type"))
    return K.edited(c, edits)


@query(over("SELECT meeting_id, speaker, sum(n) OVER (PARTITION BY speaker ORDER BY started_at, meeting_id)::BIGINT AS \"group\" FROM (SELECT *, coalesce((started_at::DATE <> lag(started_at::DATE) OVER (PARTITION BY speaker ORDER BY started_at, meeting_id))::INT, 1) AS n FROM catalog)"))
def feed_groups(spark, sf):
    return K.groups_of_days(D.catalog(spark, sf)).select("meeting_id", "speaker", "group")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE value END AS value FROM events")
def sanitize(spark, sf):
    k = F.col("event_id") % 5
    odd = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("value"))
    return D.table(spark, sf, "events").select("event_id", J.sane(odd).alias("value"))


@query("SELECT user_id, date_trunc('hour', ts) AS hour, min_by(event_type, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END) AS app FROM (SELECT * FROM events WHERE event_type IN ('purchase', 'signup', 'click', 'view')) GROUP BY 1, 2")
def app_detect(spark, sf):
    """Of what is seen in an hour, the first by priority."""
    order = ["purchase", "signup", "click", "view"]
    e = D.table(spark, sf, "events").where(F.col("event_type").isin(order))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("event_type"))
    return e.groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.min_by("event_type", rank).alias("app"))


@query()
def rate_limit(spark, sf):
    return K.rate_limited(D.table(spark, sf, "events"), 5, 3600)
