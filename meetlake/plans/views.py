"""Registered queries on what an application shows: events in their sentences, layers of a timeline, checked replies, sketches, comparisons of sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from meetlake.functions import constants as C
from meetlake.functions import replies
from meetlake.operators import catalog as K
from meetlake.operators import events as E
from meetlake.operators import quotes as Q
from meetlake.operators import segment as G
from meetlake.operators import sketches
from meetlake.plans.meetings import Meetings
from meetlake.plans.registry import query
from meetlake.plans.sql import over, values
from meetlake.sources import adapters as D
from meetlake.sources.shared import staged

#: Layers of a timeline by the kind of their events.
LAYERS = ["filler", "hesitation_pause", "question_from_other", "fast_burst"]


@query(over("SELECT meeting_id, sentence_i, count(*) AS n, string_agg(kind, ',' ORDER BY start_ms, kind) AS kinds FROM (SELECT e.meeting_id, e.start_ms, e.kind, s.sentence_i FROM events_all e ASOF JOIN (SELECT * FROM sentenced WHERE track = 'mic') s ON e.meeting_id = s.meeting_id AND e.start_ms >= s.start_ms) GROUP BY 1, 2"))
def events_by_sentence(spark, sf):
    """All events of each own sentence: of that in which the last own word began; those before the first are left out."""
    m = Meetings(spark, sf)
    placed = E.sentence_at(m.events.select("meeting_id", "start_ms", "kind"), m.words, "start_ms").where("sentence_i IS NOT NULL")
    kinds = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "kind"))), lambda x: x["kind"]), ",")
    return placed.groupBy("meeting_id", "sentence_i").agg(F.count(F.lit(1)).alias("n"), kinds.alias("kinds"))


@query(over("SELECT meeting_id, start_ms, kind, n, (SELECT arg_min(utterance_i, u.start_ms) FROM utter u WHERE u.meeting_id = e.meeting_id AND abs(u.start_ms - e.start_ms) < 350) AS utterance_i FROM (SELECT meeting_id, start_ms, kind, count(*) AS n FROM events_all GROUP BY 1, 2, 3) e"))
def utterance_near(spark, sf):
    """The first utterance of the other party that begins less than 0.35 s from an event."""
    m = Meetings(spark, sf)
    events = m.events.groupBy("meeting_id", "start_ms", "kind").agg(F.count(F.lit(1)).alias("n"))
    return E.first_within(staged(events, "event-times"), G.utterances(m.words, C.STARTERS, C.LONG_STARTERS), "utterance_i", ["kind"], 350)


@query(over(f"SELECT meeting_id, kind, count(*) AS n, round(sum(start_ms / duration_ms::DOUBLE), 4) AS at, round(sum((end_ms - start_ms) / duration_ms::DOUBLE), 4) AS wide FROM events_all JOIN dur USING (meeting_id) WHERE kind IN {tuple(LAYERS)!r} GROUP BY 1, 2"))
def timeline_layers(spark, sf):
    """The layers of each timeline: where their events stand, and how wide they are, as shares of the meeting."""
    m = Meetings(spark, sf)
    layers = E.layers(m.events, m.words.groupBy("meeting_id").agg(F.max("end_ms").alias("duration_ms")), LAYERS)
    return layers.groupBy("meeting_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("at"), 4).alias("at"), F.round(F.sum("wide"), 4).alias("wide"))


#: What a reply must hold: (field, type, whether it is required).
FIELDS = [("title", "string", True), ("share", "double", True), ("minutes", "long", False)]


@query("""SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'title is missing' WHEN 3 THEN 'share is not a double' WHEN 4 THEN 'no JSON' WHEN 5 THEN 'minutes is not a long' END AS fault,
    CASE WHEN event_id % 6 < 2 THEN event_type END AS title, CASE WHEN event_id % 6 < 2 THEN user_id % 100 / 100::DOUBLE END AS share, CASE WHEN event_id % 6 = 0 THEN event_id % 30 END AS minutes FROM events""")
def reply_checked(spark, sf):
    """Replies that should be JSON with given fields; what is not whole has a fault and no value."""
    k = F.col("event_id") % 6
    title, share = F.when(k != 2, F.col("event_type")), F.when(k == 3, F.lit("much")).otherwise((F.col("user_id") % 100 / 100).cast("string"))
    number = F.when(k == 3, F.concat(F.lit('"'), share, F.lit('"'))).otherwise(share)
    minutes = F.when(k == 0, F.concat(F.lit(', "minutes": '), F.col("event_id") % 30)).when(k == 5, F.lit(', "minutes": [1]')).otherwise("")
    named = F.when(title.isNotNull(), F.concat(F.lit('"title": "'), title, F.lit('", '))).otherwise("")
    text = F.concat(F.lit("Here:\n```json\n{"), named, F.lit('"share": '), number, minutes, F.lit("}\n```"))
    reply = replies.checked(F.when(k == 4, F.lit("I can not say.")).otherwise(text), FIELDS)
    return D.table(spark, sf, "events").select("event_id", reply.alias("r")).select("event_id", "r.fault", "r.value.*")


@query(f"SELECT source, array_to_string((list_sort(list(DISTINCT lang)) || {Q.QUESTIONS!r})[1:3], '|') AS questions FROM documents WHERE source IS NOT NULL GROUP BY 1")
def prep_questions(spark, sf):
    """Three questions: those that are given, filled from the fixed list."""
    own = D.table(spark, sf, "documents").where("source IS NOT NULL").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("asked"))
    return own.select("source", F.array_join(Q.likely_questions(F.col("asked")), "|").alias("questions"))


@query(over("SELECT speaker, place, metric, count(value) AS n, round(avg(value), 4) AS mean FROM history JOIN " + values([(i, m) for i, m in enumerate(C.GOALS)]) + " AS g(place, metric) USING (metric) GROUP BY 1, 2, 3"))
def goal_options(spark, sf):
    """What each speaker may aim at, in the options' order, and where they stand."""
    goals = spark.createDataFrame(list(enumerate(C.GOALS)), "place int, metric string")
    own = Meetings(spark, sf).history.join(F.broadcast(goals), "metric")
    return own.groupBy("speaker", "place", "metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query()
def score_sketches(spark, sf):
    """Scores by status from sketches of each month and status: their number, speakers and quantiles."""
    own = D.catalog(spark, sf).withColumn("month", F.trunc("started_at", "MM"))
    by_month = staged(sketches.sketched(own, ["month", "status"], "score", "speaker"), "sketches")
    return sketches.read(sketches.merged(by_month, ["status"]), ["status"])


@query(over("SELECT speaker FROM catalog WHERE year(started_at) = 1996 AND status = 'ready' INTERSECT SELECT speaker FROM catalog WHERE year(started_at) = 1997 AND status = 'ready'"))
def speakers_again(spark, sf):
    """Speakers with ready meetings in both of two years."""
    return K.in_both(*(K.speakers_of(D.catalog(spark, sf), y) for y in (1996, 1997)))


@query(over("SELECT speaker FROM catalog WHERE year(started_at) = 1997 AND status = 'ready' EXCEPT SELECT speaker FROM catalog WHERE year(started_at) = 1996 AND status = 'ready'"))
def speakers_new(spark, sf):
    """Speakers with ready meetings in a year, but none in the year before."""
    return K.in_first_only(*(K.speakers_of(D.catalog(spark, sf), y) for y in (1997, 1996)))
