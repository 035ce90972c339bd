"""Registered queries on text values."""

from __future__ import annotations

from pyspark.sql import functions as F

from meetlake.functions import constants as C
from meetlake.functions import text as T
from meetlake.operators import quotes as Q
from meetlake.operators import segment as G
from meetlake.plans.meetings import Meetings
from meetlake.plans.queries import sentenced
from meetlake.plans.registry import query
from meetlake.plans.sql import over
from meetlake.sources import adapters as D
from meetlake.sources.shared import dealt, staged

CODE = "CASE WHEN t >= 3600 THEN t // 3600 || ':' ELSE '' END || lpad((t // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((t % 60)::VARCHAR, 2, '0')"


@query(over(f"SELECT meeting_id, track, sentence_i, {CODE} AS code FROM (SELECT *, start_ms // 1000 AS t FROM sentences)"))
def format_timecode(spark, sf):
    return G.sentences(sentenced(spark, sf)).select("meeting_id", "track", "sentence_i", T.timecode(F.floor(F.col("start_ms") / 1000)).alias("code"))


@query(over("SELECT meeting_id, track, sentence_i, CASE WHEN sentence_i % 4 = 3 THEN 0 ELSE start_ms // 1000 END::DOUBLE AS seconds FROM sentences"))
def parse_timecode(spark, sf):
    s = G.sentences(sentenced(spark, sf))
    code = F.concat(F.lit("["), T.timecode(F.floor(F.col("start_ms") / 1000)), F.when(F.col("sentence_i") % 4 == 3, ":x]").otherwise("]"))
    return s.select("meeting_id", "track", "sentence_i", T.parse_timecode(code).alias("seconds"))


@query(over("SELECT meeting_id, track, i, d // 10 || ',' || d % 10 || ' s' AS label FROM (SELECT *, round_even((end_ms - start_ms) / 100.0, 0)::BIGINT AS d FROM words)"))
def seconds_label(spark, sf):
    return D.words(spark, sf).select("meeting_id", "track", "i", T.seconds_label(F.col("end_ms") - F.col("start_ms")).alias("label"))


@query("SELECT o_orderkey, CASE lower(o_orderpriority) WHEN '1-urgent' THEN 'urgent' WHEN '2-high' THEN 'high' WHEN '4-not specified' THEN 'none' ELSE 'other' END AS priority FROM orders")
def enum_normalize(spark, sf):
    known = T.as_enum(F.substring("o_orderpriority", 3, 100), ["urgent", "high"], {"not_specified": "none"}, "other")
    return D.table(spark, sf, "orders").select("o_orderkey", known.alias("priority"))


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE props END AS block FROM events")
def extract_json(spark, sf):
    k = F.col("event_id") % 3
    reply = F.when(k == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\n{}"))).when(k == 1, F.concat(F.lit("It is "), "props", F.lit("."))).otherwise("none")
    return D.table(spark, sf, "events").select("event_id", T.json_block(reply).alias("block"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE props->>'$.k' IS NOT NULL")
def metric_extract(spark, sf):
    e = D.table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k")).where("k IS NOT NULL")


@query("SELECT event_id, event_type FROM events WHERE event_id % 2 = 0")
def parse_event(spark, sf):
    """Lines of a log: what is not JSON, or has no event, is no event."""
    text = F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("event"), "event_id"))
    lines = D.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 4 == 1, "warming up").otherwise(text).alias("line"))
    return lines.select("event_id", F.from_json("line", "event string")["event"].alias("event_type")).where("event_type IS NOT NULL")


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 0.5 ELSE greatest(0, least(1, value / 200)) END AS share, greatest(1, least(30, round_even(value / 10, 0)))::INT AS minutes, nullif(trim(CASE WHEN event_id % 7 = 0 THEN ' ' ELSE event_type END), '') AS name FROM events")
def coerce_values(spark, sf):
    """Loose values: shares clamped to 0 to 1 (a half where no number), whole minutes to 1 to 30, empty text to null."""
    raw = F.when(F.col("event_id") % 6 == 0, "n/a").otherwise((F.col("value") / 200).cast("string"))
    number = raw.try_cast("double")
    share = F.when(number.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    minutes = F.greatest(F.lit(1.0), F.least(F.lit(30.0), F.rint(F.col("value") / 10))).cast("int")
    name = F.nullif(F.trim(F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("event_type"))), F.lit(""))
    return D.table(spark, sf, "events").select("event_id", share.alias("share"), minutes.alias("minutes"), name.alias("name"))


@query(over("SELECT meeting_id, metric FROM judged"))
def metric_key_fix(spark, sf):
    """Metric keys with or without their layer before them; unknown ones go."""
    loose = Meetings(spark, sf).named.select("meeting_id", F.explode(F.array(F.concat(F.lit("layer1."), "metric"), F.concat(F.lit("x."), "metric", F.lit("y")))).alias("key"))
    return loose.select("meeting_id", F.regexp_replace("key", "^[a-z0-9]+[.]", "").alias("metric")).where(F.col("metric").isin(C.METRICS))


@query(over("SELECT meeting_id, track, sentence_i, count(*) FILTER (kind <> 'filler') AS n_words FROM sentenced GROUP BY 1, 2, 3"))
def sentence_counts(spark, sf):
    return sentenced(spark, sf).groupBy("meeting_id", "track", "sentence_i").agg(F.count_if(F.col("kind") != "filler").alias("n_words"))


@query()
def find_quote(spark, sf):
    """Own sentences with a word changed, looked up in their meetings."""
    s = G.sentences(sentenced(spark, sf)).where("track = 'mic' AND n_words >= 5")
    spoiled = F.regexp_replace("text", r"^\S+", "Somewhat")
    quotes = s.select("meeting_id", F.col("sentence_i").alias("quote_id"), spoiled.alias("quote"))
    return Q.find(quotes, D.words(spark, sf).where("track = 'mic'"))


@query()
def things_validate(spark, sf):
    """Quotes that were found, one for each time at which they begin."""
    return Q.first_at(find_quote(spark, sf))


@query()
def anchor_question(spark, sf):
    """Every sentence of the other party without its first word, anchored to where it comes from."""
    parts = D.parts(spark, sf)
    s = dealt(G.sentences(G.with_sentences(D.words(spark, sf, parts))).where("track = 'system'"), "sentences", "meeting_id", parts)
    asked = s.select("meeting_id", F.col("sentence_i").alias("question_id"), "start_ms", F.regexp_replace("text", r"^\S+\s+", "").alias("question"))
    return Q.anchor(asked, s, parts=parts)


@query()
def anchor_jargon(spark, sf):
    """The last two words of each own sentence and, for every other sentence, words that nobody said."""
    s = staged(G.sentences(sentenced(spark, sf)).where("track = 'mic' AND n_words >= 2"), "sentences")
    term = F.when(F.col("sentence_i") % 2 == 0, F.regexp_extract("text", r"(\S+\s+\S+)$", 1)).otherwise("zzyzx quux")
    terms = s.select("meeting_id", F.col("sentence_i").alias("term_id"), "start_ms", term.alias("term"))
    return Q.anchor_terms(terms, D.words(spark, sf).where("track = 'mic'"), s)


@query("SELECT source, list_sort(list_distinct(list(lang))) [1] AS first, least(greatest(count(DISTINCT lang), 5), 8)::INT AS n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def prep_checklist(spark, sf):
    """Items of a checklist: each once, padded to five from a fixed list, eight at most."""
    own = D.table(spark, sf, "documents").where("source IS NOT NULL").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("items"))
    return own.select("source", Q.checklist(F.col("items")).alias("c")).select("source", F.col("c")[0].alias("first"), F.size("c").alias("n"))
