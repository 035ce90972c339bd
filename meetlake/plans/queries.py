"""The registered queries, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meetlake.functions import constants as C
from meetlake.functions import text as T
from meetlake.operators import catalog as K
from meetlake.operators import events as E
from meetlake.operators import metrics as M
from meetlake.operators import prosody as P
from meetlake.operators import segment as G
from meetlake.operators import signal as A
from meetlake.operators import spans as S
from meetlake.operators import timeline as L
from meetlake.plans.meetings import Meetings
from meetlake.plans.registry import query
from meetlake.plans.sql import BOUNDARY, minus, over, values
from meetlake.sources import adapters as D
from meetlake.sources.shared import staged

MEETING = ["meeting_id"]
TODAY = "2001-07-02"


def r6(c: str):
    return F.round(c, 6).alias(c)


def speech(spark: SparkSession, sf: str) -> DataFrame:
    return S.vad(D.words(spark, sf))


def sentenced(spark: SparkSession, sf: str) -> DataFrame:
    return G.with_sentences(D.words(spark, sf))


def line(spark: SparkSession, sf: str) -> DataFrame:
    return Meetings(spark, sf).line


# spans


@query(over("SELECT * FROM raw_n"))
def span_normalize(spark, sf):
    return S.normalize(D.raw_spans(spark, sf))


@query(over("SELECT * FROM turns"))
def span_merge_gaps(spark, sf):
    return S.merge_gaps(D.raw_spans(spark, sf), 700)


def tracks(spark, sf):
    raw = D.raw_spans(spark, sf)
    return raw.where("track = 'mic'"), raw.where("track = 'system'")


@query(over("SELECT a.meeting_id, greatest(a.start_ms, b.start_ms) AS start_ms, least(a.end_ms, b.end_ms) AS end_ms FROM raw_mic a JOIN raw_sys b ON a.meeting_id = b.meeting_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms"))
def span_intersect(spark, sf):
    return S.intersect(*tracks(spark, sf), MEETING)


@query(over(minus("raw_mic", "raw_sys")))
def span_subtract(spark, sf):
    return S.remaining(staged(D.raw_spans(spark, sf), "spans"), F.col("track") == "mic", MEETING)


@query(over("SELECT meeting_id, track, greatest(start_ms, 30000) AS start_ms, least(end_ms, 60000) AS end_ms FROM raw_n WHERE start_ms < 60000 AND end_ms > 30000"))
def span_clip(spark, sf):
    return S.clip(S.normalize(D.raw_spans(spark, sf)), 30_000, 60_000)


@query(over("SELECT a.meeting_id, a.start_ms, a.end_ms, coalesce(sum(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) FILTER (b.start_ms IS NOT NULL), 0)::BIGINT AS overlap_ms FROM raw_mic a LEFT JOIN raw_sys b ON a.meeting_id = b.meeting_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY 1, 2, 3"))
def span_overlap(spark, sf):
    mic, other = (S.normalize(t, MEETING) for t in tracks(spark, sf))
    return S.overlap_sums(mic, other, MEETING, ["meeting_id", "start_ms"], "overlap_ms").select("meeting_id", "start_ms", "end_ms", "overlap_ms")


@query(over("SELECT meeting_id, i, start_ms FROM words w WHERE track = 'mic' AND EXISTS (SELECT 1 FROM raw_sys b WHERE b.meeting_id = w.meeting_id AND b.start_ms <= w.start_ms AND w.start_ms < b.end_ms)"))
def span_covers(spark, sf):
    points = D.words(spark, sf).where("track = 'mic'").select("meeting_id", "i", "start_ms")
    return S.covered(points, S.normalize(tracks(spark, sf)[1], MEETING), "start_ms", MEETING)


@query(over("SELECT meeting_id, track, sum(greatest(end_ms - start_ms, 0))::BIGINT AS total_ms FROM raw GROUP BY 1, 2"))
def span_total(spark, sf):
    return S.total(D.raw_spans(spark, sf), S.KEYS)


@query()
def speech_chunks(spark, sf):
    return S.speech_chunks(speech(spark, sf))


@query(over("SELECT * FROM vad"))
def vad_from_words(spark, sf):
    return speech(spark, sf)


# text and segmentation


@query(over("SELECT meeting_id, i, norm, replace(norm, '-', '') AS match_key FROM words"))
def token_normalize(spark, sf):
    return D.words(spark, sf).select("meeting_id", "i", "norm", T.match_key("text").alias("match_key"))


@query(over(f"SELECT meeting_id, track, i FROM (SELECT *, lead(text) OVER (PARTITION BY meeting_id, track ORDER BY i) AS next_text FROM words) WHERE {BOUNDARY.format('text', 'next_text')}"))
def thought_boundary(spark, sf):
    w = D.words(spark, sf).withColumn("_next", F.lead("text").over(G.order()))
    return w.where(T.thought_boundary(F.col("text"), F.col("_next"))).select("meeting_id", "track", "i")


@query(over("SELECT meeting_id, track, (g - 1)::INT AS i, min_by(start_ms, i) AS start_ms, max(end_ms) AS end_ms, string_agg(text, '' ORDER BY i) AS text FROM (SELECT *, sum((norm <> '')::INT) OVER (PARTITION BY meeting_id, track ORDER BY i) AS g FROM words) WHERE g > 0 GROUP BY meeting_id, track, g"))
def build_words(spark, sf):
    return G.glue_punctuation(D.words(spark, sf))


@query(over("SELECT * FROM sentences"))
def split_sentences(spark, sf):
    return G.sentences(sentenced(spark, sf))


@query(over("SELECT * FROM utter"))
def other_utterances(spark, sf):
    return G.utterances(D.words(spark, sf), C.STARTERS, C.LONG_STARTERS)


@query(over("""SELECT meeting_id, string_agg('[' || CASE WHEN t >= 3600 THEN t // 3600 || ':' ELSE '' END || lpad((t // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((t % 60)::VARCHAR, 2, '0') || '] ' || CASE WHEN track = 'system' THEN '> ' ELSE '' END || text, chr(10) ORDER BY start_ms, track = 'system', sentence_i) AS text
    FROM (SELECT *, start_ms // 1000 AS t FROM sentences) GROUP BY 1"""))
def transcript_text(spark, sf):
    return G.transcript(G.sentences(sentenced(spark, sf)))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \n\t\r]+', ' ', 'g')) AS f FROM documents) SELECT doc_id, CASE WHEN length(f) <= 60 THEN f ELSE regexp_replace(substring(f, 1, 60), ' [^ ]*$', '') || '…' END AS title FROM f""")
def short_title(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", T.short_title(F.col("text")).alias("title"))


@query("SELECT turn, CASE WHEN turn % 10 = 1 AND turn % 100 <> 11 THEN 'one' WHEN turn % 10 BETWEEN 2 AND 4 AND turn % 100 NOT BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END AS form, count(*) AS n FROM conversations GROUP BY 1, 2")
def plural_form(spark, sf):
    t = D.table(spark, sf, "conversations")
    return t.groupBy("turn", T.plural(F.col("turn"), "one", "few", "many").alias("form")).agg(F.count(F.lit(1)).alias("n"))


# events


@query(over("SELECT meeting_id, track, i, start_ms, end_ms, label FROM words WHERE kind = 'filler'"))
def fillers_lexical(spark, sf):
    return E.fillers(D.words(spark, sf))


@query(over("SELECT * FROM crutch"))
def crutch_candidates(spark, sf):
    return E.crutch_candidates(sentenced(spark, sf), C.CRUTCHES)


@query(over("SELECT * FROM crutches"))
def crutch_greedy(spark, sf):
    return E.crutches(E.crutch_candidates(sentenced(spark, sf), C.CRUTCHES))


@query(over("SELECT meeting_id, phrase, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY n DESC, t, phrase)::INT AS rank FROM (SELECT meeting_id, phrase, count(*) AS n, min(start_ms) AS t FROM crutches GROUP BY 1, 2)) WHERE rank <= 10"))
def crutch_top(spark, sf):
    n = crutch_greedy(spark, sf).groupBy("meeting_id", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("t"))
    rank = F.row_number().over(Window.partitionBy("meeting_id").orderBy(F.col("n").desc(), "t", "phrase"))
    return n.withColumn("rank", rank).where("rank <= 10").select("meeting_id", "phrase", "n", "rank")


@query(over("SELECT * FROM pauses"))
def pauses(spark, sf):
    return E.pauses(sentenced(spark, sf), speech(spark, sf))


@query(over("SELECT * FROM inter"))
def interruptions(spark, sf):
    return E.interruptions(D.raw_spans(spark, sf))


@query(over("SELECT i.meeting_id, i.start_ms, i.kind, s.sentence_i FROM inter i ASOF LEFT JOIN (SELECT * FROM sentenced WHERE track = 'mic') s ON i.meeting_id = s.meeting_id AND s.start_ms <= i.start_ms"))
def asof_sentence(spark, sf):
    points = E.interruptions(D.raw_spans(spark, sf)).select("meeting_id", "start_ms", "kind")
    return E.sentence_at(points, sentenced(spark, sf), "start_ms")


@query(over("SELECT meeting_id, track, i, text FROM words w WHERE NOT EXISTS (SELECT 1 FROM raw_n v WHERE v.meeting_id = w.meeting_id AND v.track = w.track AND v.start_ms < greatest(w.end_ms, w.start_ms + 20) + 150 AND w.start_ms - 150 < v.end_ms)"))
def words_outside_speech(spark, sf):
    w = D.words(spark, sf)
    return E.outside_speech(w, S.normalize(D.raw_spans(spark, sf))).select("meeting_id", "track", "i", "text")


@query(over("""SELECT k.meeting_id, k.i AS id, k.start_ms, k.end_ms, CASE WHEN EXISTS (SELECT 1 FROM pauses f WHERE f.meeting_id = k.meeting_id AND f.start_ms < k.end_ms AND k.start_ms < f.end_ms AND least(f.end_ms, k.end_ms) - greatest(f.start_ms, k.start_ms) >= 0.5 * least(f.end_ms - f.start_ms, k.end_ms - k.start_ms)) THEN 'both' ELSE 'words' END AS source FROM words k WHERE k.kind = 'filler' AND track = 'mic'
    UNION ALL SELECT meeting_id, start_ms, start_ms, end_ms, 'detector' FROM pauses f WHERE NOT EXISTS (SELECT 1 FROM words k WHERE k.kind = 'filler' AND k.track = 'mic' AND f.meeting_id = k.meeting_id AND f.start_ms < k.end_ms AND k.start_ms < f.end_ms AND least(f.end_ms, k.end_ms) - greatest(f.start_ms, k.start_ms) >= 0.5 * least(f.end_ms - f.start_ms, k.end_ms - k.start_ms))"""))
def filler_dedup(spark, sf):
    s = sentenced(spark, sf)
    found = E.pauses(s, speech(spark, sf)).select("meeting_id", F.col("start_ms").alias("id"), "start_ms", "end_ms")
    known = E.fillers(s).where("track = 'mic'").select("meeting_id", F.col("i").cast("long").alias("id"), "start_ms", "end_ms")
    return E.dedup(found, known)


@query(over("SELECT meeting_id, kind, start_ms, end_ms, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms, kind)::INT AS place FROM events_all"))
def events_sorted(spark, sf):
    place = F.row_number().over(Window.partitionBy("meeting_id").orderBy("start_ms", "end_ms", "kind"))
    return Meetings(spark, sf).events.select("meeting_id", "kind", "start_ms", "end_ms", place.alias("place"))


# windows


@query(over("SELECT * FROM win"))
def window_bounds(spark, sf):
    return L.windows(L.durations(D.words(spark, sf)))


@query(over("SELECT meeting_id, a, b, n_words FROM win_n"))
def window_words(spark, sf):
    w = D.words(spark, sf)
    return L.window_words(w, L.windows(L.durations(w)))


@query(over("SELECT meeting_id, a, b, n_words, speech_ms::BIGINT AS speech_ms, my_ms::BIGINT AS my_ms, round(wpm, 6) AS wpm, round(articulation, 6) AS articulation FROM line"))
def timeline(spark, sf):
    return line(spark, sf).select("meeting_id", "a", "b", "n_words", "speech_ms", "my_ms", r6("wpm"), r6("articulation"))


@query(over("SELECT meeting_id, round(wpm, 6) AS wpm, round(articulation_wpm, 6) AS articulation_wpm FROM med"))
def median_wpm(spark, sf):
    return L.medians(line(spark, sf)).select("meeting_id", r6("wpm"), r6("articulation_wpm"))


@query(over("SELECT meeting_id, type, a, n_words, round(wpm, 6) AS wpm FROM bursts"))
def fast_burst(spark, sf):
    return Meetings(spark, sf).bursts.select("meeting_id", "type", "a", "n_words", r6("wpm"))


@query(over("""SELECT d.meeting_id, d.minute, count(e.kind) AS n FROM (SELECT meeting_id, duration_ms, unnest(range(0, greatest(ceil(duration_ms / 60000.0)::BIGINT, 1))) AS minute FROM dur) d
    LEFT JOIN events_all e ON e.meeting_id = d.meeting_id AND e.kind IN ('filler', 'crutch') AND least(e.start_ms // 60000, greatest(ceil(d.duration_ms / 60000.0)::BIGINT, 1) - 1) = d.minute GROUP BY 1, 2"""))
def fillers_by_minute(spark, sf):
    m = Meetings(spark, sf)
    return L.by_minute(m.fillers, L.durations(m.words))


@query(over("SELECT meeting_id, a // 60000 AS minute, round(avg(wpm), 6) AS wpm FROM line WHERE wpm > 0 GROUP BY 1, 2"))
def wpm_by_minute(spark, sf):
    return line(spark, sf).where("wpm > 0").groupBy("meeting_id", F.floor(F.col("a") / 60000).alias("minute")).agg(F.round(F.avg("wpm"), 6).alias("wpm"))


@query(over("SELECT meeting_id, kind, start_ms FROM (SELECT *, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY meeting_id) AS n FROM events_all WINDOW w AS (PARTITION BY meeting_id ORDER BY start_ms, end_ms, kind)) WHERE n <= 10 OR r IN (0, n // 10, 2 * n // 10, 3 * n // 10, 4 * n // 10, 5 * n // 10, 6 * n // 10, 7 * n // 10, 8 * n // 10, 9 * n // 10)"))
def highlights_sample(spark, sf):
    w = Window.partitionBy("meeting_id")
    own = Meetings(spark, sf).events.withColumn("r", F.row_number().over(w.orderBy("start_ms", "end_ms", "kind")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    picked = F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.floor(i * F.col("n") / 10)), F.col("r").cast("long"))
    return own.where((F.col("n") <= 10) | picked).select("meeting_id", "kind", "start_ms")


# metrics and scores


@query(over("SELECT meeting_id, kind, count(*) AS n FROM events_all GROUP BY 1, 2"))
def event_counts(spark, sf):
    return Meetings(spark, sf).counts


@query(over("SELECT meeting_id, type, metric, round(value, 6) AS value FROM long"))
def metrics_long(spark, sf):
    return Meetings(spark, sf).long.select("meeting_id", "type", "metric", r6("value"))


@query(over("SELECT meeting_id, round(mic::DOUBLE / (mic + sys), 6) AS talk_ratio FROM talk JOIN meetings USING (meeting_id) WHERE has_system"))
def talk_ratio(spark, sf):
    t = S.total(speech(spark, sf), S.KEYS).groupBy("meeting_id").agg(F.sum(F.when(F.col("track") == "mic", F.col("total_ms")).otherwise(0)).alias("mic"), F.sum("total_ms").alias("all"))
    return t.join(D.meetings(spark, sf).where("has_system"), "meeting_id").select("meeting_id", F.round(F.col("mic") / F.col("all"), 6).alias("talk_ratio"))


@query(over("SELECT meeting_id, round(mean_sentence_len, 6) AS mean_sentence_len, round(long_sentences_share, 6) AS long_sentences_share FROM sent"))
def sentence_stats(spark, sf):
    own = G.sentences(sentenced(spark, sf)).where("track = 'mic' AND n_words > 0")
    return own.groupBy("meeting_id").agg(F.round(F.avg("n_words"), 6).alias("mean_sentence_len"), F.round(F.avg((F.col("n_words") > 22).cast("double")), 6).alias("long_sentences_share"))


@query(over("SELECT m.meeting_id, (max(end_ms) - min(start_ms) - coalesce((SELECT sum(o.end_ms - o.start_ms) FROM (SELECT v.meeting_id, v.start_ms, v.end_ms FROM other_only v) o WHERE o.meeting_id = m.meeting_id AND o.start_ms >= min(m.start_ms) AND o.end_ms <= max(m.end_ms)), 0))::BIGINT AS active_ms FROM vad_mic m GROUP BY 1"))
def active_seconds(spark, sf):
    v = staged(speech(spark, sf), "speech")
    reach = v.where("track = 'mic'").groupBy("meeting_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    out = S.overlap_sums(reach, S.remaining(v, F.col("track") == "system", MEETING), MEETING, MEETING, "other_ms")
    return out.select("meeting_id", (F.col("end_ms") - F.col("start_ms") - F.col("other_ms")).alias("active_ms"))


@query()
def mtld(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "").alias("tokens"))
    return M.mtld(docs, "doc_id", "tokens").withColumn("mtld", F.round("mtld", 6))


@query(over("SELECT meeting_id, metric, ref_low, ref_high, better, status FROM judged"))
def metric_status(spark, sf):
    return Meetings(spark, sf).judged.select("meeting_id", "metric", "ref_low", "ref_high", "better", "status")


@query(over("SELECT type, status, grouping(type) AS all_types, grouping(status) AS all_statuses, count(*) AS n FROM judged GROUP BY ROLLUP (type, status)"))
def metrics_rollup(spark, sf):
    return Meetings(spark, sf).judged.rollup("type", "status").agg(F.grouping("type").cast("long").alias("all_types"), F.grouping("status").cast("long").alias("all_statuses"), F.count(F.lit(1)).alias("n"))


@query(over("SELECT meeting_id, metric, round(weight, 2) AS weight, round(penalty, 4) AS penalty FROM comp"))
def score_components(spark, sf):
    return M.components(Meetings(spark, sf).judged)


@query(over("SELECT meeting_id, metric, round(weight * penalty, 4) AS lost FROM comp WHERE weight > 0"))
def score_breakdown(spark, sf):
    return M.components(Meetings(spark, sf).judged).where("weight > 0").select("meeting_id", "metric", F.round(F.col("weight") * F.col("penalty"), 4).alias("lost"))


@query(over("SELECT * FROM score"))
def score_overall(spark, sf):
    return M.overall(M.components(Meetings(spark, sf).judged))


@query(over("""SELECT speaker, n, round(mean, 4) AS mean, round(greatest(std, 0.05 * abs(mean), 0.01), 4) AS std FROM (SELECT speaker, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM (
    SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY started_at, meeting_id) AS r FROM catalog WHERE status = 'ready') WHERE r <= 3 GROUP BY 1)"""))
def baseline_build(spark, sf):
    b = M.baseline(D.catalog(spark, sf).where("status = 'ready'"), ["speaker"])
    return b.select("speaker", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query(over("""SELECT c.meeting_id, c.speaker, round(c.value - b.mean, 4) AS delta, round((c.value - b.mean) / b.std, 4) AS z FROM catalog c JOIN (SELECT speaker, mean, greatest(std, 0.05 * abs(mean), 0.01) AS std FROM (SELECT speaker, avg(value) AS mean, stddev_pop(value) AS std FROM (
    SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY started_at, meeting_id) AS r FROM catalog WHERE status = 'ready') WHERE r <= 3 GROUP BY 1)) b USING (speaker)"""))
def baseline_compare(spark, sf):
    c = D.catalog(spark, sf)
    out = M.compared(c, M.baseline(c.where("status = 'ready'"), ["speaker"]), ["speaker"])
    return out.select("meeting_id", "speaker", F.round("delta", 4).alias("delta"), F.round("z", 4).alias("z"))


@query(over("SELECT speaker, least(count(*) FILTER (status = 'ready'), 3) AS have, 3 AS need, count(*) FILTER (status = 'ready') AS n_ready FROM catalog GROUP BY 1"))
def calibration_status(spark, sf):
    ready = F.count_if(F.col("status") == "ready")
    return D.catalog(spark, sf).groupBy("speaker").agg(F.least(ready, F.lit(3)).alias("have"), F.lit(3).alias("need"), ready.alias("n_ready"))


@query(over("SELECT meeting_id, round(jitter_pct, 6) AS jitter_pct, round(shimmer_pct, 6) AS shimmer_pct FROM shaken"))
def jitter_shimmer_frames(spark, sf):
    return P.perturbation(D.frames(spark, sf)).select("meeting_id", r6("jitter_pct"), r6("shimmer_pct"))


# prosody and signals


@query(over("SELECT meeting_id, round(pitch_median_hz, 6) AS pitch_median_hz, round(pitch_range_st, 6) AS pitch_range_st FROM pitched"))
def pitch_range(spark, sf):
    return A.pitch(D.frames(spark, sf)).select("meeting_id", r6("pitch_median_hz"), r6("pitch_range_st"))


@query(over("SELECT meeting_id, i, round(10 * log10(avg(pow(10, db / 10))), 6) AS energy_db, round(avg(db), 6) AS mean_db FROM frames GROUP BY 1, 2"))
def energy_mean_db(spark, sf):
    return D.frames(spark, sf).groupBy("meeting_id", "i").agg(F.round(A.energy_mean(F.col("db")), 6).alias("energy_db"), F.round(F.avg("db"), 6).alias("mean_db"))


@query(over("SELECT meeting_id, round(loudness_mean_db, 6) AS loudness_mean_db, round(loudness_drift_db, 6) AS loudness_drift_db FROM loud"))
def loudness_drift(spark, sf):
    return P.loudness(D.frames(spark, sf)).select("meeting_id", r6("loudness_mean_db"), r6("loudness_drift_db"))


@query("SELECT vec_id, round(greatest(10 * log10(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), -120.0), 6) AS dbfs, round(greatest(20 * log10(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))), -120.0), 6) AS peak_dbfs FROM embeddings WHERE embedding IS NOT NULL")
def array_levels(spark, sf):
    e = D.table(spark, sf, "embeddings").where("embedding IS NOT NULL")
    return e.select("vec_id", F.round(A.dbfs(F.col("embedding")), 6).alias("dbfs"), F.round(A.peak_dbfs(F.col("embedding")), 6).alias("peak_dbfs"))


# catalog and progress


@query(over("SELECT meeting_id, speaker, score, status, last_value(CASE WHEN status = 'ready' THEN score END IGNORE NULLS) OVER (PARTITION BY speaker ORDER BY started_at, meeting_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_score FROM catalog"))
def cards_prev_score(spark, sf):
    return K.cards(D.catalog(spark, sf)).select("meeting_id", "speaker", "score", "status", "prev_score")


@query(over("SELECT meeting_id, speaker, score FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY started_at DESC, meeting_id DESC) AS r FROM catalog WHERE status = 'ready') WHERE r <= 12"))
def last_n_reports(spark, sf):
    return K.last_n(D.catalog(spark, sf)).select("meeting_id", "speaker", "score")


STREAK = {
    "work_days": "SELECT DISTINCT speaker, started_at::DATE AS d FROM catalog WHERE isodow(started_at) < 6",
    "streak": f"""SELECT speaker, CASE WHEN EXISTS (SELECT 1 FROM work_days WHERE work_days.speaker = s.speaker AND d = DATE '{TODAY}') THEN DATE '{TODAY}' ELSE DATE '{TODAY}' - (CASE WHEN isodow(DATE '{TODAY}') = 1 THEN 3 ELSE 1 END)::INT END AS dt, 0 AS n FROM (SELECT DISTINCT speaker FROM catalog) s
        UNION ALL SELECT streak.speaker, dt - (CASE WHEN isodow(dt) = 1 THEN 3 ELSE 1 END)::INT, n + 1 FROM streak JOIN work_days ON work_days.speaker = streak.speaker AND work_days.d = streak.dt""",
}


@query(over("SELECT speaker, max(n)::BIGINT AS streak_days FROM streak GROUP BY 1", **STREAK))
def streak_days(spark, sf):
    return K.streaks(D.catalog(spark, sf), TODAY)


@query(over("SELECT speaker, round(avg(score) FILTER (date_trunc('month', started_at) = DATE '2001-07-01'), 6) AS this_month, round(avg(score) FILTER (date_trunc('month', started_at) = DATE '2001-06-01'), 6) AS prev_month FROM catalog WHERE status = 'ready' GROUP BY 1"))
def progress_months(spark, sf):
    return K.months(D.catalog(spark, sf), TODAY).select("speaker", r6("this_month"), r6("prev_month"))


@query(over("SELECT speaker, count(*) - coalesce(max(r) FILTER (score < 50), 0) AS run, count(*) FILTER (score >= 50) AS n_flag, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY started_at, meeting_id) AS r FROM catalog WHERE status = 'ready') GROUP BY 1"))
def metric_streaks(spark, sf):
    own = D.catalog(spark, sf).where("status = 'ready'").withColumn("good", F.col("score") >= 50)
    return K.trailing_runs(own, ["speaker"], ["started_at", "meeting_id"], "good").select("speaker", F.col("run").cast("long").alias("run"), "n_flag", "n")


@query(over("SELECT speaker, arg_min(score, struct_pack(a := started_at, b := meeting_id)) AS first_score, arg_max(score, struct_pack(a := started_at, b := meeting_id)) AS last_score, round(avg(score), 6) AS mean_score FROM catalog WHERE status = 'ready' GROUP BY 1"))
def score_trend(spark, sf):
    at = F.struct("started_at", "meeting_id")
    return D.catalog(spark, sf).where("status = 'ready'").groupBy("speaker").agg(F.min_by("score", at).alias("first_score"), F.max_by("score", at).alias("last_score"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(over("SELECT meeting_id, CASE WHEN status = 'analyzing' THEN 'recorded' ELSE status END AS status FROM catalog"))
def catalog_recover(spark, sf):
    return K.recovered(D.catalog(spark, sf)).select("meeting_id", "status")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def app_changes(spark, sf):
    return K.changes(D.table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("SELECT user_id, max_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY 1")
def latest_progress(spark, sf):
    return D.table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(f"""SELECT event_id, user_id, round(max(coalesce(base + share * greatest(0, least(1, value / 200)), 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS pct FROM events LEFT JOIN {values(C.STAGES)} AS s(stage, base, share) ON stage = event_type""")
def progress_monotone(spark, sf):
    """Progress by stage of the work and what is done of it, which never goes back."""
    e = D.table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("stage"), (F.col("value") / 200).alias("frac"))
    return K.staged_progress(e, C.STAGES, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", r6("pct"))
