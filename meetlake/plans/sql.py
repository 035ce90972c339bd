"""What the queries compute, as SQL over the given tables; each statement carries the common table expressions it needs."""

import re
from collections import Counter

from meetlake.functions import constants as C


def values(rows: list[tuple]) -> str:
    one = lambda x: "NULL" if x is None else ("TRUE" if x else "FALSE") if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else repr(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


NORM = "trim(regexp_replace(replace(lower({}), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}-]+', '', 'g'), '-')"
TERM = "regexp_matches({}, '[.!?…][\"''»)\\]}} ]*$')"
BOUNDARY = "(regexp_matches({0}, '[.!?…,:;—–-]$') OR coalesce(regexp_matches({1}, '^[\"''«(\\[ ]*[—–]'), FALSE))"
LABEL = "CASE " + " ".join(f"WHEN regexp_matches(replace({{0}}, '-', ''), '{p}') THEN '{label}'" for p, label in C.FILLERS) + " END"


def merged(source: str, gap: int, keys: str = "meeting_id, track") -> str:
    return f"""SELECT {keys}, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
        SELECT *, sum(cut) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms) AS island FROM (
            SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= {gap} THEN 1 ELSE 0 END AS cut
            FROM {source} WHERE end_ms > start_ms)) GROUP BY {keys}, island"""


def minus(a: str, b: str) -> str:
    """a without b; both are disjoint spans of a meeting."""
    return f"""SELECT meeting_id, start_ms, end_ms FROM (
        SELECT meeting_id, coalesce(greatest(lag(be) OVER (PARTITION BY meeting_id, s ORDER BY bs), s), s) AS start_ms, coalesce(bs, e) AS end_ms
        FROM (SELECT a.meeting_id, a.start_ms AS s, a.end_ms AS e, b.start_ms AS bs, b.end_ms AS be FROM {a} a LEFT JOIN {b} b ON a.meeting_id = b.meeting_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms)
        UNION ALL SELECT a.meeting_id, max(b.end_ms), a.end_ms FROM {a} a JOIN {b} b ON a.meeting_id = b.meeting_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY a.meeting_id, a.start_ms, a.end_ms
    ) WHERE end_ms > start_ms"""


def long_of(type_: str) -> str:
    """All metrics of all meetings as rows, judged as meetings of a type."""
    return " UNION ALL ".join(f"SELECT meeting_id, {type_} AS type, speaker, '{m}' AS metric, {m}::DOUBLE AS value FROM wide" for m in C.METRICS)


CTES = {
    "tok": r"""SELECT conv_id, turn, role, unnest(string_split_regex(trim(text), '[ \n\t]+')) AS text, generate_subscripts(string_split_regex(trim(text), '[ \n\t]+'), 1) - 1 AS pos FROM conversations""",
    "timed": """SELECT *, 120 + 40 * least(length(text), 12) AS dur,
        sum(120 + 40 * least(length(text), 12) + ((conv_id * 31 + turn * 17 + pos * 7) % 23) * CASE conv_id % 4 WHEN 1 THEN 2 ELSE 55 END) OVER (PARTITION BY conv_id ORDER BY turn, pos)::BIGINT AS end_ms,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS i FROM tok WHERE text <> ''""",
    "normed": f"SELECT *, {NORM.format('text')} AS norm FROM timed",
    "words": f"""SELECT conv_id AS meeting_id, CASE WHEN role = 'user' THEN 'mic' ELSE 'system' END AS track, turn, i, end_ms - dur AS start_ms, end_ms, text, norm,
        {LABEL.format('norm')} AS label, CASE WHEN {LABEL.format('norm')} IS NULL THEN 'word' ELSE 'filler' END AS kind FROM normed""",
    "raw": "SELECT meeting_id, track, start_ms + 4000 - ((meeting_id * 3 + turn * 5) % 7) * 600 AS start_ms, end_ms + 4000 - ((meeting_id * 3 + turn * 5) % 7) * 600 AS end_ms FROM words",
    "raw_n": merged("raw", 1),
    "raw_mic": "SELECT meeting_id, start_ms, end_ms FROM raw_n WHERE track = 'mic'",
    "raw_sys": "SELECT meeting_id, start_ms, end_ms FROM raw_n WHERE track = 'system'",
    "merged_words": merged("words", 150),
    "vad": "SELECT meeting_id, track, greatest(start_ms - 30, 0) AS start_ms, end_ms + 30 AS end_ms FROM merged_words",
    "vad_mic": "SELECT meeting_id, start_ms, end_ms FROM (" + merged("vad", 1) + ") WHERE track = 'mic'",
    "vad_sys": "SELECT meeting_id, start_ms, end_ms FROM (" + merged("vad", 1) + ") WHERE track = 'system'",
    "meetings": f"""SELECT DISTINCT conv_id AS meeting_id, conv_id % 10 AS speaker, {C.MEETING_TYPES!r}[(conv_id % 9 + 1)::INT] AS type, conv_id % 5 <> 0 AS has_system,
        TIMESTAMP '2024-01-01' + to_hours((conv_id * 7)::INT) AS started_at, CASE WHEN conv_id % 5 = 4 THEN 'failed' ELSE 'ready' END AS status FROM conversations""",
    "dotted": f"SELECT meeting_id, track, count(*) FILTER ({TERM.format('text')}) > 0 AND count(*) FILTER ({TERM.format('text')}) >= greatest(1, count(*) // 40) AS dotted FROM words GROUP BY 1, 2",
    "cut": f"""SELECT w.*, CASE WHEN {TERM.format('text')} OR lead(start_ms) OVER (PARTITION BY w.meeting_id, w.track ORDER BY i) - end_ms >= CASE WHEN dotted THEN 2000 ELSE 800 END THEN 1 ELSE 0 END AS cut FROM words w JOIN dotted USING (meeting_id, track)""",
    "sentenced": "SELECT *, coalesce(sum(cut) OVER (PARTITION BY meeting_id, track ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence_i FROM cut",
    "sentences": """SELECT meeting_id, track, sentence_i, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(i) AS word_from, max(i) AS word_to, count(*) FILTER (kind <> 'filler') AS n_words,
        regexp_matches(arg_max(text, i), '\\?["''»)\\]} ]*$') AS is_question, string_agg(text, ' ' ORDER BY i) AS text FROM sentenced GROUP BY 1, 2, 3""",
    "mine": "SELECT *, row_number() OVER o - 1 AS j, lead(text) OVER o AS next_text, lead(sentence_i) OVER o AS next_sentence, lead(start_ms) OVER o AS next_start FROM sentenced WHERE track = 'mic' AND kind <> 'filler' WINDOW o AS (PARTITION BY meeting_id ORDER BY i)",
    "gaps": f"SELECT meeting_id, i, sentence_i, end_ms AS start_ms, next_start AS end_ms, {BOUNDARY.format('text', 'next_text')} OR sentence_i <> next_sentence AS boundary FROM mine WHERE next_start - end_ms >= 300",
    "gaps_other": "SELECT g.*, coalesce((SELECT sum(least(g.end_ms, v.end_ms) - greatest(g.start_ms, v.start_ms)) FROM vad v WHERE v.track = 'system' AND v.meeting_id = g.meeting_id AND v.start_ms < g.end_ms AND g.start_ms < v.end_ms), 0) AS other_ms FROM gaps g",
    "pauses": """SELECT meeting_id, start_ms, end_ms, kind, CASE WHEN kind = 'hesitation_pause' AND end_ms - start_ms >= 800 THEN 'long' END AS label, sentence_i FROM (
        SELECT *, CASE WHEN boundary AND end_ms - start_ms >= 800 THEN 'structural_pause' WHEN NOT boundary THEN 'hesitation_pause' END AS kind FROM gaps_other WHERE other_ms <= greatest(100, 0.2 * (end_ms - start_ms))) WHERE kind IS NOT NULL""",
    "turns": merged("raw", 700),
    "inter": """SELECT meeting_id, start_ms, end_ms, kind FROM (SELECT m.meeting_id, greatest(m.start_ms, s.start_ms) AS start_ms, least(m.end_ms, s.end_ms) AS end_ms,
        CASE WHEN s.start_ms - m.start_ms >= 1000 THEN 'by_other' WHEN m.start_ms - s.start_ms >= 1000 THEN 'by_me' END AS kind
        FROM turns m JOIN turns s ON m.meeting_id = s.meeting_id AND m.track = 'mic' AND s.track = 'system' AND least(m.end_ms, s.end_ms) - greatest(m.start_ms, s.start_ms) >= 500) WHERE kind IS NOT NULL""",
    "phrases": "SELECT * FROM " + values(C.CRUTCHES) + " AS p(phrase, conditional)",
    "own": "SELECT *, coalesce(sentence_i <> lag(sentence_i) OVER o, TRUE) OR coalesce(start_ms - lag(end_ms) OVER o >= 200, TRUE) AS starts, lead(norm) OVER o AS norm2, lead(end_ms) OVER o AS end2, lead(start_ms, 2) OVER o AS start3, lead(norm, 2) OVER o AS norm3, lead(end_ms, 2) OVER o AS end3, lead(start_ms, 3) OVER o AS start4 FROM mine WINDOW o AS (PARTITION BY meeting_id ORDER BY i)",
    "grams": """SELECT meeting_id, i, j, start_ms, starts, 1 AS n, norm AS phrase, coalesce(next_start - end_ms >= 200, TRUE) AS pause FROM own
        UNION ALL SELECT meeting_id, i, j, start_ms, starts, 2, norm || ' ' || norm2, coalesce(start3 - end2 >= 200, TRUE) FROM own WHERE norm2 IS NOT NULL
        UNION ALL SELECT meeting_id, i, j, start_ms, starts, 3, norm || ' ' || norm2 || ' ' || norm3, coalesce(start4 - end3 >= 200, TRUE) FROM own WHERE norm3 IS NOT NULL""",
    "crutch": "SELECT meeting_id, i, j, n, start_ms, phrase FROM grams JOIN phrases USING (phrase) WHERE NOT conditional OR starts OR pause",
    "best": "SELECT meeting_id, j, max(n) AS n, arg_max(i, n) AS i, arg_max(start_ms, n) AS start_ms, arg_max(phrase, n) AS phrase FROM crutch GROUP BY 1, 2",
    "ordered": "SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY j) AS r FROM best",
    "greedy": """SELECT meeting_id, r, j + n AS free, TRUE AS taken, i, n, start_ms, phrase FROM ordered WHERE r = 1
        UNION ALL SELECT o.meeting_id, o.r, CASE WHEN o.j >= g.free THEN o.j + o.n ELSE g.free END, o.j >= g.free, o.i, o.n, o.start_ms, o.phrase FROM greedy g JOIN ordered o ON o.meeting_id = g.meeting_id AND o.r = g.r + 1""",
    "crutches": "SELECT meeting_id, i, n, start_ms, phrase FROM greedy WHERE taken",
    "dur": "SELECT meeting_id, max(end_ms) AS duration_ms FROM words GROUP BY 1",
    "win": "SELECT meeting_id, a, least(a + 15000, duration_ms) AS b FROM (SELECT *, unnest(CASE WHEN duration_ms >= 15000 THEN range(0, duration_ms - 15000 + 1, 5000) ELSE [0] END) AS a FROM dur WHERE duration_ms > 0)",
    "win_n": "SELECT win.meeting_id, a, b, count(w.i) AS n_words FROM win LEFT JOIN words w ON w.meeting_id = win.meeting_id AND w.track = 'mic' AND w.kind <> 'filler' AND w.start_ms >= a AND w.start_ms < a + 15000 GROUP BY 1, 2, 3",
    "other_only": minus("vad_sys", "vad_mic"),
    "line": """SELECT meeting_id, a, b, n_words, speech_ms, b - a - other_ms AS my_ms, CASE WHEN speech_ms > 0 AND b - a - other_ms > 0 THEN n_words * 60000.0::DOUBLE / (b - a - other_ms) ELSE 0 END AS wpm, CASE WHEN speech_ms > 0 THEN n_words * 60000.0::DOUBLE / speech_ms ELSE 0 END AS articulation FROM (
        SELECT w.*, coalesce((SELECT sum(least(w.b, v.end_ms) - greatest(w.a, v.start_ms)) FROM vad v WHERE v.track = 'mic' AND v.meeting_id = w.meeting_id AND v.start_ms < w.b AND w.a < v.end_ms), 0) AS speech_ms,
        coalesce((SELECT sum(least(w.b, v.end_ms) - greatest(w.a, v.start_ms)) FROM other_only v WHERE v.meeting_id = w.meeting_id AND v.start_ms < w.b AND w.a < v.end_ms), 0) AS other_ms FROM win_n w)""",
    "med": "SELECT meeting_id, quantile_cont(wpm, 0.5) FILTER (n_words >= 5) AS wpm, quantile_cont(articulation, 0.5) FILTER (n_words >= 5 AND speech_ms > 0) AS articulation_wpm FROM line GROUP BY 1",
    "events_all": """SELECT meeting_id, start_ms, end_ms, 'filler' AS kind FROM words WHERE kind = 'filler' AND track = 'mic' UNION ALL SELECT meeting_id, start_ms, start_ms, 'crutch' FROM crutches
        UNION ALL SELECT meeting_id, start_ms, end_ms, kind FROM pauses UNION ALL SELECT meeting_id, start_ms, end_ms, kind FROM inter
        UNION ALL SELECT meeting_id, start_ms, end_ms, 'question_from_other' FROM utter WHERE is_question
        UNION ALL SELECT meeting_id, greatest(s.start_ms, s.end_ms - 500), s.end_ms, 'decay' FROM decay JOIN sentences s USING (meeting_id, sentence_i) WHERE track = 'mic' AND decay_db > 6
        UNION ALL SELECT meeting_id, s.start_ms, s.end_ms, 'rising_statement' FROM rise JOIN sentences s USING (meeting_id, sentence_i) WHERE track = 'mic' AND rise_st >= 2
        UNION ALL SELECT meeting_id, a, b, 'fast_burst' FROM bursts""",
    "utter": f"""SELECT meeting_id, u::BIGINT AS utterance_i, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words,
        regexp_matches(arg_max(text, i), '\\?$') OR arg_min(norm, i) IN {tuple(C.STARTERS)!r} OR {' OR '.join(f"starts_with(arg_min(three, i), '{p}')" for p in C.LONG_STARTERS)} AS is_question FROM (
        SELECT *, concat_ws(' ', norm, lead(norm) OVER o, lead(norm, 2) OVER o) AS three FROM (SELECT *, coalesce(sum(c) OVER (PARTITION BY meeting_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM (
        SELECT *, ({TERM.format('text')} OR coalesce(lead(start_ms) OVER (PARTITION BY meeting_id ORDER BY i) - end_ms >= 1000, FALSE))::INT AS c FROM words WHERE track = 'system')) WINDOW o AS (PARTITION BY meeting_id, u ORDER BY i)) GROUP BY meeting_id, u""",
    "bursts": "SELECT line.*, type FROM line JOIN meetings USING (meeting_id) LEFT JOIN (SELECT type AS t, high AS th FROM type_refs WHERE metric = 'wpm') ON t = type WHERE n_words >= 5 AND wpm > 1.2 * coalesce(th, 130.0)",
    "framed": "SELECT f.*, s.sentence_i FROM frames f JOIN sentenced s ON s.meeting_id = f.meeting_id AND s.i = f.i",
    "decay_rows": """SELECT f.meeting_id, f.sentence_i, f.db, row_number() OVER (PARTITION BY f.meeting_id, f.sentence_i ORDER BY t_ms, i) - 1 AS r, count(*) OVER (PARTITION BY f.meeting_id, f.sentence_i) AS n
        FROM framed f JOIN sentences s ON s.track = 'mic' AND s.meeting_id = f.meeting_id AND s.sentence_i = f.sentence_i AND s.end_ms - s.start_ms > 1500""",
    "decay": "SELECT meeting_id, sentence_i, 10 * log10(avg(pow(10, db / 10)) FILTER (r >= n // 4 AND r < 3 * n // 4)) - 10 * log10(avg(pow(10, db / 10)) FILTER (r >= n - 50)) AS decay_db FROM decay_rows WHERE n >= 60 GROUP BY 1, 2",
    "rise_rows": """SELECT f.meeting_id, f.sentence_i, 12 * log2(f0 / 100) AS st, max(t_ms) OVER (PARTITION BY f.meeting_id, f.sentence_i) - t_ms AS back
        FROM framed f JOIN sentences s ON s.track = 'mic' AND NOT s.is_question AND s.meeting_id = f.meeting_id AND s.sentence_i = f.sentence_i AND s.end_ms - s.start_ms > 1000 WHERE f0 > 0""",
    "rise": "SELECT meeting_id, sentence_i, median(st) FILTER (back <= 400) - median(st) FILTER (back > 400 AND back <= 1000) AS rise_st FROM rise_rows GROUP BY 1, 2 HAVING count(*) >= 10 AND count(*) FILTER (back <= 400) >= 3 AND count(*) FILTER (back > 400 AND back <= 1000) >= 3",
    "pitched": "SELECT meeting_id, median(f0) AS pitch_median_hz, CASE WHEN count(*) >= 10 THEN quantile_cont(12 * log2(f0 / 100), 0.9) - quantile_cont(12 * log2(f0 / 100), 0.1) END AS pitch_range_st FROM frames WHERE f0 > 0 GROUP BY 1",
    "loud": "SELECT meeting_id, avg(db) AS loudness_mean_db, CASE WHEN count(*) >= 10 THEN avg(db) FILTER (r > n // 2) - avg(db) FILTER (r <= n // 2) END AS loudness_drift_db FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY t_ms, i) AS r, count(*) OVER (PARTITION BY meeting_id) AS n FROM frames) GROUP BY 1",
    "shaken": """SELECT meeting_id, 100 * avg(abs(1 / f0 - 1 / f1)) FILTER (t_ms - t1 = 10) / avg(1 / f0) AS jitter_pct, 100 * avg(abs(pow(10, db / 20) - pow(10, db1 / 20))) FILTER (t_ms - t1 = 10) / avg(pow(10, db / 20)) AS shimmer_pct
        FROM (SELECT *, lag(f0) OVER o AS f1, lag(db) OVER o AS db1, lag(t_ms) OVER o AS t1 FROM frames WHERE f0 > 0 WINDOW o AS (PARTITION BY meeting_id, i ORDER BY t_ms)) GROUP BY 1""",
    "voice": """SELECT l.meeting_id, pitch_median_hz, pitch_range_st, loudness_mean_db, loudness_drift_db, jitter_pct, shimmer_pct, phrase_final_decay_db, rising_statements_share FROM loud l LEFT JOIN pitched USING (meeting_id) LEFT JOIN shaken USING (meeting_id)
        LEFT JOIN (SELECT meeting_id, median(decay_db) AS phrase_final_decay_db FROM decay GROUP BY 1) USING (meeting_id) LEFT JOIN (SELECT meeting_id, avg((rise_st >= 2)::INT) AS rising_statements_share FROM rise GROUP BY 1) USING (meeting_id)""",
    "said": "SELECT meeting_id, norm, row_number() OVER (PARTITION BY meeting_id ORDER BY i) AS p, count(*) OVER (PARTITION BY meeting_id) AS n FROM words WHERE track = 'mic' AND kind <> 'filler' AND norm <> ''",
    "both_ways": "SELECT meeting_id, 0 AS way, p, n, norm FROM said UNION ALL SELECT meeting_id, 1, n + 1 - p, n, norm FROM said",
    "walk": """SELECT meeting_id, way, 0::BIGINT AS p, n, []::VARCHAR[] AS seen, 0 AS k, 0 AS closed FROM both_ways WHERE p = 1 AND n >= 50
        UNION ALL SELECT meeting_id, way, p, n, CASE WHEN closes THEN [] ELSE seen END, CASE WHEN closes THEN 0 ELSE k END, closed + closes::INT FROM (SELECT *, len(seen)::DOUBLE / k <= 0.72 AS closes FROM (
        SELECT w.meeting_id, w.way, b.p, w.n, CASE WHEN list_contains(w.seen, b.norm) THEN w.seen ELSE list_append(w.seen, b.norm) END AS seen, w.k + 1 AS k, w.closed FROM walk w JOIN both_ways b ON b.meeting_id = w.meeting_id AND b.way = w.way AND b.p = w.p + 1))""",
    "diverse": "SELECT meeting_id, avg(CASE WHEN f > 0 THEN n / f ELSE n::DOUBLE END) AS mtld FROM (SELECT meeting_id, way, n, closed + CASE WHEN k > 0 THEN (1 - len(seen)::DOUBLE / k) / (1 - 0.72::DOUBLE) ELSE 0 END AS f FROM walk WHERE p = n) GROUP BY 1",
    "per": "SELECT meeting_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("filler", "crutch", "structural_pause", "hesitation_pause", "by_me", "by_other")) + " FROM events_all GROUP BY 1",
    "talk": "SELECT meeting_id, coalesce(sum(end_ms - start_ms) FILTER (track = 'mic'), 0) AS mic, coalesce(sum(end_ms - start_ms) FILTER (track = 'system'), 0) AS sys FROM vad GROUP BY 1",
    "sent": "SELECT meeting_id, avg(n_words) AS mean_sentence_len, avg((n_words > 22)::INT) AS long_sentences_share FROM sentences WHERE track = 'mic' AND n_words > 0 GROUP BY 1",
    "total": "SELECT meeting_id, count(*) AS words_total FROM words WHERE track = 'mic' AND kind <> 'filler' GROUP BY 1",
    "wide": "SELECT m.meeting_id, m.type, m.speaker, coalesce(words_total, 0) AS words_total, coalesce(mic, 0) AS my_speech_ms, CASE WHEN words_total > 0 THEN coalesce(wpm, CASE WHEN words_total >= 5 AND mic > 0 THEN words_total * 60000.0::DOUBLE / mic END) END AS wpm, CASE WHEN words_total > 0 THEN coalesce(articulation_wpm, CASE WHEN words_total >= 5 AND mic > 0 THEN words_total * 60000.0::DOUBLE / mic END) END AS articulation_wpm, "
    + ", ".join(f"CASE WHEN words_total > 0 AND mic > 0 THEN coalesce({k}, 0) * 60000.0::DOUBLE / mic END AS {n}" for k, n in (("filler", "filled_pauses_per_min"), ("crutch", "crutch_words_per_min"), ("structural_pause", "structural_pauses_per_min"), ("hesitation_pause", "hesitation_pauses_per_min")))
    + """, CASE WHEN words_total > 0 AND has_system THEN mic::DOUBLE / (mic + sys) END AS talk_ratio, CASE WHEN words_total > 0 THEN mean_sentence_len END AS mean_sentence_len, CASE WHEN words_total > 0 THEN long_sentences_share END AS long_sentences_share,
        CASE WHEN words_total > 0 AND has_system THEN coalesce(by_me, 0)::DOUBLE END AS interruptions_by_me, CASE WHEN words_total > 0 AND has_system THEN coalesce(by_other, 0)::DOUBLE END AS interruptions_by_other, CASE WHEN words_total > 0 THEN mtld END AS mtld, pitch_median_hz, pitch_range_st, phrase_final_decay_db, rising_statements_share, jitter_pct, shimmer_pct, loudness_drift_db, loudness_mean_db
        FROM meetings m LEFT JOIN total USING (meeting_id) LEFT JOIN talk USING (meeting_id) LEFT JOIN per USING (meeting_id) LEFT JOIN sent USING (meeting_id) LEFT JOIN med USING (meeting_id) LEFT JOIN voice USING (meeting_id) LEFT JOIN diverse USING (meeting_id)""",
    "long": long_of("type"),
    "base_refs": "SELECT * FROM " + values(C.RANGES) + " AS r(metric, low, high, better)",
    "type_refs": "SELECT * FROM " + values(C.TYPE_RANGES) + " AS r(type, metric, low, high, better)",
    "judged0": """SELECT l.*, CASE WHEN t.better IS NOT NULL THEN t.low ELSE b.low END::DOUBLE AS ref_low, CASE WHEN t.better IS NOT NULL THEN t.high ELSE b.high END::DOUBLE AS ref_high, coalesce(t.better, b.better, 'inside') AS better
        FROM long l LEFT JOIN type_refs t ON l.type = t.type AND l.metric = t.metric LEFT JOIN base_refs b ON l.metric = b.metric""",
    "judged": """SELECT *, CASE WHEN value IS NULL OR (ref_low IS NULL AND ref_high IS NULL) THEN 'na'
        WHEN (ref_low IS NULL OR value >= ref_low) AND (ref_high IS NULL OR value <= ref_high) THEN 'good'
        WHEN ref_low IS NOT NULL AND ref_high IS NOT NULL THEN CASE WHEN greatest(ref_low - value, value - ref_high) <= 0.2 * (ref_high - ref_low) THEN 'warn' ELSE 'bad' END
        WHEN ref_high IS NOT NULL THEN CASE WHEN value - ref_high <= 0.2 * greatest(abs(ref_high), 1e-9) THEN 'warn' ELSE 'bad' END
        ELSE CASE WHEN ref_low - value <= 0.2 * greatest(abs(ref_low), 1e-9) THEN 'warn' ELSE 'bad' END END AS status FROM judged0""",
    "weights": "SELECT * FROM " + values(C.WEIGHTS) + " AS w(metric, w)",
    "pen": """SELECT j.*, w::DOUBLE AS w, CASE WHEN status = 'na' THEN NULL WHEN status = 'good' THEN 0.0::DOUBLE
        WHEN ref_low IS NOT NULL AND ref_high IS NOT NULL THEN least(1.0, greatest(ref_low - value, value - ref_high) / (ref_high - ref_low))
        WHEN ref_high IS NOT NULL THEN least(1.0, (value - ref_high) / greatest(abs(ref_high), 1.0)) ELSE least(1.0, (ref_low - value) / greatest(abs(ref_low), 1.0)) END AS p FROM judged j JOIN weights USING (metric)""",
    "comp": "SELECT meeting_id, metric, CASE WHEN p IS NULL THEN 0.0 ELSE round(w * 100 / sum(w) FILTER (p IS NOT NULL) OVER (PARTITION BY meeting_id), 2) END AS weight, coalesce(round(p, 4), 0.0) AS penalty FROM pen",
    "score": "SELECT meeting_id, CASE WHEN sum(weight) > 0 THEN greatest(0, least(100, round_even(round(100 - sum(weight * penalty), 6), 0)))::INT ELSE 0 END AS score FROM comp GROUP BY 1",
    "frames0": "SELECT meeting_id, i, start_ms, unnest(range(0, (end_ms - start_ms) // 10)) AS k FROM words WHERE track = 'mic'",
    "frames": "SELECT meeting_id, i, start_ms + 10 * k AS t_ms, CASE WHEN (meeting_id + i + k) % 7 = 0 THEN 0 ELSE 100 + (meeting_id * 13 + i * 7 + k * 3) % 60 END::DOUBLE AS f0, (50 + (meeting_id * 5 + i * 11 + k) % 20)::DOUBLE AS db FROM frames0",
    "catalog": "SELECT o_orderkey AS meeting_id, o_custkey AS speaker, least(floor(o_totalprice / 1000), 100)::BIGINT AS score, o_totalprice AS value, o_orderdate AS started_at, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'recorded' ELSE 'analyzing' END AS status FROM orders",
    "smooth": "SELECT meeting_id, i, t_ms, avg(db) OVER (PARTITION BY meeting_id, i ORDER BY t_ms ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS level FROM frames",
}


_USED = r"(?:\bFROM|\bJOIN|\),)\s+(\w+)"


def over(statement: str, **given: str) -> str:
    """The statement with the expressions that it reaches, each after those that it needs; `given` ones stand in for those of CTES.

    What is read more than once is worked out once.
    """
    known, done = CTES | given, {}

    def need(sql: str, above: tuple[str, ...]) -> None:
        for name in dict.fromkeys(re.findall(_USED, sql)):
            if name in known and name not in done and name not in above:
                need(known[name], (*above, name))
                done[name] = known[name]

    need(statement, ())
    own = set(re.findall(r"\b(\w+) AS (?:MATERIALIZED )?\(\s*SELECT", statement))
    if clash := own & done.keys():
        raise ValueError(f"the statement defines {clash} too")
    if missing := given.keys() - done.keys():
        raise ValueError(f"the statement does not reach {missing}")
    if not done:
        return statement
    uses = Counter(x for name, sql in [*done.items(), ("", statement)] for x in re.findall(_USED, sql) if x != name)
    often = {n for n, k in uses.items() if k > 1 and n in done and n not in re.findall(_USED, done[n])}
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in often else ''}({s})" for n, s in done.items()) + "\n" + statement
