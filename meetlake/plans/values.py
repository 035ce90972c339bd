"""Registered queries on values as text: numbers, durations, days and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from meetlake.functions import text as T
from meetlake.plans.registry import query
from meetlake.plans.texts import CODE
from meetlake.sources import adapters as D

TODAY = "1998-08-02"
_PLAIN = "abs(k) // 10 || CASE WHEN k % 10 <> 0 THEN ',' || abs(k) % 10 ELSE '' END"


@query(f"""SELECT event_id, CASE WHEN k IS NULL THEN '—' ELSE CASE WHEN k < 0 THEN '−' ELSE '' END || {_PLAIN} END AS plain,
    CASE WHEN k IS NULL THEN '—' WHEN k = 0 THEN '0' ELSE CASE WHEN k < 0 THEN '−' ELSE '+' END || {_PLAIN} END AS with_sign,
    CASE WHEN k IS NULL THEN '—' ELSE CASE WHEN k < 0 THEN '−' ELSE '' END || abs(k) || ' %' END AS share
    FROM (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN event_id % 401 - 200 END AS k FROM events)""")
def number_text(spark, sf):
    """Numbers of one place, with their sign, and shares as percent; a dash where there is none."""
    k = F.when(F.col("event_id") % 50 != 0, F.col("event_id") % 401 - 200)
    return D.table(spark, sf, "events").select("event_id", T.number(k / 10).alias("plain"), T.signed(k / 10).alias("with_sign"), T.percent(k / 100).alias("share"))


@query(f"""SELECT event_id, CASE WHEN s < 120 THEN s || ' s' WHEN (s + 30) // 60 < 60 THEN (s + 30) // 60 || ' min' ELSE (s + 30) // 60 // 60 || ' h ' || lpad(((s + 30) // 60 % 60)::VARCHAR, 2, '0') || ' min' END AS words, {CODE} AS code
    FROM (SELECT event_id, event_id % 9001 AS s, (2 * (event_id % 9001) + event_id % 2 + 1) // 2 AS t FROM events)""")
def duration_text(spark, sf):
    """Durations in words, and half seconds as a code of the nearest second."""
    s = F.col("event_id") % 9001
    return D.table(spark, sf, "events").select("event_id", T.duration_words(s).alias("words"), T.rounded_timecode(s + F.col("event_id") % 2 / 2).alias("code"))


@query(f"""SELECT o_orderkey, CASE WHEN ago = 0 THEN 'today' WHEN ago = 1 THEN 'yesterday' WHEN ago BETWEEN 2 AND 6 THEN strftime(day, '%A')
    ELSE day(day) || ' ' || strftime(day, '%B') || CASE WHEN year(day) <> 1998 THEN ' ' || year(day) ELSE '' END END AS label
    FROM (SELECT o_orderkey, o_orderdate::DATE AS day, DATE '{TODAY}' - o_orderdate::DATE AS ago FROM orders)""")
def day_label(spark, sf):
    return D.table(spark, sf, "orders").select("o_orderkey", T.day_label(F.col("o_orderdate").cast("date"), TODAY).alias("label"))


@query("SELECT n_nationkey, 'Dear ' || n_name || ', you are no. ' || n_nationkey || ' (' || n_name || ') of region ' || n_regionkey || '.' AS line FROM nation")
def template_render(spark, sf):
    values = {"name": F.col("n_name"), "n": F.col("n_nationkey"), "region": F.col("n_regionkey")}
    return D.table(spark, sf, "nation").select("n_nationkey", T.render("Dear {name}, you are no. {n} ({name}) of region {region}.", values).alias("line"))
