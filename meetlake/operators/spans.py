"""Interval algebra on half-open spans (keys, start_ms, end_ms)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["meeting_id", "track"]
BUCKET_MS = 60_000


def _islands(spans: DataFrame, least_gap: int, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(F.col("start_ms") - reach >= least_gap, 1).otherwise(0)
    marked = spans.withColumn("_cut", cut).withColumn("_island", F.sum("_cut").over(order))
    return marked.groupBy(*keys, "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_island")


def normalize(spans: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Sorted spans, overlapping or touching ones merged, empty ones dropped."""
    return _islands(spans.select(*keys, "start_ms", "end_ms").where("end_ms > start_ms"), 1, keys)


def merge_gaps(spans: DataFrame, gap_ms: int, keys: list[str] = KEYS) -> DataFrame:
    """normalize, with spans less than gap_ms apart merged too."""
    return _islands(spans.select(*keys, "start_ms", "end_ms").where("end_ms > start_ms"), max(gap_ms, 1), keys)


def overlapping(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Pairs of spans that overlap: a's columns, b_start and b_end. Spans meet by key and minute, never by key alone.

    Neither side is broadcast: what it is exploded from is no measure of its size.
    """

    def dealt(df: DataFrame, start: str, end: str) -> DataFrame:
        return df.withColumn("_minute", F.explode(F.sequence(F.floor(F.col(start) / BUCKET_MS), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / BUCKET_MS))))

    b = b.select(*on, F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    both = dealt(a, "start_ms", "end_ms").join(dealt(b, "b_start", "b_end").hint("merge"), [*on, "_minute"])
    first = F.floor(F.greatest("start_ms", "b_start") / BUCKET_MS)
    both = both.where((F.col("start_ms") < F.col("b_end")) & (F.col("b_start") < F.col("end_ms")) & (F.col("_minute") == first)).drop("_minute")
    return both.select(*a.columns, "b_start", "b_end")


def overlap_sums(a: DataFrame, b: DataFrame, on: list[str], by: list[str], name: str) -> DataFrame:
    """a with the sum of its overlaps with b; `by` are a's own keys.

    One sweep by `on` over the borders of both: up to a time t, spans of b reach t less their start, and those that have
    ended their end less their start, so that counts and sums of borders tell how much of b lies before each of a's borders.
    """
    rest = [c for c in a.columns if c not in on]
    border = lambda t, sign: F.struct(F.col(t).cast("long").alias("_t"), F.lit(sign).alias("_sign"))
    ends = F.inline(F.array(border("start_ms", 1), border("end_ms", -1)))
    mine = a.select(*on, "start_ms", "end_ms", F.struct(*rest).alias("_a"))
    other = b.where("end_ms > start_ms").select(*on, "start_ms", "end_ms", F.lit(None).cast(mine.schema["_a"].dataType).alias("_a"))
    both = mine.unionByName(other).select(*on, "_a", ends)
    upto = Window.partitionBy(*on).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    of_b = lambda v: F.sum(F.when(F.col("_a").isNull(), v).otherwise(F.lit(0).cast("long"))).over(upto)
    before = F.col("_t") * of_b(F.col("_sign")) - of_b(F.col("_sign") * F.col("_t"))
    sums = both.withColumn("_before", before).where("_a IS NOT NULL").select(*on, "_a.*", (-F.col("_sign") * F.col("_before")).alias("_over"))
    over = F.when(F.col("end_ms") > F.col("start_ms"), F.col("_over"))
    return sums.groupBy(*on, *rest).agg(F.coalesce(F.sum(over), F.lit(0)).alias(name)).select(*a.columns, name)


def intersect(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    both = overlapping(normalize(a, on), normalize(b, on), on)
    return both.select(*on, F.greatest("start_ms", "b_start").alias("start_ms"), F.least("end_ms", "b_end").alias("end_ms"))


def subtract(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """What of a is not in b."""
    sides = (spans.select(*on, "start_ms", "end_ms", F.lit(mine).alias("mine")) for spans, mine in ((a, True), (b, False)))
    return remaining(next(sides).unionByName(next(sides)), F.col("mine"), on)


def remaining(spans: DataFrame, mine: Column, on: list[str]) -> DataFrame:
    """What of the spans that are `mine` is not in the others: one sweep over the borders of both, so that their source is read and sorted once."""
    sides = normalize(spans.withColumn("_mine", mine), [*on, "_mine"])
    da, db = F.col("_mine").cast("int"), (~F.col("_mine")).cast("int")
    border = lambda t, sign: F.struct(F.col(t).alias("t"), (sign * da).alias("da"), (sign * db).alias("db"))
    borders = sides.select(*on, F.inline(F.array(border("start_ms", 1), border("end_ms", -1))))
    steps = borders.groupBy(*on, "t").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    order = Window.partitionBy(*on).orderBy("t")
    steps = steps.select(*on, F.col("t").alias("start_ms"), F.lead("t").over(order).alias("end_ms"), F.sum("da").over(order).alias("a"), F.sum("db").over(order).alias("b"))
    return steps.where("a > 0 AND b = 0 AND end_ms IS NOT NULL").select(*on, "start_ms", "end_ms")


def clip(spans: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    out = spans.withColumn("start_ms", F.greatest("start_ms", F.lit(start_ms))).withColumn("end_ms", F.least("end_ms", F.lit(end_ms)))
    return out.where("end_ms > start_ms")


def total(spans: DataFrame, by: list[str]) -> DataFrame:
    return spans.groupBy(*by).agg(F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("total_ms"))


def covered(points: DataFrame, spans: DataFrame, at: str, on: list[str]) -> DataFrame:
    """Points (each once) that lie in a span, start included and end not."""
    spans = spans.select(*on, F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    spans = spans.withColumn("_minute", F.explode(F.sequence(F.floor(F.col("_s") / BUCKET_MS), F.floor(F.greatest(F.col("_e") - 1, F.col("_s")) / BUCKET_MS))))
    points = points.withColumn("_minute", F.floor(F.col(at) / BUCKET_MS))
    same = [points[c] == spans[c] for c in [*on, "_minute"]]
    hit = (points[at] >= spans["_s"]) & (points[at] < spans["_e"])
    for c in same:
        hit = hit & c
    return points.join(spans.hint("merge"), hit, "left_semi").drop("_minute")


def vad(words: DataFrame, gap_ms: int = 150, pad_ms: int = 30) -> DataFrame:
    """Speech spans of words: gaps below gap_ms are closed, ends padded."""
    merged = merge_gaps(words, gap_ms)
    return merged.select(*KEYS, F.greatest(F.col("start_ms") - pad_ms, F.lit(0)).alias("start_ms"), (F.col("end_ms") + pad_ms).alias("end_ms"))


def folded(rows: DataFrame, keys: list[str], order: list[str], schema: str, step: Callable[[Any, Any], tuple[Any, list[tuple]]], end: Callable[[Any], list[tuple]]) -> DataFrame:
    """What a running state emits over the rows of each group in their order: one pass, in the memory of the state.

    step(state, row) gives the next state (null before a group's first row) and the rows it lets go; end(state) those that
    are left when the group ends. schema: of what is emitted, without the keys.
    """
    kinds = dict(rows.dtypes)
    names = [*keys, *(c.split()[0] for c in schema.split(", "))]

    def run(frames):
        key, state = None, None
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                own = tuple(getattr(row, k) for k in keys)
                if own != key:
                    if key is not None:
                        out += [(*key, *r) for r in end(state)]
                    key, state = own, None
                state, done = step(state, row)
                out += [(*key, *r) for r in done]
            yield pd.DataFrame(out, columns=names)
        if key is not None:
            yield pd.DataFrame([(*key, *r) for r in end(state)], columns=names)

    sorted_ = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))


def speech_chunks(spans: DataFrame, gap_ms: int = 1000, longest_ms: int = 28_000, pad_ms: int = 250) -> DataFrame:
    """Spans joined greedily across gaps below gap_ms up to longest_ms; longer ones split into equal parts; padded.

    The greedy join is a running state over a meeting's spans: the one that may still grow.
    """
    def step(open_, row):
        if open_ and row.start_ms - open_[1] < gap_ms and row.end_ms - open_[0] <= longest_ms:
            return (open_[0], row.end_ms), []
        return (row.start_ms, row.end_ms), [open_] if open_ else []

    own = normalize(spans)
    joined = folded(own, KEYS, ["start_ms", "end_ms"], "start_ms long, end_ms long", step, lambda open_: [open_])
    parts = joined.join(own.groupBy(*KEYS).agg(F.max("end_ms").alias("last")), KEYS)
    n = F.greatest(F.ceil((F.col("end_ms") - F.col("start_ms")) / longest_ms), F.lit(1))
    parts = parts.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    size = (F.col("end_ms") - F.col("start_ms")) / F.col("n")
    begin, stop = F.floor(F.col("start_ms") + F.col("k") * size), F.floor(F.col("start_ms") + (F.col("k") + 1) * size)
    return parts.select(*KEYS, F.greatest(begin - pad_ms, F.lit(0)).alias("start_ms"), F.least(stop + pad_ms, F.col("last")).alias("end_ms"))
