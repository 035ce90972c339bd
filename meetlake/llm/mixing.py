"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Each source's target is its share of all words by weight, at most `limit` times its own words, the excess reshared by
weight until no target is above. A source is taken whole as often as its target allows (complete epochs); what remains
is drawn without replacement: a document's exponential key is -ln(u) / quality weight, with u a hash of id and text,
documents are taken in the order of their keys until the budget of words is met, and the last is taken if that comes
nearer to the budget. Reruns agree.

The order by key is never sorted as a whole: keys are cut into ranges, ranges are summed in each source (with partial
sums before the shuffle), and only the one range in which a budget ends is sorted, so that a source with a third of all
rows costs no task more than a small part of them.

Defined results: a null text has size 0; a null source is a source, the last; sources without words have target 0; a
document without words is taken 0 words; repeated rows are drawn together in any order with the same sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlake.llm.common import WORD, free, staged

#: Ranges of keys in a source.
RANGES = 4096
#: Sources up to which their table (some 100 bytes a row) is broadcast, and parts of a source's rows in a join beyond.
BROADCAST_SOURCES, SALTS = 50_000, 256


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size, key, range. weights: doc_id and quality_weight > 0; others weigh 1."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(8), "doc_id", "text"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = docs.select("doc_id", "source", words("text").alias("size"), u.alias("u"))
    if weights is not None:
        own = weights.where("doc_id IS NOT NULL AND quality_weight > 0").groupBy("doc_id").agg(F.max("quality_weight").alias("quality_weight"))
        rows = rows.join(own, "doc_id", "left")
    else:
        rows = rows.withColumn("quality_weight", F.lit(1.0))
    key = -F.log(F.col("u")) / F.coalesce(F.col("quality_weight"), F.lit(1.0))
    rows = rows.select("doc_id", "source", "size", key.alias("key"))
    return rows.withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key"))) * RANGES), F.lit(RANGES - 1)).cast("int"))


def targets(rows: DataFrame, limit: float) -> DataFrame:
    """A row for each source: source_size, target. All windows here are over the table of sources."""
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    all_ = Window.partitionBy(F.lit(0))
    s = s.withColumn("w", ((F.row_number().over(all_.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double")).withColumn("cap", limit * F.col("source_size"))
    # by cap for a unit of weight, the sources at their caps come first; the others share the rest by weight
    order = all_.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("rest", F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("left_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("capped", F.col("rest") / F.col("left_w") >= F.col("cap") / F.col("w"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("rest") / F.col("left_w")))).over(all_)["col2"]
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("w"))).select("source", "source_size", "target")


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with the plan of their source: a broadcast of few sources; of many, a join by parts of a source's rows."""
    plan = staged(plan, "sources")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if plan.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), same).drop("_source")
    parts = plan.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS))).join(parts, same & (F.col("_salt") == F.col("_part"))).drop("_source", "_salt", "_part")


def mix(docs: DataFrame, weights: DataFrame | None = None, limit: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs; taken is a multiple of size."""
    rows = staged(sizes(docs, weights), "sizes")  # texts are read once
    plan = targets(rows, limit).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "_source")
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("before", before)
    # the range in which the budget of the source ends, and the words before it
    ends = ranges.join(plan, F.col("source").eqNullSafe(F.col("_source"))).where("before <= budget AND before + n > budget").groupBy("_source").agg(F.min("range").alias("end"), F.min_by("before", "range").alias("before"))
    plan = plan.join(ends.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    rows = with_plan(rows, plan)
    plain, last = rows.where("range <> end OR end IS NULL"), rows.where("range = end")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size")
    sum_before = F.col("before") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = last.withColumn("drawn", sum_before + F.col("size") / 2 < F.col("budget"))
    plain = plain.withColumn("drawn", F.coalesce(F.col("range") < F.col("end"), F.lit(False)))
    taken = F.col("size") * (F.col("epochs") + F.col("drawn").cast("long"))
    return plain.unionByName(last).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights of labelled documents: 2 for good ones, a half for bad ones."""
    return labels.where("quality IN (0, 1)").select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("quality_weight"))


def numbered(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """rows with a number from 0 on among those of equal keys.

    They are written first, so that a row's place is fixed; places are numbered in each part of the file and parts by
    their counts, so that no task holds all rows of a key.
    """
    at, part, before, *own = free(rows, "_at", "_part", "_before", "_p", *(f"_k{i}" for i in range(len(keys))))
    rows = staged(rows.withColumn(at, F.monotonically_increasing_id()), "repeated").withColumn(part, F.shiftright(at, 33))
    counts = rows.groupBy(*(F.col(k).alias(c) for k, c in zip([part, *keys], own, strict=True))).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(*own[1:]).orderBy(own[0]).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*own, F.coalesce(earlier, F.lit(0)).alias(before))
    same = F.col(part) == F.col(own[0])
    for k, c in zip(keys, own[1:], strict=True):
        same = same & F.col(k).eqNullSafe(F.col(c))
    place = F.row_number().over(Window.partitionBy(part, *keys).orderBy(at)) - 1
    rows = rows.withColumn(number, place).join(counts, same)
    return rows.withColumn(number, F.col(number) + F.col(before)).drop(*own, before, at, part)


def draw(docs: DataFrame, weights: DataFrame | None = None, limit: float = 3.0) -> DataFrame:
    """The mix itself: each row of docs, in its own columns, as often as it is taken.

    Rows that repeat id, source and size share their number of copies evenly; the first of them take what is left over.
    """
    id_, source, size, n, rows, own, copy, number = free(docs, "_id", "_source", "_size", "_n", "_rows", "_words", "_copy", "_number")
    taken = mix(docs, weights, limit).where("size > 0")
    copies = taken.groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(size)).agg(F.sum(F.col("taken") / F.col("size")).cast("long").alias(n), F.count(F.lit(1)).alias(rows))
    copies = staged(copies.where(F.col(n) > 0), "copies")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(own) == F.col(size))
    joined = docs.withColumn(own, words("text")).join(copies, same)
    if copies.where(F.col(rows) > 1).isEmpty():
        times = F.col(n)
    else:
        joined = joined.where(F.col(rows) == 1).withColumn(number, F.lit(0).cast("long")).unionByName(numbered(joined.where(F.col(rows) > 1), [id_, source, size], number))
        times = F.floor(F.col(n) / F.col(rows)) + (F.col(number) < F.col(n) % F.col(rows)).cast("long")
    return joined.withColumn(copy, times).where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy)))).select(*docs.columns)
