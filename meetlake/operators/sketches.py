"""Approximate aggregates as sketches that merge: of each month and group once, then upwards without the rows.

Ranks by KLL (double), distinct counts by HyperLogLog; both are Spark's own, so that a sketch is a binary column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: KLL's k (ranks are within 1.33 % at 200 with 99 % confidence; 400 halves that) and the logarithm of HyperLogLog's registers.
K, LOG = 400, 14


def sketched(rows: DataFrame, by: list[str], value: str, member: str) -> DataFrame:
    """by, n, ranks, members: a row of sketches for each group; nulls take no part, a group of nulls alone has a null sketch."""
    ranks = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K))
    return rows.groupBy(*by).agg(F.count(value).alias("n"), ranks.alias("ranks"), F.hll_sketch_agg(member, F.lit(LOG)).alias("members"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of larger groups from those of smaller ones."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("ranks").alias("ranks"), F.hll_union_agg("members").alias("members"))


def read(sketches: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """by, n, members and q10, q50, ... of each sketch."""
    places = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(q))).alias(f"q{round(100 * q)}") for q in quantiles]
    return sketches.select(*by, "n", F.hll_sketch_estimate("members").alias("members"), *places)
