"""The given tables as meetings: words on a clock of whole milliseconds, spans, frames, a catalog."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meetlake.functions import text as T
from meetlake.functions.constants import FILLERS, MEETING_TYPES
from meetlake.operators.signal import Frames
from meetlake.sources.shared import stored_bytes


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parts(spark: SparkSession, sf: str) -> int:
    """Into how many tasks meetings are dealt, by the bytes of their turns: two megabytes become some half a million words."""
    size = stored_bytes(spark, f"{sf}/conversations.parquet")
    return max(1, min(24, size >> 18), size >> 21)


def words(spark: SparkSession, sf: str, parts: int | None = None) -> DataFrame:
    """meeting_id, track, turn, i, start_ms, end_ms, text, norm, label, kind: the tokens of conversations, one after another.

    With `parts`, turns are dealt by meeting into so many tasks, and their tokens are not shuffled.
    """
    turns = table(spark, sf, "conversations")
    turns = turns.repartition(parts, "conv_id") if parts else turns
    tok = turns.select("conv_id", "turn", "role", F.posexplode(F.split(F.trim("text"), r"[ \n\t]+")).alias("pos", "text")).where("text <> ''")
    dur = 120 + 40 * F.least(F.length("text"), F.lit(12))
    pace = F.when(F.col("conv_id") % 4 == 1, 2).otherwise(55)  # every fourth meeting is a fast one
    gap = ((F.col("conv_id") * 31 + F.col("turn") * 17 + F.col("pos") * 7) % 23) * pace
    order = Window.partitionBy("conv_id").orderBy("turn", "pos")
    tok = tok.withColumn("dur", dur.cast("long")).withColumn("end_ms", F.sum(F.col("dur") + gap).over(order)).withColumn("i", F.row_number().over(order) - 1)
    label = T.filler_label(F.col("norm"), FILLERS)
    out = tok.withColumn("norm", T.norm("text")).withColumn("label", label)
    return out.select(F.col("conv_id").alias("meeting_id"), F.when(F.col("role") == "user", "mic").otherwise("system").alias("track"), "turn", "i", (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms", "text", "norm", "label", F.when(F.col("label").isNotNull(), "filler").otherwise("word").alias("kind"))


def raw_spans(spark: SparkSession, sf: str) -> DataFrame:
    return raw_of(words(spark, sf))


def raw_of(words: DataFrame) -> DataFrame:
    """meeting_id, track, start_ms, end_ms: the words moved by turn, so that the tracks overlap."""
    shift = 4000 - ((F.col("meeting_id") * 3 + F.col("turn") * 5) % 7) * 600
    return words.select("meeting_id", "track", (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"))


def meetings(spark: SparkSession, sf: str) -> DataFrame:
    """meeting_id, speaker, type, has_system, started_at, status of each conversation."""
    c = F.col("meeting_id")
    names = F.array(*map(F.lit, MEETING_TYPES))
    started = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=(c * 7).cast("int"))
    status = F.when(c % 5 == 4, "failed").otherwise("ready")
    own = table(spark, sf, "conversations").select(F.col("conv_id").alias("meeting_id")).distinct()
    return own.select("meeting_id", (c % 10).alias("speaker"), F.element_at(names, (c % 9 + 1).cast("int")).alias("type"), (c % 5 != 0).alias("has_system"), started.alias("started_at"), status.alias("status"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return frames_of(words(spark, sf).withColumn("sentence_i", F.lit(None).cast("long"))).drop("sentence_i")


def frames_of(words: DataFrame) -> DataFrame:
    """meeting_id, i (word), sentence_i, t_ms, f0, db: ten-millisecond frames of the mic's words; f0 is 0 where unvoiced."""
    return words.where("track = 'mic'").select("meeting_id", "i", "sentence_i", F.inline(framed().array()))


def framed() -> Frames:
    """The frames of a word in their order: what is worked out by word needs no shuffle of frames."""
    c, i = F.col("meeting_id"), F.col("i")

    def at(k: Column) -> dict[str, Column]:
        f0 = F.when((c + i + k) % 7 == 0, 0).otherwise(100 + (c * 13 + i * 7 + k * 3) % 60)
        return {"t_ms": F.col("start_ms") + 10 * k, "f0": f0.cast("double"), "db": (50 + (c * 5 + i * 11 + k) % 20).cast("double")}

    return Frames(F.floor((F.col("end_ms") - F.col("start_ms")) / 10), at)


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """meeting_id, speaker, score, started_at, status: a large catalog, from orders."""
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "recorded").otherwise("analyzing")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.col("o_custkey").alias("speaker"), F.least(F.floor(F.col("o_totalprice") / 1000), F.lit(100)).alias("score"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("started_at"), status.alias("status"))
