"""The live path: counts of sliding windows and sessions from a stream, and streams that are run until their input is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.sources.shared import shared_dir

#: State on disk: what custom state needs, and what keeps the state of many keys out of memory.
ON_DISK = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def on_disk(spark: SparkSession) -> SparkSession:
    """A session of its own for a stream with custom state, so that its settings are no one else's."""
    own = spark.newSession()
    for name, value in ON_DISK.items():
        own.conf.set(name, value)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def rates(stream: DataFrame, key: str, at: str = "ts", size: str = "10 minutes", step: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """key, start, n, level of each sliding window of the stream; rows later than the watermark are left out, closed windows leave the state."""
    windows = F.window(F.col(at), size, step)
    out = stream.withWatermark(at, late).groupBy(key, windows.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("level"))
    return out.select(key, F.col("w.start").alias("start"), "n", "level")


def sessions(rows: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """key, start, end, n, level of runs of rows with no gap between them: of a table, or closed ones of a stream (append mode).

    A row that comes late, but before the watermark (`late`), and closes a gap merges the two sessions beside it.
    """
    rows = rows.withWatermark(at, late) if late else rows
    out = rows.groupBy(key, F.session_window(F.col(at), gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("level"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "level")


def with_open(closed: DataFrame, rows: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """closed sessions of a stream and those that are open yet: of the rows after a key's last closed session, for sessions close in order of time."""
    last = closed.groupBy(key).agg(F.max("end").alias("_until"))
    rest = rows.join(last, key, "left").where(F.col("_until").isNull() | (F.col(at) >= F.col("_until"))).drop("_until")
    return closed.unionByName(sessions(rest, key, at, gap))


def drained(stream: DataFrame, name: str, mode: str = "update", at: tuple[str, str] | None = None) -> DataFrame:
    """All rows that the stream has emitted once its present input is read, with the number of their batch.

    Updates are appended as Parquet; a batch that runs again after a failure replaces its own folder. at: the folders of an
    earlier run of the same stream, to go on from where it ended.
    """
    spark = stream.sparkSession
    path, log = at or (shared_dir(spark, name), shared_dir(spark, f"{name}-log"))

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/run={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", log).foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    kinds = ", ".join(f"`{c}` {k}" for c, k in [*stream.dtypes, ("batch", "bigint")])
    return spark.read.schema(kinds).parquet(path)


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch", "run")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
