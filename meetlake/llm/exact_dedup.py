"""Exact deduplication as a stateful stream.

Contents arrive in the shared folder as files of rows; a row's locator is its file and its place there. A stream of
(identifier, SHA-256 of the text, locator) runs over them in micro-batches through state that is keyed by digest, kept on
disk by RocksDB and never expires: for each digest the identifier that stays, the number of texts, and the locator of the
content that stays. `Store` keeps contents, state and changes below one folder, so that what arrives later meets what came
before. Each micro-batch writes the changed keys under its own number; a replayed batch overwrites itself.

A digest that came more than once is a hit: the content that stays is read at its locator, and the full bytes of every
hit are compared with it. Should two different texts ever share a digest, that digest's texts are grouped by their bytes
instead. Where hits meet what stays both sides are plain shuffles, so that Spark splits a digest with very many copies.

Defined results: null text is empty text; of equal texts the largest id stays and a null id stays only if the whole
group has none; rows that repeat id and text count each in group_size and are all marked as the id that stays (a filter
keeps one of them); an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.common import free, shared_dir, staged

#: State on disk with a bound on the memory of all stores of an executor; no preallocated files, as a cluster has very many small stores, and changes rather than snapshots at each commit.
_STATE = "spark.sql.streaming.stateStore"
STATE = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.allowFAllocate": "false",
    f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}.rocksdb.maxMemoryUsageMB": "96",
    f"{_STATE}.rocksdb.writeBufferSizeMB": "2",
}
#: Micro-batches into which what arrives at once is dealt, at most.
BATCHES = 3
#: Hits of a digest that meet the content that stays in one group.
HITS = 1_000
#: Rows of a table of ids and digests up to which it is broadcast (some 100 bytes each).
BROADCAST_ROWS = 200_000
LOCATOR = "struct<file:string,row:long>"
CHANGES = f"digest binary, keep_id long, group_size long, locator {LOCATOR}, batch int"


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def located(contents: DataFrame) -> Column:
    return F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


class Store:
    """Contents, state and changes below a folder of the shared store; what arrives there later meets what came before.

    Contents keep the columns of the documents under names of the store's own, so that no name clashes with its.
    """

    def __init__(self, spark: SparkSession, root: str, columns: list[tuple[str, str]]):
        """columns: (name, type) of the documents, doc_id and text among them."""
        self.spark, self.root = spark, root
        self.names = [n for n, _ in columns]
        self.doc_id, self.text = (f"c{self.names.index(n)}" for n in ("doc_id", "text"))
        self.schema = ", ".join([*(f"c{i} {kind}" for i, (_, kind) in enumerate(columns)), "digest binary"])
        none = spark.createDataFrame([], CHANGES.removesuffix(", batch int"))
        none.coalesce(1).write.mode("overwrite").parquet(f"{root}/changes/batch=-1")  # so that there is a table before the first batch

    def arrive(self, docs: DataFrame, batches: int = BATCHES) -> int:
        """Take in documents: write them, then run the stream over what it has not seen yet. The number of new files."""
        contents = docs.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(self.names)), sha(F.col("text")).alias("digest"))
        folder = f"{self.root}/contents/arrival={uuid.uuid4().hex}"
        contents.write.option("compression", "zstd").parquet(folder)
        files = self.spark.read.schema(self.schema).parquet(folder).inputFiles()
        if files:
            self.run(-(-len(files) // batches))
        return len(files)

    def contents(self) -> DataFrame:
        """The documents' columns as c0, c1, ..., digest and locator of all that arrived."""
        rows = self.spark.read.schema(self.schema).parquet(f"{self.root}/contents/arrival=*")
        return rows.withColumn("locator", located(rows))

    def run(self, files: int) -> None:
        """The stream over contents that it has not seen, so many files a micro-batch."""
        spark = self.spark
        before = {name: spark.conf.get(name, None) for name in STATE}
        for name, value in STATE.items():
            spark.conf.set(name, value)
        try:
            rows = spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files).parquet(f"{self.root}/contents/arrival=*")
            rows = rows.select(F.col(self.doc_id).alias("doc_id"), "digest", located(rows).alias("locator"))
            last = F.max_by("locator", F.coalesce("doc_id", F.lit(-(1 << 63))))
            state = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), last.alias("locator"))
            write = lambda df, n: df.write.mode("overwrite").parquet(f"{self.root}/changes/batch={n}")
            state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{self.root}/state").foreachBatch(write).start().awaitTermination()
        finally:
            for name, value in before.items():
                if value is None:
                    spark.conf.unset(name)
                else:
                    spark.conf.set(name, value)

    def groups(self) -> DataFrame:
        """digest, keep_id, group_size, locator as of now: the last change of each digest."""
        changes = self.spark.read.schema(CHANGES).parquet(f"{self.root}/changes")
        last = F.max_by(F.struct("keep_id", "group_size", "locator"), "batch").alias("s")
        return staged(changes.groupBy("digest").agg(last).select("digest", "s.*"), "groups")

    def unequal(self, groups: DataFrame) -> DataFrame:
        """Digests under which a hit differs in its bytes from the content at the locator that stays.

        A digest's hits are dealt out by their locators, a part for every HITS of them, and what stays is sent to each.
        """
        parts = F.ceil(F.col("group_size") / HITS).cast("int")
        hits = groups.where("group_size > 1").select(F.col("digest").alias("_d"), F.col("locator").alias("_l"), parts.alias("_n"))
        met = self.contents().select("digest", "locator", F.coalesce(self.text, F.lit("")).alias("text")).join(hits, F.col("digest") == F.col("_d"))
        part = F.pmod(F.xxhash64("locator"), F.col("_n")).cast("int")
        met = staged(met.select("digest", "text", part.alias("part"), F.when(F.col("locator") == F.col("_l"), F.col("_n")).alias("stays")), "hits")
        stays = met.where("stays IS NOT NULL").select(F.col("digest").alias("_d"), F.col("text").alias("kept"), F.explode(F.sequence(F.lit(0), F.col("stays") - 1)).alias("_p"))
        same = (F.col("digest") == F.col("_d")) & (F.col("part") == F.col("_p"))
        return staged(met.where("stays IS NULL").join(stays, same).where("text <> kept").select("digest").distinct(), "collided")

    def marks(self) -> DataFrame:
        """doc_id, digest, locator, keep_id, group_size, keep_at of every row that arrived; keep_at is the locator that stays."""
        groups = self.groups()
        slim = self.contents().select(F.col(self.doc_id).alias("doc_id"), "digest", "locator")
        marks = slim.join(groups.withColumnRenamed("locator", "keep_at"), "digest")
        collided = self.unequal(groups)
        if not collided.isEmpty():
            texts = self.contents().select(F.col(self.doc_id).alias("doc_id"), "digest", "locator", F.coalesce(self.text, F.lit("")).alias("text")).join(collided, "digest", "left_semi")
            last = F.max_by("locator", F.coalesce("doc_id", F.lit(-(1 << 63))))
            own = texts.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), last.alias("keep_at"))
            own = texts.join(own, ["digest", "text"]).select("digest", "doc_id", "locator", "keep_id", "group_size", "keep_at")
            marks = marks.join(collided, "digest", "left_anti").unionByName(own)
        return marks

    def drop(self) -> None:
        """Delete everything below the folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def marked(docs: DataFrame) -> DataFrame:
    """marks() of docs alone, by a store that is gone afterwards."""
    docs = docs.select("doc_id", "text")
    store = Store(docs.sparkSession, shared_dir(docs.sparkSession, "dedup"), docs.dtypes)
    store.arrive(docs)
    marks = staged(store.marks(), "marks")
    store.drop()
    return marks


def mark(docs: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept for every row of docs."""
    return marked(docs).select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, in their own columns: one of each group of equal texts, of those with the id that stays."""
    marks = marked(docs)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = staged(marks.where(~stays).select(F.col("doc_id").alias("_i"), F.col("digest").alias("_d")).distinct(), "gone")
    digest, own, other = free(docs, "digest", "_id", "_digest")
    gone, few = gone.toDF(own, other), gone.count() <= BROADCAST_ROWS
    rows = docs.withColumn(digest, sha(F.col("text")))
    rows = rows.join(F.broadcast(gone) if few else gone, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(digest) == F.col(other)), "left_anti")
    if not marks.where(stays & (F.col("locator") != F.col("keep_at"))).isEmpty():  # rows that repeat id and text
        rows = rows.dropDuplicates(["doc_id", digest])
    return rows.select(*docs.columns)
