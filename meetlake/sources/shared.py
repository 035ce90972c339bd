"""Tables written below the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Folders by application, until they are swept.
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is unset, a local session uses this machine's temporary folder; a cluster has none to share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "meetlake-shared")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Delete the folders that this application made so far; for when the results that read them are written. Their number."""
    made, conf = _MADE.pop(spark.sparkContext.applicationId, []), spark._jsc.hadoopConfiguration()
    for name in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    return len(made)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: worked out once, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a table."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(own).getLength()


def dealt(df: DataFrame, name: str, key: str, parts: int, then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """staged() in `parts` buckets of the key: tables that are dealt by the same key and number group, sort and meet without a shuffle.

    then: what is done with the dealt rows, which keeps them where they are, before they are written.
    """
    path, made = shared_dir(df.sparkSession, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    then(df.repartition(parts, key)).write.bucketBy(parts, key).option("path", path).format("parquet").saveAsTable(made)
    return df.sparkSession.table(made)


def together(spark: SparkSession, *steps: Callable[[], object]) -> None:
    """Run steps that do not need each other at the same time, so that small jobs do not wait for one another."""
    with ThreadPoolExecutor(max(1, len(steps))) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]:
            done.result()
