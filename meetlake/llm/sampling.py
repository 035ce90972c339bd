"""Bounded samples of labelled texts, and models fitted on them in one task."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.llm.common import text_bytes


def training_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, max_bytes: int) -> tuple[DataFrame, float]:
    """doc_id, text, y: a bounded sample of labelled texts, as many of each class at most; and the share of label 1 among all kept labels.

    Rows are taken in the order of a hash of the id, so that reruns agree. Ids, not texts, pass through the broadcast;
    the sample has at most 2 * per_class texts of max_bytes each.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max(label).alias("y"))
    rank = F.xxhash64("doc_id")
    wanted = own.where("y = 0").orderBy(rank, "doc_id").limit(2 * per_class).unionByName(own.where("y = 1").orderBy(rank, "doc_id").limit(2 * per_class))
    short = docs.select("doc_id", "text").where((F.octet_length("text") <= max_bytes) & F.col("doc_id").isNotNull())
    found = short.join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "y")
    rows = found.where("y = 0").orderBy(rank, "doc_id", "text").limit(per_class).unionByName(found.where("y = 1").orderBy(rank, "doc_id", "text").limit(per_class))
    share = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    return rows, share.get(1, 0) / max(1, sum(share.values()))


def fitted(rows: DataFrame, fit: Callable[[list[bytes], np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The arrays that fit(texts, labels) makes of a bounded sample, in one task; the driver sees the arrays only."""

    def run(batches):
        texts, y = [], []
        for batch in batches:
            texts += text_bytes(batch.column("text"))
            y += batch.column("y").to_pylist()
        out = io.BytesIO()
        np.savez(out, **fit(texts, np.array(y, int)))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    one = rows.coalesce(1).sortWithinPartitions("y", F.xxhash64("doc_id"), "doc_id", "text").select("text", "y")
    model = one.mapInArrow(run, "model binary").collect()
    if not model:  # nothing is labelled
        return fit([], np.empty(0, int))
    with np.load(io.BytesIO(model[0]["model"])) as arrays:
        return dict(arrays)
